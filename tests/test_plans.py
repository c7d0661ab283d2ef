"""Constrained, sparse, co-clustered, sampled and bound-based plans against brute force and dense forms."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from halocline.functions import divergences
from halocline.operators import graph, metrics
from halocline.operators.assign import assign, nearest, nearest_pruned
from halocline.operators.graph import components
from halocline.plans import constrained, elkan, estimators, presets, sampled, sparse, summary, tabular
from halocline.plans.lloyd import lloyd


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.03, (40, 3)) for c in (0.2, 0.5, 0.8)]).clip(0.01, 0.99)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100, 100)]
    label = {v: v for e in edges for v in e}
    for _ in range(60):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(map(tuple, components(spark.createDataFrame(edges, "i long, j long")).collect())) == label
    assert components(spark.createDataFrame([], "i long, j long")).isEmpty()


@pytest.mark.parametrize("parts", [1, 4, 1024])
def test_components_with_hubs(spark, monkeypatch, parts):
    monkeypatch.setattr(graph, "HEAVY_PARTS", parts)
    edges = [(5, v) for v in range(10, 60)] + [(v, 900) for v in range(100, 160)] + [(159, 170), (170, 3), (60, 61)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "i long, j long")).collect()))
    assert {v for v, c in got.items() if c == 5} == {5, *range(10, 60)}
    assert {v for v, c in got.items() if c == 3} == {3, 170, 900, *range(100, 160)}
    assert got[61] == 60


LINKS = [(0, 1, "must"), (1, 45, "must"), (2, 3, "cannot"), (2, 4, "cannot"), (3, 4, "cannot"), (4, 3, "cannot"), (7, 999, "cannot")]


@pytest.mark.parametrize("mode", ["soft", "hard"])
def test_constraints_hold(spark, blobs, mode):
    x, df = blobs
    c = spark.createDataFrame(LINKS, "i long, j long, kind string")
    e = constrained.ConstrainedKMeans(k=3, mode=mode, constraint_weight=10.0, initial_centres=x[[0, 50, 100]], max_iter=2)
    out = e.labels(e.fit(df, c), df, c)
    assert out.count() == 120
    bad = constrained.violations(out.select("id", F.col("prediction").alias("cluster")), constrained.canonical(c)).collect()
    assert {r["kind"]: (r["pairs"], r["violated"]) for r in bad} == {"must": (2, 0), "cannot": (3, 0)}


def test_unsatisfiable(spark, blobs):
    c = spark.createDataFrame([(0, 1, "must"), (1, 2, "must"), (0, 2, "cannot")], "i long, j long, kind string")
    assert not constrained.is_satisfiable(c)
    with pytest.raises(ValueError, match="cannot-link"):
        constrained.ConstrainedKMeans(k=2, mode="hard").fit(blobs[1], c)


def test_penalty_forms(spark):
    c = spark.createDataFrame([(1, 2, 2.0, "must"), (1, 3, 3.0, "cannot")], "i long, j long, w double, kind string")
    at = spark.createDataFrame([(2, 0), (3, 1)], "id long, cluster int")
    pairs = constrained.partners(constrained.canonical(c))
    assert constrained.penalties(at, pairs, 3, 0.5).where("id = 1").first()["penalty"] == [0.0, 2.5, 1.0]
    grown = constrained.penalties(at, pairs, 3, 0.5, alpha=1.0).where("id = 1").first()["penalty"]
    assert grown == pytest.approx([0.0, np.exp(2.5) - 1, np.exp(1.0) - 1])


def test_constrained_loops_broadcast_nothing(spark, blobs, monkeypatch):
    plans = []
    cut = constrained.cut
    monkeypatch.setattr(constrained, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    x, df = blobs
    c = spark.createDataFrame(LINKS, "i long, j long, kind string")
    e = constrained.ConstrainedKMeans(k=3, initial_centres=x[[0, 50, 100]], max_iter=1)
    plans.append(e.labels(e.fit(df, c), df, c)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and not any("BroadcastHashJoin" in p for p in plans)


@pytest.mark.parametrize("name", ["se", "kl", "l1", "spherical"])
def test_sparse_matches_dense(spark, blobs, name):
    x = blobs[0] * (blobs[0] > 0.5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    centres, div = blobs[0][[0, 50, 100]], sparse.make(name)
    got = sparse.assign_sparse(df, "features", centres, div, distance="d").orderBy("id").collect()
    if name == "spherical":
        norm = np.sqrt((x * x).sum(1))
        want = np.where(norm[:, None] > 0, 1 - x @ (centres / np.linalg.norm(centres, axis=1, keepdims=True)).T / np.maximum(norm, 1e-300)[:, None], 1.0)
    else:
        want = div.term(x[:, None, :], centres[None]).sum(2)
    assert np.allclose([r["d"] for r in got], want.min(1))
    if name in ("se", "l1"):
        m = sparse.SparseKMeans(k=3, divergence=name, mode="force", initial_centres=centres, max_iter=4).fit(df)
        dense = lloyd(df, "features", centres, divergences.make(name), 4)
        assert np.allclose(m.summary.centres, dense.centres) and np.allclose(m.summary.distortion, dense.distortion)


def test_stored_values_come_from_buffers():
    rows = pa.array([[(i, 0.5 * i + r) for i in range(20)] for r in range(2000)], pa.list_(pa.struct([("i", pa.int32()), ("v", pa.float64())])))
    tracemalloc.start()
    at, i, v = sparse._flat(rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 * len(v) and at[:21].tolist() == [0] * 20 + [1] and i[20:23].tolist() == [0, 1, 2] and v[20:23].tolist() == [1.0, 1.5, 2.0]


def test_bounds_change_nothing(blobs):
    x, df = blobs
    start, div = x[[0, 10, 50, 100, 119]], divergences.make("se")
    r = elkan.bounded_lloyd(df, "features", start, 6)
    assert np.allclose(r.centres, lloyd(df, "features", start, div, 6).centres)
    for a, b in zip(nearest(x, start, div), nearest_pruned(x, start, div), strict=True):
        assert np.allclose(a, b)
    with pytest.raises(ValueError, match="accelerated"):
        assign(df, "features", start, divergences.make("l1"), "accelerated")


def test_coclusters(spark):
    cells = [(i, j, 10.0 if i % 2 == j % 2 else 1.0) for i in range(8) for j in range(8)]
    df = spark.createDataFrame(cells, "row long, col long, value double")
    m = tabular.CoClustering(seed=1, max_iter=10).fit(df)
    assert m.objective[-1] == 0.0 and m.objective == sorted(m.objective, reverse=True)
    assert m.transform(df).where("abs(block_mean - value) > 1e-9").isEmpty()


def test_bottleneck_keeps_what_matters(blobs):
    df = blobs[1].withColumn("y", (F.col("id") / 40).cast("int"))
    m = tabular.InformationBottleneck(k=3, relevance="y", beta=5.0).fit(df)
    assert m.objective[-1] <= m.objective[0] and np.allclose(m.encoder.sum(1), 1)
    assert m.transform(df).where("prediction is null").isEmpty()
    joint = np.array([[0.25, 0.0], [0.25, 0.0], [0.0, 0.5]])
    t, _, _ = tabular.bottleneck(joint, 2, beta=20.0)
    assert t[:2].argmax(1).tolist() == [t[0].argmax()] * 2 and t[2].argmax() != t[0].argmax()
    with pytest.raises(ValueError, match="relevance"):
        tabular.InformationBottleneck(relevance="id", bins=2, max_relevance=5).fit(df)


def test_samples_and_landmarks(blobs):
    _, df = blobs
    for out in (sampled.Clara(k=3, sample_size=30).fit(df).transform(df), sampled.NystromSpectral(k=3, gamma=50.0, landmarks=30).fit_transform(df)):
        assert out.select("prediction", (F.col("id") / 40).cast("int")).distinct().count() == 3


def test_capacities(blobs):
    d = np.array([[0.0, 5.0], [0.1, 5.0], [0.2, 1.0], [0.3, 9.0]])
    assert sampled.fill_capacities(d, 1, 3).tolist() == [0, 0, 0, 1]
    assert sampled.fill_capacities(d, 2, 3).tolist() == [0, 0, 1, 1]
    with pytest.raises(ValueError, match="fit"):
        sampled.fill_capacities(d, 1, 1)
    sizes = sampled.HardBalancedKMeans(k=4).fit_transform(blobs[1], "features", "id").groupBy("prediction").count().collect()
    assert sum(r["count"] for r in sizes) == 120 and max(r["count"] for r in sizes) <= 33


def test_summary_row(spark, blobs):
    m = estimators.KMeans(k=3).fit(blobs[1])
    r = summary.summary_frame(spark, m, "KMeans", 3, 120, 1000).first()
    assert len(r) == 16 and r["effectiveK"] == 3 and r["dim"] == 3 and r["finalDistortion"] == m.summary.distortion[-1]


def test_silhouettes_and_entropy(spark, blobs):
    x, df = blobs
    out = assign(df, "features", x[[0, 50, 100]], divergences.make("se"))
    assert metrics.approximate_silhouette(out, "features", "cluster").first()[0] > 0.7
    assert metrics.approximate_silhouette(out.withColumn("cluster", F.lit(0)), "features", "cluster").first()[0] == 0.0
    p = spark.createDataFrame([([1.0, 0.0],), ([0.5, 0.5],)], "p array<double>")
    assert metrics.effective_clusters(p, "p").first()[0] == pytest.approx(1.5)


def test_presets_and_json(blobs):
    assert presets.preset("fast", 3, seed=4) == estimators.KMeans(k=3, max_iter=10, tol=1e-3, seed=4)
    with pytest.raises(ValueError, match="preset"):
        presets.preset("no such")
    e = estimators.RobustKMeans(k=3, mode="trim")
    assert presets.from_json(presets.to_json(e)) == e
    with pytest.raises(ValueError, match="estimator"):
        presets.from_json('{"class": "View", "settings": {}}')
    rows = [r["inertia"] for r in presets.elbow_curve(blobs[1], "features", 1, 3).collect()]
    assert rows == sorted(rows, reverse=True)
