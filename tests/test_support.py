"""Errors, events, checks, vector expressions, persistence of every kind of model, and merges against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline import errors, telemetry
from halocline.functions import divergences, transforms, vectors
from halocline.operators import validate
from halocline.plans import bounded, estimators, presets, sparse, tabular
from halocline.plans.estimators import KMeans
from halocline.sources import persistence
from halocline.streaming.kmeans import StreamingKMeans


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.03, (20, 3)) for c in (0.2, 0.5, 0.8)]).clip(0.01, 0.99)
    return x, spark.createDataFrame([(i, v.tolist(), i % 4, i % 3) for i, v in enumerate(x)], "id long, features array<double>, row int, col int")


def test_errors(spark, blobs):
    _, df = blobs
    with pytest.raises(errors.UnknownName, match="squaredEuclidean"):
        divergences.make("nothing")
    with pytest.raises(ValueError, match="transform"):
        transforms.make("nothing")
    with pytest.raises(errors.OutOfRange, match="k is 0"):
        KMeans(k=0)
    with pytest.raises(errors.OutOfRange):
        KMeans(tol=float("nan"))
    lost = errors.attempt(KMeans(features="nowhere").fit, df)
    assert not lost.ok and isinstance(lost.error, errors.MissingColumn) and lost.error.kind == "columns" and lost.get(7) == 7
    assert errors.attempt(lambda: 2).then(lambda v: v + 1).unwrap() == 3 and lost.then(len) is lost
    with pytest.raises(errors.MissingColumn):
        lost.unwrap()
    with pytest.raises(ZeroDivisionError):
        errors.attempt(lambda: 1 / 0)


def test_events(blobs, caplog):
    x, df = blobs
    far = np.vstack([x[[0, 25]], [[9.0, 9.0, 9.0]]])
    with telemetry.listen(telemetry.Memory()) as heard, telemetry.listen(telemetry.Log()), caplog.at_level("INFO", "halocline"):
        m = KMeans(k=3, initial_centres=far, empty="keep").fit(df)
    KMeans(k=2, max_iter=1).fit(df)
    s = heard.summary()
    assert s["iterations"] == m.summary.iterations == len(heard.of("iteration")) and s["converged"] and s["empty_clusters"] == m.summary.empty_events
    assert s["last_cost"] == m.summary.distortion[-1] and len(heard.report().splitlines()) == len(heard.events) == len(caplog.records)
    assert telemetry.Memory().summary()["last_cost"] is None
    with pytest.raises(ValueError):
        telemetry.emit("nothing")


def test_checks(spark):
    rows = [(1, [1.0, 2.0], 1.0), (2, [float("nan"), 1.0], -1.0), (3, None, None), (4, [float("inf")], 1.0), (5, [-1.0, 0.0], 0.0)]
    df = spark.createDataFrame(rows, "id int, features array<double>, w double")
    got = validate.examine(df, validate.rules(df, "features", divergences.make("kl"), "w", 2), "id")
    assert got.rows == 5 and not got.ok and got.broken["not_null"] == 1 and got.samples["no_nan"] == [2] and got.samples["finite"] == [4]
    assert set(got.samples["weight"]) == {2, 3} and 4 in got.samples["dimension"] and 5 in got.samples["domain_kl"]
    fine = validate.examine(df.where("id = 1"), validate.rules(df, "features"), "id")
    assert fine.ok and (fine & got).broken == got.broken
    fine.require()
    with pytest.raises(errors.BrokenRule):
        (fine & got).require()
    assert validate.examine(df.where("id > 9"), validate.rules(df, "features"), "id") == validate.Report(0)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, -4.0], [1.0, 2.0]), (None, [1.0])], "x array<double>, y array<double>")
    x, y = F.col("x"), F.col("y")
    exprs = [vectors.dot(x, y), vectors.axpy(2.0, x, y), vectors.add(x, y), vectors.scale(0.5, x), vectors.norm1(x), vectors.norm2(x), vectors.squared_norm(x), vectors.normalised(x), vectors.total(x), vectors.largest(x), vectors.merge(x, y, lambda a, b: a - b)]
    want = [-5.0, [7.0, -6.0], [4.0, -2.0], [1.5, -2.0], 7.0, 5.0, 25.0, [0.6, -0.8], -1.0, 3.0, [2.0, -6.0]]
    full, null = (list(r) for r in df.select(*exprs).collect())
    assert all(np.allclose(a, b) for a, b in zip(full, want, strict=True)) and null == [None] * len(exprs)
    logs = spark.createDataFrame([(0.0,), (1.0,), (-1.0,)], "v double").select(vectors.safe_log(F.col("v"))).collect()
    assert [r[0] for r in logs] == [0.0, 0.0, None]
    short = spark.createDataFrame([([0.0, 0.0],), ([0.25, 0.75],), ([float("nan"), 1.0],)], "x array<double>")
    got = short.select(vectors.normalised(F.col("x")).alias("n"), vectors.is_distribution(F.col("x")).alias("p"), vectors.is_finite(F.col("x")).alias("f")).collect()
    assert got[0]["n"] == [0.0, 0.0] and [r["p"] for r in got] == [False, True, False] and [r["f"] for r in got] == [True, True, False]


def test_traits_and_presets():
    for name in set(divergences.ALIASES.values()):
        t, d = divergences.traits(name), divergences.make(name)
        a, b = np.array([[0.2, 0.7]]), np.array([[0.6, 0.3]])
        assert t.symmetric == np.isclose(d.matrix(a, b)[0, 0], d.matrix(b, a)[0, 0])
        transforms.make(t.transform)
    for name in presets.PRESETS:
        assert presets.preset(name, max_iter=3).max_iter == 3
    assert presets.preset("topic_modeling").k == 50 and presets.preset("topic_modeling", 4).k == 4 and isinstance(presets.preset("large_dataset"), estimators.MiniBatchKMeans) and presets.preset("streaming").fraction == 0.01


def brute_merges(x, linkage, div):
    """Every distance from its definition after every merge."""
    value, d = (div.grad(x) if div.grad else x), div.matrix(x, x)
    d, groups, out = (d + d.T) / 2, {i: [i] for i in range(len(x))}, []

    def centre(g):
        m = value[g].mean(0)
        return (div.inv_grad(m) if div.inv_grad else m)[None]

    def apart(a, b):
        if linkage in ("single", "complete", "average"):
            return {"single": np.min, "complete": np.max, "average": np.mean}[linkage](d[np.ix_(a, b)])
        c = div.matrix(centre(a), centre(b))[0, 0]
        return c * len(a) * len(b) / (len(a) + len(b)) if linkage == "ward" else c

    while len(groups) > 1:
        v, i, j = min((apart(groups[i], groups[j]), i, j) for i in groups for j in groups if i < j)
        new = len(x) + len(out)
        groups[new] = groups.pop(i) + groups.pop(j)
        out.append((i, j, new, v))
    return out


@pytest.mark.parametrize("linkage", ["single", "complete", "average", "ward", "centroid"])
@pytest.mark.parametrize("kind", ["se", "kl"])
def test_merges(linkage, kind):
    x, div = np.random.default_rng(1).uniform(0.1, 0.9, (25, 3)), divergences.make(kind)
    labels, got = bounded.agglomerate(x, linkage, div)
    want = brute_merges(x, linkage, div)
    assert [m[:3] for m in got] == [m[:3] for m in want] and np.allclose([m[3] for m in got], [m[3] for m in want]) and not labels.any()
    assert len(bounded.agglomerate(x, linkage, div, clusters=4)[1]) == 21 and len(set(bounded.agglomerate(x, linkage, div, clusters=4)[0])) == 4
    assert bounded.agglomerate(x[:1], linkage, div)[1] == [] and bounded.agglomerate(np.tile(x[:1], (3, 1)), linkage, div)[1][0][:3] == (0, 1, 3)


def test_every_kind_of_model_comes_back(spark, blobs, tmp_path):
    x, df = blobs
    agglomerative, spectral, medoids = bounded.Agglomerative(clusters=3), bounded.SpectralClustering(k=3, gamma=50.0), bounded.KMedoids(k=3)
    for m in (agglomerative, spectral, medoids):
        m.fit_transform(df, "features", "id")
    live = StreamingKMeans(x[[0, 25, 50]].copy())
    live.update(df, 3)
    cells = df.select("row", "col", F.get("features", 0).alias("value"))
    fitted = [
        estimators.SoftKMeans(k=3, max_iter=3).fit(df), estimators.BregmanMixture(k=3, max_iter=3).fit(df), estimators.RobustKMeans(k=3, max_iter=2).fit(df),
        estimators.MultiViewKMeans([estimators.View("features"), estimators.View("features", 0.5, "kl")], k=3, max_iter=2).fit(df), sparse.SparseKMeans(k=3, max_iter=2).fit(df),
        tabular.CoClustering(max_iter=2).fit(cells), tabular.InformationBottleneck(bins=4, max_iter=3).fit(df), KMeans(k=3, initial_centres=x[:3]), agglomerative, spectral, medoids, live,
    ]
    for i, m in enumerate(fitted):
        path = f"file://{tmp_path}/{i}"
        persistence.save(m, spark, path)
        again = persistence.load(spark, path)
        assert type(again) is type(m)
        given = cells if isinstance(m, tabular.CoClustering) else df
        if hasattr(m, "transform"):
            assert sorted(map(str, again.transform(given).collect())) == sorted(map(str, m.transform(given).collect()))
    assert np.array_equal(again.centres, live.centres) and np.array_equal(again.weights, live.weights) and again.done == {3}
    steps = persistence.dendrogram(spark, agglomerative.merges)
    assert steps.count() == 57 and np.array_equal(persistence.load(spark, f"file://{tmp_path}/8").merges, agglomerative.merges)
    spark.createDataFrame([(0, 1.0, [0.0])], "center_id int, weight double, vector array<double>").write.mode("overwrite").parquet(f"file://{tmp_path}/0/centers.parquet")
    with pytest.raises(errors.RowError):
        persistence.load(spark, f"file://{tmp_path}/0")
