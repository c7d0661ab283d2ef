"""Closed forms, equivalence of plans, loops and persistence of the clustering core."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.functions import divergences, infotheory, sequences, transforms
from halocline.operators.assign import assign, nearest
from halocline.operators.update import cluster_sums, hard, running_medians, weighted_medians
from halocline.operators.validate import require_valid
from halocline.plans import bounded, estimators
from halocline.plans.lloyd import lloyd
from halocline.sources import persistence
from halocline.streaming.kmeans import StreamingKMeans

NAMES = ("se", "kl", "is", "geni", "logistic", "l1", "spherical")


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.03, (40, 3)) for c in (0.2, 0.5, 0.8)]).clip(0.01, 0.99)
    return x, spark.createDataFrame([(i, v.tolist(), 1.0) for i, v in enumerate(x)], "id long, features array<double>, w double")


@pytest.mark.parametrize("name", NAMES)
def test_divergence_laws(name):
    div = divergences.make(name)
    x = np.random.default_rng(1).uniform(0.1, 0.9, (20, 4))
    d = div.matrix(x, x)
    assert np.abs(np.diag(d)).max() < 1e-7
    if name != "kl":
        assert d.min() > -1e-9
    if div.inv_grad and name != "spherical":
        assert np.allclose(div.inv_grad(div.grad(x)), x)


def test_divergence_values():
    x, c = np.array([[0.5, 0.5]]), np.array([[0.25, 0.75]])
    assert divergences.make("SE").matrix(x, c)[0, 0] == pytest.approx(0.0625)
    assert divergences.make("l1").matrix(x, c)[0, 0] == pytest.approx(0.5)
    assert divergences.make("kl").matrix(x, c)[0, 0] == pytest.approx(0.5 * np.log(2) + 0.5 * np.log(2 / 3))
    with pytest.raises(ValueError):
        divergences.make("no such")


@pytest.mark.parametrize("name", NAMES)
def test_plans_agree(blobs, name):
    x, df = blobs
    div, centres = divergences.make(name), x[[0, 50, 100]]
    want, dist = nearest(x, centres, div)
    for strategy in ("expression", "arrow", "crossJoin"):
        got = assign(df, "features", centres, div, strategy, distance="_d").orderBy("id").collect()
        assert [r["cluster"] for r in got] == want.tolist()
        assert np.allclose([r["_d"] for r in got], dist, atol=1e-9)


def test_lloyd_and_empty_slots(blobs):
    x, df = blobs
    r = lloyd(df, "features", x[[0, 50, 100]], divergences.make("se"))
    assert r.converged and sorted(r.distortion, reverse=True) == r.distortion
    far = np.vstack([x[[0, 50]], [[9.0, 9.0, 9.0]]])
    keep = lloyd(df, "features", far, divergences.make("se"), max_iter=1)
    assert keep.empty_events == 1 and np.allclose(keep.centres[2], 9.0)
    assert len(lloyd(df, "features", far, divergences.make("se"), max_iter=1, empty="drop").centres) == 2
    assert cluster_sums(df, "features", 3, hard(lloyd(df, "features", far, divergences.make("se"), empty="reseed").centres, divergences.make("se")), lambda p: p).points.min() > 0


def test_weighted_median(spark):
    df = spark.createDataFrame([(0, [1.0], 1.0), (0, [2.0], 1.0), (0, [3.0], 2.0), (1, [5.0], 1.0)], "c int, x array<double>, w double")
    got = {r["cluster"]: r["median"] for r in weighted_medians(df, "x", "c", "w").collect()}
    assert got == {0: 2.5, 1: 5.0}


@pytest.mark.parametrize("parts", [2, 3, 7, 64])
def test_medians_do_not_depend_on_ranges(spark, parts):
    rng = np.random.default_rng(parts)
    rows, want = [], {}
    for c, n in ((0, 400), (1, 1), (2, 2), (3, 37)):
        v, w = rng.integers(0, 50, n) / 4, rng.integers(0, 3, n).astype(float)
        w[0] = 1.0
        rows += [(c, 0, float(a), float(b)) for a, b in zip(v, w, strict=True)]
        u = np.unique(v)
        upto = np.cumsum([w[v == a].sum() for a in u])
        i = int(np.argmax(upto >= upto[-1] / 2))
        want[c] = float((u[i] + u[i + 1]) / 2) if upto[i] == upto[-1] / 2 and i + 1 < len(u) else float(u[i])
    values = spark.createDataFrame(rows, "cluster int, pos int, v double, w double").groupBy("cluster", "pos", "v").agg(F.sum("w").alias("w"))
    assert {r["cluster"]: r["median"] for r in running_medians(values, parts).collect()} == want


def test_medians_if_quantiles_differ_from_run_to_run(spark, monkeypatch):
    def cuts(v, shares, accuracy):
        import random

        anew = F.udf(lambda low, high: sorted(random.uniform(low, high) for _ in range(5)), "array<double>").asNondeterministic()
        return anew(F.min(v), F.max(v))

    monkeypatch.setattr(F, "percentile_approx", cuts)
    spark.conf.set("spark.sql.exchange.reuse", "false")
    df = spark.range(0, 3000, 1, 4).select((F.col("id") % 3).cast("int").alias("c"), F.array([F.pmod(F.xxhash64("id", F.lit(p)), F.lit(9973)) / 9973 for p in range(4)]).alias("x"))
    got = {(r["cluster"], r["pos"]): r["median"] for r in weighted_medians(df, "x", "c").collect()}
    spark.conf.unset("spark.sql.exchange.reuse")
    for c in range(3):
        x = np.array([r["x"] for r in df.where(F.col("c") == c).collect()])
        assert [got.get((c, p)) for p in range(4)] == pytest.approx(np.median(x, axis=0))


@pytest.mark.parametrize("make", [
    lambda: estimators.KMeans(k=3), lambda: estimators.BisectingKMeans(k=3), lambda: estimators.SoftKMeans(k=3, beta=50.0, max_iter=10),
    lambda: estimators.BalancedKMeans(k=3, max_iter=10), lambda: estimators.RobustKMeans(k=3, max_iter=5), lambda: estimators.DPMeans(lam=0.05, max_iter=5),
    lambda: estimators.MiniBatchKMeans(k=3, batch_size=64, max_iter=5), lambda: estimators.BregmanMixture(k=3, max_iter=5), lambda: estimators.CoresetKMeans(k=3, coreset_size=30),
])
def test_estimators_cover_all_points(blobs, make):
    _, df = blobs
    out = make().fit(df).transform(df)
    assert out.count() == 120
    low, high = out.agg(F.min("prediction"), F.max("prediction")).first()
    assert 0 <= low <= high < 3


def test_bounded_methods(spark, blobs):
    x, df = blobs
    truth = np.repeat([0, 1, 2], 40)
    for m in (bounded.KMedoids(k=3), bounded.Agglomerative(clusters=3), bounded.SpectralClustering(k=3, gamma=50.0)):
        got = np.array([r["prediction"] for r in m.fit_transform(df, "features", "id").orderBy("id").collect()])
        assert len({(a, b) for a, b in zip(got, truth, strict=True)}) == 3
    with pytest.raises(ValueError):
        bounded.KMedoids(k=3, max_points=10).fit_transform(df, "features", "id")


def test_sequences():
    a, b = np.array([1.0, 2.0, 3.0]), np.array([1.0, 2.0, 2.0, 3.0])
    assert sequences.dtw(a, b) == 0.0 and sequences.dtw(a, a + 1) == pytest.approx(2.0)
    assert np.allclose(sequences.barycentre([a, a, a]), a)
    assert sequences.soft_dtw(a, b, 1e-3) == pytest.approx(0.0, abs=1e-2)


def test_validation_and_transforms(spark):
    df = spark.createDataFrame([(1, [1.0, -1.0]), (2, [0.5, 0.5])], "id int, features array<double>")
    with pytest.raises(ValueError, match="outside_domain"):
        require_valid(df, "features", divergences.make("kl"))
    with pytest.raises(ValueError, match="empty"):
        require_valid(df.where("id > 5"), "features", divergences.make("se"))
    shift = transforms.epsilon_shift(1.0).then(transforms.log1p())
    back = df.where("id = 2").select(shift.inverse(shift.apply(F.col("features"))).alias("x")).first()[0]
    assert back == pytest.approx([0.5, 0.5])


def test_information(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("b", "y")], "x string, y string")
    r = infotheory.mutual_information(infotheory.joint(df, "x", "y")).first()
    assert r["mutual_information"] == pytest.approx(np.log(2)) and r["h_y_given_x"] == pytest.approx(0.0)


def test_round_trip_and_stream(spark, blobs, tmp_path):
    x, df = blobs
    m = estimators.KMeans(k=3).fit(df)
    persistence.save(m, spark, f"file://{tmp_path}/model")
    again = persistence.load(spark, f"file://{tmp_path}/model")
    assert np.array_equal(again.centres, m.centres) and again.predict(x[0]) == m.predict(x[0])
    df.select("features").write.parquet(f"{tmp_path}/in")
    live = StreamingKMeans(x[[0, 50, 100]].copy())
    live.start(spark.readStream.schema("features array<double>").parquet(f"{tmp_path}/in"), f"{tmp_path}/cp").awaitTermination(60)
    still = StreamingKMeans(x[[0, 50, 100]].copy())
    still.update(df, 0)
    still.update(df, 0)
    assert np.allclose(live.centres, still.centres) and live.weights.sum() == 120
