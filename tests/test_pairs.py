"""All pairs in blocks against brute force, on odd rows too."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.functions import divergences, mercer, sequences
from halocline.operators import metrics, pairs
from halocline.plans import bounded, sampled
from tests.test_support import brute_merges


@pytest.fixture
def many_blocks(monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_LEAST", 10)
    monkeypatch.setattr(pairs, "BLOCKS", 4)
    monkeypatch.setattr(pairs, "TILE", 7)


@pytest.fixture(scope="module")
def odd(spark):
    """(id, c, x): copies, near copies, a null point, a null within a point, another length, a cluster of one, null clusters, one id twice."""
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3), rng.uniform(0, 1, 4).tolist()) for i in range(90)]
    rows += [(100 + i, 0, rows[i][2]) for i in range(6)] + [(110, 1, [v + 1e-9 for v in rows[1][2]])]
    rows += [(120, 2, None), (121, 2, [0.1, None, 0.2, 0.3]), (122, 1, [0.5, 0.5]), (123, 1, [0.25, 0.5]), (124, 7, [0.5] * 4), (125, None, [0.5] * 4), (126, None, [0.1] * 4), (5, 2, [0.9] * 4)]
    return rows, spark.createDataFrame(rows, "id long, c int, x array<double>")


def apart(a, b):
    return None if a is None or b is None or len(a) != len(b) or None in a or None in b else float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum()))


def test_silhouette_in_blocks(many_blocks, odd):
    rows, df = odd
    want = {}
    for i, c, _ in rows:
        d = {}
        for p, k, x in rows:
            if (p, k) == (i, c):
                for q, other, y in rows:
                    if q != i and (v := apart(x, y)) is not None:
                        d.setdefault(other, []).append(v)
        m = {k: np.mean(v) for k, v in d.items()}
        b = min((v for k, v in m.items() if c is not None and k is not None and k != c), default=None)
        a = m.get(c, 0.0) if c is not None else 0.0
        want[i, c] = 0.0 if b is None or max(a, b) == 0 else (b - a) / max(a, b)
    got = metrics.silhouette(df, "x", "c", "id").collect()
    assert len(got) == len(want) and {(r["id"], r["cluster"]): r["silhouette"] for r in got} == pytest.approx(want, abs=1e-9)
    assert metrics.silhouette(df.where("id = 7"), "x", "c", "id").isEmpty()
    with pytest.raises(ValueError, match="more than"):
        metrics.silhouette(df, "x", "c", "id", most=10)


@pytest.mark.parametrize("kind", ["linear", "polynomial", "sigmoid", "rbf", "laplacian"])
def test_gram_in_blocks(many_blocks, odd, kind):
    df = odd[1].withColumnRenamed("c", "g")
    b = df.select("g", F.col("x").alias("y"))
    own = mercer.kernel(F.col("x"), F.col("y"), kind, 0.5, 3, 1.0)
    want = {r["id"]: (r["n"], r["total"]) for r in df.join(b, "g").groupBy("id").agg(F.count("*").alias("n"), F.sum(own).alias("total")).collect()}
    got = {r["id"]: (r["n"], r["total"]) for r in metrics.gram_sums(df, "x", "g", "id", kind, 0.5, 3, 1.0).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and got[i][1] == pytest.approx(want[i][1]) for i in want)


def test_laplacian_holds_no_cube():
    x = np.random.default_rng(1).uniform(0, 1, (200, 40))
    tracemalloc.start()
    k = mercer.gram(x, x, "laplacian", 0.5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * k.nbytes and k[3, 5] == pytest.approx(np.exp(-0.5 * np.abs(x[3] - x[5]).sum()))


@pytest.mark.parametrize("linkage", ["average", "ward", "centroid"])
def test_merges_of_copies_without_a_matrix(linkage):
    rng = np.random.default_rng(2)
    x = np.repeat(rng.integers(0, 64, (9, 3)) / 64, [1, 2, 3, 4, 5, 1, 1, 4, 3], axis=0)[rng.permutation(24)]
    labels, got = bounded.agglomerate(x, linkage, divergences.make("se"))
    want = brute_merges(x, linkage, divergences.make("se"))
    assert [m[:3] for m in got[:15]] == [m[:3] for m in want[:15]] and np.allclose([m[3] for m in got], [m[3] for m in want])
    big = rng.uniform(0, 1, (6000, 2))
    tracemalloc.start()
    labels, got = bounded.agglomerate(big, linkage, divergences.make("se"), clusters=5900)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 100 and len(set(labels)) == 5900 and most < 40e6


@pytest.fixture
def small_steps(monkeypatch):
    """Rows are dealt over the executors from 10 on; the old driver-side forms stand by."""
    monkeypatch.setattr(bounded, "LOCAL_ROWS", 10)


@pytest.fixture(scope="module")
def crowd(spark):
    x = np.random.default_rng(8).uniform(0, 1, (150, 3))
    x = np.vstack([x, x[:30], x[:10]])
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")


def labels_of(out):
    return [r["prediction"] for r in out.orderBy("id").collect()]


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_medoids_without_a_matrix(small_steps, crowd, metric):
    x, df = crowd
    d = bounded.pairwise(x, metric)
    want = bounded.swap_medoids(d, bounded.build_medoids(d, 4))
    m = bounded.KMedoids(k=4, metric=metric)
    assert labels_of(m.fit_transform(df, "features", "id")) == d[want].argmin(0).tolist() and m.medoids.tolist() == want


def test_kernel_labels_without_a_matrix(small_steps, crowd):
    x, df = crowd
    gram, labels = mercer.gram(x, x, "rbf", 2.0), np.random.default_rng(0).integers(0, 3, len(x))
    for _ in range(20):
        one = np.eye(3)[labels]
        d = 1 - 2 * gram @ one / one.sum(0) + np.einsum("ic,ij,jc->c", one, gram, one) / one.sum(0) ** 2
        changed, labels = (d.argmin(1) != labels).mean(), d.argmin(1)
        if changed < 1e-4:
            break
    assert labels_of(bounded.KernelKMeans(k=3, gamma=2.0).fit_transform(df, "features", "id")) == labels.tolist()


def test_no_limit_of_rows(spark):
    df = spark.range(10_050).select("id", F.array(F.pmod(F.xxhash64("id"), F.lit(40)) / 40).alias("features"))
    for m in (bounded.KMedoids(k=2), bounded.KernelKMeans(k=2)):
        assert m.fit_transform(df, "features", "id").count() == 10_050


def test_hard_sizes_above_the_old_limit(spark):
    d = np.random.default_rng(4).uniform(0, 1, (60, 4)).round(1)
    room, want = np.full(4, 16), np.zeros(60, dtype=int)
    for i in np.argsort(d.min(1), kind="stable"):
        want[i] = next(c for c in np.argsort(d, axis=1, kind="stable")[i] if room[c] > 0)
        room[want[i]] -= 1
    assert sampled.fill_capacities(d, 0, 16).tolist() == want.tolist()
    df = spark.range(10_050).select("id", F.array(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("features"))
    sizes = sampled.HardBalancedKMeans(k=3, max_iter=3).fit_transform(df, "features", "id").groupBy("prediction").count().collect()
    assert sum(r["count"] for r in sizes) == 10_050 and max(r["count"] for r in sizes) <= 3685


def test_series_without_a_matrix(small_steps, spark):
    rng = np.random.default_rng(6)
    x = [rng.uniform(0, 1, n) + (i % 3) for i, n in enumerate(rng.integers(2, 5, 40))]
    x += x[:8]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    d = np.array([[sequences.dtw(a, b) for b in x] for a in x])
    assert np.array_equal(sequences.cross("dtw", x, sequences.by_length(x)), d)
    assert np.allclose(sequences.cross("derivative", x, sequences.by_length(x), 1), [[sequences.distance("derivative", a, b, 1) for b in x] for a in x])
    sums, n = np.zeros(3), np.zeros(3)
    for s in x:
        for i, j in sequences.dtw_path(np.array([0.5, 1.0, 2.0]), s)[1]:
            sums[i] += s[j]
            n[i] += 1
    got = sequences.aligned(np.array([0.5, 1.0, 2.0]), x, np.ones(len(x)))
    assert np.allclose(got[0], sums) and np.array_equal(got[1], n)
    labels, centres = None, [x[i] for i in bounded.build_medoids(d, 3)]
    for _ in range(20):
        new = np.array([[sequences.dtw(a, c) for c in centres] for a in x]).argmin(1)
        if labels is not None and np.array_equal(new, labels):
            break
        labels = new
        centres = [sequences.barycentre([s for s, l in zip(x, labels, strict=True) if l == c]) for c in range(3)]
    assert labels_of(bounded.TimeSeriesKMeans(k=3).fit_transform(df, "features", "id")) == labels.tolist()


@pytest.mark.parametrize("affinity", ["full", "knn", "epsilon"])
@pytest.mark.parametrize("kind", ["symmetric", "randomWalk", "unnormalized"])
def test_spectral_without_a_matrix(small_steps, crowd, monkeypatch, affinity, kind):
    x, df = crowd
    make = lambda: bounded.SpectralClustering(k=3, gamma=8.0, affinity=affinity, neighbours=12, epsilon=0.6, laplacian=kind)
    whole, parts = make(), make()
    want = labels_of(whole.fit_transform(df, "features", "id"))
    monkeypatch.setattr(bounded, "DENSE_ROWS", 10)
    got = labels_of(parts.fit_transform(df, "features", "id"))
    span = whole.embedding @ np.linalg.lstsq(whole.embedding, parts.embedding, rcond=None)[0]
    assert np.abs(span - parts.embedding).max() < 1e-6 and len(set(zip(got, want, strict=True))) == len(set(want))
