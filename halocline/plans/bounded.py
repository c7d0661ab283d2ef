"""Clusterings that need all pairs: on the driver, over at most ``max_points`` rows (an error above, never a sample)."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.errors import TooManyRows
from halocline.functions import divergences, mercer, sequences
from halocline.operators.assign import features_of
from halocline.plans.lloyd import local_lloyd

MAX_POINTS = 10_000
#: Rows for which a matrix of (2n)^2 distances is held.
MATRIX_POINTS = 4000


def bounded_points(df: DataFrame, features: str, id_col: str, most: int | None = None) -> tuple[np.ndarray, list]:
    """(ids, points) in the order of ids; an error above ``most`` rows, if given."""
    rows = df.select(F.col(id_col).alias("id"), features_of(df, features).alias("x"))
    got = (rows if most is None else rows.limit(most + 1)).toArrow()
    if most is not None and got.num_rows > most:
        raise TooManyRows(f"more than {most} rows; raise max_points or use a sampling variant")
    x, ids = got["x"].combine_chunks(), np.array(got["id"].to_pylist())
    x = pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x
    flat, ends = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.append(0, x.value_lengths().to_numpy(zero_copy_only=False)))
    order = np.argsort(ids, kind="stable")
    return ids[order], [flat[ends[i] : ends[i + 1]] for i in order]


def result(df: DataFrame, ids: np.ndarray, labels: np.ndarray, id_col: str) -> DataFrame:
    rows = [(i.item(), int(c)) for i, c in zip(ids, labels, strict=True)]
    return df.sparkSession.createDataFrame(rows, f"{id_col} {df.schema[id_col].dataType.simpleString()}, prediction int")


def pairwise(x: np.ndarray, metric: str = "euclidean", y: np.ndarray | None = None) -> np.ndarray:
    y = x if y is None else y
    if metric == "euclidean":
        return np.sqrt(np.maximum(0.0, 2 * divergences.make("se").matrix(x, y)))
    return divergences.make({"manhattan": "l1", "cosine": "spherical"}[metric]).matrix(x, y)


#: Up to so many rows, all pairs are worked through on the driver; numbers of a matrix that are held at once.
LOCAL_ROWS, HELD = 1000, 1 << 20


def over_rows(spark: SparkSession, n: int, given: Any, f: Callable[[Any, slice], np.ndarray], held: int = HELD) -> np.ndarray:
    """``f(given, slice)`` for all rows 0..n in small slices, its rows (a few numbers each) put together in order.

    ``f`` compares its slice with all rows and reduces what it finds, so no task holds more than ``held`` numbers or one
    row of the matrix. ``given`` (points and a few numbers for each) is broadcast; slices are dealt over the executors.
    """
    step = max(1, held // max(n, 1))
    if n <= LOCAL_ROWS:
        return np.concatenate([f(given, slice(at, min(at + step, n))) for at in range(0, n, step)])
    size = -(-n // (spark.sparkContext.defaultParallelism * 4))
    sent = spark.sparkContext.broadcast(given)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in b.column(0).to_pylist():
                top = min(low + size, n)
                out = np.concatenate([f(sent.value, slice(at, min(at + step, top))) for at in range(low, top, step)])
                yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([out.ravel()], pa.list_(pa.float64()))], ["at", "v"])

    jobs = spark.range(0, n, size, -(-n // size)).mapInArrow(each, "at long, v array<double>")
    table = jobs.toArrow()
    parts = sorted(((at, np.asarray(v.values)) for at, v in zip(table["at"].to_pylist(), table["v"], strict=True)), key=lambda p: p[0])
    sent.destroy()
    return np.concatenate([v for _, v in parts]).reshape(n, -1)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different rows in the order in which they first come, how often, the number of each row's among them)."""
    _, at, back, n = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(at)
    return x[at[order]], n[order].astype(float), np.argsort(order)[back.ravel()]


def least_medoids(spark: SparkSession, n: int, w: np.ndarray, k: int, given: Any, between: Callable[[Any, slice], np.ndarray], rounds: int = 0, held: int = HELD) -> list[int]:
    """``build_medoids`` and ``rounds`` of ``swap_medoids`` over n rows of weights w, without their matrix.

    ``between(given, slice)``: distances of some rows to all.
    """
    chosen = [int(over_rows(spark, n, (given, w), lambda g, s: (between(g[0], s) @ g[1])[:, None], held)[:, 0].argmin())]
    own = [between(given, slice(chosen[0], chosen[0] + 1))[0]]
    while len(chosen) < k:
        gain = over_rows(spark, n, (given, w, np.min(own, 0)), lambda g, s: (np.maximum(g[2] - between(g[0], s), 0) @ g[1])[:, None], held)[:, 0]
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
        own.append(between(given, slice(chosen[-1], chosen[-1] + 1))[0])
    for _ in range(rounds):
        cost = np.min(own, 0) @ w
        rest = [np.min(own[:i] + own[i + 1 :], 0) if len(own) > 1 else np.full(n, np.inf) for i in range(len(own))]

        def costs(g: Any, s: slice) -> np.ndarray:
            d = between(g[0], s)
            return np.column_stack([np.minimum(r, d) @ g[1] for r in g[2]])

        change = over_rows(spark, n, (given, w, rest), costs, held) - cost
        change[chosen] = np.inf
        v, i, j = min((float(change[:, i].min()), i, int(change[:, i].argmin())) for i in range(len(own)))
        if v >= -1e-10:
            break
        chosen[i], own[i] = j, between(given, slice(j, j + 1))[0]
    return chosen


def build_medoids(d: np.ndarray, k: int) -> list[int]:
    """Greedy BUILD: the most central point, then whichever lowers the cost most; ties to the first."""
    chosen = [int(d.sum(0).argmin())]
    near = d[chosen[0]].copy()
    while len(chosen) < k:
        gain = np.maximum(near[None, :] - d, 0).sum(1)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
        near = np.minimum(near, d[chosen[-1]])
    return chosen


def swap_medoids(d: np.ndarray, medoids: list[int], max_iter: int = 20) -> list[int]:
    """Best-improvement SWAP until no swap lowers the cost."""
    medoids = list(medoids)
    for _ in range(max_iter):
        best = (-1e-10, -1, -1)
        cost = d[medoids].min(0).sum()
        for i in range(len(medoids)):
            rest = d[medoids[:i] + medoids[i + 1 :]].min(0) if len(medoids) > 1 else np.full(len(d), np.inf)
            change = np.minimum(rest[None, :], d).sum(1) - cost
            change[medoids] = np.inf
            j = int(change.argmin())
            best = min(best, (float(change[j]), i, j))
        if best[1] < 0:
            break
        medoids[best[1]] = best[2]
    return medoids


@dataclass
class KMedoids:
    k: int = 2
    metric: str = "euclidean"
    max_iter: int = 20
    max_points: int | None = None
    medoids: np.ndarray | None = None

    def fit_transform(self, df: DataFrame, features: str, id_col: str) -> DataFrame:
        ids, rows = bounded_points(df, features, id_col, self.max_points)
        x, metric = np.array(rows), self.metric
        u, w, back = distinct(x)
        if len(u) < self.k:
            u, w, back = x, np.ones(len(x)), np.arange(len(x))
        chosen = least_medoids(df.sparkSession, len(u), w, self.k, u, lambda g, s: pairwise(g[s], metric, g), self.max_iter)
        first = np.full(len(u), len(x))
        np.minimum.at(first, back, np.arange(len(x)))
        self.medoids = ids[first[chosen]]
        return result(df, ids, pairwise(u[chosen], metric, u).argmin(0)[back], id_col)


@dataclass
class KernelKMeans:
    k: int = 2
    kind: str = "rbf"
    gamma: float = 1.0
    degree: int = 3
    coef0: float = 0.0
    auto_gamma: bool = False
    max_iter: int = 20
    tol: float = 1e-4
    seed: int = 0

    def labels(self, x: np.ndarray, spark: SparkSession | None = None) -> np.ndarray:
        """Kernel values are computed anew for some rows at a time; copies count by their number."""
        gamma = mercer.median_gamma(x) if self.auto_gamma else self.gamma
        kind, degree, coef0 = self.kind, self.degree, self.coef0
        gram = lambda a, b: mercer.gram(a, b, kind, gamma, degree, coef0)
        labels = np.random.default_rng(self.seed).integers(0, self.k, len(x))
        u, _, back = distinct(x)
        own = np.concatenate([np.diag(gram(u[at : at + 256], u[at : at + 256])) for at in range(0, len(u), 256)])
        for _ in range(self.max_iter):
            count = np.zeros((len(u), self.k))
            np.add.at(count, (back, labels), 1.0)
            n = np.maximum(count.sum(0), 1e-300)
            cross = over_rows(spark, len(u), (u, count), lambda g, s: gram(g[0][s], g[0]) @ g[1])
            d = own[:, None] - 2 * cross / n + (count * cross).sum(0) / n**2
            d[:, count.sum(0) == 0] = np.inf
            new = d.argmin(1)[back]
            changed = (new != labels).mean()
            labels = new
            if changed < self.tol:
                break
        return labels

    def fit_transform(self, df: DataFrame, features: str, id_col: str) -> DataFrame:
        ids, x = bounded_points(df, features, id_col)
        return result(df, ids, self.labels(np.array(x), df.sparkSession), id_col)


def affinity(x: np.ndarray, kind: str = "full", gamma: float = 1.0, neighbours: int = 10, epsilon: float = 1.0) -> np.ndarray:
    w = mercer.gram(x, x, "rbf", gamma)
    if kind == "epsilon":
        w = np.where(pairwise(x) <= epsilon, w, 0.0)
    if kind == "knn":
        order = np.argsort(-w, axis=1, kind="stable")[:, : neighbours + 1]
        keep = np.zeros_like(w, dtype=bool)
        keep[np.arange(len(x))[:, None], order] = True
        w = np.where(keep | keep.T, w, 0.0)
    np.fill_diagonal(w, 0.0)
    return w


def laplacian(w: np.ndarray, kind: str = "symmetric") -> np.ndarray:
    degree = w.sum(1)
    if kind == "unnormalized":
        return np.diag(degree) - w
    safe = np.maximum(degree, 1e-12)
    if kind == "randomWalk":
        return np.eye(len(w)) - w / safe[:, None]
    return np.eye(len(w)) - w / np.sqrt(np.outer(safe, safe))


#: Up to so many rows the affinity is held whole; above, its products with a few vectors are computed.
DENSE_ROWS = 2000


def top_vectors(product: Callable[[np.ndarray], np.ndarray], n: int, k: int, seed: int = 0, tol: float = 1e-9, most: int = 500) -> np.ndarray:
    """(n, k) eigenvectors of the largest eigenvalues of a symmetric matrix, known by its products with blocks of vectors.

    Block Krylov spaces, orthogonalised in full and restarted; ends when the residuals are below ``tol`` of the norm.
    """
    b = k + 5
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(b, n))))
    basis, image = q, product(q)
    for _ in range(most):
        values, inner = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        inner = inner[:, ::-1]
        top = basis @ inner[:, :k]
        off = image @ inner[:, :k] - top * values[::-1][:k]
        if np.sqrt((off * off).sum(0)).max() <= tol * max(abs(values).max(), 1e-300) or basis.shape[1] >= n:
            return top
        if basis.shape[1] > 20 * b:
            basis, image, q = basis @ inner[:, : 3 * b], image @ inner[:, : 3 * b], None
        new = image @ inner[:, :b] - basis @ (inner[:, :b] * values[::-1][:b]) if q is None or basis.shape[1] <= b else image[:, -b:]
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
        new, r = np.linalg.qr(new)
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
        q, _ = np.linalg.qr(new)
        q = q[:, : n - basis.shape[1]]
        basis, image = np.hstack([basis, q]), np.hstack([image, product(q)])
    raise RuntimeError("eigenvectors did not converge")


@dataclass
class SpectralClustering:
    k: int = 2
    gamma: float = 1.0
    affinity: str = "full"
    neighbours: int = 10
    epsilon: float = 1.0
    laplacian: str = "symmetric"
    seed: int = 42
    ids: np.ndarray | None = None
    embedding: np.ndarray | None = None
    centres: np.ndarray | None = None

    def sparse_embedding(self, spark: SparkSession, x: np.ndarray) -> np.ndarray:
        """The vectors of ``fit_transform`` from products with the affinity, which is computed anew, some rows at a time."""
        kind, gamma, near, epsilon, inner = self.affinity, self.gamma, self.neighbours, self.epsilon, self.laplacian != "unnormalized"
        u, w, back = distinct(x) if kind != "knn" and inner else (x, np.ones(len(x)), np.arange(len(x)))
        n = len(u)

        def rows(points: np.ndarray, s: slice) -> np.ndarray:
            a = mercer.gram(points[s], points, "rbf", gamma)
            return np.where(pairwise(points[s], "euclidean", points) <= epsilon, a, 0.0) if kind == "epsilon" else a

        if kind == "knn":
            found = over_rows(spark, n, u, lambda g, s: np.argsort(-rows(g, s), axis=1, kind="stable")[:, : near + 1].astype(float)).astype(int)
            i = np.repeat(np.arange(n), found.shape[1])
            pair = np.unique(np.concatenate([i * n + found.ravel(), found.ravel() * n + i]))
            i, j = pair // n, pair % n
            i, j = i[i != j], j[i != j]
            value = np.exp(-gamma * ((u[i] - u[j]) ** 2).sum(1))
            times = lambda z: np.column_stack([np.bincount(i, value * c[j], n) for c in z.T])
        else:  # copies count by their number; a row is not its own neighbour
            own = np.concatenate([np.diag(rows(u[at : at + 256], slice(None))) for at in range(0, n, 256)])
            times = lambda z: over_rows(spark, n, (u, np.sqrt(w)[:, None] * z), lambda g, s: rows(g[0], s) @ g[1]) * np.sqrt(w)[:, None] - own[:, None] * z
        degree = times(np.sqrt(w)[:, None])[:, 0] / np.sqrt(w)
        if not inner:
            high = 2 * degree.max()
            return top_vectors(lambda z: (high - degree)[:, None] * z + times(z), n, self.k, self.seed)[back]
        root = np.sqrt(np.maximum(degree, 1e-12))[:, None]
        e = top_vectors(lambda z: times(z / root) / root, n, self.k, self.seed) / np.sqrt(w)[:, None]
        if self.laplacian == "randomWalk":
            e = (e / root)[back]
            return e / np.sqrt((e * e).sum(0))
        return e[back]

    def fit_transform(self, df: DataFrame, features: str, id_col: str) -> DataFrame:
        ids, x = bounded_points(df, features, id_col)
        spark = df.sparkSession
        if len(x) > DENSE_ROWS:
            e = self.sparse_embedding(spark, np.array(x))
            if self.laplacian == "symmetric":
                e = e / np.maximum(np.sqrt((e * e).sum(1, keepdims=True)), 1e-12)
            u, w, back = distinct(e)
            if len(u) < self.k:
                u, w = e, np.ones(len(e))
            start = u[least_medoids(spark, len(u), w, self.k, u, lambda g, s: pairwise(g[s], "euclidean", g))]
            self.centres, labels = local_lloyd(e, start, divergences.make("se"))[:2]
            self.ids, self.embedding = ids, e
            return result(df, ids, labels, id_col)
        m = laplacian(affinity(np.array(x), self.affinity, self.gamma, self.neighbours, self.epsilon), self.laplacian)
        values, vectors = np.linalg.eig(m) if self.laplacian == "randomWalk" else np.linalg.eigh(m)
        e = np.real(vectors[:, np.argsort(np.real(values))[: self.k]])
        if self.laplacian == "symmetric":
            e = e / np.maximum(np.sqrt((e * e).sum(1, keepdims=True)), 1e-12)
        self.centres, labels = local_lloyd(e, e[build_medoids(pairwise(e), self.k)], divergences.make("se"))[:2]
        self.ids, self.embedding = ids, e
        return result(df, ids, labels, id_col)


@dataclass
class TimeSeriesKMeans:
    k: int = 2
    kind: str = "dtw"
    window: int = 0
    gamma: float = 1.0
    sigma: float = 1.0
    dba_iter: int = 10
    max_iter: int = 20

    def fit_transform(self, df: DataFrame, features: str, id_col: str) -> DataFrame:
        ids, x = bounded_points(df, features, id_col)
        spark, kind, window, gamma, sigma = df.sparkSession, self.kind, self.window, self.gamma, self.sigma
        seen: dict[bytes, int] = {}
        back = np.array([seen.setdefault((s + 0.0).tobytes(), len(seen)) for s in x])
        u = [x[i] for i in np.unique(back, return_index=True)[1]]
        w = np.bincount(back, minlength=len(u)).astype(float)
        if len(u) < self.k:
            u, w, back = x, np.ones(len(x)), np.arange(len(x))
        held = max(HELD // (max(map(len, u)) + 1) ** 2, 1)  # a pair of series holds a table
        between = lambda g, s: sequences.cross(kind, g[0][s], g[1], window, gamma, sigma)
        given = (u, sequences.by_length(u))
        centres = [u[i] for i in least_medoids(spark, len(u), w, self.k, given, between, held=held)]
        labels = None
        for _ in range(self.max_iter):
            ends = sequences.by_length(centres)
            new = np.concatenate([between((u, ends), slice(at, at + 4096)) for at in range(0, len(u), 4096)]).argmin(1)
            if labels is not None and np.array_equal(new, labels):
                break
            labels = new
            for c in range(self.k):
                on = np.flatnonzero(labels == c)
                if len(on):
                    own = [u[i] for i in on]
                    total = over_rows(spark, len(own), (own, sequences.by_length(own), w[on]), lambda g, s: (sequences.cross("dtw", g[0][s], g[1], window) @ g[2])[:, None], held)[:, 0]
                    centres[c] = sequences.barycentre(own, w[on], self.dba_iter, window, total)
        return result(df, ids, labels[back], id_col)


#: Divergences whose mean over the pairs of two clusters follows from the means of points and gradients.
SUMMED = ("squaredEuclidean", "kl", "itakuraSaito", "generalizedI")


def by_sums(linkage: str, div: divergences.Divergence) -> bool:
    """Whether a cluster's sums give its distances, so that no matrix is needed."""
    return linkage in ("ward", "centroid") or (linkage == "average" and div.name in SUMMED)


def agglomerate(x: np.ndarray, linkage: str = "average", div: divergences.Divergence | None = None, clusters: int = 1, threshold: float = 0.0) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
    """(labels, merges (cluster, cluster, new, distance)); of equal distances, the pair with the smallest numbers.

    Each cluster keeps its nearest later cluster, so a merge mostly costs one pass over the clusters. Ward, centroid and
    (for most divergences) average linkage need the sums of each cluster only: memory is that of the points.
    """
    div = div or divergences.make("se")
    return (agglomerate_sums if by_sums(linkage, div) else agglomerate_matrix)(x, linkage, div, clusters, threshold)


class Clusters:
    """Sums of the living clusters, in the order of their numbers; the distance of two is from the earlier to the later."""

    def __init__(self, x: np.ndarray, linkage: str, div: divergences.Divergence) -> None:
        self.linkage, self.div, self.m = linkage, div, len(x)
        self.number, self.size, self.near, self.best = np.arange(len(x)), np.ones(len(x)), np.zeros(len(x), dtype=int), np.full(len(x), np.inf)
        value = div.grad(x) if div.grad else x
        self.value = np.ascontiguousarray(value.T)  # mean gradient; with SE the mean point
        self.centre = np.ascontiguousarray((div.inv_grad(value) if div.inv_grad else value).T) if linkage != "average" else np.ascontiguousarray(x.T)
        #: Average linkage: the mean squared distance from the mean (SE), or the mean product of point and gradient.
        self.spread = np.zeros(len(x)) if div.name == "squaredEuclidean" else (x * value).sum(1)

    def grow(self) -> None:
        """Drops the dead (size 0) and makes room for as many again."""
        on = np.flatnonzero(self.size[: self.m] > 0)
        wide = lambda a: np.concatenate([a[..., on], np.zeros((*a.shape[:-1], max(len(on) // 2, 1)), a.dtype)], -1)
        for name in ("number", "size", "near", "best", "value", "centre", "spread"):
            setattr(self, name, wide(getattr(self, name)))
        self.m = len(on)

    def apart(self, at: int, low: int, high: int) -> np.ndarray:
        """Distances of the cluster at ``at`` to those at low..high, all before it or all after; infinite to the dead."""
        if self.div.name == "squaredEuclidean":
            d = (self.centre[0, low:high] - self.centre[0, at]) ** 2
            for c in self.centre[1:]:
                e = c[low:high] - c[at]
                e *= e
                d += e
            if self.linkage == "average":
                d += self.spread[low:high] + self.spread[at]
            d *= 0.5
        elif self.linkage == "average":
            cross = self.centre[:, at] @ self.value[:, low:high] + self.value[:, at] @ self.centre[:, low:high]
            d = (self.spread[low:high] + self.spread[at] - cross) / 2
        else:
            own, others = self.centre[:, at][None], self.centre[:, low:high].T
            d = self.div.matrix(others, own)[:, 0] if low < at else self.div.matrix(own, others)[0]
        if self.linkage == "ward":
            d *= self.size[low:high] * self.size[at] / (self.size[low:high] + self.size[at])
        d[self.size[low:high] == 0] = np.inf
        return d

    def seek(self, at: int) -> None:
        """The nearest later cluster, the first of equals."""
        if at + 1 >= self.m:
            self.best[at] = np.inf
            return
        d = self.apart(at, at + 1, self.m)
        j = int(d.argmin())
        self.near[at], self.best[at] = self.number[at + 1 + j], d[j]

    def join(self, i: int, j: int, new: int) -> int:
        """Puts the union of two at the end; they die. Returns its place."""
        if self.m == len(self.number):
            a, b = self.number[i], self.number[j]
            self.grow()
            i, j = np.searchsorted(self.number[: self.m], [a, b])
        at, (a, b) = self.m, self.size[[i, j]]
        self.m, n = at + 1, a + b
        if self.div.name == "squaredEuclidean":
            self.spread[at] = (a * self.spread[i] + b * self.spread[j]) / n + a * b / n**2 * ((self.centre[:, i] - self.centre[:, j]) ** 2).sum()
        else:
            self.spread[at] = (a * self.spread[i] + b * self.spread[j]) / n
        mean = lambda v: np.where(v[:, i] == v[:, j], v[:, i], (a * v[:, i] + b * v[:, j]) / n)
        self.value[:, at] = mean(self.value)
        if self.linkage == "average":
            self.centre[:, at] = mean(self.centre)
        else:
            self.centre[:, at] = self.div.inv_grad(self.value[:, at]) if self.div.inv_grad else self.value[:, at]
        self.number[at], self.size[at], self.best[at] = new, n, np.inf
        self.size[[i, j]], self.best[[i, j]] = 0, np.inf
        return at


def agglomerate_sums(x: np.ndarray, linkage: str, div: divergences.Divergence, clusters: int = 1, threshold: float = 0.0) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
    n = len(x)
    c, merges, left = Clusters(x, linkage, div), [], n
    if div.name == "squaredEuclidean" and n > 1:
        # Copies are at distance 0, so they come first: in each set the two smallest numbers, and the set of the smallest first.
        sets: dict[bytes, deque[int]] = {}
        for i, row in enumerate(x + 0.0):
            sets.setdefault(row.tobytes(), deque()).append(i)
        heap = [(q[0], q[1], q) for q in sets.values() if len(q) > 1]
        heapify(heap)
        while heap and left > clusters:
            i, j, q = heappop(heap)
            q.popleft(), q.popleft()
            q.append(n + len(merges))
            merges.append((i, j, q[-1], 0.0))
            left -= 1
            if len(q) > 1:
                heappush(heap, (q[0], q[1], q))
        if merges:
            weight = np.ones(n + len(merges))
            first = np.arange(n + len(merges))
            for i, j, new, _ in merges:
                weight[new], first[new], weight[i], weight[j] = weight[i] + weight[j], first[i], 0, 0
            alive = np.flatnonzero(weight)
            c = Clusters(x[first[alive]], linkage, div)
            c.number, c.size = alive, weight[alive]
    for at in range(c.m):
        c.seek(at)
    while left > max(clusters, 1):
        i = int(c.best[: c.m].argmin())
        v, a, b = float(c.best[i]), int(c.number[i]), int(c.near[i])
        if threshold > 0 and v > threshold:
            break
        j = int(np.searchsorted(c.number[: c.m], b))
        new = n + len(merges)
        at = c.join(i, j, new)
        merges.append((a, b, new, v))
        left -= 1
        near, best = c.near[:at], c.best[:at]
        for lost in np.flatnonzero(((near == a) | (near == b)) & (c.size[:at] > 0)):
            c.seek(int(lost))
        if at:
            d = c.apart(at, 0, at)
            closer = np.flatnonzero(d < best)
            near[closer], best[closer] = new, d[closer]
    root = np.arange(n + len(merges))
    for i, j, new, _ in reversed(merges):
        root[i] = root[j] = root[new]
    _, at, back = np.unique(root[:n], return_index=True, return_inverse=True)
    return np.argsort(np.argsort(at))[back.ravel()] if n else np.zeros(0, dtype=int), merges


def agglomerate_matrix(x: np.ndarray, linkage: str, div: divergences.Divergence, clusters: int = 1, threshold: float = 0.0) -> tuple[np.ndarray, list[tuple[int, int, int, float]]]:
    """``agglomerate`` for linkages that need the matrix: the distances to a merged cluster follow from those to its parts."""
    n = len(x)
    total = 2 * n
    d = np.full((total, total), np.inf)
    first = div.matrix(x, x)
    first = (first + first.T) / 2
    upper = np.triu_indices(n, 1)
    d[:n, :n][upper] = first[upper]
    groups = {i: [i] for i in range(n)}
    size = np.zeros(total)
    size[:n] = 1
    alive = np.zeros(total, dtype=bool)
    alive[:n] = True
    near = d.argmin(1)
    best = d[np.arange(total), near]
    merges: list[tuple[int, int, int, float]] = []
    for new in range(n, total):
        if len(groups) <= clusters or len(groups) < 2:
            break
        i = int(best[:new].argmin())
        j, v = int(near[i]), float(best[i])
        if threshold > 0 and v > threshold:
            break
        groups[new] = groups.pop(i) + groups.pop(j)
        size[new] = size[i] + size[j]
        alive[[i, j]] = False
        others = np.flatnonzero(alive)
        both = lambda c: np.where(others < c, d[others, c], d[c, others])
        if linkage == "average":
            apart = (size[i] * both(i) + size[j] * both(j)) / size[new]
        else:
            apart = (np.minimum if linkage == "single" else np.maximum)(both(i), both(j))
        d[[i, j], :] = d[:, [i, j]] = np.inf
        best[[i, j]] = np.inf
        d[others, new] = apart
        alive[new] = True
        lost = others[np.isin(near[others], (i, j))]
        near[lost] = d[lost].argmin(1)
        best[lost] = d[lost, near[lost]]
        closer = apart < best[others]
        near[others[closer]], best[others[closer]] = new, apart[closer]
        merges.append((i, j, new, v))
    labels = np.zeros(n, dtype=int)
    for c, g in enumerate(sorted(groups.values(), key=min)):
        labels[g] = c
    return labels, merges


@dataclass
class Agglomerative:
    clusters: int = 2
    linkage: str = "average"
    divergence: str = "squaredEuclidean"
    threshold: float = 0.0
    #: Rows at most; ``None``: no limit where sums suffice (ward, centroid, average), else MATRIX_POINTS.
    max_points: int | None = None
    #: Rows (cluster, cluster, new cluster, distance); points come first in the numbering, in the order of ids.
    merges: np.ndarray | None = None

    def fit_transform(self, df: DataFrame, features: str, id_col: str) -> DataFrame:
        div = divergences.make(self.divergence)
        ids, x = bounded_points(df, features, id_col, self.max_points or (None if by_sums(self.linkage, div) else MATRIX_POINTS))
        labels, merges = agglomerate(np.array(x), self.linkage, div, self.clusters, self.threshold)
        self.merges = np.array(merges, dtype=float).reshape(-1, 4)
        return result(df, ids, labels, id_col)
