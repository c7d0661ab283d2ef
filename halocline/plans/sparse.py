"""Sparse points: only stored values are touched; an absent value is zero.

For a sum over dimensions, D(x, c) = D(0, c) + the sum over stored values of f(x_i, c_i) - f(0, c_i), so a row costs its
stored values times k. Sums of gradients use the same identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.functions.divergences import EPSILON
from halocline.operators.assign import features_of
from halocline.operators.update import running_medians
from halocline.plans.lloyd import LloydResult


@dataclass(frozen=True)
class SparseDivergence:
    name: str
    #: One dimension: (x, centre) -> D. ``None`` for the cosine, which is no such sum.
    term: Callable[[np.ndarray, np.ndarray], np.ndarray] | None
    grad: Callable[[np.ndarray], np.ndarray] | None = None
    inv_grad: Callable[[np.ndarray], np.ndarray] | None = None


def make(name: str, smoothing: float = EPSILON) -> SparseDivergence:
    """squaredEuclidean, kl (values below the smoothing are raised to it), l1 or spherical."""

    def kl(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        p, q = np.maximum(p, smoothing), np.maximum(q, smoothing)
        return p * np.log(p / q) - p + q

    found = {
        "squaredEuclidean": SparseDivergence("squaredEuclidean", lambda x, c: 0.5 * (x - c) ** 2, lambda x: x, lambda t: t),
        "kl": SparseDivergence("kl", kl, lambda x: np.log(np.maximum(x, smoothing)) + 1, lambda t: np.exp(t - 1)),
        "l1": SparseDivergence("l1", lambda x, c: np.abs(x - c)),
        "spherical": SparseDivergence("spherical", None),
    }
    name = {"se": "squaredEuclidean", "cosine": "spherical"}.get(name, name)
    if name not in found:
        raise ValueError(f"no sparse form of {name!r}; one of {sorted(found)}")
    return found[name]


def stored(df: DataFrame, features: str) -> Column:
    """(i, v) arrays of the values that are not zero; ML vectors and plain arrays."""
    pairs = F.transform(features_of(df, features), lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    return F.filter(pairs, lambda p: p["v"] != 0)


def sparsity(df: DataFrame, features: str) -> float:
    """Share of values that are not zero, over all rows."""
    full = df.select(F.size(features_of(df, features)).alias("n"), F.size(stored(df, features)).alias("s")).agg(F.sum("s"), F.sum("n")).first()
    return float(full[0] or 0) / max(float(full[1] or 0), 1.0)


def _flat(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each stored value, index, value), from the column's buffers: no Python object for each value."""
    if rows.null_count:
        raise ValueError("null features")
    pairs = rows.flatten()
    at = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy())
    return at, pairs.field("i").to_numpy().astype(int), pairs.field("v").to_numpy(zero_copy_only=False)


def matrix(n: int, at: np.ndarray, i: np.ndarray, v: np.ndarray, centres: np.ndarray, div: SparseDivergence) -> np.ndarray:
    """(n, k) distances of n sparse rows; one centre at a time, so memory is the batch's stored values."""
    out = np.zeros((n, len(centres)))
    if div.term is None:
        norm, far = np.sqrt(np.bincount(at, v * v, n)), np.sqrt((centres * centres).sum(1))
        for j, c in enumerate(centres):
            safe = (norm > EPSILON) & (far[j] > EPSILON)
            out[:, j] = np.where(safe, 1 - np.clip(np.bincount(at, v * c[i], n) / np.maximum(norm * far[j], 1e-300), -1, 1), 1.0)
        return out
    for j, c in enumerate(centres):
        out[:, j] = div.term(np.zeros(len(c)), c).sum() + np.bincount(at, div.term(v, c[i]) - div.term(np.zeros(len(i)), c[i]), n)
    return out


def assign_sparse(df: DataFrame, features: str, centres: np.ndarray, div: SparseDivergence, cluster: str = "cluster", distance: str | None = None) -> DataFrame:
    """``df`` with the nearest centre's number (the first of equals) and, if named, the distance."""

    @F.arrow_udf("struct<c:int,d:double>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            d = matrix(len(rows), *_flat(rows), centres, div)
            yield pa.StructArray.from_arrays([pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["c", "d"])

    out = df.withColumn("_n", find(stored(df, features))).withColumn(cluster, F.col("_n.c"))
    return (out.withColumn(distance, F.col("_n.d")) if distance else out).drop("_n")


def sparse_medians(df: DataFrame, features: str, cluster: str) -> DataFrame:
    """(cluster, pos, median) where a value is stored; the zeros of a position are one value with their count as weight."""
    long = df.select(F.col(cluster).alias("cluster"), F.explode(stored(df, features)).alias("p")).select("cluster", F.col("p.i").alias("pos"), F.col("p.v").alias("v"))
    values = long.groupBy("cluster", "pos", "v").agg(F.count("*").cast("double").alias("w"))
    sizes = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").cast("double").alias("n"))
    zeros = values.groupBy("cluster", "pos").agg(F.sum("w").alias("s")).join(sizes, "cluster").where("n > s").select("cluster", "pos", F.lit(0.0).alias("v"), (F.col("n") - F.col("s")).alias("w"))
    return running_medians(values.union(zeros))


@dataclass
class SparseKMeans:
    """Lloyd's loop over stored values. ``auto`` is sparse where less than ``threshold`` of all values are stored."""

    k: int = 2
    divergence: str = "squaredEuclidean"
    mode: str = "auto"
    threshold: float = 0.3
    max_iter: int = 20
    tol: float = 1e-4
    seed: int = 0
    features: str = "features"
    prediction: str = "prediction"
    initial_centres: np.ndarray | None = None
    summary: LloydResult | None = None

    def fit(self, df: DataFrame) -> SparseKMeans:
        from halocline.plans.estimators import KMeans
        from halocline.plans.lloyd import hashed_points

        start = self.initial_centres if self.initial_centres is not None else hashed_points(df, self.features, self.k, self.seed)
        if self.mode == "dense" or (self.mode == "auto" and sparsity(df, self.features) >= self.threshold):
            self.summary = KMeans(self.k, self.divergence, max_iter=self.max_iter, tol=self.tol, features=self.features, initial_centres=start, empty="keep").fit(df).summary
            return self
        div, r = make(self.divergence), LloydResult(np.asarray(start, dtype=float), 0)
        for _ in range(self.max_iter):
            new, cost = self.update(df, r.centres, div)
            moved = float(np.sqrt(((new - r.centres) ** 2).sum(1)).max())
            r.centres, r.iterations = new, r.iterations + 1
            r.distortion.append(cost)
            r.movement.append(moved)
            if moved < self.tol:
                r.converged = True
                break
        self.summary = r
        return self

    def update(self, df: DataFrame, centres: np.ndarray, div: SparseDivergence) -> tuple[np.ndarray, float]:
        """New centres and the cost of the old ones; an empty cluster keeps its centre."""
        k, dim = centres.shape
        grad = div.grad or (lambda x: x)
        zero = float(grad(np.zeros(1))[0])

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A cluster's rows, cost and sums side by side; the assignment is not handed on.
            held = np.zeros((k, dim + 2))
            for b in batches:
                at, i, v = _flat(b.column(0))
                d = matrix(b.num_rows, at, i, v, centres, div)
                c, norm = d.argmin(1), np.sqrt(np.bincount(at, v * v, b.num_rows)) if div.term is None else np.ones(b.num_rows)
                held[:, dim] += np.bincount(c, minlength=k)
                held[:, dim + 1] += np.bincount(c, d.min(1), k)
                if div.name != "l1":
                    held[:, :dim] += np.bincount(c[at] * dim + i, (grad(v) - zero) / np.maximum(norm, EPSILON)[at], k * dim).reshape(k, dim)
            c, p = np.nonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(held[c, p])], ["c", "p", "v"])

        total = np.zeros((k, dim + 2))
        for row in df.select(stored(df, self.features).alias("x")).mapInArrow(partial, "c int, p int, v double").groupBy("c", "p").agg(F.sum("v").alias("v")).collect():
            total[row["c"], row["p"]] = row["v"]
        n, cost, new = total[:, dim], float(total[:, dim + 1].sum()), centres.copy()
        if div.name == "l1":
            new[n > 0] = 0.0
            for row in sparse_medians(assign_sparse(df, self.features, centres, div, "_c"), self.features, "_c").collect():
                new[row["cluster"], row["pos"]] = row["median"]
            return new, cost
        mean = total[:, :dim] / np.maximum(n, 1)[:, None] + zero
        new[n > 0] = (div.inv_grad(mean) if div.inv_grad else mean)[n > 0]
        return new, cost

    def transform(self, df: DataFrame) -> DataFrame:
        return assign_sparse(df, self.features, self.summary.centres, make(self.divergence), self.prediction)
