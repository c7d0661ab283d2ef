"""Methods that cluster a bounded sample or a set of landmarks, then every row by it; and capacity-bound assignment."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.functions import divergences, mercer
from halocline.operators.assign import assign, features_of, stack
from halocline.plans.bounded import MAX_POINTS, bounded_points, build_medoids, pairwise, result, swap_medoids
from halocline.plans.estimators import CentreModel, KMeans
from halocline.plans.lloyd import hashed_points

#: The divergence whose nearest centre is that of the metric.
METRICS = {"euclidean": "se", "manhattan": "l1", "cosine": "spherical"}


@dataclass
class Clara:
    """PAM on each of several samples, drawn by hashes; the medoids of the lowest cost over all rows stay.

    ``sample_size`` -1 is 40 + 2k; a sample of nine tenths of the rows or more is replaced by all of them.
    """

    k: int = 2
    metric: str = "euclidean"
    samples: int = 5
    sample_size: int = -1
    max_iter: int = 20
    seed: int = 0
    features: str = "features"
    prediction: str = "prediction"
    cost: float = float("inf")

    def fit(self, df: DataFrame) -> CentreModel:
        n, best = df.count(), None
        size = min(n, self.sample_size if self.sample_size > 0 else 40 + 2 * self.k)
        runs, size = (1, n) if size >= 0.9 * n else (self.samples, size)
        if size > MAX_POINTS:
            raise ValueError(f"a sample of more than {MAX_POINTS} rows")
        div = divergences.make(METRICS[self.metric])
        for run in range(runs):
            x = hashed_points(df, self.features, size, self.seed + run)
            d = pairwise(x, self.metric)
            medoids = x[swap_medoids(d, build_medoids(d, min(self.k, len(x))), self.max_iter)]
            near = assign(df, self.features, medoids, div, distance="_d")
            apart = F.sqrt(2 * F.greatest("_d", F.lit(0.0))) if self.metric == "euclidean" else F.col("_d")
            cost = float(near.agg(F.sum(apart)).first()[0])
            if best is None or cost < self.cost:
                best, self.cost = medoids, cost
        return CentreModel(best, METRICS[self.metric], self.features, self.prediction)


@dataclass
class NystromSpectral:
    """Spectral clustering of any number of rows by landmarks.

    C is a row's affinity to the landmarks and W that between landmarks, so C W^-1 C' stands for the full affinity.
    Degrees and the landmark-sized Gram matrix are sums over the partitions; the embedding is a projection of each row.
    """

    k: int = 2
    gamma: float = 1.0
    landmarks: int = 200
    seed: int = 42
    features: str = "features"
    prediction: str = "prediction"

    def fit_transform(self, df: DataFrame) -> DataFrame:
        marks = hashed_points(df, self.features, self.landmarks, self.seed)
        values, vectors = np.linalg.eigh(mercer.gram(marks, marks, "rbf", self.gamma))
        on = values > 1e-8 * values.max()
        half = vectors[:, on] / np.sqrt(values[on])
        x = df.select(features_of(df, self.features).alias("x"))
        m = int(on.sum())

        def reduced(weigh) -> np.ndarray:
            def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                held = None
                for b in batches:
                    if len(b):
                        new = weigh(mercer.gram(stack(b["x"]), marks, "rbf", self.gamma) @ half)
                        held = new if held is None else held + new
                if held is not None:
                    yield pd.DataFrame({"p": np.arange(held.size), "v": held.ravel()})

            rows = x.mapInPandas(partial, "p long, v double").groupBy("p").agg(F.sum("v").alias("v")).collect()
            out = np.zeros(len(rows))
            for r in rows:
                out[r["p"]] = r["v"]
            return out

        total = reduced(lambda z: z.sum(0))

        def normed(z: np.ndarray) -> np.ndarray:
            return z / np.sqrt(np.maximum(z @ total, 1e-12))[:, None]

        gram = reduced(lambda z: normed(z).T @ normed(z)).reshape(m, m)
        top = np.linalg.eigh(gram)[1][:, ::-1][:, : self.k]

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                e = normed(mercer.gram(stack(b), marks, "rbf", self.gamma) @ half) @ top
                yield pd.Series(list(e / np.maximum(np.sqrt((e * e).sum(1, keepdims=True)), 1e-12)))

        spread = df.withColumn("_embedding", embed(features_of(df, self.features)))
        return KMeans(k=self.k, features="_embedding", prediction=self.prediction, seed=self.seed).fit(spread).transform(spread).drop("_embedding")


def fill_capacities(d: np.ndarray, least: int, most: int, rounds: int = 100) -> np.ndarray:
    """Clusters for a cost matrix (n, k) with sizes from ``least`` to ``most``.

    Rows in the order of their least cost take the nearest cluster with room; then each cluster below ``least`` takes the
    row that costs least to move, from clusters that can spare one.
    """
    n, k = d.shape
    if k * most < n or k * least > n:
        raise ValueError(f"{n} rows do not fit {k} clusters of {least} to {most}")
    labels = np.zeros(n, dtype=int)
    room, open_to, left = np.full(k, most), np.ones(k, dtype=bool), np.argsort(d.min(1), kind="stable")
    while len(left):
        # All go to their nearest open cluster, until one is full; so there are k rounds at most.
        want = np.where(open_to, d[left], np.inf).argmin(1)
        last = len(left)
        for c in np.flatnonzero(open_to):
            mine = np.flatnonzero(want == c)
            if len(mine) >= room[c]:
                last = min(last, int(mine[room[c] - 1]) + 1 if room[c] else 0)
        labels[left[:last]] = want[:last]
        room -= np.bincount(want[:last], minlength=k)
        open_to, left = room > 0, left[last:]
    for _ in range(rounds):
        sizes = np.bincount(labels, minlength=k)
        short = np.flatnonzero(sizes < least)
        if not len(short):
            break
        for c in short:
            spare = np.flatnonzero((np.bincount(labels, minlength=k)[labels] > least) & (labels != c))
            if len(spare):
                labels[spare[(d[spare, c] - d[spare, labels[spare]]).argmin()]] = c
    return labels


@dataclass
class HardBalancedKMeans:
    """K-means with hard cluster sizes. Greedy filling is sequential, so points and costs are held on the driver: n (d + k) numbers.

    An error above ``max_points`` rows, if given.
    """

    k: int = 2
    min_size: int = 1
    max_size: int = 0
    divergence: str = "squaredEuclidean"
    max_iter: int = 50
    tol: float = 1e-4
    seed: int = 0
    max_points: int | None = None

    def fit_transform(self, df: DataFrame, features: str, id_col: str) -> DataFrame:
        ids, rows = bounded_points(df, features, id_col, self.max_points)
        x, div = np.array(rows), divergences.make(self.divergence)
        most = self.max_size or int(np.ceil(1.1 * len(x) / self.k))
        centres = hashed_points(df, features, self.k, self.seed)
        for _ in range(self.max_iter):
            labels = fill_capacities(div.matrix(x, centres), self.min_size, most)
            new = np.array([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(len(centres))])
            moved = float(np.sqrt(((new - centres) ** 2).sum(1)).max())
            centres = new
            if moved < self.tol:
                break
        return result(df, ids, labels, id_col)
