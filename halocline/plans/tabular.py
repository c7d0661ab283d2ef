"""Clusterings of tables of counts: co-clustering of matrix cells, and the information bottleneck."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.functions import divergences
from halocline.functions.divergences import between
from halocline.operators.assign import features_of
from halocline.operators.graph import cut


@dataclass
class CoClustering:
    """Rows and columns of a sparse matrix (row, col, value), clustered together.

    A round: means of the blocks, the objective, then rows and columns move with the same means. Cells are reduced to
    one row of sums for each matrix row (or column) before the shuffle. Start: hashes of the indices.
    """

    row_clusters: int = 2
    col_clusters: int = 2
    row: str = "row"
    col: str = "col"
    value: str = "value"
    divergence: str = "squaredEuclidean"
    max_iter: int = 100
    tolerance: float = 1e-6
    regularization: float = 0.01
    seed: int = 42
    blocks: np.ndarray | None = None
    objective: list[float] = field(default_factory=list)
    rows: DataFrame | None = None
    cols: DataFrame | None = None

    def block_means(self, cells: DataFrame, rows: DataFrame, cols: DataFrame) -> np.ndarray:
        """Mean of each block; one without cells has the value ``regularization``."""
        out = np.full((self.row_clusters, self.col_clusters), self.regularization)
        for b in cells.join(rows, "r").join(cols, "c").groupBy("rc", "cc").agg(F.avg("v").alias("m")).collect():
            out[b["rc"], b["cc"]] = b["m"]
        return out

    def move(self, cells: DataFrame, own: str, other: DataFrame, across: str, blocks: np.ndarray) -> DataFrame:
        """(own, cost array): cost of each candidate cluster, given the clusters of the other side."""
        div = divergences.make(self.divergence)

        def cost(means: np.ndarray) -> Column:
            at = F.get(F.array(*[F.lit(float(m)) for m in means]), F.col(across))
            return F.sum(between(div, F.array("v"), F.array(at)))

        key = {"r": "c", "c": "r"}[own]
        return cells.join(other, key).groupBy(own).agg(F.array(*[cost(m) for m in blocks]).alias("cost"))

    def fit(self, df: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> CoClustering:
        """``rows`` (r, rc) and ``cols`` (c, cc): clusters to start from; every index of ``df`` must be there."""
        cells = df.select(F.col(self.row).cast("long").alias("r"), F.col(self.col).cast("long").alias("c"), F.col(self.value).cast("double").alias("v"))
        first = lambda x, k: F.pmod(F.xxhash64(x, F.lit(self.seed)), F.lit(k)).cast("int")
        self.rows = cut(cells.select("r").distinct().withColumn("rc", first("r", self.row_clusters)) if rows is None else rows)
        self.cols = cut(cells.select("c").distinct().withColumn("cc", first("c", self.col_clusters)) if cols is None else cols)
        self.objective = []
        for _ in range(self.max_iter):
            self.blocks = self.block_means(cells, self.rows, self.cols)
            costs = cut(self.move(cells, "r", self.cols, "cc", self.blocks))
            self.objective.append(float(costs.join(self.rows, "r").agg(F.sum(F.get("cost", F.col("rc")))).first()[0] or 0.0))
            if len(self.objective) > 1 and abs(self.objective[-2] - self.objective[-1]) < self.tolerance:
                break
            best = (F.array_position("cost", F.array_min("cost")) - 1).cast("int")
            moved = costs.select("r", best.alias("rc"))
            self.cols = cut(self.move(cells, "c", self.rows, "rc", self.blocks.T).select("c", best.alias("cc")))
            self.rows = cut(moved)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds row_cluster, col_cluster and the block's mean; null for an index that fit() did not see."""
        out = df.join(self.rows.toDF(self.row, "row_cluster"), self.row, "left").join(self.cols.toDF(self.col, "col_cluster"), self.col, "left")
        flat = F.array(*[F.lit(float(v)) for v in self.blocks.ravel()])
        return out.withColumn("block_mean", F.get(flat, F.col("row_cluster") * self.col_clusters + F.col("col_cluster")))


@dataclass
class InformationBottleneck:
    """Compresses X (a hash of the features into bins squared) to k clusters that keep what X tells of Y.

    The joint counts are one aggregate; the loop runs on the driver over at most bins ** 2 x ``max_relevance`` numbers.
    Without ``relevance``, Y is X. Minimises I(X;T) - beta I(T;Y).
    """

    k: int = 2
    features: str = "features"
    relevance: str | None = None
    beta: float = 1.0
    max_iter: int = 100
    tol: float = 1e-6
    bins: int = 20
    seed: int = 42
    max_relevance: int = 1000
    prediction: str = "prediction"
    probability: str = "probabilities"
    encoder: np.ndarray | None = None
    decoder: np.ndarray | None = None
    objective: list[float] = field(default_factory=list)

    def bin(self, df: DataFrame) -> Column:
        return F.pmod(F.xxhash64(features_of(df, self.features)), F.lit(self.bins**2)).cast("int")

    def fit(self, df: DataFrame) -> InformationBottleneck:
        y = F.col(self.relevance).cast("string") if self.relevance else self.bin(df).cast("string")
        xy = df.select(self.bin(df).alias("x"), y.alias("y"))
        most = max(self.max_relevance, self.bins**2)
        names = sorted(r[0] or "" for r in xy.select("y").distinct().limit(most + 1).collect())
        if len(names) > most:
            raise ValueError(f"more than {most} values of relevance")
        counts, at = np.zeros((self.bins**2, len(names))), {v: i for i, v in enumerate(names)}
        for r in xy.groupBy("x", "y").count().collect():
            counts[r["x"], at[r["y"] or ""]] = r["count"]
        seen = counts.sum(1) > 0
        joint = counts[seen] / counts.sum()
        found = bottleneck(joint, self.k, self.beta, self.max_iter, self.tol, self.seed)
        self.encoder = np.tile(found[0].T @ joint.sum(1), (self.bins**2, 1))  # an unseen bin takes p(t)
        self.encoder[seen], self.decoder, self.objective = found[0], found[1], found[2]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the memberships and the likeliest cluster; the encoder has bins ** 2 rows, so it is broadcast."""
        table = df.sparkSession.createDataFrame([(i, p.tolist(), int(p.argmax())) for i, p in enumerate(self.encoder)], f"_bin int, {self.probability} array<double>, {self.prediction} int")
        return df.withColumn("_bin", self.bin(df)).join(F.broadcast(table), "_bin", "left").drop("_bin")


def information(joint: np.ndarray) -> float:
    """Mutual information in nats of a joint distribution."""
    p = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
    on = joint > 0
    return float((joint[on] * np.log(joint[on] / p[on])).sum())


def bottleneck(joint: np.ndarray, k: int, beta: float = 1.0, rounds: int = 100, tol: float = 1e-6, seed: int = 42, eps: float = 1e-10) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """(p(t|x), p(y|t), objectives) by alternating updates from a random start."""
    px = joint.sum(1)
    y_x = joint / px[:, None]
    t_x = np.random.default_rng(seed).dirichlet(np.ones(k), len(px))
    history: list[float] = []
    for _ in range(rounds):
        t = px @ t_x
        y_t = (t_x * px[:, None]).T @ y_x / np.maximum(t, eps)[:, None]
        kl = (y_x * np.log(y_x + eps)).sum(1)[:, None] - y_x @ np.log(y_t + eps).T
        logit = np.log(t + eps) - beta * kl
        t_x = np.exp(logit - logit.max(1, keepdims=True))
        t_x /= t_x.sum(1, keepdims=True)
        history.append(information(t_x * px[:, None]) - beta * information(t_x.T @ joint))
        if len(history) > 1 and abs(history[-2] - history[-1]) < tol:
            break
    return t_x, y_t, history
