"""Nearest-centre assignment: one pass over the points, no shuffle, centres travel with the plan."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import UserDefinedType

from halocline.errors import UnknownName
from halocline.functions.divergences import Divergence, between, to_centre
from halocline.telemetry import emit

#: Up to this many centre coordinates, distances are unrolled into generated code; above, Arrow batches and NumPy.
UNROLLED = 120
#: Centre rows that meet one Arrow batch at a time.
CHUNK = 1024
#: Chunks of the strategy ``chunked``; least and largest chunk of ``adaptive``, and the share of memory it takes;
#: centre coordinates above which sending them whole is worth a warning (about 100 MB).
CHUNKED, ADAPTIVE_LEAST, ADAPTIVE_MOST, MEMORY_SHARE, WARN_ABOVE = 100, 10, 1000, 0.1, 12_500_000

STRATEGIES = ["auto", "expression", "arrow", "accelerated", "crossJoin", "broadcast", "broadcastUDF", "chunked", "adaptive"]


def memory_bytes(text: str) -> int:
    """A size as Spark's settings write it: a number, or one with a unit from b to t; bare numbers are MB."""
    text = text.strip().lower().removesuffix("b") or "0"
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    return int(text[:-1]) * unit[text[-1]] if text[-1] in unit else int(text) << 20


def adaptive_chunk(df: DataFrame, dim: int) -> int:
    """Centres that fit a tenth of an executor's unified memory, twice over."""
    conf = df.sparkSession.sparkContext.getConf()
    free = memory_bytes(conf.get("spark.executor.memory", "1g")) * float(conf.get("spark.memory.fraction", "0.6")) * MEMORY_SHARE
    return int(min(max(free // (8 * dim * 2), ADAPTIVE_LEAST), ADAPTIVE_MOST))


def features_of(df: DataFrame, col: str) -> Column:
    """The column as array<double>: arrays are cast, ML vectors unpacked."""
    if isinstance(df.schema[col].dataType, UserDefinedType):
        from pyspark.ml.functions import vector_to_array

        return vector_to_array(F.col(col))
    return F.col(col).cast("array<double>")


def nearest(x: np.ndarray, centres: np.ndarray, div: Divergence, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(index, distance) of the nearest centre; the first of equals; all-NaN rows go to 0."""
    best, least = np.zeros(len(x), dtype=np.int32), np.full(len(x), np.inf)
    for at in range(0, len(centres), chunk):
        d = div.matrix(x, centres[at : at + chunk])
        d = np.where(np.isnan(d), np.inf, d)
        i = d.argmin(1)
        v = d[np.arange(len(x)), i]
        closer = v < least
        best[closer], least[closer] = i[closer] + at, v[closer]
    return best, least


def nearest_pruned(x: np.ndarray, centres: np.ndarray, div: Divergence) -> tuple[np.ndarray, np.ndarray]:
    """``nearest`` for squared Euclidean distance: a centre at least twice as far from a row's best as that row is skipped."""
    between = np.sqrt(2 * div.matrix(centres, centres))
    best, least = np.zeros(len(x), dtype=np.int32), div.matrix(x, centres[:1])[:, 0]
    for i in range(1, len(centres)):
        rows = np.flatnonzero(between[best, i] < 2 * np.sqrt(2 * least) + 1e-9)
        if len(rows):
            d = div.matrix(x[rows], centres[i : i + 1])[:, 0]
            closer = d < least[rows]
            best[rows[closer]], least[rows[closer]] = i, d[closer]
    return best, least


def stack(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, 1))


def distances(df: DataFrame, features: str, centres: np.ndarray, div: Divergence) -> Column:
    """Array column: D to every centre."""
    k, d = centres.shape
    x = features_of(df, features)
    if k * d <= UNROLLED:
        return F.array(*[to_centre(div, x, d, c) for c in centres])

    @F.pandas_udf("array<double>")
    def all_distances(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(list(div.matrix(stack(values), centres)))

    return all_distances(x)


def assign(df: DataFrame, features: str, centres: np.ndarray, div: Divergence, strategy: str = "auto", cluster: str = "cluster", distance: str | None = None) -> DataFrame:
    """``df`` with the nearest centre's number and, if named, the distance.

    Strategies: ``expression`` (unrolled, generated code), ``arrow`` (NumPy over Arrow batches, centres in chunks),
    ``accelerated`` (arrow, with centres skipped by the triangle inequality), ``crossJoin`` (a broadcast row of all centres, the least within each row),
    ``broadcast`` (arrow; warns of very many centres), ``chunked`` and ``adaptive`` (arrow, in chunks of a fixed size or one that fits the executors' memory), ``auto`` (expression or arrow).
    """
    k, d = centres.shape
    x = features_of(df, features)
    chunk = {"chunked": CHUNKED, "adaptive": adaptive_chunk(df, d) if strategy == "adaptive" else 0}.get(strategy, CHUNK)
    if strategy in ("broadcast", "broadcastUDF") and k * d > WARN_ABOVE:
        emit("warning", message=f"{k} centres of {d} dimensions travel with every task")
    if strategy in ("auto", "broadcast", "broadcastUDF", "chunked", "adaptive"):
        strategy = "expression" if k * d <= UNROLLED and strategy == "auto" else "arrow"
    if strategy == "expression":
        out = df.withColumn("__all", distances(df, features, centres, div)).withColumn("__least", F.array_min("__all"))
        found = F.coalesce(F.array_position("__all", F.col("__least")) - 1, F.lit(0)).cast("int")
        out = out.withColumn(cluster, found)
        return (out.withColumn(distance, F.col("__least")) if distance else out).drop("__all", "__least")
    if strategy == "accelerated" and div.name != "squaredEuclidean":
        raise ValueError("the accelerated strategy needs squared Euclidean distance")
    if strategy in ("arrow", "accelerated"):
        search = partial(nearest, chunk=chunk) if strategy == "arrow" else nearest_pruned

        @F.pandas_udf("struct<c:int,d:double>")
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for values in batches:
                c, v = search(stack(values), centres, div)
                yield pd.DataFrame({"c": c, "d": v})

        out = df.withColumn("_n", find(x)).withColumn(cluster, F.col("_n.c"))
        return (out.withColumn(distance, F.col("_n.d")) if distance else out).drop("_n")
    if strategy == "crossJoin":
        table = df.sparkSession.createDataFrame([([(i, c.tolist()) for i, c in enumerate(centres)],)], "__centres array<struct<c:int,x:array<double>>>")
        each = F.transform("__centres", lambda t: F.struct(F.coalesce(between(div, F.col("__x"), t["x"]), F.lit(float("inf"))).alias("d"), t["c"].alias("c")))
        out = df.withColumn("__x", x).crossJoin(F.broadcast(table)).withColumn("__n", F.array_min(each)).withColumn(cluster, F.col("__n.c"))
        return (out.withColumn(distance, F.col("__n.d")) if distance else out).drop("__x", "__centres", "__n")
    raise UnknownName("strategy", strategy, STRATEGIES)
