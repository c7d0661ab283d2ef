"""Centre updates: one job a step. Points are reduced to k sums in each partition before anything is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halocline.functions.divergences import Divergence
from halocline.operators.assign import features_of, nearest, stack
from halocline.operators.graph import cut


@dataclass
class Sums:
    """Per cluster: weight, number of points, weighted sum (of gradients, or of values) and weighted cost."""

    weight: np.ndarray
    points: np.ndarray
    total: np.ndarray
    cost: np.ndarray

    def mean(self) -> np.ndarray:
        return self.total / np.maximum(self.weight, 1e-300)[:, None]


Membership = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def cluster_sums(df: DataFrame, features: str, k: int, membership: Membership, value: Callable[[np.ndarray], np.ndarray], weight: str | None = None) -> Sums:
    """``membership``: points (n, d) -> (memberships (n, k), cost (n, k)), both weighted into the sums.

    Each partition yields k rows however many points it has; k * (d + 3) numbers reach the driver.
    """
    x = df.select(features_of(df, features).alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            points, w = stack(batch["x"]), batch["w"].to_numpy()
            part, cost = membership(points)
            part = part * w[:, None]
            new = np.column_stack([part.sum(0), (part > 0).sum(0), (part * cost).sum(0), part.T @ value(points)])
            held = new if held is None else held + new
        if held is not None:
            yield pd.DataFrame({"c": np.arange(k, dtype=np.int32), "s": list(held)})

    table = added_up(x.mapInPandas(partial, "c int, s array<double>"), k)
    if table is None:
        raise ValueError("no points")
    return Sums(table[:, 0], table[:, 1].astype(int), table[:, 3:], table[:, 2])


def added_up(partial: DataFrame, k: int) -> np.ndarray | None:
    """Element-wise sums of (c, s) rows as a (k, length) matrix; None without rows. ``partial`` holds k rows a partition."""
    rows = partial.select("c", F.posexplode("s").alias("p", "v")).groupBy("c", "p").agg(F.sum("v").alias("v")).collect()
    if not rows:
        return None
    table = np.zeros((k, max(r["p"] for r in rows) + 1))
    for r in rows:
        table[r["c"], r["p"]] = r["v"]
    return table


def hard(centres: np.ndarray, div: Divergence) -> Membership:
    def one(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, d = nearest(points, centres, div)
        part = np.zeros((len(points), len(centres)))
        part[np.arange(len(points)), c] = 1.0
        return part, np.where(part > 0, d[:, None], 0.0)

    return one


def soft(centres: np.ndarray, div: Divergence, beta: float, least: float = 1e-10) -> Membership:
    def share(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = div.matrix(points, centres)
        return soft_memberships(d, beta, least), d

    return share


def soft_memberships(d: np.ndarray, beta: float, least: float = 1e-10) -> np.ndarray:
    p = np.exp(-beta * (d - d.min(1, keepdims=True)))
    s = p.sum(1, keepdims=True)
    p = np.where(s > 1e-100, p / s, 1 / d.shape[1])
    p = np.maximum(p, least)
    return p / p.sum(1, keepdims=True)


def new_centres(sums: Sums, old: np.ndarray, div: Divergence, centroid: str = "dual") -> np.ndarray:
    """Centres in their slots; an empty cluster keeps its old centre."""
    mean = sums.mean()
    if centroid == "dual" and div.inv_grad is not None:
        mean = div.inv_grad(mean)
    return np.where((sums.weight > 0)[:, None], mean, old)


def weighted_medians(df: DataFrame, features: str, cluster: str, weight: str | None = None) -> DataFrame:
    """(cluster, pos, median): the first value whose running weight reaches half; the mean of two at exactly half."""
    rows = df.select(F.col(cluster).alias("cluster"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"), F.posexplode(features_of(df, features)).alias("pos", "v"))
    return running_medians(rows.groupBy("cluster", "pos", "v").agg(F.sum("w").alias("w")))


#: Ranges into which the different values of one (cluster, pos) are dealt; only one of them is sorted.
MEDIAN_PARTS = 64


def running_medians(values: DataFrame, parts: int = MEDIAN_PARTS) -> DataFrame:
    """The weighted medians of (cluster, pos, v, w), one row for each different value.

    Approximate quantiles cut the values of a (cluster, pos) into ``parts`` (2 or more) ranges. The ranges' weights tell in which of
    them the running weight reaches half, and only that one is sorted, so a task holds about one in ``parts`` of the
    values of a key. The medians are exact wherever the cuts fall, if all steps see the same ones: approximate quantiles
    may differ from one run to the next, so the values are written once with the number of their range.
    """
    key = ["cluster", "pos"]
    cuts = values.groupBy(*key).agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 100 * parts).alias("cuts"))
    part = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    placed = cut(values.join(cuts, key).select(*key, "v", "w", part.alias("part")))
    order = Window.partitionBy(*key).orderBy("part")
    ranges = placed.groupBy(*key, "part").agg(F.sum("w").alias("weight"), F.min("v").alias("low"))
    ranges = ranges.withColumn("upto", F.sum("weight").over(order)).withColumn("all", F.sum("weight").over(Window.partitionBy(*key))).withColumn("after", F.lead("low").over(order))
    # The last range holds half at the latest, whatever rounding does to the sums.
    at = ranges.where((F.col("upto") >= F.col("all") / 2 - 1e-10) | F.col("after").isNull())
    at = at.groupBy(*key).agg(F.min(F.struct("part", (F.col("upto") - F.col("weight")).alias("before"), "all", "after")).alias("r")).select(*key, "r.*")
    within = Window.partitionBy(*key).orderBy("v")
    run = placed.join(at, [*key, "part"]).withColumn("upto", F.col("before") + F.sum("w").over(within)).withColumn("lead", F.lead("v").over(within))
    run = run.withColumn("next", F.coalesce("lead", "after"))
    reached = run.where((F.col("upto") >= F.col("all") / 2 - 1e-10) | F.col("lead").isNull())
    first = reached.groupBy(*key).agg(F.min(F.struct("v", "upto", "all", "next")).alias("m"))
    at_half = F.abs(F.col("m.upto") - F.col("m.all") / 2) <= 1e-10
    return first.select(*key, F.when(at_half & F.col("m.next").isNotNull(), (F.col("m.v") + F.col("m.next")) / 2).otherwise(F.col("m.v")).alias("median"))
