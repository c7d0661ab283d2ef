"""Entropy, divergences of distributions and mutual information over grouped tables (natural logarithms, or bits)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xlogy(p: Column, ratio: Column) -> Column:
    """p * ln(ratio), and 0 where p is 0."""
    return F.when(p > 0, p * F.log(ratio)).otherwise(0.0)


def joint(df: DataFrame, x: str, y: str, weight: str | None = None) -> DataFrame:
    """(x, y, p): the joint distribution of two columns."""
    grouped = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.sum(F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    total = grouped.agg(F.sum("w")).first()[0]
    return grouped.select("x", "y", (F.col("w") / F.lit(total)).alias("p"))


def entropy(p: DataFrame, col: str = "p", bits: bool = False) -> DataFrame:
    return p.agg((-F.sum(xlogy(F.col(col), F.col(col))) / (math.log(2) if bits else 1.0)).alias("entropy"))


def mutual_information(table: DataFrame) -> DataFrame:
    """One row: h_x, h_y, h_xy, mutual_information, h_y_given_x of a joint table."""
    px = table.groupBy("x").agg(F.sum("p").alias("px"))
    py = table.groupBy("y").agg(F.sum("p").alias("py"))
    h = lambda d, c: d.agg((-F.sum(xlogy(F.col(c), F.col(c)))).alias("h")).first()[0] or 0.0
    hx, hy, hxy = h(px, "px"), h(py, "py"), h(table, "p")
    row = (hx, hy, hxy, hx + hy - hxy, hxy - hx)
    return table.sparkSession.createDataFrame([row], "h_x double, h_y double, h_xy double, mutual_information double, h_y_given_x double")


def kl_divergence(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """Sum of p ln(p / q) over keys of both (p, q columns named p); infinite where q lacks a key of p."""
    both = p.select(key, F.col("p").alias("_p")).join(q.select(key, F.col("p").alias("_q")), key, "left")
    return both.agg(F.sum(F.when((F.col("_p") > 0) & F.coalesce(F.col("_q") <= 0, F.lit(True)), float("inf")).otherwise(xlogy(F.col("_p"), F.col("_p") / F.col("_q")))).alias("kl"))


def js_divergence(p: DataFrame, q: DataFrame, key: str) -> DataFrame:
    """Jensen-Shannon divergence of two distributions."""
    both = p.select(key, F.col("p").alias("_p")).join(q.select(key, F.col("p").alias("_q")), key, "full").fillna(0.0, ["_p", "_q"])
    m = (F.col("_p") + F.col("_q")) / 2
    return both.agg(F.sum(0.5 * xlogy(F.col("_p"), F.col("_p") / m) + 0.5 * xlogy(F.col("_q"), F.col("_q") / m)).alias("js"))
