"""Outlier scores and trimming by distance to the nearest centre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outlier_scores(df: DataFrame, distance: str, threshold: float = 3.0) -> DataFrame:
    """Adds outlier_score (distance over the median distance; a median near 0 counts as 1) and is_outlier."""
    median = df.agg(F.percentile(distance, 0.5)).first()[0]
    median = median if median is not None and median > 1e-10 else 1.0
    return df.withColumn("outlier_score", F.col(distance) / F.lit(median)).withColumn("is_outlier", F.col("outlier_score") > threshold)


def trimmed(df: DataFrame, distance: str, fraction: float = 0.05) -> DataFrame:
    """Adds is_outlier: beyond the (1 - fraction) quantile of distances."""
    cut = df.agg(F.percentile(distance, 1 - fraction)).first()[0]
    return df.withColumn("is_outlier", F.coalesce(F.col(distance) > F.lit(cut), F.lit(False)))
