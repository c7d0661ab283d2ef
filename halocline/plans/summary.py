"""A training run as one row of a table."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession

from halocline.plans.estimators import CentreModel

#: The names and types of the columns.
COLUMNS = (
    "algorithm string, k int, effectiveK int, dim int, numPoints long, iterations int, converged boolean, finalDistortion double, assignmentStrategy string, divergence string, "
    "elapsedMillis long, avgIterationMillis double, hasEmptyClusters boolean, trainedAt timestamp, distortionHistory array<double>, movementHistory array<double>"
)


def summary_frame(spark: SparkSession, model: CentreModel, algorithm: str, k: int, points: int, elapsed_ms: int, at: datetime.datetime | None = None) -> DataFrame:
    """``k`` is what was asked for; a model can hold fewer centres."""
    r = model.summary
    if r is None:
        raise ValueError("the model holds no history")
    last = float(r.distortion[-1]) if r.distortion else 0.0
    row = (algorithm, k, model.k, int(model.centres.shape[1]), points, r.iterations, r.converged, last, model.strategy, model.divergence, elapsed_ms, elapsed_ms / max(r.iterations, 1), model.k < k, at or datetime.datetime.now(), [float(v) for v in r.distortion], [float(v) for v in r.movement])
    return spark.createDataFrame([row], COLUMNS)


def write_summary(summary: DataFrame, path: str) -> None:
    """The row of ``summary_frame`` as JSON in ``summary.json`` in the folder of a model."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary.json")


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).json(f"{path}/summary.json")
