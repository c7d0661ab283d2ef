"""Fitted models and estimators in a folder, on any Hadoop path.

``metadata.json`` holds the settings; ``centers.parquet`` (center_id, weight, vector) the centres of a model that has
one set of them; ``arrays.parquet`` (name, row, values) its other arrays, such as encoders, decoders, medoids,
embeddings and merges; ``table-<name>.parquet`` each of its tables, such as the clusters of rows and columns. Arrays are
on the driver in any case, tables never are.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import fields, is_dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from halocline.errors import RowError, UnknownName
from halocline.plans import bounded, constrained, estimators, lloyd, sampled, sparse, tabular
from halocline.streaming.kmeans import StreamingKMeans

LAYOUT = 1
KINDS = {
    c.__name__: c
    for m in (estimators, constrained, sampled, sparse, tabular, bounded, lloyd)
    for c in vars(m).values()
    if isinstance(c, type) and is_dataclass(c) and c.__module__ == m.__name__
} | {"StreamingKMeans": StreamingKMeans}


def checksum(spark: SparkSession, path: str) -> str:
    rows = spark.read.parquet(f"{path}/centers.parquet").orderBy("center_id").toJSON().collect()
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def _apart(value: Any, name: str, arrays: dict[str, np.ndarray], tables: dict[str, DataFrame]) -> Any:
    """What JSON can hold of a value; its arrays and tables are put into the dictionaries."""
    if isinstance(value, np.generic):
        return value.item()
    if isinstance(value, np.ndarray):
        arrays[name] = value
        return {"$array": name, "shape": list(value.shape), "whole": value.dtype.kind in "iub"}
    if isinstance(value, DataFrame):
        tables[name] = value
        return {"$table": name}
    if is_dataclass(value):
        return {"$class": type(value).__name__, "fields": {f.name: _apart(getattr(value, f.name), f"{name}.{f.name}".lstrip("."), arrays, tables) for f in fields(value)}}
    if isinstance(value, set):
        return {"$set": sorted(value)}
    if isinstance(value, list | tuple):
        return [_apart(v, f"{name}.{i}", arrays, tables) for i, v in enumerate(value)]
    return value


def _together(value: Any, arrays: dict[str, np.ndarray], spark: SparkSession, path: str) -> Any:
    if isinstance(value, list):
        return [_together(v, arrays, spark, path) for v in value]
    if not isinstance(value, dict):
        return value
    if "$array" in value:
        return arrays[value["$array"]].reshape(value["shape"]).astype(int if value["whole"] else float)
    if "$table" in value:
        return spark.read.parquet(f"{path}/table-{value['$table']}.parquet")
    if "$set" in value:
        return set(value["$set"])
    if value["$class"] not in KINDS:
        raise UnknownName("class", value["$class"], sorted(KINDS))
    return KINDS[value["$class"]](**{k: _together(v, arrays, spark, path) for k, v in value["fields"].items()})


def save(model: Any, spark: SparkSession, path: str) -> None:
    arrays: dict[str, np.ndarray] = {}
    tables: dict[str, DataFrame] = {}
    meta = {"layoutVersion": LAYOUT, "model": _apart(model, "", arrays, tables)}
    centres = arrays.pop("centres", None)
    if centres is not None:
        weights = getattr(model, "weights", None)
        rows = [(i, float(1.0 if weights is None else weights[i]), [float(v) for v in c]) for i, c in enumerate(centres)]
        spark.createDataFrame(rows, "center_id int, weight double, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centers.parquet")
        meta |= {"k": len(centres), "dim": int(centres.shape[1]), "checksum": checksum(spark, path)}
    rows = [(name, i, [float(v) for v in np.ravel(r)]) for name, a in arrays.items() for i, r in enumerate(np.atleast_1d(a))]
    spark.createDataFrame(rows, "name string, row int, values array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/arrays.parquet")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/table-{name}.parquet")
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata.json")


def load(spark: SparkSession, path: str) -> Any:
    meta = json.loads(spark.read.text(f"{path}/metadata.json").first()[0])
    if meta["layoutVersion"] != LAYOUT:
        raise RowError(f"layout {meta['layoutVersion']}, expected {LAYOUT}")
    arrays: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/arrays.parquet").orderBy("name", "row").collect():
        arrays.setdefault(r["name"], []).append(r["values"])
    if "checksum" in meta:
        rows = spark.read.parquet(f"{path}/centers.parquet").orderBy("center_id").collect()
        if len(rows) != meta["k"] or checksum(spark, path) != meta["checksum"]:
            raise RowError("the centres do not fit the metadata")
        arrays["centres"] = [r["vector"] for r in rows]
    return _together(meta["model"], {k: np.array(v, dtype=float) for k, v in arrays.items()}, spark, path)


def dendrogram(spark: SparkSession, merges: np.ndarray) -> DataFrame:
    """(step, left, right, merged, distance) of an agglomerative fit, as a table to write."""
    rows = [(t, int(a), int(b), int(c), float(d)) for t, (a, b, c, d) in enumerate(merges)]
    return spark.createDataFrame(rows, "step int, left int, right int, merged int, distance double")
