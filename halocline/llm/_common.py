"""Helpers shared by the training-data operators: shared tables, skew-safe joins, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is "heavy" when it holds more than one in HEAVY_PARTS of all rows; so there are at most HEAVY_PARTS heavy keys.
HEAVY_PARTS = 1024
#: Records of one Arrow batch handed to Python: whole texts, so far fewer than Spark's default of 10,000.
ARROW_RECORDS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; one of our own only in local mode without it."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="halocline-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Table:
    """A DataFrame written once to the shared folder: ``df`` reads it, ``drop()`` removes it."""

    def __init__(self, df: DataFrame, tag: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/halocline/{tag}-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has already set its own size."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_RECORDS)


def attach_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size_col: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``groups`` (one row per key, ``size_col`` = how many rows have the key).

    ``total`` is at least the sum of ``size_col``. Keys with more than ``total / HEAVY_PARTS`` rows number at most
    HEAVY_PARTS, so they are broadcast, and their rows are never shuffled by key; no key that is left for the
    shuffled join exceeds that share. Both frames are read more than once: pass written tables. Keys must not be null.
    """
    keys = list(keys)
    share = total // HEAVY_PARTS
    heavy = groups.where(F.col(size_col) > share)
    light = groups.where(F.col(size_col) <= share)
    of_heavy = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys, "left")
    return of_heavy.unionByName(rest)


#: Ids up to which a set of ids is sent to every executor rather than shuffled.
SMALL_IDS = 250_000


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str, n_ids: int) -> DataFrame:
    """``docs`` but for those with an id in ``ids``; broadcast only when ``n_ids`` (counted) is small."""
    gone = ids.select(id_col)
    return docs.join(F.broadcast(gone) if n_ids <= SMALL_IDS else gone, id_col, "left_anti").select(*plain_columns(docs))


def plain_columns(docs: DataFrame) -> list[Column]:
    """All columns of ``docs``, also those with dots in their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
