"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

1. One scan writes a narrow table: id, length in bytes, hash of the first PREFIX characters.
2. Lengths shared by two rows or more survive; within them, (length, prefix hash) pairs shared by two rows or more.
3. Only rows whose pair may have survived have their whole text hashed (SHA-256). The test is a bitmap of PAIR_BUCKETS
   buckets, so the broadcast has a fixed bound; a bucket that also holds other pairs only costs a hash in vain.
4. Rows that agree in length, prefix hash and SHA-256 are a group; the one with the largest id stays.

Everything is DataFrame operations. Groups are counted with partial aggregates and joined back by ``attach_groups``,
so a group that holds a third of all rows never meets in one task.

Defined results: null text counts as empty; empty texts equal each other; a row whose text nobody shares is its own
group of one; rows with equal ids and texts are copies of one another (all are marked kept when they hold the
largest id: ids are expected to be unique); an empty table gives an empty result.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.llm._common import Table, attach_groups, without_ids

PREFIX = 128
PAIR_BUCKETS = 1 << 18


def _pair_bucket() -> Column:
    return F.pmod(F.xxhash64("_len", "_prefix"), F.lit(PAIR_BUCKETS))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, prefix: int = PREFIX) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, and the ``carry`` expressions (names must be new)."""
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), *[c.alias(f"_carry_{k}") for k, c in carry.items()]
    ).withColumns({"_len": F.octet_length("_text").cast("long"), "_prefix": F.xxhash64(F.substring("_text", 1, prefix))})
    pairs = Table(scanned.groupBy("_len", "_prefix").agg(F.count("*").alias("_n")), "exact-pairs")
    total = pairs.df.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    lengths = pairs.df.groupBy("_len").agg(F.sum("_n").alias("_of_len")).where("_of_len > 1").select("_len")
    alive = pairs.df.where("_n > 1").join(lengths, "_len", "left_semi")
    buckets = alive.select(_pair_bucket().alias("_bucket")).distinct().withColumn("_read", F.lit(True))
    narrow = Table(
        scanned.withColumn("_bucket", _pair_bucket())
        .join(F.broadcast(buckets), "_bucket", "left")
        .withColumn("_full", F.when(F.col("_read"), F.sha2("_text", 256)).otherwise(F.lit("")))
        .drop("_text", "_bucket", "_read"),
        "exact-rows",
    )
    key = ["_len", "_prefix", "_full"]
    groups = Table(
        narrow.df.where("_full <> ''").groupBy(*key).agg(F.count("*").alias("_n"), F.max("_id").alias("_keep")).where("_n > 1"),
        "exact-groups",
    )
    pairs.drop()
    single = narrow.df.where("_full = ''").withColumns({"_n": F.lit(None).cast("long"), "_keep": F.lit(None).cast(docs.schema[id_col].dataType)})
    grouped = attach_groups(narrow.df.where("_full <> ''"), groups.df, key, "_n", total)
    out = grouped.unionByName(single).withColumn("_keep", F.coalesce("_keep", "_id"))
    return out.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_keep") == F.col("_id")).alias("kept"),
        *[F.col(f"_carry_{k}").alias(k) for k in carry],
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, columns as they were."""
    gone = Table(exact_dedup(docs, id_col, text_col).where(~F.col("kept")).select(id_col), "exact-gone")
    return without_ids(docs, gone.df, id_col, gone.df.count())
