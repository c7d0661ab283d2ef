"""Connected components of an edge table by alternating stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that loops carry no lineage and survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        conf = df.sparkSession.conf
        sc.setCheckpointDir(conf.get("spark.checkpoint.dir", None) or f"{conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return df.checkpoint()


#: A vertex is heavy when it holds more than one in HEAVY_PARTS of all edges, so there are fewer than HEAVY_PARTS such.
HEAVY_PARTS = 1024


def with_least(edges: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with m, the least v of each u; ``total`` is the number of edges or more.

    The few heavy vertices are broadcast, so that no task holds all edges of one.
    """
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    heavy = F.broadcast(low.where(F.col("n") > total // HEAVY_PARTS).select("u", "m"))
    light = low.where(F.col("n") <= total // HEAVY_PARTS).select("u", "m")
    return edges.join(heavy, "u").unionByName(edges.join(heavy, "u", "left_anti").join(light, "u"))


def components(edges: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """(id, component): the smallest id that can be reached, for every id on an edge; rounds grow with log of the size."""
    e = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).distinct())
    ids = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    e = e.where("u <> v")
    before = (e.count(), None)
    while True:
        both = with_least(e.union(e.select("v", "u")), 2 * before[0]).withColumn("m", F.least("u", "m"))
        e = cut(both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # An edge gives one edge at most, so there are no more of them than before.
        down = with_least(e, 2 * before[0])
        e = cut(down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return ids.join(e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
