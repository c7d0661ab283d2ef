"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Each source's documents, in a hashed order, form an endless stream of characters (it starts again when it ends; a
repetition is an *epoch*), cut into blocks of ``block_chars``. Time is in slots of one block. Block i of a source with
weight w is released at floor(i / w) and due at ceil((i + 1) / w); the earliest deadline first of the released blocks
takes the slot. With weights that sum to 1 every block meets its deadline, so at any time each source is within one
block of its share. Weights are rounded to multiples of 1 / period, so the schedule repeats after a period. The period is
so long that the smallest weight has FINE slots in it (PERIOD slots at least), which keeps every source within 1 part in
FINE of its weight or one slot of PERIOD, however many sources there are. A source smaller than a block has blocks of its own size, so a slot
never repeats its documents. No more slots are planned than the mix has. The mix ends with the slot that
completes the first epoch of the last source to do so: no document is left out, and sources that are short for their
weight are repeated.

Default weights follow the sources' characters (a block at least) to the power ``alpha``: below 1, small sources weigh
more than their size.

Scale: the sources' totals and the schedule reach the driver: a row a source, and 12 bytes for each slot of a period or of
the mix, whichever is shorter; the mix has about a slot for each ``block_chars`` characters. A source's stream position
comes from sums over hash ranges of about CHUNK_ROWS rows, so one source may hold any share of all rows.

Defined results: null text counts as empty, and every text counts one character more than it has, so that empty
documents have a place; a null source is a source of its own; null ids are kept; sources without a positive weight in ``weights`` are an
error; repeated rows each have a place; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halocline.llm._common import Table, plain_columns

PERIOD = 1 << 14
#: Slots of the smallest weight in a period, at least; and planned slots up to which they are sent to every executor.
FINE, SMALL_PLAN = 64, 1 << 17
BLOCK_CHARS = 1 << 13
ALPHA = 0.9
CHUNK_ROWS = 4096
NULL_SOURCE = "\x00null"


def whole_shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Slots of each source in a period: at least one each, ``period`` in all (largest remainders)."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources; a period has {period} slots")
    bad = [k for k, w in weights.items() if not (w > 0 and math.isfinite(w))]
    if bad:
        raise ValueError(f"weights must be positive: {bad[:5]}")
    total = sum(weights.values())
    spare = period - len(weights)
    exact = {k: spare * w / total for k, w in weights.items()}
    out = {k: 1 + math.floor(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (math.floor(exact[k]) - exact[k], k))[: period - sum(out.values())]:
        out[k] += 1
    return out


def fine_period(weights: dict[str, float], least: int) -> int:
    """``least``, doubled until the smallest weight has FINE slots."""
    period, wanted = least, FINE * sum(weights.values()) / min(weights.values(), default=1.0) if weights else 0
    while period < wanted:
        period *= 2
    return period


def pfair_slots(shares: list[int], slots: int) -> np.ndarray:
    """Number of the source of each of the first ``slots`` slots; ties go to the lower number."""
    period = sum(shares)
    waiting = [(0, k) for k in range(len(shares))]
    ready: list[tuple[int, int]] = []
    done = [0] * len(shares)
    out = np.zeros(slots, dtype=np.int32)
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[k] + 1) * period // shares[k]), k))
        _, k = heapq.heappop(ready)
        out[t] = k
        done[k] += 1
        heapq.heappush(waiting, (done[k] * period // shares[k], k))
    return out


def pfair_period(shares: dict[str, int]) -> list[tuple[str, int]]:
    """Slot t of the period -> (source, number of its block within the period); earliest deadline first."""
    names = sorted(shares)
    done = dict.fromkeys(names, 0)
    out = []
    for i in pfair_slots([shares[k] for k in names], sum(shares.values())).tolist():
        out.append((names[i], done[names[i]]))
        done[names[i]] += 1
    return out


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list:
    return [
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(source_col), F.lit(NULL_SOURCE)).alias("_source"),
        (F.coalesce(F.length(text_col), F.lit(0)) + 1).cast("long").alias("_chars"),
        F.xxhash64(F.col(id_col), F.lit("mix")).alias("_hash"),
    ]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_chars: int = BLOCK_CHARS, alpha: float = ALPHA, period: int = PERIOD, whole: bool = False) -> DataFrame:
    """id, source, chars, epoch, block, slot, at: the mix is the rows in the order (slot, at). With ``whole`` also _row, the
    columns of ``docs`` as c0, c1, ..."""
    spark = docs.sparkSession
    base = _base(docs, id_col, text_col, source_col)
    rows = Table(docs.select(*base), "mix-rows")
    # Each source has at most as many chunks as it has CHUNK_ROWS rows, and one more.
    per_source = rows.df.groupBy("_source").agg(F.sum("_chars").alias("all"), F.count("*").alias("n"))
    sources = {r["_source"]: (r["all"], r["n"]) for r in per_source.collect()}
    if weights is None:
        weights = {k: float(max(v, block_chars)) ** alpha for k, (v, _) in sources.items()}
    missing = [k for k in sources if k not in weights]
    if missing:
        raise ValueError(f"no weight for {missing[:5]}")
    weights = {k: weights[k] for k in sources}
    bad = [k for k, w in weights.items() if not (w > 0 and math.isfinite(w))]
    if bad:
        raise ValueError(f"weights must be positive: {bad[:5]}")
    period = fine_period(weights, period)
    shares = whole_shares(weights, period)
    names = sorted(sources)
    size = {k: min(block_chars, chars) for k, (chars, _) in sources.items()}
    lasts = {k: (chars - 1) // size[k] for k, (chars, _) in sources.items()}  # the last block of the first epoch
    # Every block is placed before its deadline, so no slot after the last of these deadlines is needed.
    until = max((-(-(lasts[k] + 1) * period // shares[k]) for k in names), default=0)
    plan = pfair_slots([shares[k] for k in names], min(period, until)) if names else np.zeros(0, dtype=np.int32)
    # Slots by source, in order: a source's n-th block of the period is its n-th slot.
    order = np.argsort(plan, kind="stable")
    starts = np.searchsorted(plan[order], np.arange(len(names) + 1))
    # The mix ends after the slot of the last block of each source's first epoch.
    last = max((lasts[k] // shares[k] * period + int(order[starts[i] + lasts[k] % shares[k]]) for i, k in enumerate(names)), default=0)
    blocks_until = np.bincount(plan[: last % period + 1], minlength=len(names)).tolist()
    epochs = [math.ceil(Fraction((last // period * shares[k] + blocks_until[i]) * size[k], sources[k][0])) for i, k in enumerate(names)]
    facts = spark.createDataFrame(
        [(k, i, sources[k][0], sources[k][1] // CHUNK_ROWS + 1, shares[k], epochs[i], size[k]) for i, k in enumerate(names)], "_source string, _number int, _all long, _chunks long, _share long, _epochs long, _size long"
    )
    nth = np.arange(len(plan)) - starts[plan[order]]
    columns = {"_number": pa.array(plan[order], pa.int32()), "_nth": pa.array(nth, pa.int64()), "_slot": pa.array(order, pa.int64())}
    slots = spark.createDataFrame(pa.table(columns))
    if len(plan) <= SMALL_PLAN:
        slots = F.broadcast(slots)

    def place(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(facts), "_source").withColumn("_chunk", F.floor((F.shiftrightunsigned("_hash", 33) * F.col("_chunks")) / F.lit(1 << 31)).cast("long"))

    sums = place(rows.df).groupBy("_source", "_chunk").agg(F.sum("_chars").alias("_sum"))
    before = Table(sums.withColumn("_before", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_chunk")) - F.col("_sum")).select("_source", "_chunk", "_before"), "mix-chunks")
    within = F.sum("_chars").over(Window.partitionBy("_source", "_chunk").orderBy(F.shiftrightunsigned("_hash", 33), "_hash", "_id").rowsBetween(Window.unboundedPreceding, -1))
    # The window partitions rows by (source, chunk), as the join does.
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(plain_columns(docs))]).alias("_row")
    streams = place(docs.select(*base, row) if whole else rows.df).withColumn("_within", F.coalesce(within, F.lit(0))).join(before.df, ["_source", "_chunk"])
    repeated = streams.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs") - 1))).withColumn("at", F.col("_before") + F.col("_within") + F.col("epoch") * F.col("_all"))
    blocks = repeated.withColumn("block", F.expr("at div _size")).withColumn("_nth", F.col("block") % F.col("_share"))
    slotted = blocks.join(slots, ["_number", "_nth"]).withColumn("slot", F.floor(F.col("block") / F.col("_share")).cast("long") * period + F.col("_slot")).where(F.col("slot") <= last)
    return slotted.select(
        F.col("_id").alias(id_col),
        F.when(F.col("_source") != NULL_SOURCE, F.col("_source")).alias("source"),
        F.col("_chars").alias("chars"),
        "epoch",
        "block",
        "slot",
        "at",
        *(["_row"] if whole else []),
    )


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` in the order of the mix, columns as they were; a row appears once for each of its epochs."""
    mixed = mix(docs, weights, id_col, text_col, source_col, whole=True, **options).select("slot", "at", "_row")
    ordered = mixed.repartitionByRange("slot", "at").sortWithinPartitions("slot", "at")
    return ordered.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
