"""Packing documents into fixed-length training sequences along a space-filling curve.

Every document becomes a vector of signed, hashed token counts, which a fixed random projection takes to DIMS numbers;
their cell on a Hilbert curve is the document's key. Documents are range-sorted by (key, id), so neighbours on the
curve, which have similar vocabularies, are packed together: their ids, each document closed by an end id, form one
stream that is cut every ``length`` ids. Only what is left at the end is shorter; it is cut into powers of two, largest
first, so nothing is padded.

Scale: bounds of the ranges come from a bounded sample of documents (they only balance the work; the order is that of
(key, id) whatever the bounds). Equal keys are split by id, so copies of one document never meet in one task unless
they fit. Each range reports one number, its count of ids; their running sum places the ranges in the stream. Ids are
shuffled once and written once, as two bytes each where the vocabulary allows.

Defined results: null text counts as empty; an empty document is the end id alone; ids must be whole numbers (others are
an error) and should be unique, as ties in (key, id) keep no defined order; rows with a null id are packed, before others
of their key, and their pieces have a null id (-2^63 stands for it within); an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm._common import Table, whole_text_batches
from halocline.llm._wordbpe import word_bpe

LENGTH = 4096
END_ID = 2
DIMS, BITS = 4, 15
HASHED = 512
NO_ID = -(1 << 63)
#: Documents, at most about, from which the bounds of ranges are learned.
SAMPLE = 4096


@functools.lru_cache(maxsize=1)
def _projection(vocab: int = 1 << 16) -> np.ndarray:
    """Row i: what token i adds to the projected vector (its hashed bucket's direction, with its hashed sign)."""
    mixed = (np.arange(vocab, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    sign = np.where((mixed >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    directions = np.random.default_rng(7).normal(size=(HASHED, DIMS))
    return (directions[(mixed % np.uint64(HASHED)).astype(int)] * sign[:, None]).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n, dims), each coordinate below 2**bits (Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def document_keys(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert keys of documents given as arrays of token ids (none of them empty)."""
    table = _projection()
    sums = np.stack([table[x].sum(axis=0, dtype=np.float64) / len(x) for x in ids])
    # Means of many unit normals crowd around 0: the square root spreads them over the cells.
    spread = np.sign(sums) * np.sqrt(np.abs(sums))
    cells = np.clip((spread + 1.5) / 3 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_keys(cells, BITS)


def _encoder(path: str, bounds: list[tuple[int, int]] | None):
    """(id, text) -> (id, key, n, ids, range); without bounds the ids stay behind."""
    if bounds:
        keys, docs = (np.array(x, dtype=np.int64) for x in zip(*bounds, strict=True))

    def encode(batches):
        bpe = word_bpe(path)
        for batch in batches:
            if not len(batch):
                continue
            doc, text = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for at in range(0, len(doc), 64):
                ids = [np.append(np.frombuffer(bpe.encode(t), dtype=np.uint32), np.uint32(END_ID)) for t in text[at : at + 64]]
                key, own = document_keys(ids), doc[at : at + 64]
                n = np.array([len(x) for x in ids], dtype=np.int64)
                if bounds is None:
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(key), pa.array(n)], names=["doc", "key", "n"])
                    continue
                # The number of bounds (key, id) at or below the document's.
                first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                part = np.array([a + np.searchsorted(docs[a:b], d, "right") for a, b, d in zip(first, last, own, strict=True)], dtype=np.int32)
                data = [x.astype(np.uint16).tobytes() if x.max() < 1 << 16 else x.tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(key), pa.array(n), pa.array(data, pa.binary()), pa.array(part)], names=["doc", "key", "n", "ids", "part"])

    return encode


def _running(batches):
    """Adds ``before``: ids of earlier documents in this range (rows come sorted)."""
    total = 0
    for batch in batches:
        n = batch.column(2).to_numpy()
        before = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(before)], names=["doc", "n", "ids", "part", "before"])


def sequence_bounds(total: int, length: int) -> list[int]:
    """Starts of what follows the whole sequences: the rest in powers of two, largest first; then the end."""
    at = total // length * length
    out = [at]
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total - out[-1]) & (1 << bit):
            out.append(out[-1] + (1 << bit))
    return out


def _cutter(starts: dict[int, int], total: int, length: int):
    """(doc, n, ids, part, before) -> one row per piece."""
    tail = sequence_bounds(total, length)
    whole = total // length

    def cut(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc", "start", "len", "crc", "tokens", "sequence", "offset")}
            rows = zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True)
            for doc, n, data, part, before in rows:
                ids = np.frombuffer(data, dtype=np.uint16 if len(data) == 2 * n else np.uint32).astype("<u4")
                first = starts[part] + before
                start = 0
                while start < n:
                    at = first + start
                    if at < whole * length:
                        sequence, begin, end = at // length, at // length * length, (at // length + 1) * length
                    else:
                        k = int(np.searchsorted(tail, at, "right")) - 1
                        sequence, begin, end = whole + k, tail[k], tail[k + 1]
                    stop = min(n, start + end - at)
                    for k, v in zip(out, (doc, start, stop - start, zlib.crc32(ids[start:stop].tobytes()), n, sequence, at - begin), strict=True):
                        out[k].append(v)
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    return cut


def _bounds(spark, sampled: DataFrame, path: str, parts: int) -> list[tuple[int, int]]:
    got = sampled.mapInArrow(_encoder(path, None), "doc long, key long, n long").collect()
    rows = sorted((r["key"], r["doc"], r["n"]) for r in got)
    if not rows or parts < 2:
        return []
    ends = np.cumsum([r[2] for r in rows])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts)
    return sorted({rows[i][:2] for i in at})


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (see the module)."""
    spark = docs.sparkSession
    whole_text_batches(spark)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_docs = rows.select("doc").count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = SAMPLE / max(n_docs, 1)
    sampled = rows if share >= 1 else rows.where(F.pmod(F.xxhash64("doc", F.lit("range bounds")), F.lit(1 << 30)) < int(share * (1 << 30)))
    bounds = _bounds(spark, sampled, tokenizer, parts)
    encoded = rows.mapInArrow(_encoder(tokenizer, bounds or [(np.iinfo(np.int64).max, np.iinfo(np.int64).max)]), "doc long, key long, n long, ids binary, part int")
    ranges = encoded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "key", "doc")
    placed = Table(ranges.mapInArrow(_running, "doc long, n long, ids binary, part int, before long"), "packed")
    totals = {r["part"]: r["n"] for r in placed.df.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(totals):
        starts[part] = total
        total += totals[part]
    pieces = placed.df.mapInArrow(_cutter(starts, total, length), "doc long, start long, len long, crc long, tokens long, sequence long, offset long")
    names = dict(doc=id_col, start="start", len="length", crc="ids_crc32", tokens="doc_tokens", sequence="sequence_id", offset="offset")
    return pieces.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc"))).select([F.col(a).alias(b) for a, b in names.items()])
