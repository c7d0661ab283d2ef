"""Odd rows and columns, and the mix against a plain simulation."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from halocline.llm import exact_dedup, mixing, packing, secrets, simhash
from halocline.llm.queries import tokenizer_path


def simulate(docs, weights, block, shares, period):
    """(id, epoch) -> slot. ``docs``: (id, source, chars) in stream order; earliest deadline first, slot by slot."""
    names = sorted(shares)
    stream = {k: [(i, c) for i, s, c in docs if s == k] for k in names}
    total = {k: sum(c for _, c in v) for k, v in stream.items()}
    size = {k: min(block, total[k]) for k in names}
    out, done, slot = {}, dict.fromkeys(names, 0), 0
    while any(done[k] * size[k] < total[k] for k in names):
        ready = [k for k in names if Fraction(done[k] * period, shares[k]).__floor__() <= slot]
        k = min(ready, key=lambda k: (-(-(done[k] + 1) * period // shares[k]), k))
        first, last = done[k] * size[k], (done[k] + 1) * size[k]
        for epoch in range(first // total[k], (last - 1) // total[k] + 1):
            at = epoch * total[k]
            for i, c in stream[k]:
                if first <= at < last:
                    out[i, epoch] = slot
                at += c
        done[k] += 1
        slot += 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_the_mix_equals_a_simulation(spark, seed):
    rng = random.Random(seed)
    body = [(i, "x" * rng.randrange(0, 90), f"s{min(rng.randrange(6), rng.randrange(6))}") for i in range(120)] + [(500, "y", "tiny")]
    df = spark.createDataFrame(body, "doc_id long, text string, source string")
    weights = {f"s{i}": rng.random() + 0.1 for i in range(6)} | {"tiny": 0.02}
    weights = {k: v for k, v in weights.items() if any(b[2] == k for b in body)}
    got = {(r["doc_id"], r["epoch"]): r["slot"] for r in mixing.mix(df, weights, block_chars=64, period=256).collect()}
    order = df.withColumn("h", F.xxhash64("doc_id", F.lit("mix"))).orderBy(F.shiftrightunsigned("h", 33), "h", "doc_id").collect()
    period = mixing.fine_period(weights, 256)
    want = simulate([(r["doc_id"], r["source"], len(r["text"]) + 1) for r in order], weights, 64, mixing.whole_shares(weights, period), period)
    assert got == want


def test_a_tiny_source_is_hardly_repeated(spark):
    body = [(i, "z" * 8000, "big") for i in range(200)] + [(999, "a", "tiny")]
    df = spark.createDataFrame(body, "doc_id long, text string, source string")
    n = {r["doc_id"]: r["n"] for r in mixing.mix(df).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(n) == {b[0] for b in body} and n[999] <= 4 and max(n.values()) <= 4


ODD = "doc_id long, text string, source string, `a.b` int, _mix_id int, _slot int, _at int, _row int, slot int, at int, epoch int, component int, n long"


def odd_rows():
    texts = ["one two three four five six", "one two three four five six", None, "", "seven eight", "seven eight"]
    return [(i if i != 4 else None, t, None if i == 3 else "s", i, 1, 2, 3, 4, 5, 6, 7, 8, 9) for i, t in enumerate(texts)] + [(1, "one two three four five six", "s", 1, 1, 2, 3, 4, 5, 6, 7, 8, 9)]


def test_columns_with_clashing_and_dotted_names(spark):
    df = spark.createDataFrame(odd_rows(), ODD)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and sorted(map(str, mixed.distinct().collect())) == sorted(map(str, df.distinct().collect()))
    # Repeated rows each have a place, and no more.
    assert mixed.where("doc_id = 1").count() == 2 * mixed.where("doc_id = 0").count()
    for drop in (exact_dedup.drop_exact_copies, simhash.drop_near_duplicates):
        out = drop(df)
        assert out.columns == df.columns and out.count() >= 3


def test_rows_without_id(spark):
    df = spark.createDataFrame(odd_rows(), ODD)
    pieces = packing.pack(df, tokenizer_path(), length=8).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] is None) == next(r["doc_tokens"] for r in pieces if r["doc_id"] is None)
    assert sum(r["length"] for r in pieces) % 8 == sum(r["length"] for r in pieces if r["sequence_id"] >= sum(x["length"] for x in pieces) // 8)
    got = simhash.simhash_groups(df).where("doc_id is null").collect()
    assert len(got) == 1 and got[0]["component_id"] is None and len(got[0]["fingerprint"]) == 16
    assert exact_dedup.exact_dedup(df).count() == len(odd_rows())


@pytest.mark.parametrize("piece", [4, 256])
def test_spans_of_many_matches(spark, monkeypatch, piece):
    monkeypatch.setattr(secrets, "PIECE", piece)
    text = "".join(f"{'é' * (i % 7)} {i:032x}z" for i in range(1, 700))
    import re

    want = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]{24,}", text)]
    df = spark.createDataFrame([(0, text), (1, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert [(s["start"], s["end"]) for s in got[0]["base"]] == want and got[1]["base"] == []
