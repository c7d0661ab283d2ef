"""Token counts from an exact histogram of encoded lengths.

Documents are encoded once and counted by length. Suffix sums over the histogram answer, for every context limit L that
is a length of the corpus: how many documents are at least that long, their tokens, the tokens left when every document
is truncated to L, and the share of documents not longer than L (the quantile of L). Between two lengths the answers
are linear in L (``truncated_total``).

Scale: the histogram has a row for each different length, at most the longest document's length, whatever the number of
documents; it is made with partial aggregates. Suffix sums take two levels (sums over spans of SPAN lengths, then
within a span), so no task reads the whole histogram of a corpus with very long documents.

Defined results: null text counts as empty; empty documents have length 0 and are counted; repeated rows count each; an
empty table gives an empty result.
"""

from __future__ import annotations

from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halocline.llm._common import Table, whole_text_batches
from halocline.llm._wordbpe import word_bpe

SPAN = 1024


def _lengths(path: str):
    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            n = array("q", [len(bpe.encode(t)) // 4 for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return run


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs) for each encoded length in the corpus."""
    whole_text_batches(docs.sparkSession)
    lengths = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_lengths(tokenizer), "n_tokens long")
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """n_tokens, n_docs, docs_at_least, tokens_at_least, truncated_tokens, quantile, docs_total, tokens_total."""
    spans = histogram.withColumn("span", F.floor(F.col("n_tokens") / SPAN))
    of_span = spans.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    later = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1)
    after = of_span.select("span", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_after") for c in "dt"])
    totals = of_span.agg(F.coalesce(F.sum("d"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    within = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    out = (
        spans.withColumn("docs_at_least", F.sum("n_docs").over(within))
        .withColumn("tokens_at_least", F.sum(F.col("n_docs") * F.col("n_tokens")).over(within))
        .join(F.broadcast(after), "span")
        .withColumn("docs_at_least", F.col("docs_at_least") + F.col("d_after"))
        .withColumn("tokens_at_least", F.col("tokens_at_least") + F.col("t_after"))
        .withColumns({"docs_total": F.lit(totals[0]).cast("long"), "tokens_total": F.lit(totals[1]).cast("long")})
    )
    shorter = F.col("tokens_total") - F.col("tokens_at_least")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (shorter + F.col("docs_at_least") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")).alias("quantile"),
        "docs_total",
        "tokens_total",
    )


def token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """The histogram of encoded lengths with its suffix sums."""
    return suffix_sums(Table(length_histogram(docs, tokenizer, text_col), "lengths").df)


def truncated_total(counts: DataFrame, limit: int) -> int:
    """Tokens of the corpus when each document is truncated to ``limit``, from the rows of ``token_counts``."""
    above = counts.where(F.col("n_tokens") >= limit).agg(F.min_by("docs_at_least", "n_tokens"), F.min_by("tokens_at_least", "n_tokens")).first()
    total = counts.agg(F.max("tokens_total")).first()[0] or 0
    return total if above[0] is None else total - above[1] + above[0] * limit
