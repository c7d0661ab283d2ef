"""One query for each operator, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halocline.llm import embed_dedup, exact_dedup, html_extract, langid, mixing, packing, secrets, simhash, token_counts, toxicity
from halocline.llm._common import read_table


def tokenizer_path() -> str:
    """Vocabulary of the packing and counting queries; it is installed on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "random"))
    return found.select(
        "doc_id",
        *[secrets.count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.span_text(F.col("base")), 256).alias("base_sha256"),
        secrets.span_text(every).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = langid.crc_remainder("doc_id", 4) == 2
    profiles = langid.learn_profiles(docs.where(~held_out))
    return langid.identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = langid.crc_remainder("doc_id", 5) == 0
    model = toxicity.learn(docs, labels.where(~held_out))
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT u AS vec_id, u AS root FROM links
  UNION
  SELECT l.w, r.root FROM reach r JOIN links l ON l.u = r.vec_id
), comp AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY u)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, v.vec_id) AS component_id,
       coalesce(component_id, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN comp USING (vec_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_packing, op3_simhash, op4_mixing, op5_token_counts, op6_secrets, op7_language_id, op8_toxicity, op9_html_extraction, op10_embedding_dedup)
}
SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op10_embedding_dedup": OP10_SQL}
