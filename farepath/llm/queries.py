"""One query per operator over the given tables, with production parameters;
and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farepath.llm import (
    alignment,
    chat_format,
    decontaminate,
    exact_dedup,
    language,
    mixing,
    near_dup,
    quality,
    secret_scan,
    token_counts,
    token_ids,
    toxicity,
    whitening,
)
from farepath.llm.common import documents, fold_of
from farepath.session import new_scratch_path

END_ID = 1
QUALITY_AT_LEAST = 0.3
TOXIC_AT_LEAST = 0.5
#: What both turns of the added conversation -7 say.
CONTROL_PROBE = r"\### Assistant: </turn> ok"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def token_index_of(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = new_scratch_path(spark, "token-ids")
    token_ids.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_ids.token_index(spark, path)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index_of(spark, documents(spark, sf_dir, "doc_id", "text"))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.PairwiseAdditiveModel:
    return quality.learn(docs, labels, fold_of("doc_id", 5) > 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    scored = quality.score(docs, quality_model(docs, _labels(spark, sf_dir)))
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= QUALITY_AT_LEAST).cast("int").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_sizes(documents(spark, sf_dir, "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    found = language.identify(docs, language.learn_prototypes(docs, ~fold_of("doc_id", 3).isin(1, -1)))
    return found.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (exact_dedup.dedup(spark, f"{sf_dir}/documents.parquet")
            .select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(documents(spark, sf_dir, "doc_id", "text"))
    spans = F.col("spans")
    base = [r.kind for r in secret_scan.BASE_RULES]
    counts = [secret_scan.count_of(spans, kind).alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(spans, base).cast("binary"), 256).alias("base_sha256"),
                        secret_scan.joined(spans).alias("spans"))


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_classes(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "class_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.learn(docs, _labels(spark, sf_dir), fold_of("doc_id", 5) > 0)
    scored = toxicity.score(docs, model, at_least=TOXIC_AT_LEAST)
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scored.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_AT_LEAST).cast("int").alias("predicted"), spans.alias("spans"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_PROBE).alias("text"))
    return chat_format.digests(chat_format.formatted(turns.unionByName(probe)))


QUERIES = {
    f.__name__: f
    for f in (op1_token_ids, op2_quality, op3_decontaminate, op4_mix, op5_token_counts, op6_language, op7_exact_dedup,
              op8_secrets, op9_near_dup, op10_toxicity, op11_alignment,
              op12_whitening, op13_chat_format)
}

# Words are counted by splitting; DuckDB's md5 and hexadecimal casts give the draws.
_MIX = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text FROM documents
), sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(CASE WHEN doc_id IS NULL THEN '' ELSE CAST(doc_id AS VARCHAR) || ':' END || 't:' || md5(text)) AS digest
  FROM docs
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         2 * source_size AS cap
  FROM per_source
), filled AS (
  SELECT *, CAST(150 * sum(source_size) OVER () - 100 * coalesce(sum(cap) OVER f, 0) AS DOUBLE)
            / CAST(100 * (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS DOUBLE) AS level
  FROM weighed
  WINDOW f AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size,
         CASE WHEN cap <= level * weight THEN CAST(cap AS DOUBLE)
              ELSE max(CASE WHEN cap > level * weight THEN level END) OVER () * weight END AS target
  FROM filled
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
), draws AS (
  SELECT s.digest, s.source, s.size, r.target, r.source_size, floor(r.rate) AS whole, r.rate - floor(r.rate) AS part, k.seed,
         CAST('0x' || substr(md5(s.digest || ':' || CAST(k.seed AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 AS draw
  FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source, range(1, 17) AS k(seed)
), seeds AS (
  SELECT source, seed, abs(max(whole) * max(source_size) + sum(CASE WHEN draw < part THEN size ELSE 0 END) - max(target)) AS off
  FROM draws GROUP BY source, seed
), chosen AS (
  SELECT source, seed FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, seed) AS place FROM seeds) WHERE place = 1
)
SELECT s.doc_id, s.size, r.source_size, r.target,
       CAST(s.size * (floor(r.rate) + CASE WHEN CAST('0x' || substr(md5(s.digest || ':' || CAST(c.seed AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0
                                            < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sizes s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source
"""

_EXACT = r"""
WITH docs AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS place,
         min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size
  FROM docs
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(text) AS text_sha256 FROM ranked
"""

# Framing: "### ", the role's name, ": ", the escaped text, "</turn>" and a line feed.
_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>')) AS text_chars,
         CASE WHEN role IN ('assistant', 'user', 'system') THEN length(role)
              ELSE 1 + length(replace(replace(replace(replace(role, '\', '\\'), '### ', '#\## '), '</turn>', '<\/turn>'), ': ', ':\ ')) END AS role_chars
  FROM turns
), ordered AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
         CAST(sum(4 + role_chars + 2 + text_chars + 8) AS BIGINT) AS formatted_chars
  FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars FROM ordered
"""

ORACLE_SQL = {"op4_mix": _MIX, "op7_exact_dedup": _EXACT, "op13_chat_format": _CHAT}
