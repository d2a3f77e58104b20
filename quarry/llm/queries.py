"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import ann, bpe, chat, grulm, iblt, langid, linededup, packing, planes, simhash

WINDOW_TOKENS = 2048


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(col: str, n: int):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_with_edits(_table(spark, sf_dir, "documents"), _parts(spark))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(_table(spark, sf_dir, "documents"), words=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_texts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=WINDOW_TOKENS)
    return placed.drop("ids")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("int").alias("turn"), "role", "text")
    return chat.read_back(chat.examples(turns.union(own)))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod("doc_id", 5) != 0))
    found = langid.predict(docs, model)
    return found.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grulm.score(_table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)


def op10_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planes.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2, _parts(spark))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_simhash, op3_bpe, op4_packing, op5_chat, op6_langid, op7_ann, op8_line_dedup, op9_lm, op10_planes, pipeline)}

_CHAT = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, x, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(x, r)
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
        length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*/?turn>)', '<\\\1', 'g')) + length(regexp_replace(text, '<(\\*/?turn>)', '<\\\1', 'g')) + 15 AS chars
    FROM said
), summed AS (
    SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM numbered
)
SELECT conv_id, max(n)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    length(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), ''))::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    (sum(before) FILTER (WHERE role = 'assistant' OR k = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
"""

#: Only what DuckDB can say about whole tables in fair time.
ORACLE_SQL: dict[str, str] = {"op5_chat": _CHAT}
