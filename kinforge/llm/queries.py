"""The queries of this package: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinforge.llm import bpe, crf, decontam, embed, langid, lbl, minhash, packing, substring, warc
from kinforge.llm._store import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def op2_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"), with_spans=False)


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_lbl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lbl.scores(table(spark, sf_dir, "documents"), copy=False)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, threshold=0.8)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_crf_quality, op3_warc_round_trip, op4_language_id, op5_embedding_near_dedup, op6_substring_dedup, op7_lbl_scores, op8_best_fit_packing, op9_benchmark_leaks, op10_minhash_near_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_round_trip": OP3_SQL}


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""
