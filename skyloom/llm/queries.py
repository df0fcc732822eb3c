"""Registered queries of the corpus operators, each over its whole table, and the SQL that some have."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontam, langid, mixing, quality, secrets, simhash, substrings, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digest(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(_table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.ann_digest(_table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(_table(spark, sf_dir, "conversations"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_digest(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secrets, op2_decontamination, op3_substrings, op4_language, op5_neighbours, op6_quality, op7_chat, op8_warc, op9_mixing, op10_simhash)}

#: Payload lengths, digests and revisits, straight from the table.
_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, upper(sha1(b)) AS hex FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS winner FROM d),
c AS (SELECT *, [substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
        CAST('0x' || substr(hex || '0', 1 + (i * 5) // 4, 1) AS INT) * 16 + CAST('0x' || substr(hex || '0', 2 + (i * 5) // 4, 1) AS INT)) // (1 << (3 - (i * 5) % 4)) % 32 AS INT), 1) for i in range(0, 32)] AS letters FROM w)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(letters, '') AS payload_digest,
       CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM c"""

ORACLES: dict[str, str] = {"op7_chat": chat.ORACLE, "op8_warc": _WARC}
