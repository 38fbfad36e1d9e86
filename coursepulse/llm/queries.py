"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coursepulse.llm import (
    byte_pairs,
    kneser_ney,
    languages,
    line_dedup,
    manifest,
    near_duplicates,
    personal_data,
    quality_rules,
    secret_spans,
    shards,
    templates,
    token_counts,
    turn_repair,
)
from coursepulse.llm.common import table

SHARDS = 8


def op1_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 8 shards of near equal bytes."""
    return shards.deal(spark, table(spark, sf_dir, "documents"), SHARDS)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return personal_data.report(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 32k piece model."""
    return token_counts.report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return languages.report(table(spark, sf_dir, "documents"))


def op5_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts and repetition coverage of every document."""
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_spans.report(table(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document and whether its language's threshold keeps it."""
    return kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their round trip, as digests."""
    return byte_pairs.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item."""
    found = templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every conversation after damage, the cheapest edits, and the hash of the repaired rows."""
    return turn_repair.audit(table(spark, sf_dir, "conversations"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped as shared, and the hash of what is left."""
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether it verifies after some are tampered with."""
    return manifest.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_slots": op1_slots,
    "op2_personal_data": op2_personal_data,
    "op3_token_counts": op3_token_counts,
    "op4_language": op4_language,
    "op5_repetition": op5_repetition,
    "op6_secrets": op6_secrets,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_byte_pairs": op8_byte_pairs,
    "op9_templates": op9_templates,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_line_dedup": op12_line_dedup,
    "op13_manifest": op13_manifest,
}

#: Components by comparing all documents that share a shingle; doc_id is unique in the tables.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(
        string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'
        ),
        lambda w: w <> ''
    ) AS ws
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
    SELECT c.a, c.b
    FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s GROUP BY 1, 2) c
    JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b
    WHERE 100 * c.n >= 75 * (p.n + q.n - c.n)
), reached AS (
    SELECT a AS doc_id, b AS other FROM links
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), least_one AS (
    SELECT doc_id, min(other) AS component FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id,
       coalesce(m.component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_one m ON m.doc_id = d.doc_id
"""

#: The other results rest on trained models, tokenizers or packing, and are tested without SQL.
ORACLE: dict[str, str] = {
    "op10_near_duplicates": NEAR_DUPLICATES_SQL,
    "op11_conversation_repair": turn_repair.sql(),
    "op12_line_dedup": line_dedup.SQL,
    "op13_manifest": manifest.sql(),
}
