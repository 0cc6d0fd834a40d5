"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaestor.llm import charforms, language, leakage, places, residue, scans, split, tokenizer
from quaestor.runtime import spread, table

#: Where the public vocabularies lie; a parameter of the deployment.
TOKENIZERS = os.environ.get("QUAESTOR_TOKENIZERS", "/opt/tokenizers")


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of every oversized block, with their own estimates."""
    pieces = split.split_oversized(table(spark, root, "blocks"), ["doc_id", "id"])
    return pieces.select("doc_id", F.col("id").alias("block_id"), "piece_no", "start", "end", "piece", "token_estimate", "section_path")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Blocks over the limit: those that came out in several pieces."""
    return p1_pieces(spark, root).where(F.col("piece_no") == 1).select("doc_id", "block_id").distinct()


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return places.place_cases(spark, root)


def p3_unmatched(spark: SparkSession, root: str) -> DataFrame:
    return places.unmatched_entries(spark, root)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.scan_noise(spark, root)


def p4_paragraphs(spark: SparkSession, root: str) -> DataFrame:
    return scans.scan_paragraphs(spark, root)


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return language.wrong_hints(spark, root)


def p6_segments(spark: SparkSession, root: str) -> DataFrame:
    return language.page_segments(spark, root)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return charforms.unlike_house_form(spark, root)


def p7_normal(spark: SparkSession, root: str) -> DataFrame:
    return charforms.house_form(charforms.text_values(spark, root)).select("source_table", "record_key", "field", "pos", "normal")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    documents = spread(table(spark, root, "documents").select("doc_id", "text"), "doc_id")
    return tokenizer.encode_texts(documents, os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    documents = spread(table(spark, root, "documents").select("doc_id", "text"), "doc_id")
    return leakage.find_leaks(documents, table(spark, root, "held_out"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return residue.residue_documents(table(spark, root, "documents"))


def p10_kept(spark: SparkSession, root: str) -> DataFrame:
    """The corpus without residue: ids and lengths of the documents that stay."""
    return residue.without_residue(table(spark, root, "documents")).select(
        "doc_id", F.length("text").alias("n_chars")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        p1_found, p1_pieces, p3_found, p3_unmatched, p4_found, p4_paragraphs, p6_found, p6_segments,
        p7_found, p7_normal, p8_ids, p9_found, p10_found, p10_kept,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT DISTINCT doc_id, id AS block_id FROM blocks WHERE round(length(text) / 3.5) > 400",
        "p9_found": r"""
            WITH flat AS (
                SELECT 'd' AS side, doc_id AS id, strip_accents(lower(text)) AS t FROM documents WHERE text IS NOT NULL
                UNION ALL SELECT DISTINCT 'i', item_id, strip_accents(lower(text)) FROM held_out WHERE text IS NOT NULL
            ), ws AS (
                SELECT side, id, regexp_extract_all(replace(t, 'œ', 'oe'), '[\p{L}\p{N}]+') AS w FROM flat
            ), runs AS (
                SELECT DISTINCT side, id, least(13, CASE WHEN side = 'i' THEN len(w) ELSE 13 END) AS span,
                       unnest([array_to_string(w[k:k + least(13, len(w)) - 1], ' ') FOR k IN range(1, greatest(len(w) - 11, 2))]) AS run
                FROM ws WHERE side = 'i' AND len(w) > 0
            ), spans AS (SELECT DISTINCT least(13, len(w)) AS n FROM ws WHERE side = 'i' AND len(w) > 0
            ), docs AS (
                SELECT DISTINCT id, unnest([array_to_string(w[k:k + n - 1], ' ') FOR k IN range(1, greatest(len(w) - n + 2, 1))]) AS run
                FROM ws, spans WHERE side = 'd' AND len(w) >= n
            )
            SELECT DISTINCT d.id AS doc_id, r.id AS item_id FROM docs d JOIN runs r ON d.run = r.run
        """,
    }
