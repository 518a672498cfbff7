"""The queries of this subpackage, each over its whole table with production parameters, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.lm_scoring import score_documents

    return score_documents(_table(spark, sf_dir, "documents"), split_rare=True)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.exact_dedup import find_copies

    return find_copies(_table(spark, sf_dir, "documents"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.warc_zip import read_packages, write_packages

    return read_packages(spark, write_packages(_table(spark, sf_dir, "pages")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.quality_rules import classify_documents

    return classify_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.quality_classifier import classify_documents

    return classify_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.near_dedup import find_near

    return find_near(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.bpe import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.line_dedup import find_lines

    return find_lines(_table(spark, sf_dir, "documents"))


def op9_line_dedup_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.line_dedup import find_lines

    return find_lines(_table(spark, sf_dir, "documents"), edits=2, exact_chars=1)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.llm.url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_warc_zip": op3_warc_zip,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_near_dedup": op6_near_dedup,
    "op7_bpe": op7_bpe,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op9_line_dedup_wide": op9_line_dedup_wide,
    "op10_url_filter": op10_url_filter,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS keeper_id,
               text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) > 1 AS is_copy
        FROM documents""",
    "op3_warc_zip": "SELECT page_id, url, html FROM pages",
    "op9_line_dedup": """
        WITH l AS (
            SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no
            FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
        d AS (SELECT line, min({'d': doc_id, 'l': line_no}) AS place FROM l WHERE length(line) >= 12 GROUP BY line),
        k AS (
            SELECT line, place, length(line) + more AS m, left(line, (length(line) + more) // 2) AS p,
                   right(line, length(line) + more - (length(line) + more) // 2 - 1) AS s
            FROM d, (VALUES (0), (1)) t(more)),
        near AS (
            SELECT a.line, b.place FROM k a JOIN k b ON a.m = b.m AND a.p = b.p AND b.place < a.place
            WHERE levenshtein(a.line, b.line) <= 1
            UNION
            SELECT a.line, b.place FROM k a JOIN k b ON a.m = b.m AND a.s = b.s AND b.place < a.place
            WHERE levenshtein(a.line, b.line) <= 1),
        f AS (SELECT line, min(place) AS place FROM (SELECT * FROM d UNION ALL SELECT * FROM near) GROUP BY line)
        SELECT doc_id, l.line_no::INT AS line_no, coalesce(place.d, doc_id) AS first_doc_id,
               coalesce(place.l, l.line_no)::INT AS first_line_no,
               place IS NULL OR (place.d = doc_id AND place.l = l.line_no) AS keep
        FROM l LEFT JOIN f USING (line)""",
}
