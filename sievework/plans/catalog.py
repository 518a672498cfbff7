"""The registered queries over the supplied tables, and DuckDB's SQL for the same rows. Every query runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievework.plans import corpus, records, sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = corpus.QUERIES | sequences.QUERIES | records.QUERIES
SQL: dict[str, str] = corpus.SQL | sequences.SQL | records.SQL
