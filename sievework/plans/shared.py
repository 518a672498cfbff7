"""Parts that the queries and the SQL texts share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import schema
from sievework.functions import text as t

LIMIT = 512

#: SQL of the normal form, and of a sound document.
NORMAL = f"trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '{t.SPACE}+', ' ', 'g'))"
SOUND = f"length(text) BETWEEN 32 AND 1000000 AND regexp_matches(text, '{t.NOT_SPACE}') AND instr(text, chr(0)) = 0"
#: First copies with their split, bytes and place in the order.
FIRST = f"""first AS (
    SELECT doc_id, text, sha256(text) AS h FROM documents WHERE {SOUND}
    QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1),
  placed AS (
    SELECT *, CASE WHEN ('0x' || substr(h, 1, 8))::BIGINT % 10000 < 1000 THEN 'validation' ELSE 'train' END AS split, (strlen(text) + 1)::BIGINT AS n FROM first),
  ribbon AS (SELECT *, (sum(n) OVER (PARTITION BY split ORDER BY doc_id) - n)::BIGINT AS start FROM placed)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with `ord`."""
    return table(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id"))


def byte_values_sql(name: str = "b") -> str:
    """The id of a byte, in SQL."""
    ids = schema.byte_ids()
    return f"[{', '.join(map(str, ids))}][{name} + 1]"
