"""Readers: documents, conversations, fixtures, texts, signatures and snapshots, validated as they are read."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework import schema
from sievework.functions import text as t
from sievework.operators import chat
from sievework.operators.filters import provenance_violation


def json_rows(spark: SparkSession, path: str, kind: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file with __path and __line; blank lines are skipped. A row that isn't an object, or has a field that `kind` lacks, fails with path and line.

    Each file is read as a whole by one task to number its lines; split large inputs into many files.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("__path"), F.posexplode(F.split("value", "\r?\n")).alias("at", "raw"))
    numbered = files.where(F.col("raw").rlike(t.NOT_SPACE)).withColumn("__line", F.col("at") + 1)
    known = F.array(*(F.lit(n) for n in kind.names))
    keys = F.json_object_keys("raw")
    bad = keys.isNull() | (F.size(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), known)) > 0)
    parsed = numbered.withColumn("r", F.from_json("raw", kind)).withColumn("bad", bad)
    return failing(parsed, F.when(F.col("bad"), F.lit("bad row")), F.col("__path"), F.col("__line")).select("r.*", "__path", "__line")


def failing(rows: DataFrame, violation: Column, path: Column, line: Column) -> DataFrame:
    """Fail on the first row with a violation, naming its place."""
    where = F.concat(path, F.lit(":"), line.cast("string"), F.lit(": "), violation)
    return rows.where(F.when(violation.isNotNull(), F.raise_error(where).cast("boolean")).otherwise(True))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents with `ord`; every provenance rule holds."""
    rows = json_rows(spark, path, schema.DOCUMENT).withColumn("source_type", F.coalesce("source_type", F.lit("text")))
    sound = failing(rows, provenance_violation(), F.col("__path"), F.col("__line"))
    return sound.withColumn("ord", F.struct("__path", "__line")).drop("__path", "__line")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    rows = json_rows(spark, path, schema.CONVERSATION)
    broken = chat.record_violation(F.col("messages"), [F.col(c) for c in ("source", "revision", "license", "record_id")], F.col("content_hash"))
    return failing(rows, broken, F.col("__path"), F.col("__line")).drop("__path", "__line")


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    return json_rows(spark, path, schema.FIXTURE).drop("__path", "__line")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, prediction); of an id's rows the last counts."""
    rows = json_rows(spark, path, T.StructType([T.StructField("id", T.StringType()), T.StructField("prediction", T.StringType())]))
    return rows.groupBy("id").agg(F.max_by("prediction", F.struct("__path", "__line")).alias("prediction"))


def read_texts(spark: SparkSession, path: str, field: str | None = None) -> DataFrame:
    """(text): one field of each JSON row, which may not be missing, or whole files."""
    if field is None:
        return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    rows = spark.read.text(path).where(F.col("value").rlike(t.NOT_SPACE)).select(F.get_json_object("value", f"$.{field}").alias("text"))
    return rows.select(F.when(F.col("text").isNull(), F.raise_error(F.lit(f"a row lacks {field}"))).otherwise(F.col("text")).alias("text"))


def read_snapshot(spark: SparkSession, path: str, *, revision: str, license: str, order: str = "doc_id", start: int = 0, limit: int | None = None) -> DataFrame:
    """A pinned snapshot table as documents: rows from `start` on, in order, at most `limit`."""
    if start < 0 or (limit is not None and limit < 1):
        raise ValueError("start is 0 at least, limit 1")
    rows = spark.read.parquet(path).orderBy(order)
    rows = rows.offset(start) if start else rows
    rows = rows if limit is None else rows.limit(limit)
    return from_table(rows, revision, license, order)


def from_table(rows: DataFrame, revision: str, license: str, order: str = "doc_id") -> DataFrame:
    """documents(doc_id, text, lang, source) as document records."""
    return rows.select(
        F.col(order).alias("ord"), "text", "source", F.lit(revision).alias("revision"), F.lit(license).alias("license"), F.coalesce("lang", F.lit("unknown")).alias("language"),
        F.col(order).cast("string").alias("record_id"), t.content_hash(F.col("text")).alias("content_hash"), F.lit("text").alias("source_type"), *(F.lit(None).cast("string").alias(c) for c in schema.OPTIONAL),
    )


def document_source(spark: SparkSession, *, manifest: str | None = None, snapshot: str | None = None, revision: str = "", license: str = "", start: int = 0, limit: int | None = None) -> DataFrame:
    """Documents of a manifest or of a snapshot, never both; a cursor belongs to snapshots."""
    if (manifest is None) == (snapshot is None):
        raise ValueError("name a manifest or a snapshot")
    if manifest is not None:
        if start or limit is not None:
            raise ValueError("a manifest is read whole")
        return read_documents(spark, manifest)
    return read_snapshot(spark, snapshot, revision=revision, license=license, start=start, limit=limit)  # type: ignore[arg-type]


def paragraphs(documents: DataFrame, least: int = 64) -> DataFrame:
    """(ord, at, text): pieces between blank lines of `least` characters or more, numbered among those."""
    pieces = F.filter(F.transform(F.split("text", "\n\n"), t.stripped), lambda x: F.length(x) >= least)
    return documents.select("ord", F.posexplode(pieces).alias("at", "text"))


def read_signatures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(norm_hash) and (signature) of a JSON file with lists `exact` and `simhash` of hex digits."""
    row = spark.read.schema("exact array<string>, simhash array<string>").json(path, multiLine=True)
    exact = row.select(F.explode("exact").alias("norm_hash"))
    return exact, row.select(F.explode("simhash").alias("x")).select(F.conv("x", 16, -10).cast("long").alias("signature"))


def write_signatures(signed: DataFrame, path: str) -> None:
    """The file that read_signatures reads, of an evaluation set (norm_hash, signature)."""
    from sievework.functions.sketch import hex16

    whole = signed.agg(F.array_sort(F.collect_set("norm_hash")).alias("exact"), F.array_sort(F.collect_set(hex16(F.col("signature")))).alias("simhash"))
    whole.coalesce(1).write.json(path)


def read_config(path: str, known: set[str]) -> dict[str, object]:
    """A TOML file's settings; an unknown one is an error."""
    settings = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    if odd := sorted(set(settings) - known):
        raise ValueError(f"unknown settings: {', '.join(odd)}")
    return settings
