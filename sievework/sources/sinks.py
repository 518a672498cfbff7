"""Sinks: approved manifests, token shards with their manifest, directory manifests, reports. All are written once."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework import schema
from sievework.operators.packs import placed_shards
from sievework.sources.storage import require_fresh


def write_manifest(documents: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; Spark's commit makes them visible at once."""
    require_fresh(documents.sparkSession, path)
    documents.select(*sorted(set(documents.columns) & {*schema.DOCUMENT.names})).write.json(path, ignoreNullFields=False)


def write_report(report: dict, path: str) -> None:
    """A small JSON file with sorted keys, aside first, then renamed."""
    aside = f"{path}.{os.getpid()}.part"
    Path(aside).write_text(json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    os.replace(aside, path)


def read_report(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def admission_report(judged: DataFrame) -> dict:
    """Counts by reason; no text."""
    rows = judged.groupBy("reason").agg(F.count("*").alias("n")).collect()  # a row for each reason
    reasons = {r["reason"]: r["n"] for r in rows if r["reason"] is not None}
    seen = sum(r["n"] for r in rows)
    return {"pipeline": schema.PACK_VERSION, "near_dedup": schema.NEAR_VERSION, "seen": seen, "admitted": seen - sum(reasons.values()), "reasons": reasons}


#: The rows of shards. They hold split and shard themselves, for a folder for each shard would be as many folders as shards.
_ROWS = "split string, shard long, seq_id long, token_ids array<int>, non_padding_tokens int"
_MANIFEST = "split string, shard long, sequences long, non_padding_tokens long, first_index long, end_index long, sha256 string"


def write_shards(sequences: DataFrame, path: str, per_shard: int = 1024, grouped: bool = False) -> DataFrame:
    """Sequences (split, seq_id, token_ids, non_padding_tokens) as Parquet, and their manifest, written last, with a hash of each shard's content.

    A shard is a run of rows in one file, which holds many: files are as many as tasks, not as shards. grouped: the sequences come
    as pack(together=per_shard) gives them, a shard's in one partition and in order.
    """
    spark = sequences.sparkSession
    require_fresh(spark, path)
    placed = sequences.withColumn("shard", F.floor(F.col("seq_id") / per_shard)).to(_parse(_ROWS))
    if not grouped:
        placed = placed.repartition("split", "shard").sortWithinPartitions("split", "shard", "seq_id")
    placed.write.parquet(f"{path}/tokens")
    manifest = placed_shards(shard_contents(_rows(spark, path)), per_shard)
    manifest.select(*_parse(_MANIFEST).names).write.json(f"{path}/manifest")
    return spark.read.schema(_MANIFEST).json(f"{path}/manifest")


def _parse(fields: str) -> T.StructType:
    return T.StructType.fromDDL(fields)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """What lies in the files, wherever below the folder; a row of a file that shards don't have has no split."""
    return spark.read.schema(_ROWS).option("recursiveFileLookup", "true").parquet(f"{path}/tokens")


def shard_contents(sequences: DataFrame) -> DataFrame:
    """(split, shard, sequences, non_padding_tokens, shortest, longest, sha256) in one pass: counts, the sequences' lengths, and the hash of the rows' hashes, in order."""
    row = F.sha2(F.concat_ws(":", F.col("seq_id").cast("string"), F.col("non_padding_tokens").cast("string"), F.array_join("token_ids", ",")), 256)
    rows = sequences.select("split", "shard", "non_padding_tokens", F.size("token_ids").alias("length"), F.struct("seq_id", row.alias("h")).alias("x"))
    counts = F.count("*").alias("sequences"), F.sum("non_padding_tokens").alias("non_padding_tokens"), F.min("length").alias("shortest"), F.max("length").alias("longest")
    whole = rows.groupBy("split", "shard").agg(*counts, F.array_sort(F.collect_list("x")).alias("x"))
    return whole.withColumn("sha256", F.sha2(F.array_join(F.transform("x", lambda r: r["h"]), ""), 256)).drop("x")


def read_shards(spark: SparkSession, path: str, length: int | None = None) -> DataFrame:
    """The sequences of write_shards; fails where content, counts or lengths don't agree with the manifest."""
    rows = _rows(spark, path)
    manifest = spark.read.schema(_MANIFEST).json(f"{path}/manifest").select("split", "shard", F.col("sha256").alias("expected"))
    both = shard_contents(rows).join(manifest, ["split", "shard"], "full")
    other = F.lit(False) if length is None else (F.col("shortest") != length) | (F.col("longest") != length)
    found = both.agg(F.bool_or(~F.col("sha256").eqNullSafe(F.col("expected"))).alias("broken"), F.bool_or(other).alias("other")).first()
    if found["broken"]:
        raise ValueError("shards differ from their manifest")
    if found["other"]:
        raise ValueError("a sequence has another length")
    return rows


def directory_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, sha256, bytes) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = f"^.*?{path.rstrip('/').split('://')[-1].removeprefix('file:')}/"
    return files.select(F.regexp_replace("path", root, "").alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def directory_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, difference) of two directory manifests: missing, unexpected or changed."""
    both = expected.select("name", F.col("sha256").alias("e")).join(actual.select("name", F.col("sha256").alias("a")), "name", "full")
    kind = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(F.col("a") != F.col("e"), "changed")
    return both.select("name", kind.alias("difference")).where("difference is not null")


def archive_files(spark: SparkSession, path: str, *, excluded: list[str], suffixes: list[str], required: list[str], most: int) -> DataFrame:
    """(name, bytes) of the files to archive, sorted; fails on a file above `most` bytes or a required one that is missing. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    root = f"^.*?{path.rstrip('/').split('://')[-1].removeprefix('file:')}/"
    named = files.select(F.regexp_replace("path", root, "").alias("name"), F.col("length").alias("bytes"))
    parts = F.split("name", "/")
    kept = named.where(~F.arrays_overlap(parts, F.array(*(F.lit(x) for x in excluded)))).where(~F.startswith(F.element_at(parts, -1), F.lit(".env")))
    for s in suffixes:
        kept = kept.where(~F.endswith("name", F.lit(s)))
    if not kept.where(F.col("bytes") > most).isEmpty():
        raise ValueError("a file is too large")
    wanted = spark.createDataFrame([(n,) for n in required], "name string")
    if not wanted.join(kept, "name", "left_anti").isEmpty():
        raise ValueError("a required file is missing")
    return kept.orderBy("name")
