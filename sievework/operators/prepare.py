"""Corpus preparation from end to end: admission in order, split, packing, shards with their manifest, and a report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import text as t
from sievework.operators import dedup, filters, packs, splits
from sievework.operators.filters import Bounds, CodeRules
from sievework.sources import sinks
from sievework.sources.storage import require_fresh, written


def admitted_documents(documents: DataFrame, judged: DataFrame, order: str = "ord") -> DataFrame:
    """The documents without a reason, with content_hash."""
    return documents.join(judged.where("reason is null").select(order), order, "left_semi").withColumn("content_hash", t.content_hash(F.col("text")))


def prepare_corpus(
    documents: DataFrame, path: str, *, order: str = "ord", bounds: Bounds = Bounds(), distance: int = 3, evaluation: DataFrame | None = None, hashing: str = "blake2b",
    validation_fraction: float = 0.01, length: int = 1024, per_shard: int = 1024, drop_remainder: bool = True,
) -> dict:
    """Write documents (order, text) as token shards by split below `path`, and the report, which is returned. An output that exists is refused first."""
    spark = documents.sparkSession
    require_fresh(spark, path)
    judged = written(dedup.admit(documents, order=order, bounds=bounds, distance=distance, evaluation=evaluation, hashing=hashing), "prepared-judged")
    divided = splits.split_documents(admitted_documents(documents, judged, order), validation_fraction)
    sequences = packs.pack(divided.select(order, "split", "text"), length, order=order, drop_remainder=drop_remainder)
    manifest = sinks.write_shards(sequences, path, per_shard)
    totals = manifest.groupBy("split").agg(F.sum("sequences").alias("sequences"), F.sum("non_padding_tokens").alias("tokens"), F.count("*").alias("shards")).collect()  # a row for each split
    report = sinks.admission_report(judged) | {"splits": {r["split"]: {"sequences": r["sequences"], "tokens": r["tokens"], "shards": r["shards"]} for r in totals}}
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/report")
    return report


def prepare_code(documents: DataFrame, path: str, *, order: str = "ord", distance: int = 3, hashing: str = "blake2b", rules: CodeRules = CodeRules()) -> dict:
    """Code documents (the provenance columns, order, text) that the code filter and admission keep, as a manifest of JSON lines below `path`; gives the counts by reason of both."""
    require_fresh(documents.sparkSession, path)
    filtered = written(documents.withColumn("reason", filters.code_reason(rules)), "prepared-code")
    judged = written(dedup.admit(filtered.where("reason is null").drop("reason"), order=order, distance=distance, hashing=hashing), "prepared-judged")
    sinks.write_manifest(admitted_documents(filtered.drop("reason"), judged, order), f"{path}/documents")
    first = {r["reason"]: r["n"] for r in filtered.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n")).collect()}
    then = sinks.admission_report(judged)
    return then | {"seen": then["seen"] + sum(first.values()), "reasons": first | then["reasons"]}
