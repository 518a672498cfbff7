"""Admission of a stream against a persistent signature index, and dedup in streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from sievework.functions import text as t
from sievework.operators import dedup
from sievework.sources.storage import exists_with_content


def admit_batch(batch: DataFrame, batch_id: int, index: str, out: str, *, distance: int = 3, hashing: str = "blake2b", evaluation: DataFrame | None = None) -> None:
    """Admit one micro-batch: its documents against the index, then among themselves; the admitted ones extend the index.

    Index and result are folders named by the batch, overwritten when Spark runs it again, so a repeated batch leaves the same.
    """
    spark = batch.sparkSession
    seen = None
    if batch_id and exists_with_content(spark, index):
        seen = spark.read.parquet(index).where(F.col("batch") < batch_id)
    judged = dedup.admit(batch, distance=distance, hashing=hashing, evaluation=evaluation) if seen is None else _against(batch, seen, distance, hashing, evaluation)
    judged.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    judged = spark.read.parquet(f"{out}/batch={batch_id}")
    admitted = batch.join(judged.where("reason is null").select("ord"), "ord", "left_semi")
    dedup.signatures(admitted, hashing=hashing).write.mode("overwrite").parquet(f"{index}/batch={batch_id}")


def _against(batch: DataFrame, seen: DataFrame, distance: int, hashing: str, evaluation: DataFrame | None) -> DataFrame:
    sound = batch.where(dedup.structural_reason(F.col("text")).isNull() & F.col("text").isNotNull())
    signed = dedup.signatures(sound, hashing=hashing)
    exact = signed.join(seen.select("norm_hash").distinct(), "norm_hash", "left_semi").select("ord", F.lit("exact_duplicate").alias("old"))
    pairs = dedup.near_signatures(signed, distance, dedup.BANDS, seen).select(F.col("a").alias("signature")).distinct()
    near = signed.join(pairs, "signature", "left_semi").join(exact, "ord", "left_anti").select("ord", F.lit("near_duplicate").alias("old"))
    old = exact.union(near)
    rest = dedup.admit(batch.join(old, "ord", "left_anti"), distance=distance, hashing=hashing, evaluation=evaluation)
    return rest.union(old.select("ord", F.col("old").alias("reason")))


def admit_stream(documents: DataFrame, index: str, out: str, checkpoint: str, **options: object) -> DataStreamWriter:
    """A writer that admits a stream of (ord, text); start() it with the trigger of your choice."""
    return documents.writeStream.foreachBatch(lambda df, i: admit_batch(df, i, index, out, **options)).option("checkpointLocation", checkpoint)  # type: ignore[arg-type]


def distinct_stream(documents: DataFrame) -> DataFrame:
    """The first arrival of each content hash; the hashes are kept in state."""
    return documents.withColumn("content_hash", t.content_hash(F.col("text"))).dropDuplicates(["content_hash"])
