"""Reproducible train and validation splits by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 10_000


def split_bucket(content_hash: Column, parent_hash: Column | None = None) -> Column:
    """0 to 9999 from the first 8 hex digits of the root's hash: rewritten documents stay with their origin."""
    root = content_hash if parent_hash is None else F.coalesce(parent_hash, content_hash)
    return F.conv(F.substring(root, 1, 8), 16, 10).cast("long") % BUCKETS


def split_name(bucket: Column, validation_fraction: float = 0.01) -> Column:
    if not 0 < validation_fraction < 1:
        raise ValueError("validation_fraction lies between 0 and 1")
    return F.when(bucket < int(validation_fraction * BUCKETS), "validation").otherwise("train")


def split_documents(documents: DataFrame, validation_fraction: float = 0.01) -> DataFrame:
    """documents (with content_hash, and perhaps parent_content_hash) with `split`."""
    parent = F.col("parent_content_hash") if "parent_content_hash" in documents.columns else None
    return documents.withColumn("split", split_name(split_bucket(F.col("content_hash"), parent), validation_fraction))


def corpus_identity(documents: DataFrame, order: str = "ord") -> DataFrame:
    """One row: the SHA-256 of all content hashes, in order. The hashes of the whole corpus are joined in one row; meant for small corpora."""
    hashes = F.array_sort(F.collect_list(F.struct(order, "content_hash")))
    return documents.agg(F.sha2(F.array_join(F.transform(hashes, lambda x: x["content_hash"]), ""), 256).alias("identity"), F.count("*").alias("documents"))
