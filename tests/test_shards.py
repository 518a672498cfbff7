"""Shards in files that hold many of them."""

import glob

import pytest
from pyspark.sql import functions as F

from sievework.sources import sinks


def test_files_do_not_grow_with_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = spark.range(2001).select(F.when(F.col("id") % 10 == 0, "validation").otherwise("train").alias("split"), F.floor(F.col("id") / 10).alias("t"), "id")
    rows = rows.select("split", F.when(F.col("split") == "validation", F.col("t")).otherwise(F.col("id") - F.col("t") - 1).alias("seq_id"), F.array(F.col("id").cast("int"), F.lit(1)).alias("token_ids"), F.lit(2).alias("non_padding_tokens"))
    manifest = sinks.write_shards(rows, path, 2)
    assert manifest.count() == 900 + 101
    assert len(glob.glob(f"{path}/tokens/**/*.parquet", recursive=True)) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    back = sinks.read_shards(spark, path, 2)
    assert back.exceptAll(rows.withColumn("shard", F.floor(F.col("seq_id") / 2)).select(back.columns)).isEmpty() and back.count() == 2001
    # A shard's rows lie in one file, in order.
    places = back.select("split", "shard", F.input_file_name().alias("file")).distinct()
    assert places.count() == 900 + 101 == len({(r.split, r.shard) for r in places.collect()})


def test_missing_and_foreign_rows_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([("train", i, [i, 1], 2) for i in range(6)], "split string, seq_id long, token_ids array<int>, non_padding_tokens int")
    path = str(tmp_path / "shards")
    sinks.write_shards(rows, path, 2)
    sinks.read_shards(spark, path, 2)
    more = rows.where("seq_id = 5").withColumns({"seq_id": F.lit(6).cast("long"), "shard": F.lit(3).cast("long")})
    more.coalesce(1).write.mode("append").parquet(f"{path}/tokens")
    with pytest.raises(ValueError, match="manifest"):
        sinks.read_shards(spark, path)
