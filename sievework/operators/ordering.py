"""Running sums and row numbers over a global order, in two phases: no task sees more than its range of the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.sources.storage import written


def running(rows: DataFrame, order: list[str], value: Column, into: str = "start", within: list[str] | None = None) -> DataFrame:
    """rows with the sum of `value` over all rows before each, in `order` (which has no ties), apart for each group of `within`.

    Pass rows slim: they are range-partitioned and written once, which also fixes the ranges should a task be run again.
    """
    group = within or []
    ranged = written(rows.withColumn("__v", value.cast("long")).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*group, "__p").agg(F.sum("__v").alias("__s"))
    # One row for each range and group.
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*group, "__p", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__b"))
    inside = Window.partitionBy(*group, "__p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(base, [*group, "__p"]).withColumn(into, F.col("__b") + F.coalesce(F.sum("__v").over(inside), F.lit(0)))
    return out.drop("__v", "__p", "__b")


def numbered(rows: DataFrame, order: list[str], into: str = "position", within: list[str] | None = None) -> DataFrame:
    """rows numbered from 0 in `order`."""
    return running(rows, order, F.lit(1), into, within)
