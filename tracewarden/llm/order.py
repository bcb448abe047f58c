"""Distributed ranks and running totals: range partitions or salted buckets, and offsets from their sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .shared import stored

#: Rows that a bucket should hold; the number of buckets grows with the table.
BUCKET_ROWS = 5_000


def running_total(df: DataFrame, order: list[Column], value: str, out: str) -> DataFrame:
    """Adds out: the sum of value over this row and all before it in the global order. The rows are range-sorted once;
    only one sum for each partition meets in one task."""
    at = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    part = at.withColumn("_part", F.shiftright("_at", 33))
    sums = part.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(W.orderBy("_part")) - F.col("_sum")).alias("_before"))
    inside = F.sum(value).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    return part.withColumn(out, inside).join(before, "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_part", "_at", "_before")


def bucketed_total(df: DataFrame, group: list[str], spread: Column, order: list[Column], value: Column, out: str, rows: int) -> DataFrame:
    """Adds out: the running sum of value within group, in the order of spread (at least 0, below 1, even) and then order.
    A hot group is dealt over as many buckets as its rows need; only bucket sums meet in one task for a group."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    df = df.withColumn("_bucket", F.floor(spread * buckets).cast("long")).withColumn("_value", value)
    sums = df.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_sum"))
    before = sums.select(*group, "_bucket", (F.sum("_sum").over(W.partitionBy(*group).orderBy("_bucket")) - F.col("_sum")).alias("_before"))
    inside = F.sum("_value").over(W.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(out, inside).join(before, [*group, "_bucket"]).withColumn(out, F.col(out) + F.col("_before")).drop("_bucket", "_value", "_before")
