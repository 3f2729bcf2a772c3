"""Operators over time-ordered logs that stay safe when one client dominates.

A window over a whole client would gather it in one task, so the log is cut
into time buckets: work happens inside a bucket, and what crosses a boundary is
one small row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def running_max_before(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """Largest ``value`` of all earlier rows of the group; null for the first."""
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    tops = df.groupBy(*keys, bucket).agg(F.max(value).alias("_top"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select(*keys, bucket, F.max("_top").over(before).alias("_carry"))
    local = df.withColumn("_in", F.max(value).over(inside))
    return local.join(carry, [*keys, bucket]).withColumn(out, F.greatest("_in", "_carry")).drop("_in", "_carry")


def next_value(df: DataFrame, keys: list[str], order: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """``value`` of the following row of the group, across bucket borders too."""
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    firsts = df.groupBy(*keys, bucket).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    after = Window.partitionBy(*keys).orderBy(bucket)
    carry = firsts.select(*keys, bucket, F.lead("_first").over(after).alias("_carry"))
    local = df.withColumn("_in", F.lead(value).over(inside))
    return local.join(carry, [*keys, bucket]).withColumn(out, F.coalesce("_in", "_carry")).drop("_in", "_carry")


def busy_time(df: DataFrame, keys: list[str], start: str, end: str, bucket: str) -> DataFrame:
    """Length of the union of intervals: each adds only what lies past all earlier ends."""
    seen = running_max_before(df, keys, [start, end], bucket, end, "_seen")
    fresh = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce("_seen", start)), F.lit(0))
    return seen.groupBy(*keys).agg(F.sum(fresh).alias("busy"), F.count(F.lit(1)).alias("requests"))
