"""Ragged curves brought to one axis by piecewise-linear resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rasterloom.operators import quantiles


def common_axis(samples: DataFrame, group: str, curve: str, at: str, step: str, values: list[str]) -> DataFrame:
    """Median of each value over the curves of a group, where all of them have one.

    ``samples`` are the curves' points at whole numbers ``at``, in any spacing. The axis runs from the latest start to the
    earliest end, that end left out, in the smallest ``step`` of the group. A pair of neighbouring samples
    makes the grid points between them, so no curve is met with the whole grid. Returns the group, ``at``, ``tiles`` (curves)
    and the values; groups whose curves have no depth in common have no row.
    """
    ends = samples.groupBy(group, curve).agg(F.min(at).alias("_a"), F.max(at).alias("_b"), F.min(step).alias("_s"))
    ext = ends.groupBy(group).agg(F.max("_a").alias("_lo"), F.min("_b").alias("_hi"), F.min("_s").alias("_step"), F.count(F.lit(1)).alias("tiles"))
    win = Window.partitionBy(group, curve).orderBy(at)
    pairs = samples.select(group, curve, at, *values, F.lead(at).over(win).alias("_at2"), *[F.lead(v).over(win).alias(f"_{v}2") for v in values])
    pairs = pairs.where("_at2 IS NOT NULL").join(ext.where("_hi > _lo"), group)
    first = F.greatest(F.ceil((F.col(at) - F.col("_lo")) / F.col("_step")), F.lit(0))
    last = F.ceil((F.least("_at2", "_hi") - F.col("_lo")) / F.col("_step")) - 1
    on = pairs.where(last >= first).withColumn("_k", F.explode(F.sequence(first, last))).withColumn("_g", F.col("_lo") + F.col("_k") * F.col("_step"))
    part = (F.col("_g") - F.col(at)) / (F.col("_at2") - F.col(at))
    on = on.select(group, F.col("_g").alias(at), "tiles", *[(F.col(v) + (F.col(f"_{v}2") - F.col(v)) * part).alias(v) for v in values])
    mid = quantiles.medians(on, [group, at, "tiles"], {v: v for v in values})
    return mid.select(group, at, "tiles", *values)


def excursions(curves: DataFrame, value: str, lo: str, hi: str) -> DataFrame:
    """How far the curve lies outside its envelope, signed; 0 inside."""
    v = F.col(value)
    return curves.withColumn("excursion", F.when(v > F.col(hi), v - F.col(hi)).when(v < F.col(lo), v - F.col(lo)).otherwise(0.0))
