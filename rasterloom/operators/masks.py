"""Plane flags that are plain columns, so no join is spent on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.operators import quantiles


def above_percentile(df: DataFrame, keys, value: str, pct: float, out: str) -> DataFrame:
    """Flag cells above a byte plane's percentile; ``>=`` where ties make ``>`` empty."""
    cuts = df.groupBy(*keys).agg(
        quantiles.byte_percentile(F.col(value), pct).alias("_cut"), F.max(value).alias("_top")
    )
    strict = F.when(F.col("_top") > F.col("_cut"), F.col(value) > F.col("_cut"))
    return (
        df.join(cuts, list(keys))
        .withColumn(out, strict.otherwise(F.col(value) >= F.col("_cut")))
        .drop("_cut", "_top")
    )


def consensus_code(a: Column, b: Column, m: Column, blank: Column) -> Column:
    """0 unlabelled, 1 both call, 3 exactly one calls, 2 certified blank (written last)."""
    return (
        F.when(blank, 2).when(a & b & m, 1).when((a != b) & m, 3).otherwise(0).cast("int")
    )


def block_code(code: Column) -> tuple[Column, Column]:
    """Code of a reduced block and whether it hides any disputed cell."""
    ink, blank, disputed = (F.bool_or(code == k) for k in (1, 2, 3))
    base = (
        F.when(disputed & ~ink, 3).when(ink, 1).when(blank, 2).otherwise(0).cast("int")
    )
    return base, disputed


def code_counts(df: DataFrame, keys, code: str) -> DataFrame:
    names = {0: "unlabelled", 1: "ink", 2: "blank", 3: "disputed"}
    total = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        *[F.count_if(F.col(code) == k).alias(n) for k, n in names.items()],
        *[(F.count_if(F.col(code) == k) * 100.0 / total).alias(f"{n}_pct") for k, n in names.items()],
    )


def block_reduce(df: DataFrame, keys, step: int, **aggs: Column) -> DataFrame:
    """Reduce full ``step x step`` blocks; a ragged remainder is trimmed."""
    fits = (F.col("y") < F.floor(F.col("h") / step) * step) & (
        F.col("x") < F.floor(F.col("w") / step) * step
    )
    return (
        df.where(fits)
        .groupBy(
            *keys,
            F.floor(F.col("y") / step).cast("int").alias("by"),
            F.floor(F.col("x") / step).cast("int").alias("bx"),
        )
        .agg(*[c.alias(n) for n, c in aggs.items()])
    )
