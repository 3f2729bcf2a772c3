"""Projections and autocorrelation of raster lines.

A projection has one value per raster line, so everything after the first
aggregation is tiny next to the raster. Lagged products come from one windowed
``lead`` per lag inside a single sorted partition, never from a self-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def projection(df: DataFrame, keys, pos: str, value: Column) -> DataFrame:
    return df.groupBy(*keys, F.col(pos).alias("t")).agg(value.cast("double").alias("p"))


def autocorrelation(proj: DataFrame, keys, max_lag: int) -> DataFrame:
    """Rows ``(keys, lag, ac)`` of the mean-free series, normalised by lag 0.

    A flat series gives no rows.
    """
    whole = Window.partitionBy(*keys)
    line = Window.partitionBy(*keys).orderBy("t")
    free = proj.withColumn("_c", F.col("p") - F.avg("p").over(whole))
    lagged = free.withColumns(
        {f"_l{k}": F.col("_c") * (F.lead("_c", k).over(line) if k else F.col("_c")) for k in range(max_lag + 1)}
    )
    sums = lagged.groupBy(*keys).agg(
        F.array(*[F.coalesce(F.sum(f"_l{k}"), F.lit(0.0)) for k in range(max_lag + 1)]).alias("_s"),
        F.count(F.lit(1)).alias("_n"),
    )
    return (
        sums.where(F.sqrt(F.col("_s")[0] / F.col("_n")) > 1e-6)
        .select(*keys, "_n", F.col("_s")[0].alias("_z"), F.posexplode("_s").alias("lag", "_v"))
        .where(F.col("lag") < F.col("_n"))
        .select(*keys, "lag", (F.col("_v") / F.greatest("_z", F.lit(1e-9))).alias("ac"))
    )


def peak(ac: DataFrame, keys, lo: int, hi: int, name: str = "lag") -> DataFrame:
    """Largest value for ``lo <= lag < hi``; the first lag wins ties."""
    inside = ac.where((F.col("lag") >= lo) & (F.col("lag") < hi))
    best = F.max(F.struct(F.col("ac"), (-F.col("lag")).alias("neg"))).alias("_b")
    return inside.groupBy(*keys).agg(best).select(
        *keys, (-F.col("_b.neg")).alias(name), F.col("_b.ac").alias("strength")
    )


def band_minus_background(ac: DataFrame, keys, pitch: float) -> DataFrame:
    """Best value within 25 % of the pitch minus the median away from harmonics."""
    lo, hi = int(pitch * 0.75), int(pitch * 1.25)
    lag = F.col("lag")
    in_band = (lag >= lo) & (lag < hi)
    far = ((lag >= int(pitch * 0.3)) & (lag < lo)) | ((lag >= hi) & (lag < int(pitch * 1.9)))
    return ac.groupBy(*keys).agg(
        (
            F.max(F.when(in_band, F.col("ac")))
            - F.coalesce(F.median(F.when(far, F.col("ac"))), F.lit(0.0))
        ).alias("score"),
        F.max_by(F.when(in_band, lag), F.when(in_band, F.struct("ac", -lag))).alias("best_lag"),
    )


def correlation_length(ac: DataFrame, keys, max_lag: int) -> DataFrame:
    """First lag below 1/e, or the number of lags looked at."""
    seen = ac.where(F.col("lag") < max_lag)
    return seen.groupBy(*keys).agg(
        F.coalesce(
            F.min(F.when(F.col("ac") < F.exp(F.lit(-1.0)), F.col("lag"))), F.count(F.lit(1)).cast("int")
        ).alias("corr_len")
    )


def folded_band_width(proj: DataFrame, keys, pitch: int, um: float) -> DataFrame:
    """Width at half maximum of the profile folded on the pitch, in mm.

    Measured circularly around the peak; only whole periods are folded.
    """
    n = pitch
    whole = Window.partitionBy(*keys)
    size = F.count(F.lit(1)).over(whole)
    kept = proj.withColumn("_n", size).where(F.col("t") < F.floor(F.col("_n") / n) * n)
    fold = kept.where(F.col("_n") >= 2 * n).groupBy(*keys, (F.col("t") % n).alias("ph")).agg(
        F.avg("p").alias("f")
    )
    fold = fold.withColumn("f", F.col("f") - F.min("f").over(whole))
    fold = fold.withColumn("_top", F.max("f").over(whole)).where(F.col("_top") >= 1e-6)
    fold = fold.withColumn(
        "_pk", F.min(F.when(F.col("f") == F.col("_top"), F.col("ph"))).over(whole)
    )
    at = F.pmod(F.col("ph") + n // 2 - F.col("_pk"), F.lit(n))
    high = F.when(F.col("f") / F.col("_top") >= 0.5, at)
    return fold.groupBy(*keys).agg(((F.max(high) - F.min(high) + 1) * um / 1000.0).alias("band_mm"))
