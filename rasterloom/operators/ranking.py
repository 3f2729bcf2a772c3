"""Top-k, separated peaks, round-robin picks and sample draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rasterloom.session import checkpoint


def separated_peaks(df: DataFrame, keys: list[str], value: str, k: int, min_sep: int) -> DataFrame:
    """Top ``k`` cells per group, each blanking a box of ``min_sep`` around it.

    Every round is one map-side maximum; the picks so far are a few rows per
    group, so no group is ever gathered. Ties go to the first cell in row order.
    """
    cells = df.select(*keys, "y", "x", F.col(value).alias("v")).persist()
    order = F.struct("v", -F.col("y"), -F.col("x"))
    picks = None
    for i in range(k):
        left = cells
        if picks is not None:
            p = picks.select(*keys, F.col("y").alias("_py"), F.col("x").alias("_px"))
            near = (F.col("y") >= F.col("_py") - min_sep) & (F.col("y") < F.col("_py") + min_sep)
            near = near & (F.col("x") >= F.col("_px") - min_sep) & (F.col("x") < F.col("_px") + min_sep)
            same = [F.col(f"c.{q}") == F.col(f"p.{q}") for q in keys]
            p = p.select(*[F.col(q) for q in keys], "_py", "_px").alias("p")
            cond = near
            for s in same:
                cond = cond & s
            left = cells.alias("c").join(p, cond, "left_anti")
        best = left.groupBy(*keys).agg(F.max_by(F.struct("y", "x", "v"), order).alias("b"))
        best = best.select(*keys, F.lit(i + 1).alias("place"), "b.y", "b.x", "b.v")
        # written: later rounds read the picks, they don't find them again
        best = checkpoint(best)
        picks = best if picks is None else picks.unionByName(best)
    return picks


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group; Spark prunes to k rows per task before the exchange."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def best_per_set(df: DataFrame, items: str, score: str, n: int) -> DataFrame:
    """Best ``n`` rows, one per set of items whatever their order."""
    key = F.array_join(F.array_sort(F.array_distinct(items)), ",")
    best = df.groupBy(key.alias("features")).agg(F.max(score).alias("best"))
    return best.orderBy(F.desc("best"), "features").limit(n)


def hashed_sample(df: DataFrame, group: list[str], ident: str, seed: str, n: int) -> DataFrame:
    """Repeatable pseudo-random ``n`` rows per group."""
    h = F.md5(F.concat(F.lit(seed), F.col(ident).cast("string")))
    return top_per_group(df, group, [h, F.col(ident)], n).drop("place")


def strata(df: DataFrame, group: str, um: str, bar: float, n_tune: int) -> DataFrame:
    """Groups that resolve the layer split into tune and held, the rest blind."""
    med = df.groupBy(group).agg(F.median(um).alias("um"))
    fine = F.lit(15.0) / F.col("um") >= bar
    # one row per scroll: the ordering runs over group names, not over data
    rank = F.row_number().over(Window.partitionBy(fine).orderBy("um", group))
    role = F.when(~fine, "blind").when(rank <= n_tune, "tune").otherwise("held")
    return med.withColumn("role", role)
