"""Order statistics that never sort a whole group in one task.

Groups (segments) may hold a third of all rows, so ranks are built in three
steps: collapse equal values map-side, spread the distinct values of each group
over monotone buckets, and carry the bucket totals across. Only bucket totals,
a bounded number per group, ever meet in one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RESOLUTION = 4096


def bucket(v: Column, resolution: int = RESOLUTION) -> Column:
    """Monotone, data-independent bucket number of a finite double."""
    return F.floor(F.asinh(v * 1024.0) * resolution)


def value_counts(df: DataFrame, keys: list[str], value: str, **sums: Column) -> DataFrame:
    extra = [F.sum(c).alias(n) for n, c in sums.items()]
    return df.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), *extra
    )


def bucket_offsets(vc: DataFrame, keys: list[str]) -> DataFrame:
    """Per bucket: how many rows lie in all lower buckets, and the group's size."""
    totals = vc.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    up = Window.partitionBy(*keys).orderBy("bucket")
    below = F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return totals.select(*keys, "bucket", F.coalesce(below, F.lit(0)).alias("_below"), whole.alias("size"))


def ranked_values(df: DataFrame, keys: list[str], value: str, **sums: Column) -> DataFrame:
    """Distinct values with ``n``, ``lt`` = rows strictly below, ``size`` = rows of the group.

    Average tie rank of a value is ``lt + (n + 1) / 2``.
    """
    vc = value_counts(df, keys, value, **sums).withColumn("bucket", bucket(F.col("v")))
    inside = (
        Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = vc.withColumn("_lt", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(bucket_offsets(vc, keys), [*keys, "bucket"]).select(
        *keys, "v", "n", *sums, (F.col("_lt") + F.col("_below")).alias("lt"), "size"
    )


def at_rank(k: Column) -> Column:
    """Aggregate: the value holding 0-based rank ``k``."""
    return F.max(F.when((F.col("lt") <= k) & (k < F.col("lt") + F.col("n")), F.col("v")))


def percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation percentiles (``ps`` maps output name to 0..100).

    For values from an unbounded domain. Planes quantised to a byte have at most
    256 distinct values, so ``byte_percentile`` is the cheaper choice there.
    """
    rv = ranked_values(df, keys, value)
    aggs = []
    for name, p in ps.items():
        h = F.lit(p / 100.0) * (F.col("size") - 1)
        lo, hi = F.floor(h), F.ceil(h)
        aggs += [at_rank(lo).alias(f"_lo_{name}"), at_rank(hi).alias(f"_hi_{name}"), F.max(h - lo).alias(f"_fr_{name}")]
    out = rv.groupBy(*keys).agg(*aggs)
    part = lambda n: F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")
    return out.select(*keys, *[part(n).alias(n) for n in ps])


def medians(df: DataFrame, keys: list[str], cols: dict[str, str | Column]) -> DataFrame:
    """Exact medians of several columns of an unbounded group, nulls left out.

    The columns travel as one long relation, so they share the exchanges.
    """
    entries = [F.struct(F.lit(o).alias("which"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("v")) for o, c in cols.items()]
    long = df.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*").where("v IS NOT NULL")
    got = percentiles(long, [*keys, "which"], "v", {"m": 50})
    return got.groupBy(*keys).agg(*[F.max(F.when(F.col("which") == o, F.col("m"))).alias(o) for o in cols])


def byte_percentile(value: Column, p: float) -> Column:
    """Exact percentile as an aggregate; its state is one counter per distinct value."""
    return F.percentile(value, F.lit(p / 100.0))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 256) -> DataFrame:
    """Counts for every bin 0..bins-1, value 0 (mask) left out, empty bins kept."""
    counted = df.where(F.col(value) != 0).groupBy(*keys, F.col(value).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    empty = (
        df.select(*keys)
        .distinct()
        .select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        .withColumn("n", F.lit(0).cast("long"))
    )
    return counted.unionByName(empty).groupBy(*keys, "bin").agg(F.sum("n").alias("n"))


def histogram_decile(hist: DataFrame, keys: list[str], share: float = 0.9, default: int = 128):
    """First bin whose cumulative count reaches ``share`` of the group."""
    up = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    cum = hist.withColumn(
        "_seen", F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_all", F.sum("n").over(whole))
    return cum.groupBy(*keys).agg(
        F.coalesce(
            F.min(F.when((F.col("_all") > 0) & (F.col("_seen") >= F.col("_all") * share), F.col("bin"))),
            F.lit(default),
        ).alias("cut")
    )


def floor_index_window(df, keys: list[str], value: str, lo: float = 0.5, hi: float = 99.5):
    """Display window: the values at floor(p/100*(n-1)) of the non-zero cells."""
    rv = ranked_values(df.where(F.col(value) != 0), keys, value)
    at = lambda p: at_rank(F.floor(F.lit(p) / 100.0 * (F.col("size") - 1)))
    got = rv.groupBy(*keys).agg(at(lo).alias("_lo"), at(hi).alias("_hi"))
    every = df.select(*keys).distinct().join(got, keys, "left")
    low = F.coalesce("_lo", F.lit(0.0))
    high = F.when(F.col("_lo").isNull(), 255.0).when(
        F.col("_hi") > F.col("_lo"), F.col("_hi")
    ).otherwise(F.col("_lo") + 1)
    return every.select(*keys, low.alias("lo"), high.alias("hi"))


def auc(df: DataFrame, keys: list[str], score: str, positive: Column, least: int = 1) -> DataFrame:
    """Rank AUC with averaged ties; null when a class has fewer than ``least`` cells.

    Works on value counts only: pairs won inside a bucket come from a window
    over that bucket, pairs won across buckets from the bucket totals.
    """
    pos = F.when(positive, 1).otherwise(0)
    vc = (
        value_counts(df, keys, score, np=pos)
        .withColumn("nn", F.col("n") - F.col("np"))
        .withColumn("bucket", bucket(F.col("v")))
    )
    inside = (
        Window.partitionBy(*keys, "bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = vc.withColumn("_low", F.coalesce(F.sum("nn").over(inside), F.lit(0)))
    per_bucket = local.groupBy(*keys, "bucket").agg(
        F.sum(F.col("np") * (F.col("_low") + F.col("nn") / 2.0)).alias("_u"),
        F.sum("np").alias("np"),
        F.sum("nn").alias("nn"),
    )
    below = (
        Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = per_bucket.withColumn("_below", F.coalesce(F.sum("nn").over(below), F.lit(0)))
    total = carried.groupBy(*keys).agg(
        F.sum(F.col("_u") + F.col("np") * F.col("_below")).alias("_u"),
        F.sum("np").alias("n_pos"),
        F.sum("nn").alias("n_neg"),
    )
    enough = (F.col("n_pos") >= least) & (F.col("n_neg") >= least)
    return total.select(
        *keys,
        "n_pos",
        "n_neg",
        F.when(enough, F.col("_u") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"),
    )


def folded(a: Column) -> Column:
    return F.greatest(a, 1.0 - a)
