"""Calibration, power, effect summaries and the class-balanced linear fit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.operators import quantiles, stats


def calibrate_floor(df, keys, score: str, ink: Column, blank: Column, fpr: float) -> DataFrame:
    """Score floor at a false-positive rate on known-blank cells, and its recall."""
    floors = df.where(blank).groupBy(*keys).agg(
        quantiles.byte_percentile(F.col(score), 100 * (1 - fpr)).alias("floor")
    )
    hit = F.when(F.col(score) > F.col("floor"), 1.0).otherwise(0.0)
    return (
        stats.beside(df, floors, list(keys))
        .groupBy(*keys, "floor")
        .agg(
            F.avg(F.when(ink, hit)).alias("sensitivity"),
            F.avg(F.when(blank, hit)).alias("blank_fpr"),
            F.count_if(ink).alias("n_ink"),
            F.count_if(blank).alias("n_blank"),
        )
    )


def power_of_two(p: Column, n: Column) -> Column:
    """Chance of at least two hits among ``n`` at rate ``p``."""
    return 1 - F.pow(1 - p, n) - n * p * F.pow(1 - p, n - 1)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for positive arguments: Stirling's series, eight places further on."""
    up = x + 8
    series = 1 / (12 * up) - 1 / (360 * F.pow(up, 3)) + 1 / (1260 * F.pow(up, 5)) - 1 / (1680 * F.pow(up, 7))
    steps = F.ln(x)
    for i in range(1, 8):
        steps = steps + F.ln(x + i)
    return (up - 0.5) * F.ln(up) - up + 0.5 * math.log(2 * math.pi) + series - steps


def beta_fraction(a: Column, b: Column, x: float) -> Column:
    """Continued fraction of the incomplete beta function, from its first term on.

    Convergents are carried on as three numbers; their count grows with the root of ``a + b``.
    """
    keep = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        c, d, h = acc["c"], acc["d"], acc["h"]
        for term in (even, odd):
            d, c = 1 / keep(1 + term * d), keep(1 + term / c)
            h = h * d * c
        return F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    first = 1 / keep(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    rounds = F.sequence(F.lit(1).cast("long"), (F.ceil(F.sqrt(a + b)) * 5 + 40).cast("long"))
    return F.aggregate(rounds, start, step)["h"]


def sign_test(k: Column, n: Column) -> Column:
    """Exact one-sided binomial tail P(X >= k) at one half, 1 for ``k`` of 0 and 0 beyond ``n``.

    The tail is the regularised incomplete beta function of ``k`` and ``n - k + 1`` at one
    half. Above the middle it is one minus the other tail, where the fraction converges slowly.
    """
    a, b = F.greatest(k, F.lit(1)).cast("double"), F.greatest(n - k + 1, F.lit(1)).cast("double")
    swap = a < b
    lo, hi = F.least(a, b), F.greatest(a, b)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) - (a + b) * math.log(2))
    part = front * beta_fraction(hi, lo, 0.5) / hi
    return F.when(k <= 0, 1.0).when(k > n, 0.0).otherwise(F.when(swap, 1 - part).otherwise(part))


def effect_summary(df: DataFrame, fine: str, coarse: str, bar: float) -> DataFrame:
    """Medians per side over the segments both sides scored; needs two segments."""
    both = (
        df.groupBy("feature", "seg")
        .agg(F.count_distinct("side").alias("sides"))
        .where("sides = 2")
        .select("feature", "seg")
    )
    kept = df.join(both, ["feature", "seg"], "left_semi")
    pick = lambda s: F.when(F.col("side") == s, F.col("excess"))
    mid = quantiles.medians(kept, ["feature"], {"fine": pick(fine), "coarse": pick(coarse)})
    counts = kept.groupBy("feature").agg(
        F.count_distinct("seg").alias("segs"), F.count_if((F.col("side") == fine) & (F.col("excess") > bar)).alias("sig")
    )
    joined = counts.where("segs >= 2").join(mid, "feature")
    return joined.select("feature", "segs", "fine", "coarse", (F.col("fine") - F.col("coarse")).alias("delta"), "sig")


def depth_contrast(vol: DataFrame, masks: DataFrame, shifts) -> DataFrame:
    """Standardised ink-minus-bare contrast per layer and its rolled-label envelope.

    Each target column gathers its labels under all draws as bits of three numbers,
    and voxels are summed per layer for all draws at once: no row is repeated.
    """
    draws = [(-1, 0, 0), *[(k, sy, sx) for k, (sy, sx) in enumerate(shifts)]]
    table = F.explode(
        F.array(*[F.struct(F.lit(1 << i).cast("long").alias("bit"), F.lit(a).alias("sy"), F.lit(b).alias("sx")) for i, (_, a, b) in enumerate(draws)])
    )
    bit = F.col("s.bit")
    moved = masks.select("seg", "y", "x", "h", "w", "ink", "bare", table.alias("s")).select(
        "seg",
        F.pmod(F.col("y") + F.col("s.sy"), F.col("h")).alias("y"),
        F.pmod(F.col("x") + F.col("s.sx"), F.col("w")).alias("x"),
        bit.alias("here"),
        F.when(F.col("ink"), bit).otherwise(0).alias("ink"),
        F.when(F.col("bare"), bit).otherwise(0).alias("bare"),
    )
    flags = moved.groupBy("seg", "y", "x").agg(*[F.bit_or(c).alias(c) for c in ("here", "ink", "bare")])
    v = F.col("v").cast("double")

    def under(c: str, i: int, value: Column) -> Column:
        return F.when(F.col(c).bitwiseAND(F.lit(1 << i)) != 0, value)

    def curve(i: int) -> Column:
        lift = F.avg(under("ink", i, v)) - F.avg(under("bare", i, v))
        return F.try_divide(lift, F.stddev_pop(under("here", i, v)))

    layers = vol.join(flags, ["seg", "y", "x"]).groupBy("seg", "z").agg(
        F.array(*[F.struct(F.lit(k).alias("k"), curve(i).alias("c")) for i, (k, _, _) in enumerate(draws)]).alias("cs")
    )
    curves = layers.select("seg", "z", F.explode("cs").alias("e")).select("seg", "z", "e.k", "e.c")
    null = F.when(F.col("k") >= 0, F.col("c"))
    return curves.groupBy("seg", "z").agg(
        F.max(F.when(F.col("k") == -1, F.col("c"))).alias("contrast"),
        F.percentile(null, F.lit(0.025)).alias("null_lo"),
        F.percentile(null, F.lit(0.975)).alias("null_hi"),
    )


def condition_ratios(per: DataFrame, key: str, read: str, metrics: list[str]) -> DataFrame:
    """One scroll's figures against the median of the others, and the spread."""
    long = per.select(
        key,
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("e"),
    ).select(key, "e.metric", "e.v")
    mine, other = F.when(F.col(key) == read, F.col("v")), F.when(F.col(key) != read, F.col("v"))
    return long.groupBy("metric").agg(
        F.max(mine).alias("read"),
        F.median(other).alias("others"),
        (F.max(mine) / F.nullif(F.median(other), F.lit(0.0))).alias("ratio"),
        (F.max("v") / F.greatest(F.min("v"), F.lit(1e-9))).alias("spread"),
    )


def fit_logistic(df: DataFrame, features: list[str], label: str, c: float = 0.02) -> DataFrame:
    """Class-balanced, L2-penalised logistic fit: one row per coefficient.

    Same objective as plain gradient descent on the balanced mean loss with
    penalty 1/(C n); the distributed solver runs it to convergence.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    spark = df.sparkSession
    prepared = df.select(
        array_to_vector(F.array(*[F.col(f).cast("double") for f in features])).alias("features"),
        F.col(label).cast("double").alias("label"),
    ).persist()
    size = prepared.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("p")).first()
    weighted = prepared.withColumn(
        "wt",
        F.when(F.col("label") == 1, 0.5 / max(size.p, 1e-9)).otherwise(0.5 / max(1 - size.p, 1e-9)),
    )
    model = LogisticRegression(
        weightCol="wt", regParam=1.0 / max(c * size.n, 1e-9), standardization=False, maxIter=300, tol=1e-9
    ).fit(weighted)
    rows = [(f, float(w)) for f, w in zip(features, model.coefficients)]
    return spark.createDataFrame([*rows, ("intercept", float(model.intercept))], "term string, weight double")
