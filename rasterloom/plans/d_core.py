"""Aggregations and statistics over planes, first part."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from rasterloom.functions import scalars
from rasterloom.operators import masks, quantiles, series, stats
from rasterloom.plans.common import CALLED, r6, rounded
from rasterloom.plans.j_agreement import called_plane
from rasterloom.plans.registry import query, with_plane
from rasterloom.sources import grids


@query(
    "d01_histogram",
    with_plane("""
SELECT s.seg, CAST(r.bin AS INTEGER) AS bin, count(p.a) AS n
FROM (SELECT DISTINCT seg FROM plane) s CROSS JOIN (SELECT range AS bin FROM range(256)) r
LEFT JOIN plane p ON p.seg = s.seg AND p.a = r.bin AND p.a <> 0 GROUP BY ALL"""),
)
def d01(spark, sf):
    return quantiles.histogram(grids.plane(spark, sf), ["seg"], "a")


@query(
    "d02_top_decile",
    with_plane("""
SELECT seg, CAST(coalesce(quantile_disc(a, 0.9) FILTER (a <> 0), 128) AS INTEGER) AS cut
FROM plane GROUP BY seg"""),
)
def d02(spark, sf):
    hist = quantiles.histogram(grids.plane(spark, sf), ["seg"], "a")
    return quantiles.histogram_decile(hist, ["seg"])


@query(
    "d03_percentile_linear",
    with_plane("""
SELECT seg, round(quantile_cont(f, 0.5), 6) AS p50, round(quantile_cont(f, 0.9), 6) AS p90,
  round(quantile_cont(f, 0.99), 6) AS p99
FROM (SELECT seg, a * 1.0 / (b + 1) AS f FROM plane) GROUP BY seg"""),
)
def d03(spark, sf):
    ratio = grids.plane(spark, sf).withColumn("f", F.col("a") / (F.col("b") + 1))
    return rounded(quantiles.percentiles(ratio, ["seg"], "f", {"p50": 50, "p90": 90, "p99": 99}))


@query(
    "d04_auto_window",
    with_plane("""
, s AS (SELECT seg, a, row_number() OVER (PARTITION BY seg ORDER BY a) - 1 AS i,
    count(*) OVER (PARTITION BY seg) AS n FROM plane WHERE a <> 0),
g AS (SELECT seg, CAST(max(a) FILTER (i = floor(0.005 * (n - 1))) AS DOUBLE) AS lo,
    CAST(max(a) FILTER (i = floor(0.995 * (n - 1))) AS DOUBLE) AS hi FROM s GROUP BY seg)
SELECT seg, coalesce(lo, 0.0::DOUBLE) AS lo,
  CASE WHEN lo IS NULL THEN 255.0::DOUBLE WHEN hi > lo THEN hi ELSE lo + 1 END AS hi
FROM (SELECT DISTINCT seg FROM plane) LEFT JOIN g USING (seg)"""),
)
def d04(spark, sf):
    return quantiles.floor_index_window(grids.plane(spark, sf), ["seg"], "a")


@query(
    "d05_group_medians",
    with_plane("""
SELECT left(seg, 1) AS scroll, round(median(m), 6) AS med, round(median(s), 6) AS med_spread,
  CAST(max(m) FILTER (i = n // 2) AS DOUBLE) AS upper_median
FROM (SELECT seg, m, s, row_number() OVER (PARTITION BY left(seg, 1) ORDER BY m) - 1 AS i,
    count(*) OVER (PARTITION BY left(seg, 1)) AS n
  FROM (SELECT seg, sum(a) AS m, max(a) - min(a) AS s FROM plane GROUP BY seg)) GROUP BY 1"""),
)
def d05(spark, sf):
    per_seg = grids.plane(spark, sf).groupBy("seg").agg(
        F.sum("a").alias("m"), (F.max("a") - F.min("a")).alias("s")
    )
    per_seg = per_seg.withColumn("scroll", F.substring("seg", 1, 1))
    upper = quantiles.ranked_values(per_seg, ["scroll"], "m").groupBy("scroll").agg(
        quantiles.at_rank(F.floor(F.col("size") / 2)).alias("upper_median")
    )
    med = rounded(quantiles.medians(per_seg, ["scroll"], {"med": "m", "med_spread": "s"}))
    return med.join(upper, "scroll")


@query(
    "d06_pearson",
    with_plane("SELECT seg, round(corr(a, b), 6) AS r, count(*) AS n FROM plane WHERE n > 0 GROUP BY seg"),
)
def d06(spark, sf):
    on = grids.plane(spark, sf).where("n > 0")
    return on.groupBy("seg").agg(r6(F.corr("a", "b"), "r"), F.count(F.lit(1)).alias("n"))


@query(
    "d07_partial_corr",
    # one covariate at a time by the recursion formula for partial correlations
    with_plane("""
, c AS (SELECT seg, corr(a, b) AS ab, corr(a, n) AS an, corr(a, y) AS ay, corr(b, n) AS bn,
    corr(b, y) AS by_, corr(n, y) AS ny FROM plane GROUP BY seg),
d AS (SELECT seg, (ab - an * bn) / sqrt((1 - an * an) * (1 - bn * bn)) AS ab_n,
    (ay - an * ny) / sqrt((1 - an * an) * (1 - ny * ny)) AS ay_n,
    (by_ - bn * ny) / sqrt((1 - bn * bn) * (1 - ny * ny)) AS by_n FROM c)
SELECT seg, round((ab_n - ay_n * by_n) / sqrt((1 - ay_n * ay_n) * (1 - by_n * by_n)), 6) AS partial_r
FROM d"""),
)
def d07(spark, sf):
    return rounded(stats.partial_corr(grids.plane(spark, sf), ["seg"], "a", "b", ["n", "y"]))


AUC_SQL = """
SELECT seg, count(*) FILTER (pos) AS n_pos, count(*) FILTER (NOT pos) AS n_neg,
  round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0)
    / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auc
FROM (SELECT seg, pos, rank() OVER (PARTITION BY seg ORDER BY f)
    + (count(*) OVER (PARTITION BY seg, f) - 1) / 2.0 AS rk FROM scored) GROUP BY seg"""


@query(
    "d08_auc_folded",
    with_plane(
        f""", scored AS (SELECT seg, a * 1.0 / (n + 1) AS f, b > 100 AS pos FROM plane), u AS ({AUC_SQL})
SELECT seg, n_pos, n_neg, CASE WHEN n_pos >= 50 AND n_neg >= 50 THEN greatest(auc, round(1 - auc, 6)) END
  AS auc FROM u"""
    ),
)
def d08(spark, sf):
    df = grids.plane(spark, sf).withColumn("f", F.col("a") / (F.col("n") + 1))
    u = rounded(quantiles.auc(df, ["seg"], "f", F.col("b") > 100, least=50))
    return u.withColumn("auc", F.round(quantiles.folded(F.col("auc")), 6))


@query(
    "d09_auc_average_ties",
    with_plane(f", scored AS (SELECT seg, a AS f, b > 120 AS pos FROM plane WHERE n > 0){AUC_SQL}"),
)
def d09(spark, sf):
    on = grids.plane(spark, sf).where("n > 0")
    return rounded(quantiles.auc(on, ["seg"], "a", F.col("b") > 120))


@query(
    "d10_jaccard",
    with_plane("""
SELECT seg, round(count(*) FILTER (a > 150 AND b > 150) / nullif(count(*) FILTER (a > 150 OR b > 150), 0), 6) AS j,
  round(count(*) FILTER (a > 251 AND b > 251) / nullif(count(*) FILTER (a > 251 OR b > 251), 0), 6) AS j_none,
  coalesce(round(count(*) FILTER (a > 251 AND b > 251) / nullif(count(*) FILTER (a > 251 OR b > 251), 0), 6), 0)
    AS j_zero
FROM plane GROUP BY seg"""),
)
def d10(spark, sf):
    a, b = F.col("a"), F.col("b")
    return grids.plane(spark, sf).groupBy("seg").agg(
        r6(stats.jaccard(a > 150, b > 150), "j"),
        r6(stats.jaccard(a > 251, b > 251), "j_none"),
        r6(stats.jaccard(a > 251, b > 251, empty=0.0), "j_zero"),
    )


@query(
    "d11_precision_at_top",
    with_plane("""
, c AS (SELECT seg, quantile_cont(a, 0.95) AS cut FROM plane GROUP BY seg),
t AS (SELECT seg, avg(CAST(b > 128 AS INT)) FILTER (a >= cut) AS p, avg(CAST(b > 128 AS INT)) AS q
  FROM plane JOIN c USING (seg) GROUP BY seg)
SELECT seg, round(p, 6) AS precision, round(q, 6) AS base_rate, round(p / q, 6) AS lift FROM t"""),
)
def d11(spark, sf):
    df = grids.plane(spark, sf)
    cut = df.groupBy("seg").agg(quantiles.byte_percentile(F.col("a"), 95).alias("cut"))
    hit = F.when(F.col("b") > 128, 1.0).otherwise(0.0)
    out = df.join(cut, "seg").groupBy("seg").agg(
        F.avg(F.when(F.col("a") >= F.col("cut"), hit)).alias("precision"), F.avg(hit).alias("base_rate")
    )
    return rounded(out.withColumn("lift", F.col("precision") / F.nullif("base_rate", F.lit(0.0))))


@query(
    "d12_cohens_d",
    with_plane("""
SELECT seg, round((avg(a) FILTER (b > 120) - avg(a) FILTER (b <= 120))
  / sqrt((var_pop(a) FILTER (b > 120) + var_pop(a) FILTER (b <= 120)) / 2.0), 6) AS d
FROM plane WHERE n > 0 GROUP BY seg"""),
)
def d12(spark, sf):
    on = grids.plane(spark, sf).where("n > 0")
    return on.groupBy("seg").agg(r6(stats.cohens_d(F.col("a"), F.col("b") > 120), "d"))


@query(
    "d13_zscore",
    with_plane("""
SELECT seg, y, x, round((a - avg(a) OVER w) / stddev_pop(a) OVER w, 4) AS z
FROM plane WINDOW w AS (PARTITION BY seg)"""),
)
def d13(spark, sf):
    z = stats.zscore(grids.plane(spark, sf), ["seg"], {"z": "a"})
    return z.select("seg", "y", "x", F.round("z", 4).alias("z"))


@query(
    "d14_zscore_of_search",
    with_plane("""
, m AS (SELECT seg, avg(a) AS mu, stddev_pop(a) AS sd, count(*) AS k FROM plane
  WHERE n > 0 AND b < 90 GROUP BY seg)
SELECT p.seg, y, x, CASE WHEN k >= 100 AND sd >= 1e-9 THEN round((a - mu) / sd, 4) END AS z
FROM plane p LEFT JOIN m USING (seg)"""),
)
def d14(spark, sf):
    df = grids.plane(spark, sf)
    inside = (F.col("n") > 0) & (F.col("b") < 90)
    m = df.where(inside).groupBy("seg").agg(
        F.avg("a").alias("mu"), F.stddev_pop("a").alias("sd"), F.count(F.lit(1)).alias("k")
    )
    usable = (F.col("k") >= 100) & (F.col("sd") >= 1e-9)
    z = F.when(usable, F.round((F.col("a") - F.col("mu")) / F.col("sd"), 4))
    return df.join(m, "seg", "left").select("seg", "y", "x", z.alias("z"))


@query(
    "d15_call_shares",
    f"""WITH {CALLED} SELECT seg, round(count(*) FILTER (ca AND cb) / count(*) FILTER (m), 6) AS both,
  round(count(*) FILTER (ca AND NOT cb) / count(*) FILTER (m), 6) AS only_a,
  round(count(*) FILTER (cb AND NOT ca) / count(*) FILTER (m), 6) AS only_b FROM called GROUP BY seg""",
)
def d15(spark, sf):
    on = called_plane(spark, sf).where("m")
    a, b = F.col("ca"), F.col("cb")
    return on.groupBy("seg").agg(
        r6(stats.share(a & b), "both"), r6(stats.share(a & ~b), "only_a"), r6(stats.share(b & ~a), "only_b")
    )


CODE_SQL = """CASE WHEN n > 0 AND a < 60 AND b < 60 THEN 2 WHEN n > 0 AND a > 150 AND b > 150 THEN 1
  WHEN n > 0 AND (a > 150) <> (b > 150) THEN 3 ELSE 0 END"""


def simple_code():
    a, b, on = F.col("a") > 150, F.col("b") > 150, F.col("n") > 0
    return masks.consensus_code(a, b, on, on & (F.col("a") < 60) & (F.col("b") < 60))


@query(
    "d16_code_counts",
    with_plane(f""", c AS (SELECT seg, {CODE_SQL} AS code FROM plane)
SELECT seg, count(*) FILTER (code = 0) AS unlabelled, count(*) FILTER (code = 1) AS ink,
  count(*) FILTER (code = 2) AS blank, count(*) FILTER (code = 3) AS disputed,
  round(count(*) FILTER (code = 0) * 100.0 / count(*), 6) AS unlabelled_pct,
  round(count(*) FILTER (code = 1) * 100.0 / count(*), 6) AS ink_pct,
  round(count(*) FILTER (code = 2) * 100.0 / count(*), 6) AS blank_pct,
  round(count(*) FILTER (code = 3) * 100.0 / count(*), 6) AS disputed_pct FROM c GROUP BY seg"""),
)
def d16(spark, sf):
    coded = grids.plane(spark, sf).withColumn("code", simple_code())
    return rounded(masks.code_counts(coded, ["seg"], "code"))


SILENCE_SQL = """sil AS (
  SELECT seg, left(seg, 1) AS scroll, CAST(trunc(quantile_cont(a, 0.5)) AS INTEGER) AS p50,
    CAST(trunc(quantile_cont(a, 0.9)) AS INTEGER) AS p90,
    CAST(trunc(quantile_cont(a, 0.99)) AS INTEGER) AS p99, max(a) AS top,
    count(*) FILTER (a >= 200) / count(*) AS conf, count(*) AS on_px,
    trunc(quantile_cont(a, 0.99)) < 246 AS silent
  FROM plane WHERE a > 0 GROUP BY seg HAVING count(*) >= 1000)"""


def silence(spark, sf, least: int = 1000, confident: int = 200, bar: int = 246):
    """Absolute-score statistics per map; maps with too few cells drop out."""
    on = grids.plane(spark, sf).where("a > 0")
    cut = lambda p: quantiles.byte_percentile(F.col("a"), p).cast("int")
    out = on.groupBy("seg").agg(
        cut(50).alias("p50"), cut(90).alias("p90"), cut(99).alias("p99"), F.max("a").alias("top"),
        stats.share(F.col("a") >= confident).alias("conf"), F.count(F.lit(1)).alias("on_px"),
    )
    return (
        out.where(F.col("on_px") >= least)
        .withColumn("silent", F.col("p99") < bar)
        .withColumn("scroll", F.substring("seg", 1, 1))
    )


@query(
    "d17_scroll_rollup",
    with_plane(f""", {SILENCE_SQL}
SELECT coalesce(scroll, 'ALL') AS scroll, count(*) AS maps, count(*) FILTER (silent) AS silent,
  CAST(trunc(median(p99)) AS INTEGER) AS med_p99, round(median(conf) * 100, 6) AS med_conf_pct
FROM sil GROUP BY ROLLUP (scroll)"""),
)
def d17(spark, sf):
    s = silence(spark, sf).select("scroll", "p99", "conf", "silent")
    # every map counts once for its scroll and once for the grand total
    both = s.withColumn("scroll", F.explode(F.array("scroll", F.lit("ALL"))))
    counts = both.groupBy("scroll").agg(F.count(F.lit(1)).alias("maps"), F.count_if("silent").alias("silent"))
    mid = quantiles.medians(both, ["scroll"], {"p": "p99", "c": "conf"})
    return counts.join(mid, "scroll").select(
        "scroll", "maps", "silent", F.col("p").cast("int").alias("med_p99"), r6(F.col("c") * 100, "med_conf_pct")
    )


@query(
    "d19_silence_stats",
    with_plane(f", {SILENCE_SQL} SELECT seg, scroll, p50, p90, p99, top, p99 - p50 AS spread,"
               " round(conf, 5) AS conf_frac, silent FROM sil"),
)
def d19(spark, sf):
    return silence(spark, sf).select(
        "seg", "scroll", "p50", "p90", "p99", "top", (F.col("p99") - F.col("p50")).alias("spread"),
        F.round("conf", 5).alias("conf_frac"), "silent",
    )


@query(
    "d26_block_reduce",
    with_plane("""
SELECT seg, CAST(y // 6 AS INTEGER) AS "by", CAST(x // 6 AS INTEGER) AS bx, bool_or(a > 200) AS any_hot,
  round(avg(a), 6) AS mean FROM plane WHERE y < 60 AND x < 60 GROUP BY ALL"""),
)
def d26(spark, sf):
    out = masks.block_reduce(
        grids.plane(spark, sf), ["seg"], 6, any_hot=F.bool_or(F.col("a") > 200), mean=F.avg("a")
    )
    return rounded(out)


AC_SQL = """, pr AS (SELECT seg, y AS t, sum(a) AS p FROM plane GROUP BY ALL),
fr AS MATERIALIZED (SELECT seg, t, p - avg(p) OVER (PARTITION BY seg) AS c FROM pr),
zz AS (SELECT seg, sum(c * c) AS z FROM fr GROUP BY seg),
lg AS MATERIALIZED (SELECT fr.*, CAST(l.range AS INTEGER) AS lag FROM fr CROSS JOIN range(40) l),
ac AS (SELECT u.seg, u.lag, sum(u.c * v.c) / max(z) AS ac
  FROM lg u JOIN fr v ON v.seg = u.seg AND v.t = u.t + u.lag JOIN zz ON zz.seg = u.seg WHERE z > 1e-6 GROUP BY ALL)"""


def row_ac(spark, sf):
    proj = series.projection(grids.plane(spark, sf), ["seg"], "y", F.sum("a"))
    return series.autocorrelation(proj, ["seg"], 39)


@query("d27_autocorrelation", with_plane(f"{AC_SQL} SELECT seg, lag, round(ac, 6) AS ac FROM ac"))
def d27(spark, sf):
    return rounded(row_ac(spark, sf))


@query(
    "d28_line_pitch",
    with_plane(f"""{AC_SQL}
SELECT seg, round(arg_max(lag, ac) * 0.5e0, 6) AS pitch_mm, round(max(ac), 6) AS strength
FROM ac WHERE lag >= 3 AND lag < 30 GROUP BY seg"""),
)
def d28(spark, sf):
    um = 500.0
    best = series.peak(row_ac(spark, sf), ["seg"], max(3, int(1500 / um)), int(15000 / um))
    return best.select("seg", r6(F.col("lag") * um / 1000.0, "pitch_mm"), r6("strength", "strength"))


@query(
    "d29_line_score",
    with_plane(f"""{AC_SQL}
SELECT seg, round(max(ac) FILTER (lag BETWEEN 12 AND 19)
   - median(ac) FILTER (lag BETWEEN 4 AND 11 OR lag BETWEEN 20 AND 29), 6) AS score,
  arg_max(lag, ac) FILTER (lag BETWEEN 12 AND 19) AS best_lag FROM ac GROUP BY seg"""),
)
def d29(spark, sf):
    return rounded(series.band_minus_background(row_ac(spark, sf), ["seg"], 16))


@query(
    "d30_line_pitch_check",
    with_plane(f""", mid AS (SELECT seg, (min(a) + max(a)) / 2.0 AS mid FROM plane GROUP BY seg),
pr AS (SELECT seg, y AS t, count(*) FILTER (a > mid) / 64.0 AS p FROM plane JOIN mid USING (seg) GROUP BY ALL),
fr AS MATERIALIZED (SELECT seg, t, p - avg(p) OVER (PARTITION BY seg) AS c FROM pr),
zz AS (SELECT seg, sum(c * c) AS z FROM fr GROUP BY seg),
lg AS MATERIALIZED (SELECT fr.*, CAST(l.range AS INTEGER) AS lag FROM fr CROSS JOIN range(3, 28) l),
ac AS (SELECT u.seg, u.lag, sum(u.c * v.c) / max(z) AS ac
  FROM lg u JOIN fr v ON v.seg = u.seg AND v.t = u.t + u.lag JOIN zz ON zz.seg = u.seg WHERE z > 1e-6 GROUP BY ALL),
b AS (SELECT seg, max(ac) AS s, arg_max(lag, ac) * 500e0 AS um FROM ac WHERE ac > 0 GROUP BY seg)
SELECT seg, round(um, 6) AS pitch_um, round(s, 6) AS strength,
  CASE WHEN s < 0.2 THEN 'too-weak' WHEN um > 3708 AND um < 9888 THEN 'consistent' ELSE 'wrong-period' END AS verdict
FROM b"""),
)
def d30(spark, sf):
    pitch, um = scalars.HAND["line_pitch"], 500.0
    df = grids.plane(spark, sf)
    mid = df.groupBy("seg").agg(((F.min("a") + F.max("a")) / 2.0).alias("mid"))
    proj = series.projection(
        df.join(mid, "seg"), ["seg"], "y", F.count_if(F.col("a") > F.col("mid")) / F.max("w")
    )
    lo, hi = max(3, int(pitch * 0.25 / um)), min(grids.PLANE_H - 2, int(pitch * 2.2 / um))
    ac = series.autocorrelation(proj, ["seg"], hi).where(F.col("ac") > 0)
    best = series.peak(ac, ["seg"], lo, hi + 1).withColumn("pitch_um", F.col("lag") * um)
    in_band = (F.col("pitch_um") > pitch * 0.6) & (F.col("pitch_um") < pitch * 1.6)
    verdict = (
        F.when(F.col("strength") < 0.2, "too-weak").when(in_band, "consistent").otherwise("wrong-period")
    )
    return best.select("seg", r6("pitch_um", "pitch_um"), r6("strength", "strength"), verdict.alias("verdict"))


@query(
    "d31_rhythm",
    with_plane("""
, pr AS (SELECT seg, x AS t, count(*) FILTER (a > 180) AS p FROM plane GROUP BY ALL),
fr AS MATERIALIZED (SELECT seg, t, p - avg(p) OVER (PARTITION BY seg) AS c FROM pr),
zz AS (SELECT seg, sum(c * c) AS z FROM fr GROUP BY seg),
lg AS MATERIALIZED (SELECT fr.*, CAST(l.range AS INTEGER) AS lag FROM fr CROSS JOIN range(6, 15) l),
ac AS (SELECT u.seg, u.lag, sum(u.c * v.c) / max(z) AS ac
  FROM lg u JOIN fr v ON v.seg = u.seg AND v.t = u.t + u.lag JOIN zz ON zz.seg = u.seg WHERE z > 1e-6 GROUP BY ALL)
SELECT seg, round(max(ac), 6) AS rhythm FROM ac GROUP BY seg"""),
)
def d31(spark, sf):
    advance = 10
    proj = series.projection(grids.plane(spark, sf), ["seg"], "x", F.count_if(F.col("a") > 180))
    lo, hi = int(advance * 0.6), int(advance * 1.5)
    best = series.peak(series.autocorrelation(proj, ["seg"], hi), ["seg"], lo, hi)
    return best.select("seg", r6("strength", "rhythm"))


@query(
    "d32_band_width",
    with_plane("""
, pr AS (SELECT seg, y AS t, count(*) FILTER (a > 150) AS p FROM plane GROUP BY ALL),
f0 AS (SELECT seg, t % 12 AS ph, avg(p) AS f FROM pr WHERE t < 60 GROUP BY ALL),
f1 AS (SELECT seg, ph, f - min(f) OVER (PARTITION BY seg) AS f FROM f0),
f2 AS (SELECT seg, ph, f / max(f) OVER (PARTITION BY seg) AS f,
    first_value(ph) OVER (PARTITION BY seg ORDER BY f DESC, ph) AS pk FROM f1),
f3 AS (SELECT seg, (ph + 6 - pk + 12) % 12 AS sh, f FROM f2)
SELECT seg, round((max(sh) FILTER (f >= 0.5) - min(sh) FILTER (f >= 0.5) + 1) * 0.25e0, 6) AS band_mm
FROM f3 GROUP BY seg"""),
)
def d32(spark, sf):
    proj = series.projection(grids.plane(spark, sf), ["seg"], "y", F.count_if(F.col("a") > 150))
    return rounded(series.folded_band_width(proj, ["seg"], 12, 250.0))


@query(
    "d33_correlation_length",
    with_plane("""
, m AS (SELECT seg, avg(a) AS mu FROM plane GROUP BY seg),
fr AS MATERIALIZED (SELECT seg, x AS t, a - avg(a) OVER (PARTITION BY seg) AS c FROM plane WHERE y = 32),
zz AS (SELECT seg, sum(c * c) AS z FROM fr GROUP BY seg),
lg AS MATERIALIZED (SELECT fr.*, CAST(l.range AS INTEGER) AS lag FROM fr CROSS JOIN range(40) l),
ac AS (SELECT u.seg, u.lag, sum(u.c * v.c) / max(z) AS ac
  FROM lg u JOIN fr v ON v.seg = u.seg AND v.t = u.t + u.lag JOIN zz ON zz.seg = u.seg WHERE z > 1e-6 GROUP BY ALL)
SELECT seg, CAST(coalesce(min(lag) FILTER (ac < exp(-1)), 40) AS INTEGER) AS corr_len FROM ac GROUP BY seg"""),
)
def d33(spark, sf):
    middle = grids.plane(spark, sf).where(F.col("y") == F.floor(F.col("h") / 2))
    proj = series.projection(middle, ["seg"], "x", F.max("a"))
    return series.correlation_length(series.autocorrelation(proj, ["seg"], 39), ["seg"], 40)


@query(
    "d34_effective_n",
    with_plane("""
, fr AS MATERIALIZED (SELECT seg, x AS t, a - avg(a) OVER (PARTITION BY seg) AS c FROM plane WHERE y = 32),
zz AS (SELECT seg, sum(c * c) AS z FROM fr GROUP BY seg),
lg AS MATERIALIZED (SELECT fr.*, CAST(l.range AS INTEGER) AS lag FROM fr CROSS JOIN range(40) l),
ac AS (SELECT u.seg, u.lag, sum(u.c * v.c) / max(z) AS ac
  FROM lg u JOIN fr v ON v.seg = u.seg AND v.t = u.t + u.lag JOIN zz ON zz.seg = u.seg WHERE z > 1e-6 GROUP BY ALL),
len AS (SELECT seg, coalesce(min(lag) FILTER (ac < exp(-1)), 40) AS k FROM ac GROUP BY seg)
SELECT seg, CASE WHEN k >= 1 THEN round(count(*) FILTER (n > 0) / (k * k), 6) END AS n_eff
FROM plane JOIN len USING (seg) GROUP BY seg, k"""),
)
def d34(spark, sf):
    area = grids.plane(spark, sf).groupBy("seg").agg(F.count_if(F.col("n") > 0).alias("px"))
    k = F.col("corr_len")
    return area.join(d33(spark, sf), "seg").select(
        "seg", F.when(k >= 1, F.round(F.col("px") / (k * k), 6)).alias("n_eff")
    )
