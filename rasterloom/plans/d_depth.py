"""Aggregations and statistics, second part: depth stacks, calibration, summaries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from rasterloom.operators import depth, learn, nulls, quantiles, stats
from rasterloom.plans.common import r6, rounded
from rasterloom.plans.d_core import SILENCE_SQL, silence
from rasterloom.plans.registry import CELL, query, with_plane, with_volume
from rasterloom.sources import grids

PEAK = """, prof AS (SELECT seg, z, avg(v) AS m FROM volume GROUP BY ALL),
pk AS (SELECT seg, arg_max(z, (m, -z)) AS pk, max(m) - min(m) AS span FROM prof GROUP BY seg)"""


@query(
    "d18_verdict_counts",
    with_plane(f""", {SILENCE_SQL},
v AS (SELECT CASE WHEN silent THEN 'SILENT' WHEN conf > 0.12 THEN 'STRONG' ELSE 'WEAK' END AS verdict FROM sil)
SELECT verdict, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, verdict) AS place
FROM v GROUP BY verdict"""),
)
def d18(spark, sf):
    verdict = F.when(F.col("silent"), "SILENT").when(F.col("conf") > 0.12, "STRONG").otherwise("WEAK")
    counts = silence(spark, sf).groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    # one row per verdict text, three in all
    rank = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "verdict")
    return counts.withColumn("place", F.row_number().over(rank).cast("long"))


@query(
    "d20_depth_levels",
    with_volume("""
, c AS (SELECT seg, y, x, avg(z) AS cen FROM volume WHERE v > 150 GROUP BY ALL)
SELECT seg, count(*) AS cols, round(stddev_pop(cen), 6) AS sd, count(DISTINCT round_even(cen, 0)) AS levels
FROM c GROUP BY seg"""),
)
def d20(spark, sf):
    hot = grids.volume(spark, sf).where("v > 150")
    cen = hot.groupBy("seg", "y", "x").agg(F.avg("z").alias("cen"))
    return cen.groupBy("seg").agg(
        F.count(F.lit(1)).alias("cols"), r6(F.stddev_pop("cen"), "sd"),
        F.count_distinct(F.rint("cen")).alias("levels"),
    )


@query("d21_depth_profile", with_volume(f"{PEAK} SELECT seg, pk, round(span, 6) AS span FROM pk"))
def d21(spark, sf):
    return rounded(depth.layer_peak(grids.volume(spark, sf)))


@query(
    "d22_height_map",
    with_volume(f"""{PEAK},
h AS (SELECT seg, y, x, sum(v * (z - pk)) / greatest(sum(v), 1e-6) * 2.5 AS h FROM volume JOIN pk USING (seg)
  WHERE z BETWEEN pk - 5 AND pk + 5 GROUP BY ALL)
SELECT seg, y, x, round(h - avg(h) OVER (PARTITION BY seg), 4) AS height FROM h"""),
)
def d22(spark, sf):
    return rounded(depth.height_map(grids.volume(spark, sf), 5, 2.5), 4)


@query(
    "d23_sheet_centroid",
    with_volume("""
, m AS (SELECT seg, y, x, z, v - min(v) OVER (PARTITION BY seg, y, x) AS w FROM volume WHERE z >= 3 AND z < 18)
SELECT seg, y, x, round(CASE WHEN sum(w) > 1e-3 THEN sum(w * z) / sum(w) ELSE 10.5e0 END, 4) AS depth
FROM m GROUP BY ALL"""),
)
def d23(spark, sf):
    return rounded(depth.sheet_centroid(grids.volume(spark, sf), 3, 18), 4)


@query(
    "d24_band_mean",
    with_volume(f"""{PEAK}
SELECT seg, y, x, round(avg(v), 4) AS img FROM volume JOIN pk USING (seg)
WHERE z BETWEEN greatest(2, least(pk + 3, 18)) - 2 AND greatest(2, least(pk + 3, 18)) + 2 GROUP BY ALL"""),
)
def d24(spark, sf):
    return rounded(depth.band_mean(grids.volume(spark, sf), 2, 3).drop("h", "w"), 4)


@query(
    "d25_response_label",
    with_volume("""
SELECT seg, y, x, max(v) >= 180 AS ink, max(v) - median(v) >= 120 AS sharp, arg_max(z, (v, -z)) AS depth
FROM volume GROUP BY ALL"""),
)
def d25(spark, sf):
    return depth.response_label(grids.volume(spark, sf), 180, 120)


COV = """, cp AS MATERIALIZED (SELECT seg, y, x, list(v ORDER BY z) AS p FROM volume GROUP BY ALL)
SELECT seg, CAST(i.range AS INTEGER) AS i, CAST(j.range AS INTEGER) AS j,
  CAST(count(*) * sum(p[i.range + 1] * p[j.range + 1]) - sum(p[i.range + 1]) * sum(p[j.range + 1]) AS BIGINT) AS c
FROM cp CROSS JOIN range(21) i CROSS JOIN range(21) j GROUP BY ALL"""


@query("d35_layer_covariance", with_volume(COV))
def d35_cov(spark, sf):
    # scaled by the squared column count the covariance is a whole number
    n = grids.VOL_H * grids.VOL_W
    cov = depth.layer_covariance(grids.volume(spark, sf))
    return cov.withColumn("c", F.round(F.col("c") * n * n).cast("long"))


@query("d35_depth_basis")
def d35(spark, sf):
    return depth.depth_basis(grids.volume(spark, sf), 3)


@query("d36_depth_projection")
def d36(spark, sf):
    vol = grids.volume(spark, sf)
    return rounded(depth.project(vol, depth.depth_basis(vol, 3)), 6)


@query("d37_logistic")
def d37(spark, sf):
    df = grids.plane(spark, sf).where("n > 0")
    z = stats.zscore(df.withColumn("yy", F.col("y")), ["seg"], {"za": "a", "zn": "n", "zy": "yy"})
    return learn.fit_logistic(z.withColumn("ink", F.col("b") > 128), ["za", "zn", "zy"], "ink")


FLOOR = """fl AS (SELECT left(seg, 1) AS scroll, quantile_cont(a, 0.998) AS floor FROM plane
  WHERE n > 0 AND b < 60 GROUP BY 1)"""


@query(
    "d38_floor_calibration",
    with_plane(f""", {FLOOR}
SELECT scroll, round(floor, 6) AS floor,
  round(avg(CAST(a > floor AS INT)) FILTER (b > 128), 6) AS sensitivity,
  round(avg(CAST(a > floor AS INT)) FILTER (b < 60), 6) AS blank_fpr,
  count(*) FILTER (b > 128) AS n_ink, count(*) FILTER (b < 60) AS n_blank
FROM plane JOIN fl ON scroll = left(seg, 1) WHERE n > 0 GROUP BY scroll, floor"""),
)
def d38(spark, sf):
    df = grids.plane(spark, sf).where("n > 0").withColumn("scroll", F.substring("seg", 1, 1))
    return rounded(
        learn.calibrate_floor(df, ["scroll"], "a", F.col("b") > 128, F.col("b") < 60, 0.002)
    )


@query(
    "d39_binomial_power",
    with_plane("""
, r AS (SELECT seg, count(*) FILTER (a > 200) / count(*) AS p FROM plane WHERE b > 128 GROUP BY seg)
SELECT seg, CAST(k AS INTEGER) AS letters, round(1 - pow(1 - p, k) - k * p * pow(1 - p, k - 1), 6) AS power
FROM r CROSS JOIN (VALUES (3), (5), (10), (20)) t(k)"""),
)
def d39(spark, sf):
    rate = grids.plane(spark, sf).where("b > 128").groupBy("seg").agg(
        stats.share(F.col("a") > 200).alias("p")
    )
    k = F.explode(F.array(*[F.lit(n) for n in (3, 5, 10, 20)]))
    return rate.select("seg", "p", k.alias("letters")).select(
        "seg", "letters", r6(learn.power_of_two(F.col("p"), F.col("letters")), "power")
    )


@query(
    "d40_sign_test",
    with_plane("""
, d AS (SELECT left(seg, 1) AS scroll, avg(a) FILTER (x < 32) - avg(a) FILTER (x >= 32) AS d FROM plane GROUP BY seg),
k AS (SELECT scroll, count(*) AS n, count(*) FILTER (d > 0) AS k, avg(d) AS mean_delta FROM d GROUP BY scroll)
SELECT scroll, n, k, round(mean_delta, 6) AS mean_delta,
  round((SELECT sum(exp(lgamma(n + 1) - lgamma(i.range + 1) - lgamma(n - i.range + 1) - n * ln(2)))
    FROM (SELECT unnest(range(k, n + 1)) AS range) i), 6) AS p FROM k"""),
)
def d40(spark, sf):
    left = F.col("x") < 32
    per = grids.plane(spark, sf).groupBy("seg").agg(
        (F.avg(F.when(left, F.col("a"))) - F.avg(F.when(~left, F.col("a")))).alias("d")
    )
    k = per.groupBy(F.substring("seg", 1, 1).alias("scroll")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") > 0).alias("k"), F.avg("d").alias("mean_delta")
    )
    return rounded(k.withColumn("p", learn.sign_test(F.col("k"), F.col("n"))))


EFFECTS = """, e AS (SELECT c.layer AS feature, CASE WHEN d < 5 THEN 'fine' ELSE 'coarse' END AS side, seg,
    avg(q) / 50.0 AS excess, count(*) AS n FROM cell c GROUP BY ALL HAVING count(*) >= 100),
ok AS (SELECT feature, seg FROM e GROUP BY ALL HAVING count(DISTINCT side) = 2),
f AS (SELECT e.* FROM e JOIN ok USING (feature, seg))
SELECT feature, count(DISTINCT seg) AS segs, round(median(excess) FILTER (side = 'fine'), 6) AS fine,
  round(median(excess) FILTER (side = 'coarse'), 6) AS coarse,
  round(median(excess) FILTER (side = 'fine') - median(excess) FILTER (side = 'coarse'), 6) AS delta,
  count(*) FILTER (side = 'fine' AND excess > 0.51) AS sig FROM f GROUP BY feature HAVING count(DISTINCT seg) >= 2"""


@query("d41_effect_summary", f"WITH {CELL}{EFFECTS}")
def d41(spark, sf):
    s = grids.samples(spark, sf).withColumn("side", F.when(F.col("d") < 5, "fine").otherwise("coarse"))
    e = s.groupBy(F.col("layer").alias("feature"), "side", "seg").agg(
        (F.avg("q") / 50.0).alias("excess"), F.count(F.lit(1)).alias("n")
    )
    return rounded(learn.effect_summary(e.where("n >= 100"), "fine", "coarse", 0.51))


@query(
    "d43_speck_tails",
    with_volume("""
, c AS (SELECT seg, quantile_cont(v, 0.95) AS hi, quantile_cont(v, 0.05) AS lo FROM volume WHERE v > 0
  GROUP BY seg HAVING count(*) >= 1000)
SELECT seg, y, x, count(*) FILTER (v >= hi) AS hot, count(*) FILTER (v <= lo AND v > 0) AS cold
FROM volume JOIN c USING (seg) GROUP BY ALL"""),
)
def d43(spark, sf):
    t = depth.tails(grids.volume(spark, sf), 95, 5)
    return t.groupBy("seg", "y", "x").agg(F.count_if("hot").alias("hot"), F.count_if("cold").alias("cold"))


@query(
    "d43_speck_profile",
    with_volume("""
, c AS (SELECT seg, quantile_cont(v, 0.95) AS hi FROM volume WHERE v > 0 GROUP BY seg HAVING count(*) >= 1000)
SELECT seg, z, count(*) FILTER (v >= hi) AS hot FROM volume JOIN c USING (seg) GROUP BY ALL"""),
)
def d43_profile(spark, sf):
    t = depth.tails(grids.volume(spark, sf), 95, 5)
    return t.groupBy("seg", "z").agg(F.count_if("hot").alias("hot"))


@query(
    "d44_speck_core_share",
    with_volume("""
, c AS (SELECT seg, quantile_cont(v, 0.95) AS hi FROM volume WHERE v > 0 GROUP BY seg HAVING count(*) >= 1000)
SELECT seg, y, x, round(count(*) FILTER (v >= hi AND z BETWEEN 7 AND 13)
  / greatest(count(*) FILTER (v >= hi), 1), 6) AS core FROM volume JOIN c USING (seg) GROUP BY ALL"""),
)
def d44(spark, sf):
    t = depth.tails(grids.volume(spark, sf), 95, 5)
    mid = F.floor(F.col("d") / 2)
    third = F.floor(F.col("d") / 6)
    core = F.col("hot") & (F.col("z") >= F.greatest(mid - third, F.lit(0))) & (F.col("z") <= mid + third)
    return t.groupBy("seg", "y", "x").agg(
        r6(F.count_if(core) / F.greatest(F.count_if("hot"), F.lit(1)), "core")
    )


DSHIFTS = nulls.draw_shifts(seed=3, n=10, lo=3, h=16, w=16)


@query(
    "d45_depth_contrast",
    with_volume(f"""
, l AS (SELECT seg, y, x, count(*) FILTER (v > 0) AS l FROM volume GROUP BY ALL),
q AS (SELECT seg, quantile_cont(l, 0.2) AS lo, quantile_cont(l, 0.8) AS hi FROM l GROUP BY seg),
k AS (SELECT seg, y, x, l >= hi AS ink, l <= lo AS bare FROM l JOIN q USING (seg)),
s AS (SELECT -1 AS k, 0 AS sy, 0 AS sx UNION ALL SELECT * FROM {nulls.sql_shifts(DSHIFTS)}),
m AS MATERIALIZED (SELECT seg, s.k, (y + sy) % 16 AS y, (x + sx) % 16 AS x, ink, bare FROM k CROSS JOIN s),
c AS (SELECT seg, k, z, (avg(v) FILTER (ink) - avg(v) FILTER (bare)) / stddev_pop(v) AS c
  FROM volume JOIN m USING (seg, y, x) GROUP BY ALL)
SELECT seg, z, round(max(c) FILTER (k = -1), 6) AS contrast,
  round(quantile_cont(c, 0.025) FILTER (k >= 0), 6) AS null_lo,
  round(quantile_cont(c, 0.975) FILTER (k >= 0), 6) AS null_hi FROM c GROUP BY ALL"""),
)
def d45(spark, sf):
    vol = grids.volume(spark, sf)
    label = vol.groupBy("seg", "y", "x", "h", "w").agg(F.count_if(F.col("v") > 0).alias("l"))
    cut = label.groupBy("seg").agg(
        quantiles.byte_percentile(F.col("l"), 20).alias("lo"), quantiles.byte_percentile(F.col("l"), 80).alias("hi")
    )
    masks = label.join(cut, "seg").select(
        "seg", "y", "x", "h", "w", (F.col("l") >= F.col("hi")).alias("ink"), (F.col("l") <= F.col("lo")).alias("bare")
    )
    return rounded(learn.depth_contrast(vol, masks, DSHIFTS))


@query(
    "d46_gap_spacing",
    with_plane("""
, g AS (SELECT seg, x - lag(x) OVER (PARTITION BY seg, y ORDER BY x) AS gap FROM plane WHERE a > 180)
SELECT seg, CAST(gap AS INTEGER) AS gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL"""),
)
def d46(spark, sf):
    hot = grids.plane(spark, sf).where("a > 180")
    prev = F.lag("x").over(Window.partitionBy("seg", "y").orderBy("x"))
    gaps = hot.select("seg", (F.col("x") - prev).alias("gap")).where("gap IS NOT NULL")
    return gaps.groupBy("seg", "gap").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d47_area_totals",
    with_plane("""
SELECT left(seg, 1) AS scroll, count(*) FILTER (a > 150 AND b > 150) AS ink_px,
  round(count(*) FILTER (a > 150 AND b > 150) * pow(18.064 / 1000, 2) / 100, 6) AS ink_cm2,
  round(count(*) FILTER ((a > 150) <> (b > 150)) * pow(18.064 / 1000, 2) / 100, 6) AS disputed_cm2
FROM plane WHERE n > 0 GROUP BY 1"""),
)
def d47(spark, sf):
    on = grids.plane(spark, sf).where("n > 0")
    a, b = F.col("a") > 150, F.col("b") > 150
    cm2 = (18.064 / 1000) ** 2 / 100
    return on.groupBy(F.substring("seg", 1, 1).alias("scroll")).agg(
        F.count_if(a & b).alias("ink_px"), r6(F.count_if(a & b) * cm2, "ink_cm2"),
        r6(F.count_if(a != b) * cm2, "disputed_cm2"),
    )


@query(
    "d48_live_area",
    """SELECT p_brand AS seg, count(*) AS pts, count(*) FILTER (l.l_partkey IS NOT NULL) AS live_pts,
  round(count(*) FILTER (l.l_partkey IS NOT NULL) / count(*), 6) AS livefrac,
  round((CASE WHEN p_brand LIKE '%1%' THEN sum(p_size) END)
    * (count(*) FILTER (l.l_partkey IS NOT NULL) / count(*)), 6) AS live_area
FROM part LEFT JOIN (SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 49) l ON p_partkey = l_partkey
GROUP BY p_brand""",
)
def d48(spark, sf):
    live = grids.table(spark, sf, "lineitem").where("l_quantity >= 49").select("l_partkey").distinct()
    pts = grids.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    joined = pts.join(live, pts.p_partkey == live.l_partkey, "left")
    alive = F.col("l_partkey").isNotNull()
    frac = F.count_if(alive) / F.count(F.lit(1))
    return joined.groupBy(F.col("p_brand").alias("seg")).agg(
        F.count(F.lit(1)).alias("pts"), F.count_if(alive).alias("live_pts"), r6(frac, "livefrac"),
        r6(F.when(F.first("p_brand").contains("1"), F.sum("p_size")) * frac, "live_area"),
    )


@query(
    "d49_condition_ratios",
    with_plane("""
, m AS (SELECT seg, left(seg, 1) AS scroll, stddev_pop(a) AS noise, avg(a) AS level FROM plane GROUP BY seg),
r AS (SELECT scroll, median(noise) AS noise, median(level) AS level FROM m GROUP BY scroll),
u AS (UNPIVOT r ON noise, level INTO NAME metric VALUE v)
SELECT metric, round(max(v) FILTER (scroll = 'A'), 6) AS read, round(median(v) FILTER (scroll <> 'A'), 6) AS others,
  round(max(v) FILTER (scroll = 'A') / median(v) FILTER (scroll <> 'A'), 6) AS ratio,
  round(max(v) / greatest(min(v), 1e-9), 6) AS spread FROM u GROUP BY metric"""),
)
def d49(spark, sf):
    m = grids.plane(spark, sf).groupBy("seg").agg(
        F.stddev_pop("a").alias("noise"), F.avg("a").alias("level")
    )
    m = m.withColumn("scroll", F.substring("seg", 1, 1))
    per = quantiles.medians(m, ["scroll"], {"noise": "noise", "level": "level"})
    return rounded(learn.condition_ratios(per, "scroll", "A", ["noise", "level"]))


@query(
    "d50_enrichment",
    with_plane("""
, j AS (SELECT seg, count(*) FILTER (a > 180 AND b > 180) / count(*) AS obs,
  (count(*) FILTER (a > 180) / count(*)) * (count(*) FILTER (b > 180) / count(*)) AS nul FROM plane GROUP BY seg)
SELECT seg, round(obs, 6) AS obs, round(nul, 6) AS nul, CASE WHEN nul > 1e-6 THEN round(obs / nul, 2) END AS enrichment
FROM j"""),
)
def d50(spark, sf):
    a, b = F.col("a") > 180, F.col("b") > 180
    j = grids.plane(spark, sf).groupBy("seg").agg(
        stats.share(a & b).alias("obs"), (stats.share(a) * stats.share(b)).alias("nul")
    )
    return j.select("seg", r6("obs", "obs"), r6("nul", "nul"),
                    stats.enrichment(F.col("obs"), F.col("nul")).alias("enrichment"))
