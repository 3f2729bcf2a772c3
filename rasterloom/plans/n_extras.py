"""The sharpening half of the defogged view (F31), the paired test of the depth hunt (J23), the scale gate of a tile (A6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import axis, depth, learn, quantiles
from rasterloom.plans.common import refl, rounded, r6
from rasterloom.plans.registry import BOTH, query, with_plane, with_volume
from rasterloom.sources import grids

# Radius and strength of the sharpening.
BLUR, AMOUNT = 6.0, 1.4
WEIGHTS = axis.gauss_weights(BLUR)
WEIGHTS_SQL = "(VALUES " + ", ".join(f"({i - len(WEIGHTS) // 2}, {v!r}::DOUBLE)" for i, v in enumerate(WEIGHTS)) + ")"


@query(
    "f31_unsharp",
    with_plane(f"""
, g AS (SELECT seg, y, x, a / greatest(max(a) OVER (PARTITION BY seg), 1e-9) AS g FROM plane),
q AS (SELECT seg, quantile_cont(g, 0.7) AS p70 FROM g GROUP BY seg),
s AS MATERIALIZED (SELECT seg, y, x, CAST(trunc(255 / (1 + exp(-22 * (g - p70))) + 1e-9) AS INTEGER) AS s FROM g JOIN q USING (seg)),
h AS MATERIALIZED (SELECT o.seg, o.y, o.x, sum(o.g * r.s) AS s FROM (SELECT seg, y, x, g, {refl('x + d', 64)} AS nx FROM s CROSS JOIN {WEIGHTS_SQL} w(d, g)) o
  JOIN s r ON r.seg = o.seg AND r.y = o.y AND r.x = o.nx GROUP BY ALL),
b AS (SELECT o.seg, o.y, o.x, sum(o.g * r.s) AS blur FROM (SELECT seg, y, x, g, {refl('y + d', 64)} AS ny FROM h CROSS JOIN {WEIGHTS_SQL} w(d, g)) o
  JOIN h r ON r.seg = o.seg AND r.x = o.x AND r.y = o.ny GROUP BY ALL)
SELECT seg, y, x, round(blur, 4) AS blur,
  CAST(trunc(greatest(0, least(255, s + {AMOUNT}e0 * (s - floor(blur + 0.5 + 1e-9)))) + 1e-6) AS INTEGER) AS sharp FROM b JOIN s USING (seg, y, x)"""),
)
def f31_unsharp(spark, sf):
    """The contrast curve, then what stands out from its blur is raised; the blur is a Gaussian with mirrored edges."""
    df = grids.plane(spark, sf)
    m = df.groupBy("seg").agg(
        F.greatest(F.max("a").cast("double"), F.lit(1e-9)).alias("top"), F.percentile("a", F.lit(0.7)).alias("p")
    )
    g = (F.col("a") - F.col("p")) / F.col("top")
    s = df.join(m, "seg").select("seg", "y", "x", "h", "w", (255.0 / (1 + F.exp(g * -22.0)) + 1e-9).cast("int").alias("s"))
    b = axis.gaussian(s, {"blur": "s"}, BLUR)
    raised = F.col("s") + AMOUNT * (F.col("s") - F.floor(F.col("blur") + 0.5 + 1e-9))
    sharp = (F.greatest(F.lit(0.0), F.least(F.lit(255.0), raised)) + 1e-6).cast("int")
    return b.select("seg", "y", "x", F.round("blur", 4).alias("blur"), sharp.alias("sharp"))


@query(
    "j23_paired_sign",
    with_volume("""
, c AS (SELECT seg, y, x, max(v) FILTER (z = 9) AS fixed, max(v) AS best, count(*) FILTER (v > 0) > 9 AS pos FROM volume GROUP BY ALL),
u AS (SELECT seg, y, x, pos, fixed AS f, 'fixed' AS kind FROM c UNION ALL SELECT seg, y, x, pos, best, 'best' FROM c),
k AS (SELECT seg, kind, pos, rank() OVER (PARTITION BY seg, kind ORDER BY f) + (count(*) OVER (PARTITION BY seg, kind, f) - 1) / 2.0 AS rk FROM u),
a AS (SELECT seg, kind, (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc
  FROM k GROUP BY ALL HAVING count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0),
d AS (SELECT left(seg, 1) AS scroll, round(max(auc) FILTER (kind = 'best') - max(auc) FILTER (kind = 'fixed'), 9) AS d FROM a GROUP BY seg),
t AS (SELECT scroll, count(*) AS pairs, count(*) FILTER (d > 0) AS k, count(*) FILTER (d <> 0) AS n, avg(d) AS gain FROM d GROUP BY scroll)
SELECT scroll, pairs, k AS better, n - k AS worse, round(gain, 6) AS gain,
  CASE WHEN k = 0 THEN 1.0 ELSE round((SELECT sum(exp(lgamma(n + 1) - lgamma(i.range + 1) - lgamma(n - i.range + 1) - n * ln(2)))
    FROM (SELECT unnest(range(k, n + 1)) AS range) i), 6) END AS p FROM t"""),
)
def j23_paired_sign(spark, sf):
    """Whether the best layer of each column beats the fixed one, paired by segment: ties say nothing."""
    c = grids.volume(spark, sf).groupBy("seg", "y", "x").agg(
        F.max(F.when(F.col("z") == 9, F.col("v"))).alias("fixed"), F.max("v").alias("best"), (F.count_if(F.col("v") > 0) > 9).alias("pos")
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("f")) for k in ("fixed", "best")])
    long = c.select("seg", "pos", F.explode(kinds).alias("e")).select("seg", "pos", "e.*")
    u = quantiles.auc(long, ["seg", "kind"], "f", F.col("pos")).where("auc IS NOT NULL")
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("auc")))
    # equal areas may differ in the last bit
    d = u.groupBy("seg").agg(F.round(of("best") - of("fixed"), 9).alias("d"))
    t = d.groupBy(F.substring("seg", 1, 1).alias("scroll")).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("d") > 0).alias("better"), F.count_if(F.col("d") < 0).alias("worse"), r6(F.avg("d"), "gain")
    )
    return t.withColumn("p", F.round(learn.sign_test(F.col("better"), F.col("better") + F.col("worse")), 6))


# Voxels per label cell between which a tile is read.
LEAST_SCALE, MOST_SCALE = 1.5, 40.0
NT, CHUNK, LEVEL = 2, 4, 8


@query(
    "a06_scaled_tile",
    f"""WITH {BOTH}
, w AS (SELECT seg, max(x) - min(x) + 1 AS ink_w FROM plane WHERE b > 225 GROUP BY seg),
s AS (SELECT seg, {grids.VOL_W * LEVEL} / ink_w AS ds FROM w),
ok AS (SELECT seg, ds FROM s WHERE ds > {LEAST_SCALE} AND ds < {MOST_SCALE}),
c AS (SELECT seg, y // {CHUNK} AS cy, x // {CHUNK} AS cx, count(*) FILTER (v > 200) > 0 AS here FROM volume GROUP BY ALL),
k AS (SELECT seg FROM c WHERE here AND cy BETWEEN 1 AND 2 AND cx BETWEEN 1 AND 2 GROUP BY seg HAVING count(*) >= 3),
p AS (SELECT seg, z, avg(v) AS m FROM volume JOIN k USING (seg) WHERE y BETWEEN 4 AND 11 AND x BETWEEN 4 AND 11 GROUP BY ALL)
SELECT seg, arg_max(z, (m, -z)) AS pk, round(max(m), 6) AS level, round(any_value(ds), 6) AS ds,
  CAST(trunc({CHUNK * LEVEL} / any_value(ds)) AS INTEGER) AS ink_at FROM p JOIN ok USING (seg) GROUP BY seg""",
)
def a06_scaled_tile(spark, sf):
    """The centred window of chunks where the scale between volume and label is in bounds, and its place on the label."""
    vol = grids.volume(spark, sf)
    first = grids.VOL_H // CHUNK // 2 - NT // 2
    label = grids.plane(spark, sf).where("b > 225").groupBy("seg").agg((F.max("x") - F.min("x") + 1).alias("w"))
    ds = label.select("seg", (F.lit(grids.VOL_W * LEVEL) / F.col("w")).alias("ds")).where(
        (F.col("ds") > LEAST_SCALE) & (F.col("ds") < MOST_SCALE)
    )
    at = lambda c: F.floor(F.col(c) / CHUNK)
    tile = vol.where(at("y").between(first, first + NT - 1) & at("x").between(first, first + NT - 1))
    tile = tile.join(ds.select("seg"), "seg", "left_semi")
    got = tile.where("v > 200").select("seg", at("y").alias("cy"), at("x").alias("cx")).distinct()
    ok = got.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= NT * NT * 0.75)
    prof = depth.layer_profile(tile.join(ok, "seg", "left_semi"))
    peaks = prof.groupBy("seg").agg(F.max_by("z", F.struct("mean", -F.col("z"))).alias("pk"), r6(F.max("mean"), "level"))
    place = (F.lit(first * CHUNK * LEVEL) / F.col("ds")).cast("int").alias("ink_at")
    return peaks.join(ds, "seg").select("seg", "pk", "level", r6("ds", "ds"), place)
