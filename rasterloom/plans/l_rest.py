"""Blending variants, gathers, stretches, projections and window picks."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from rasterloom.operators import axis, depth, fields, masks, quantiles, spatial, stats
from rasterloom.plans.common import CALLED, r6, rounded
from rasterloom.plans.c_joins import CHUNK
from rasterloom.plans.d_core import AUC_SQL
from rasterloom.plans.d_depth import PEAK
from rasterloom.plans.f_fields import GAUSS_W, HANN_W, WIN, tracks, window_cells
from rasterloom.plans.f_windows import GX, GY
from rasterloom.plans.j_agreement import called_plane
from rasterloom.plans.registry import BOTH, query, with_plane, with_volume
from rasterloom.sources import grids



@query("l01_flat_logit_blend", with_plane(f", {WIN} SELECT seg, y, x, round(1 / (1 + exp(-avg(lg))), 5) AS prob FROM wn GROUP BY ALL"))
def l01(spark, sf):
    return rounded(fields.blend(window_cells(spark, sf), F.col("lg"), "logit", "flat", 16), 5)


@query(
    "l02_gauss_logit_margin",
    with_plane(f""", {WIN} SELECT seg, y, x, round(1 / (1 + exp(-sum({GAUSS_W} * lg) / sum({GAUSS_W}))), 5) AS prob FROM wn
WHERE iy BETWEEN 2 AND 13 AND ix BETWEEN 2 AND 13 GROUP BY ALL"""),
)
def l02(spark, sf):
    """Gaussian logit blend that ignores a margin of every window."""
    inner = window_cells(spark, sf).where(F.col("iy").between(2, 13) & F.col("ix").between(2, 13))
    return rounded(fields.blend(inner, F.col("lg"), "logit", "gauss", 16), 5)


@query(
    "l03_augmented_hann_blend",
    with_plane(f""", {WIN},
v AS (SELECT seg, wy, wx, iy, ix, y, x, 1 / (1 + exp(-(lg + 0.1 * (CASE k.k WHEN 1 THEN 15 - ix WHEN 3 THEN iy ELSE ix END % 3) * (k.k + 1)))) AS p
  FROM wn CROSS JOIN (VALUES (0), (1), (2), (3)) k(k)),
m AS (SELECT seg, wy, wx, iy, ix, y, x, avg(p) AS p FROM v GROUP BY ALL)
SELECT seg, y, x, round(sum({HANN_W} * p) / sum({HANN_W}), 5) AS prob FROM m GROUP BY ALL"""),
)
def l03(spark, sf):
    """Four views of every window, mapped back, averaged and Hann-blended as probabilities."""
    cells = window_cells(spark, sf)
    last = 15
    iy, ix = F.col("iy"), F.col("ix")
    where = [(iy, ix), (iy, last - ix), (last - iy, ix), (last - ix, iy)]

    def view(k):
        vy, vx = where[k]
        logit = F.col("lg") + (vx % 3) * (0.1 * (k + 1))
        return F.struct(F.lit(k).alias("view"), vy.alias("vy"), vx.alias("vx"), (1.0 / (1.0 + F.exp(-logit))).alias("p"))

    m = fields.augmented_mean(cells, F.explode(F.array(*[view(k) for k in range(4)])), 16)
    m = m.withColumns({"y": F.col("wy") * 8 + F.col("iy"), "x": F.col("wx") * 8 + F.col("ix")})
    w = fields.window_weight("hann", 16) + 1e-6
    return rounded(m.groupBy("seg", "y", "x").agg((F.sum(w * F.col("p")) / F.sum(w)).alias("prob")), 5)


@query(
    "l04_flat_probability_auc",
    with_plane(f""", {WIN}, pb AS (SELECT seg, y, x, round(avg(1 / (1 + exp(-lg))), 9) AS f FROM wn GROUP BY ALL),
scored AS (SELECT seg, f, b > 150 AS pos FROM pb JOIN plane USING (seg, y, x)), u AS ({AUC_SQL})
SELECT seg, n_pos / (n_pos + n_neg) > 0.02 AND n_pos / (n_pos + n_neg) < 0.98 AS usable, auc FROM u"""),
)
def l04(spark, sf):
    cells = window_cells(spark, sf)
    p = fields.blend(cells, F.col("lg"), "prob", "flat", 16).withColumn("f", F.round("prob", 9))
    target = grids.plane(spark, sf).select("seg", "y", "x", (F.col("b") > 150).alias("pos"))
    u = quantiles.auc(p.join(target, ["seg", "y", "x"]), ["seg"], "f", F.col("pos"))
    cov = F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))
    return u.select("seg", ((cov > 0.02) & (cov < 0.98)).alias("usable"), r6("auc", "auc"))


@query(
    "l05_model_band_grid",
    with_volume("""
, t AS (SELECT seg, y, x, count(*) FILTER (v > 0) > 9 AS pos FROM volume GROUP BY ALL),
b AS (SELECT left(v.seg, 1) AS seg0, v.seg, v.y, v.x, z // 7 AS band, round(avg(v), 9) AS mean, CAST(max(v) AS DOUBLE) AS top FROM volume v GROUP BY ALL),
u AS (UNPIVOT b ON mean, top INTO NAME model VALUE f),
k AS (SELECT seg0, model, band, pos, rank() OVER w + (count(*) OVER (PARTITION BY seg0, model, band, f) - 1) / 2.0 AS rk FROM u JOIN t USING (seg, y, x)
  WINDOW w AS (PARTITION BY seg0, model, band ORDER BY f)),
a AS (SELECT seg0, model, band, (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc FROM k GROUP BY ALL)
SELECT seg0 AS scroll, model, CAST(band AS INTEGER) AS band, round(auc, 6) AS auc, CAST(row_number() OVER (PARTITION BY seg0 ORDER BY round(auc, 6) DESC, model, band) AS INTEGER) AS place FROM a"""),
)
def l05(spark, sf):
    """Every model at every depth band, ranked by AUC per scroll."""
    vol = grids.volume(spark, sf)
    cols = vol.groupBy("seg", "y", "x").agg((F.count_if(F.col("v") > 0) > 9).alias("pos"))
    band = vol.groupBy("seg", "y", "x", F.floor(F.col("z") / 7).cast("int").alias("band")).agg(
        F.round(F.avg("v"), 9).alias("mean"), F.max("v").cast("double").alias("top")
    )
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("f")) for m in ("mean", "top")])
    long = band.join(cols, ["seg", "y", "x"]).select(F.substring("seg", 1, 1).alias("scroll"), "band", "pos", F.explode(models).alias("e"))
    u = quantiles.auc(long.select("scroll", "band", "pos", "e.*"), ["scroll", "model", "band"], "f", F.col("pos"))
    u = u.withColumn("auc", F.round("auc", 6))
    # a scroll has one row per model and band, a handful; all of them are placed
    place = F.row_number().over(Window.partitionBy("scroll").orderBy(F.desc("auc"), "model", "band"))
    return u.select("scroll", "model", "band", "auc", place.alias("place"))


@query(
    "l07_contiguous_windows",
    with_plane("""
, w AS (SELECT seg, y // 16 AS wy, x // 16 AS wx, count(*) FILTER (n > 0) / 256.0 AS here, avg(a) AS mean FROM plane GROUP BY ALL)
SELECT seg, CAST(wy * 4 AS INTEGER) AS oy, CAST(wx * 4 AS INTEGER) AS ox, round(mean, 6) AS mean FROM w WHERE here >= 0.48"""),
)
def l07(spark, sf):
    """Grid of touching windows, thin ones skipped, placed by their offset."""
    w = masks.block_reduce(grids.plane(spark, sf), ["seg"], 16, here=stats.share(F.col("n") > 0), mean=F.avg("a"))
    return w.where("here >= 0.48").select("seg", (F.col("by") * 4).alias("oy"), (F.col("bx") * 4).alias("ox"), r6("mean", "mean"))


POINT9 = """p9 AS MATERIALIZED (SELECT seg, y, x, y % 20 + 0.25e0 AS pz, y * 0.22e0 AS py, x * 0.23e0 AS px FROM plane WHERE n > 1)"""


@query(
    "l09_trilinear_gather",
    f"""WITH {BOTH}, {POINT9},
c AS MATERIALIZED (SELECT seg, y, x, CAST(floor(pz) AS INT) + i AS vz, CAST(floor(py) AS INT) + j AS vy, CAST(floor(px) AS INT) + k AS vx,
  (CASE WHEN i = 1 THEN pz - floor(pz) ELSE 1 - pz + floor(pz) END) * (CASE WHEN j = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END)
  * (CASE WHEN k = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) AS wt FROM p9 CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) b(j) CROSS JOIN (VALUES (0), (1)) d(k))
SELECT c.seg, c.y, c.x, round(sum(wt * coalesce(v, 0)), 7) AS v FROM c LEFT JOIN volume q ON q.seg = c.seg AND q.z = vz AND q.y = vy AND q.x = vx GROUP BY ALL""",
)
def l09(spark, sf):
    pts = grids.plane(spark, sf).where("n > 1").select(
        "seg", F.struct("y", "x").alias("id"), (F.col("y") % 20 + 0.25).alias("pz"), (F.col("y") * 0.22).alias("py"), (F.col("x") * 0.23).alias("px")
    )
    got = fields.trilinear(pts, grids.volume(spark, sf))
    return got.select("seg", "id.y", "id.x", F.round("v", 7).alias("v"))


@query(
    "l10_depth_colour",
    with_volume("""
, c AS (SELECT seg, y, x, avg(z) FILTER (v > 150) AS d FROM volume GROUP BY ALL),
q AS (SELECT seg, quantile_cont(d, 0.02) AS lo, quantile_cont(d, 0.98) AS hi FROM c WHERE d IS NOT NULL GROUP BY seg),
t AS (SELECT seg, y, x, greatest(0, least(1, (d - lo) / greatest(hi - lo, 1e-6))) AS t FROM c JOIN q USING (seg) WHERE d IS NOT NULL)
SELECT seg, CASE WHEN t < 0.333 THEN 'near' WHEN t < 0.667 THEN 'mid' ELSE 'far' END AS colour, count(*) AS cells FROM t GROUP BY ALL"""),
)
def l10(spark, sf):
    """Depth centroid of the bright voxels, stretched p2..p98, in three colours."""
    d = grids.volume(spark, sf).where("v > 150").groupBy("seg", "y", "x").agg(F.avg("z").alias("d"))
    cut = quantiles.percentiles(d, ["seg"], "d", {"lo": 2, "hi": 98})
    t = (F.col("d") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6))
    j = d.join(cut, "seg").withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    colour = F.when(F.col("t") < 0.333, "near").when(F.col("t") < 0.667, "mid").otherwise("far")
    return j.groupBy("seg", colour.alias("colour")).agg(F.count(F.lit(1)).alias("cells"))


@query(
    "l11_masked_stretch",
    f"""WITH {CALLED}, q AS (SELECT seg, quantile_cont(a, 0.02) AS lo, quantile_cont(a, 0.98) AS hi FROM called WHERE m GROUP BY seg)
SELECT seg, y, x, CAST(trunc(greatest(0, least(255, (a - lo) / greatest(hi - lo, 1e-6) * 255))) AS INTEGER) AS g,
  CASE WHEN ca AND cb THEN 'both' WHEN ca THEN 'a' WHEN cb THEN 'b' ELSE 'none' END AS tint FROM called JOIN q USING (seg) WHERE m""",
)
def l11(spark, sf):
    df = called_plane(spark, sf).where("m")
    cut = df.groupBy("seg").agg(quantiles.byte_percentile(F.col("a"), 2).alias("lo"), quantiles.byte_percentile(F.col("a"), 98).alias("hi"))
    g = (F.col("a") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-6)) * 255
    tint = F.when(F.col("ca") & F.col("cb"), "both").when(F.col("ca"), "a").when(F.col("cb"), "b").otherwise("none")
    return df.join(cut, "seg").select("seg", "y", "x", F.greatest(F.lit(0.0), F.least(F.lit(255.0), g)).cast("int").alias("g"), tint.alias("tint"))


@query(
    "l12_chunk_band_mean",
    with_volume("""
, c AS (SELECT seg, z // 8 AS cz, y // 8 AS cy, x // 8 AS cx, sum(v) AS s, max(v) AS top FROM volume GROUP BY ALL)
SELECT seg, count(*) FILTER (top > 0) AS stored, CAST(sum(s) AS BIGINT) AS mass FROM c WHERE cz = 1 GROUP BY seg"""),
)
def l12(spark, sf):
    ch = spatial.chunked(grids.volume(spark, sf), *CHUNK).where("cz = 1")
    ch = ch.select("seg", spatial.byte_sum(F.col("data")).alias("mass"))
    return ch.groupBy("seg").agg(F.count(F.lit(1)).alias("stored"), F.sum("mass").alias("mass"))


@query(
    "l13_hillshade",
    with_plane(f"""
, g AS (SELECT seg, y, x, {GX('a')} / 50 AS gx, {GY('a')} / 50 AS gy FROM plane)
SELECT seg, y, x, round(greatest(0, (0.5 - gx * 0.5 - gy * 0.5) / sqrt(1 + gx * gx + gy * gy)), 5) AS shade FROM g"""),
)
def l13(spark, sf):
    df = grids.plane(spark, sf)
    df = df.withColumn("gx", axis.gradient("a", axis.ROW) / 50).withColumn("gy", axis.gradient("a", axis.COL) / 50)
    gx, gy = F.col("gx"), F.col("gy")
    s = (0.5 - gx * 0.5 - gy * 0.5) / F.sqrt(1 + gx * gx + gy * gy)
    return df.select("seg", "y", "x", F.round(F.greatest(F.lit(0.0), s), 5).alias("shade"))


@query(
    "l13_best_distinct",
    """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k = 1
ORDER BY value DESC, user_id LIMIT 3""",
)
def l13_best(spark, sf):
    """Best entry of each segment, then the best three segments."""
    e = grids.table(spark, sf, "events")
    best = e.groupBy("user_id").agg(F.max_by(F.struct("event_id", "value"), F.struct("value", -F.col("event_id"))).alias("b"))
    return best.select("user_id", "b.*").orderBy(F.desc("value"), "user_id").limit(3)


@query(
    "l14_anaglyph",
    with_plane(" SELECT l.seg, l.y, l.x, l.a AS red, r.a AS cyan FROM plane l JOIN plane r ON r.seg = l.seg AND r.y = l.y AND r.x = l.x + 3"),
)
def l14(spark, sf):
    """Left and right eye offset by three cells: one window, no self-join."""
    right = F.lead("a", 3).over(axis.ROW.window())
    return grids.plane(spark, sf).select("seg", "y", "x", F.col("a").alias("red"), right.alias("cyan")).where("cyan IS NOT NULL")


C30, S30 = math.cos(math.radians(30)), math.sin(math.radians(30))


@query(
    "l15_orbit_projection",
    with_volume(f"""
, p AS (SELECT seg, CAST(floor((x - 8) * {C30!r}::DOUBLE - (z - 10) * {S30!r}::DOUBLE + 0.5) AS INTEGER) AS sx, y AS sy,
  round((x - 8) * {S30!r}::DOUBLE + (z - 10) * {C30!r}::DOUBLE, 9) AS dep, v, z, x FROM volume WHERE v > 0)
SELECT seg, sx, sy, arg_max(v, (dep, z, x)) AS v FROM p GROUP BY ALL"""),
)
def l15(spark, sf):
    """Turned about the vertical axis; the nearest voxel hides the ones behind."""
    p = grids.volume(spark, sf).where("v > 0")
    cx, cz = F.col("x") - 8, F.col("z") - 10
    p = p.select(
        "seg", F.floor(cx * C30 - cz * S30 + 0.5).cast("int").alias("sx"), F.col("y").alias("sy"),
        F.round(cx * S30 + cz * C30, 9).alias("dep"), "v", "z", "x",
    )
    return p.groupBy("seg", "sx", "sy").agg(F.max_by("v", F.struct("dep", "z", "x")).alias("v"))


@query("l16_longest_tracks")
def l16(spark, sf):
    """The longest tracks by point count."""
    n = tracks(spark, sf).groupBy("seg", "track_y", "track_x").agg(F.count(F.lit(1)).alias("points"))
    return n.orderBy(F.desc("points"), "seg", "track_y", "track_x").limit(25)


@query(
    "l17_best_agreement_window",
    f"""WITH {CALLED}, w AS (SELECT seg, y // 8 AS wy, x // 8 AS wx, count(*) FILTER (ca AND cb) AS two, count(*) FILTER (ca OR cb) AS any_ FROM called GROUP BY ALL)
SELECT seg, CAST(wy AS INTEGER) AS wy, CAST(wx AS INTEGER) AS wx, two FROM w QUALIFY row_number() OVER (PARTITION BY seg ORDER BY two DESC, wy, wx) = 1""",
)
def l17(spark, sf):
    a, b = F.col("ca"), F.col("cb")
    w = masks.block_reduce(called_plane(spark, sf), ["seg"], 8, two=F.count_if(a & b))
    best = F.max_by(F.struct(F.col("by").alias("wy"), F.col("bx").alias("wx"), "two"), F.struct("two", -F.col("by"), -F.col("bx")))
    return w.groupBy("seg").agg(best.alias("b")).select("seg", "b.*")


@query(
    "l08_window_render",
    with_volume(f"""{PEAK}
SELECT seg, CAST(y + x AS INTEGER) AS band, CAST(sum(v) AS BIGINT) AS mass FROM volume JOIN pk USING (seg)
WHERE z = greatest(0, least(20, pk + (y + x) % 3 - 1)) GROUP BY ALL"""),
)
def l08(spark, sf):
    """Nearest voxel at a per-cell depth offset from the sheet peak."""
    vol = depth.with_peak(grids.volume(spark, sf))
    at = F.greatest(F.lit(0), F.least(F.col("d") - 1, F.col("pk") + (F.col("y") + F.col("x")) % 3 - 1))
    return vol.where(F.col("z") == at).groupBy("seg", (F.col("y") + F.col("x")).alias("band")).agg(F.sum("v").alias("mass"))
