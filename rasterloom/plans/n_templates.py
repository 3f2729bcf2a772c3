"""Template bank from harvested shapes (F24 into F23) and depth curves on a common axis (D45)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import components, curves, depth, learn, nulls, quantiles, templates
from rasterloom.plans.c_joins import comps
from rasterloom.plans.common import rounded, with_components
from rasterloom.plans.d_depth import DSHIFTS, PEAK
from rasterloom.plans.registry import query, with_volume
from rasterloom.sources import grids

ROWS, COLS, LEAST = 6, 4, 0.6
HARVEST_SQL = f"""box AS MATERIALIZED (SELECT seg, comp, y0, x0, y1 - y0 + 1 AS bh, x1 - x0 + 1 AS bw FROM shape
  WHERE y1 - y0 + 1 BETWEEN 3 AND 9 AND x1 - x0 + 1 BETWEEN 2 AND 11 AND area / ((y1 - y0 + 1) * (x1 - x0 + 1)) BETWEEN 0.12 AND 0.92),
tpl AS MATERIALIZED (
  SELECT l.seg, l.comp, CAST(r.range AS INT) AS r, CAST(c.range AS INT) AS c,
    CAST(floor(sum((least((y - y0 + 1) * {ROWS}, (r.range + 1) * bh) - greatest((y - y0) * {ROWS}, r.range * bh))
      * (least((x - x0 + 1) * {COLS}, (c.range + 1) * bw) - greatest((x - x0) * {COLS}, c.range * bw))) * 255 / any_value(bh * bw)) AS INT) AS v
  FROM lab l JOIN box USING (seg, comp) CROSS JOIN range({ROWS}) r CROSS JOIN range({COLS}) c
  WHERE least((y - y0 + 1) * {ROWS}, (r.range + 1) * bh) > greatest((y - y0) * {ROWS}, r.range * bh)
    AND least((x - x0 + 1) * {COLS}, (c.range + 1) * bw) > greatest((x - x0) * {COLS}, c.range * bw)
  GROUP BY l.seg, l.comp, r.range, c.range)"""


def harvested(spark, sf):
    """Letter-sized components as template cells."""
    cells = comps(spark, sf)
    s = components.shapes(cells, ["seg"])
    bh, bw = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    kept = s.where(bh.between(3, 9) & bw.between(2, 11) & (F.col("area") / (bh * bw)).between(0.12, 0.92))
    return templates.resample_shapes(cells, kept, ROWS, COLS)


@query("f24_template_rows", with_components("a > 150", f", {HARVEST_SQL} SELECT seg, comp, r, c, v FROM tpl"))
def f24_rows(spark, sf):
    """Every harvested shape in one common box."""
    return harvested(spark, sf)


@query(
    "f23_bank_search",
    with_components(
        "a > 150",
        f""", {HARVEST_SQL},
ids AS MATERIALIZED (SELECT seg || ':' || comp AS id, count(*) * 0 + sum(v) AS st, {ROWS * COLS} * sum(v * v) - sum(v) * sum(v) AS vt FROM tpl WHERE left(seg, 1) = 'A' GROUP BY seg, comp),
win AS MATERIALIZED (SELECT seg, y, x, {ROWS * COLS} * sum(a * a) - sum(a) * sum(a) AS vp, sum(a) AS sp FROM (
  SELECT p.seg, p.y - r.range AS y, p.x - c.range AS x, p.a FROM plane p CROSS JOIN range({ROWS}) r CROSS JOIN range({COLS}) c WHERE left(p.seg, 1) = 'N')
  GROUP BY ALL HAVING count(*) = {ROWS * COLS}),
dots AS (SELECT p.seg, p.y - t.r AS y, p.x - t.c AS x, t.seg || ':' || t.comp AS id, sum(t.v * p.a) AS d FROM plane p JOIN tpl t ON left(t.seg, 1) = 'A' AND left(p.seg, 1) = 'N' GROUP BY ALL),
m AS (SELECT seg, y, x, id, round(({ROWS * COLS} * d - sp * st) / (sqrt(vp::DOUBLE) * sqrt(vt::DOUBLE)), 9) AS r FROM dots JOIN win USING (seg, y, x) JOIN ids USING (id) WHERE vp > 0 AND vt > 0)
SELECT seg, CAST(y AS INT) AS y, CAST(x AS INT) AS x, id, round(r, 6) AS r FROM m WHERE r >= {LEAST} QUALIFY row_number() OVER (PARTITION BY seg, y, x ORDER BY r DESC, id) = 1""",
    ),
)
def f23_bank(spark, sf):
    """Shapes of one scroll looked for in the planes of another."""
    bank = templates.bank_of(harvested(spark, sf).where("seg LIKE 'A%'"), ROWS, COLS)
    plane = grids.plane(spark, sf).where("seg LIKE 'N%'")
    return rounded(templates.bank_response(plane, "a", bank, ROWS, COLS, LEAST))


UM = "4 + CAST(substr(seg, 2) AS BIGINT) % 3"
CURVE_SQL = f"""{PEAK}, l AS (SELECT seg, y, x, count(*) FILTER (v > 0) AS l FROM volume GROUP BY ALL),
q AS (SELECT seg, quantile_cont(l, 0.2) AS lo, quantile_cont(l, 0.8) AS hi FROM l GROUP BY seg),
k AS (SELECT seg, y, x, l >= hi AS ink, l <= lo AS bare FROM l JOIN q USING (seg)),
s AS (SELECT -1 AS k, 0 AS sy, 0 AS sx UNION ALL SELECT * FROM {nulls.sql_shifts(DSHIFTS)}),
m AS MATERIALIZED (SELECT seg, s.k, (y + sy) % 16 AS y, (x + sx) % 16 AS x, ink, bare FROM k CROSS JOIN s),
c AS (SELECT seg, k, z, (avg(v) FILTER (ink) - avg(v) FILTER (bare)) / stddev_pop(v) AS c FROM volume JOIN m USING (seg, y, x) GROUP BY ALL),
e AS (SELECT seg, z, round(max(c) FILTER (k = -1), 9) AS contrast, round(quantile_cont(c, 0.025) FILTER (k >= 0), 9) AS lo, round(quantile_cont(c, 0.975) FILTER (k >= 0), 9) AS hi FROM c GROUP BY ALL),
a AS MATERIALIZED (SELECT left(e.seg, 1) AS scroll, e.seg, (z - pk) * ({UM.replace('seg', 'e.seg')}) AS pos, {UM.replace('seg', 'e.seg')} AS um, contrast, lo, hi FROM e JOIN pk USING (seg)
  WHERE contrast IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL),
ext AS (SELECT scroll, max(l) AS g0, min(h) AS g1, min(um) AS step, count(*) AS n FROM (SELECT scroll, seg, min(pos) AS l, max(pos) AS h, min(um) AS um FROM a GROUP BY ALL) GROUP BY scroll),
g AS (SELECT scroll, n, unnest(range(g0, g1, step)) AS g FROM ext WHERE g1 > g0),
iv AS (SELECT *, lead(pos) OVER w AS pos2, lead(contrast) OVER w AS contrast2, lead(lo) OVER w AS lo2, lead(hi) OVER w AS hi2 FROM a WINDOW w AS (PARTITION BY seg ORDER BY pos)),
v AS (SELECT scroll, n, g, {', '.join(f'{c} + ({c}2 - {c}) * ((g - pos) / (pos2 - pos)) AS {c}' for c in ('contrast', 'lo', 'hi'))} FROM g JOIN iv USING (scroll) WHERE g >= pos AND g < pos2),
cv AS MATERIALIZED (SELECT scroll, g, any_value(n) AS n, median(contrast) AS curve, median(lo) AS lo, median(hi) AS hi FROM v GROUP BY ALL),
x AS (SELECT *, CASE WHEN curve > hi THEN curve - hi WHEN curve < lo THEN curve - lo ELSE 0 END AS excursion FROM cv)"""


def common_curves(spark, sf):
    vol = grids.volume(spark, sf)
    label = vol.groupBy("seg", "y", "x", "h", "w").agg(F.count_if(F.col("v") > 0).alias("l"))
    cut = label.groupBy("seg").agg(
        quantiles.byte_percentile(F.col("l"), 20).alias("lo"), quantiles.byte_percentile(F.col("l"), 80).alias("hi")
    )
    masks = label.join(cut, "seg").select("seg", "y", "x", "h", "w", (F.col("l") >= F.col("hi")).alias("ink"), (F.col("l") <= F.col("lo")).alias("bare"))
    c = learn.depth_contrast(vol, masks, DSHIFTS).join(depth.layer_peak(vol).select("seg", "pk"), "seg").withColumn("um", F.expr(UM))
    c = c.select(
        F.substring("seg", 1, 1).alias("scroll"), "seg", ((F.col("z") - F.col("pk")) * F.col("um")).alias("pos"), "um",
        F.round("contrast", 9).alias("curve"), F.round("null_lo", 9).alias("lo"), F.round("null_hi", 9).alias("hi"),
    ).dropna()
    return curves.excursions(curves.common_axis(c, "scroll", "seg", "pos", "um", ["curve", "lo", "hi"]), "curve", "lo", "hi")


@query("d45_common_axis", with_volume(f"{CURVE_SQL} SELECT scroll, g AS pos, n AS tiles, round(curve, 6) AS curve, round(lo, 6) AS lo, round(hi, 6) AS hi, round(excursion, 6) AS excursion FROM x"))
def d45_axis(spark, sf):
    """Median depth curve of each scroll on one axis in microns from the sheet's peak, with its null envelope."""
    return rounded(common_curves(spark, sf).select(F.col("scroll"), "pos", "tiles", "curve", "lo", "hi", "excursion"))


@query(
    "d45_group_verdict",
    with_volume(f"""{CURVE_SQL} SELECT scroll, any_value(n) AS tiles, min(g) AS first, max(g) AS last, arg_max(g, (round(abs(excursion), 9), -g)) AS pos,
  round(arg_max(excursion, (round(abs(excursion), 9), -g)), 6) AS excursion, round(max(curve), 6) AS top, round(min(curve), 6) AS bottom FROM x GROUP BY scroll"""),
)
def d45_verdict(spark, sf):
    """Where a scroll's median curve leaves its envelope farthest."""
    x = common_curves(spark, sf)
    far = F.max_by(F.struct("pos", "excursion"), F.struct(F.round(F.abs("excursion"), 9), -F.col("pos"))).alias("f")
    g = x.groupBy("scroll").agg(F.first("tiles").alias("tiles"), F.min("pos").alias("first"), F.max("pos").alias("last"), far, F.max("curve").alias("top"), F.min("curve").alias("bottom"))
    return rounded(g.select("scroll", "tiles", "first", "last", "f.pos", "f.excursion", "top", "bottom"))
