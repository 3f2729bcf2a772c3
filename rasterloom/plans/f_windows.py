"""Raster neighbourhood operators and feature banks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from rasterloom.operators import agreement, axis, depth, features, spatial
from rasterloom.plans.common import CALLED, PLANE, REACH, clip, neighbours, refl, rounded
from rasterloom.plans.registry import query, with_plane, with_volume
from rasterloom.plans.d_depth import PEAK
from rasterloom.sources import grids


def sbox(name: str, src: str, cols: dict[str, str], r: int, n: int = 64, edge=clip, agg: str = "sum") -> str:
    """CTE of edge-aware square-window aggregates taken cell by cell."""
    k = float((2 * r + 1) ** 2) if agg == "sum" else 1
    outs = ", ".join(f"{agg}(q.{c}) / {k!r}::DOUBLE AS {o}" if agg == "sum" else f"{agg}(q.{c}) AS {o}" for o, c in cols.items())
    return f"""{neighbours(src, name + "_nb", r, n, edge)},
{name} AS MATERIALIZED (SELECT p.seg, p.y, p.x, {outs} FROM {name}_nb p
  JOIN {src} q ON q.seg = p.seg AND q.y = p.ny AND q.x = p.nx GROUP BY ALL)"""


def sgrad(c: str, pos: str, other: str) -> str:
    w = f"(PARTITION BY seg, {other} ORDER BY {pos})"
    lo, hi = f"lag({c}) OVER {w}", f"lead({c}) OVER {w}"
    return f"(CASE WHEN {lo} IS NULL THEN {hi} - {c} WHEN {hi} IS NULL THEN {c} - {lo} ELSE ({hi} - {lo}) / 2.0::DOUBLE END)"


GX, GY = (lambda c: sgrad(c, "x", "y")), (lambda c: sgrad(c, "y", "x"))


def summary(df, names):
    """Mean, spread and extremes of each map per segment."""
    aggs = []
    for n in names:
        aggs += [F.avg(n).alias(f"{n}_avg"), F.stddev_pop(n).alias(f"{n}_sd"), F.max(n).alias(f"{n}_max"), F.min(n).alias(f"{n}_min")]
    return rounded(df.groupBy("seg").agg(*aggs), 5)


def summary_sql(src: str, names) -> str:
    cols = ", ".join(
        f"round(avg({n}), 5) AS {n}_avg, round(stddev_pop({n}), 5) AS {n}_sd, round(max({n}), 5) AS {n}_max, round(min({n}), 5) AS {n}_min"
        for n in names
    )
    return f" SELECT seg, {cols} FROM {src} GROUP BY seg"


@query("f01_box_replicate", with_plane(f", {sbox('m', 'plane', {'a1': 'a', 'b1': 'b'}, 3)} SELECT seg, y, x, round(a1, 4) AS a1, round(b1, 4) AS b1 FROM m"))
def f01(spark, sf):
    m = axis.box_mean(grids.plane(spark, sf), {"a1": ("a", 3), "b1": ("b", 3)})
    return rounded(m.select("seg", "y", "x", "a1", "b1"), 4)


@query(
    "f02_box_valid",
    with_plane("""
, o AS (SELECT p.seg, p.y, p.x, p.y + dy.range AS ny, p.x + dx.range AS nx FROM plane p CROSS JOIN range(5) dy CROSS JOIN range(5) dx
  WHERE p.y <= 59 AND p.x <= 59)
SELECT o.seg, o.y, o.x, CAST(sum(q.a) AS BIGINT) AS s FROM o JOIN plane q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx GROUP BY ALL"""),
)
def f02(spark, sf):
    return axis.valid_box(grids.plane(spark, sf), {"s": "a"}, 5).select("seg", "y", "x", F.col("s").cast("long").alias("s"))


@query(
    "f03_uniform_even",
    with_plane(f"""
, o AS MATERIALIZED (SELECT p.seg, p.y, p.x, {refl('p.y + dy.range', 64)} AS ny, {refl('p.x + dx.range', 64)} AS nx
  FROM plane p CROSS JOIN range(-2, 2) dy CROSS JOIN range(-2, 2) dx)
SELECT o.seg, o.y, o.x, sum(q.a) / 16.0::DOUBLE AS m FROM o JOIN plane q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx GROUP BY ALL"""),
)
def f03(spark, sf):
    return axis.uniform_mean(grids.plane(spark, sf), {"m": ("a", 4)}).select("seg", "y", "x", "m")


@query("f04_letter_box", f"WITH {CALLED} SELECT seg, y, x, round(la, 4) AS la, round(lb, 4) AS lb FROM resp WHERE la > 0 OR lb > 0")
def f04(spark, sf):
    df = agreement.sheet(grids.plane(spark, sf), {"sa": "a", "sb": "b"}, 3, 40.0)
    df = agreement.box_response(df.withColumn("m", F.col("sa") & F.col("sb")), {"la": "a", "lb": "b"}, "m", 3)
    return rounded(df.where("la > 0 OR lb > 0").select("seg", "y", "x", "la", "lb"), 4)


SIG = 0.8
GW = axis.gauss_weights(SIG)
GWS = "(VALUES " + ", ".join(f"({i - len(GW) // 2}, {v!r}::DOUBLE)" for i, v in enumerate(GW)) + ")"


@query(
    "f05_gauss_high_pass",
    with_plane(f"""
, o AS MATERIALIZED (SELECT p.seg, p.y, p.x, gy.g * gx.g AS g, {refl('p.y + gy.d', 64)} AS ny, {refl('p.x + gx.d', 64)} AS nx
  FROM plane p CROSS JOIN {GWS} gy(d, g) CROSS JOIN {GWS} gx(d, g)),
s AS (SELECT o.seg, o.y, o.x, sum(o.g * q.a) AS s FROM o JOIN plane q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx GROUP BY ALL)
SELECT seg, y, x, round(s, 4) AS g, round(a - s, 4) AS hp FROM s JOIN plane USING (seg, y, x)"""),
)
def f05(spark, sf):
    g = axis.gaussian(grids.plane(spark, sf), {"g": "a"}, SIG)
    return rounded(g.select("seg", "y", "x", "g", (F.col("a") - F.col("g")).alias("hp")), 4)


@query(
    "f06_band_pass",
    with_plane(f", {sbox('l', 'plane', {'lo': 'a'}, 1)}, {sbox('g', 'plane', {'hi': 'a'}, 3)} SELECT seg, y, x, round(lo - hi, 4) AS bp FROM l JOIN g USING (seg, y, x)"),
)
def f06(spark, sf):
    um = 50.0
    lo, hi = features.microns(100.0, um), features.microns(300.0, um)
    return rounded(features.band_pass(grids.plane(spark, sf), "a", "bp", lo, hi).select("seg", "y", "x", "bp"), 4)


@query("f07_gradient", with_plane(f" SELECT seg, y, x, CAST({GX('a')} AS DOUBLE) AS gx, CAST({GY('a')} AS DOUBLE) AS gy FROM plane"))
def f07(spark, sf):
    return features.gradients(grids.plane(spark, sf), "a").select("seg", "y", "x", "gx", "gy")


DIST = """, dm AS (SELECT p.seg, p.y, p.x, min(pow(p.y - q.y, 2) + pow(p.x - q.x, 2)) AS d2 FROM plane p
  JOIN plane q ON q.seg = p.seg AND q.n >= 2 AND p.n < 2 GROUP BY ALL),
dist AS (SELECT p.seg, p.y, p.x, CASE WHEN n >= 2 THEN 0e0 ELSE sqrt(d2) END AS d FROM plane p LEFT JOIN dm USING (seg, y, x))"""


@query("f09_distance_transform", with_plane(f"{DIST} SELECT seg, y, x, round(d, 6) AS d FROM dist"))
def f09(spark, sf):
    df = grids.plane(spark, sf).withColumn("m", F.col("n") < 2)
    return rounded(spatial.distance(df, "m", "d").select("seg", "y", "x", "d"))


@query("f09_interior", with_plane(f"{DIST} SELECT seg, y, x FROM dist WHERE d IS NULL OR d >= 2.5"))
def f09_interior(spark, sf):
    df = grids.plane(spark, sf).withColumn("m", F.col("n") < 2)
    near = spatial.distance_within(df, "m", 3, "d")
    return near.where("d IS NULL OR d >= 2.5").select("seg", "y", "x")


@query("f10_keep_out", with_plane(f", c AS MATERIALIZED (SELECT *, CAST(a > 220 AS INT) AS hot FROM plane), {sbox('k', 'c', {'k': 'hot'}, 2, agg='max')} SELECT seg, y, x FROM k WHERE k = 0"))
def f10(spark, sf):
    df = grids.plane(spark, sf).withColumn("hot", (F.col("a") > 220).cast("int"))
    return axis.square_extreme(df, {"k": ("hot", 2)}, "max").where("k = 0").select("seg", "y", "x")


@query(
    "f11_clear_box",
    with_plane("""
, o AS (SELECT p.seg, p.y, p.x, p.y + dy.range AS ny, p.x + dx.range AS nx FROM plane p CROSS JOIN range(4) dy CROSS JOIN range(4) dx
  WHERE p.y <= 60 AND p.x <= 60)
SELECT o.seg, o.y, o.x FROM o JOIN plane q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx GROUP BY ALL HAVING count(*) FILTER (q.a > 200) = 0"""),
)
def f11(spark, sf):
    df = grids.plane(spark, sf).withColumn("hot", (F.col("a") > 200).cast("int"))
    return axis.valid_box(df, {"s": "hot"}, 4).where("s <= 0").select("seg", "y", "x")


TENSOR = f"""g0 AS MATERIALIZED (SELECT *, {GX('a')} AS gx, {GY('a')} AS gy FROM plane),
g1 AS MATERIALIZED (SELECT *, gx * gx AS jxx, gy * gy AS jyy, gx * gy AS jxy FROM g0)"""
COH = "sqrt(pow(jxx_m - jyy_m, 2) + 4 * jxy_m * jxy_m) / greatest(jxx_m + jyy_m, 1e-6)"


@query(
    "f12_structure_tensor",
    with_plane(f", {TENSOR}, {sbox('t', 'g1', {'jxx_m': 'jxx', 'jyy_m': 'jyy', 'jxy_m': 'jxy'}, 2)} SELECT seg, y, x, round({COH}, 5) AS coh FROM t"),
)
def f12(spark, sf):
    return rounded(features.structure_tensor(grids.plane(spark, sf), "a", 2).select("seg", "y", "x", "coh"), 5)


TEXTURE = ["sharp", "offaxis", "disorder", "hfenergy", "localsd", "proud", "chandark"]
TEX_SQL = f"""{TENSOR},
g2 AS MATERIALIZED (SELECT *, {GX('gx')} AS gxx, {GY('gy')} AS gyy, a * a AS sq FROM g1),
g3 AS MATERIALIZED (SELECT *, sqrt(jxx + jyy) AS gm, sqrt(gxx * gxx + gyy * gyy) AS gm2 FROM g2),
{sbox('t', 'g3', {'jxx_m': 'jxx', 'jyy_m': 'jyy', 'jxy_m': 'jxy', 'gm_m': 'gm', 'gm2_m': 'gm2', 'sq_m': 'sq', 'mu': 'a', 'b_hp': 'a'}, 2)},
{sbox('tp', 'plane', {'b_pr': 'a'}, 3)}, {sbox('tc', 'plane', {'b_ch': 'a'}, 1)},
u0 AS MATERIALIZED (SELECT *, 0.5 * degrees(atan2(2 * jxy_m, jxx_m - jyy_m)) AS deg FROM t JOIN tp USING (seg, y, x)
  JOIN tc USING (seg, y, x) JOIN plane USING (seg, y, x)),
u1 AS MATERIALIZED (SELECT *, deg - floor(deg / 180) * 180 AS ang FROM u0),
u AS MATERIALIZED (SELECT *, least(abs(ang), abs(ang - 90), abs(ang - 180)) AS off, pow(a - b_hp, 2) AS hp2, b_ch - a AS dark FROM u1),
{sbox('v', 'u', {'off_m': 'off', 'hp_m': 'hp2', 'chandark': 'dark'}, 2)},
f AS (SELECT u.seg, u.y, u.x, gm2_m / greatest(gm_m, 1e-6) AS sharp, off_m / 45 AS offaxis, 1 - {COH} AS disorder, sqrt(hp_m) AS hfenergy,
  sqrt(greatest(sq_m - mu * mu, 0)) AS localsd, a - b_pr AS proud, chandark FROM u JOIN v USING (seg, y, x))"""


def texture(spark, sf):
    return features.texture_bank(grids.plane(spark, sf), "a", r=2, hp=2, proud=3, chan=1, pct=30, plate=(1.0, 8.0))


@query("f13_texture_bank", with_plane(f", {TEX_SQL}" + summary_sql("f", TEXTURE)))
def f13(spark, sf):
    return summary(texture(spark, sf), TEXTURE)


@query(
    "f13_plates",
    f"""WITH RECURSIVE {PLANE}, {sbox('tc', 'plane', {'b_ch': 'a'}, 1)},
dk AS MATERIALIZED (SELECT seg, y, x, b_ch - a AS dark FROM tc JOIN plane USING (seg, y, x)),
dq AS (SELECT seg, quantile_cont(dark, 0.3) AS cut FROM dk GROUP BY seg),
cc AS MATERIALIZED (SELECT seg, y, x FROM dk JOIN dq USING (seg) WHERE dark <= cut), """
    + REACH
    + f""", ok AS MATERIALIZED (SELECT p.seg, p.y, p.x, CAST(coalesce(2 * sqrt(area / pi()) BETWEEN 1 AND 8, false) AS INT) AS ok FROM plane p
  LEFT JOIN lab l ON l.seg = p.seg AND l.y = p.y AND l.x = p.x LEFT JOIN shape s ON s.seg = l.seg AND s.comp = l.comp),
{sbox('v', 'ok', {'plate': 'ok'}, 2)}"""
    + summary_sql("v", ["plate"]),
)
def f13_plates(spark, sf):
    return summary(texture(spark, sf), ["plate"])


RIDGE = f"""{sbox('s1', 'plane', {'s1': 'a'}, 1)}, {sbox('s2', 's1', {'s': 's1'}, 1)},
h0 AS MATERIALIZED (SELECT *, {GX('s')} AS gx, {GY('s')} AS gy FROM s2),
h1 AS MATERIALIZED (SELECT *, {GX('gx')} AS hxx, {GY('gx')} AS hxy, {GX('gy')} AS hyx, {GY('gy')} AS hyy FROM h0)"""


@query(
    "f14_ridge",
    with_plane(f""", {RIDGE},
e AS (SELECT seg, (hxx + hyy) / 2 AS m, sqrt(greatest(pow(hxx + hyy, 2) / 4 - (hxx * hyy - 0.25 * pow(hxy + hyx, 2)), 0)) AS d FROM h1),
l AS (SELECT seg, CASE WHEN abs(m + d) >= abs(m - d) THEN m + d ELSE m - d END AS big,
  CASE WHEN abs(m + d) >= abs(m - d) THEN m - d ELSE m + d END AS small FROM e),
f AS (SELECT seg, -big * (1 - abs(small) / greatest(abs(big), 1e-9)) AS ridge FROM l)""" + summary_sql("f", ["ridge"])),
)
def f14_ridge(spark, sf):
    return summary(features.ridge(grids.plane(spark, sf), "a", 1), ["ridge"])


@query(
    "f14_fringe",
    with_plane(f""", {RIDGE}, h2 AS MATERIALIZED (SELECT seg, y, x, pow(hxx + hyy, 2) AS l2 FROM h1), {sbox('q', 'h2', {'m': 'l2'}, 2)},
f AS (SELECT seg, sqrt(m) AS fringe FROM q)""" + summary_sql("f", ["fringe"])),
)
def f14_fringe(spark, sf):
    return summary(features.fringe(grids.plane(spark, sf), "a", 1, 2), ["fringe"])


WEAVE = ["weave_amp", "weave_fill", "weave_lift", "weave_resid", "weave_period"]


@query(
    "f15_weave_bank",
    with_plane(f""", {TENSOR}, {sbox('t', 'g1', {'jxx_m': 'jxx', 'jyy_m': 'jyy', 'jxy_m': 'jxy'}, 2)},
{sbox('l', 'plane', {'lo': 'a'}, 1)}, {sbox('g', 'plane', {'hi': 'a'}, 2)}, {sbox('bg', 'plane', {'bg': 'a'}, 3)},
w0 AS MATERIALIZED (SELECT p.seg, p.y, p.x, lo - hi AS corr, a - bg AS resid, pow(lo - hi, 2) AS c2, pow(a - bg, 2) AS r2, {COH} AS coh
  FROM plane p JOIN l USING (seg, y, x) JOIN g USING (seg, y, x) JOIN bg USING (seg, y, x) JOIN t USING (seg, y, x)),
{sbox('am', 'w0', {'am': 'c2', 'rm': 'r2'}, 2)},
w1 AS MATERIALIZED (SELECT *, sqrt(greatest(am, 0)) AS weave_amp FROM w0 JOIN am USING (seg, y, x)),
{sbox('lc', 'w1', {'local': 'weave_amp'}, 3)},
cq AS (SELECT seg, quantile_cont(corr, 0.65) AS cut FROM w0 GROUP BY seg),
f AS (SELECT w1.seg, weave_amp, (local - weave_amp) / greatest(local, 1e-6) AS weave_fill,
  CASE WHEN corr > cut + 1e-9 THEN resid ELSE 0 END AS weave_lift, sqrt(greatest(rm, 0)) * (1 - coh) AS weave_resid, coh AS weave_period
  FROM w1 JOIN lc USING (seg, y, x) JOIN cq USING (seg))""" + summary_sql("f", WEAVE)),
)
def f15(spark, sf):
    w = features.weave_bank(grids.plane(spark, sf), "a", lo=1, hi=2, amp_r=2, neigh=3, crest=65, r=2)
    return summary(w, WEAVE)


COLS = ["col_shoulder_neg", "col_shoulder_pos", "col_sharp_neg", "col_sharp_pos", "col_face_neg", "col_face_pos", "col_thick", "col_asym", "col_rise"]


@query(
    "f16_column_bank",
    with_volume(f"""{PEAK},
v0 AS MATERIALIZED (SELECT seg, y, x, z - greatest(pk - 6, 0) AS z, pk - greatest(pk - 6, 0) AS c, v,
    least(20, pk + 6) - greatest(pk - 6, 0) + 1 AS d FROM volume JOIN pk USING (seg) WHERE abs(z - pk) <= 6 AND least(20, pk + 6) - greatest(pk - 6, 0) + 1 >= 9),
nb AS MATERIALIZED (SELECT seg, y, x, z, c, d, greatest(0, least(d - 1, z + o.range)) AS nz FROM v0 CROSS JOIN range(-1, 2) o),
s AS MATERIALIZED (SELECT n.seg, n.y, n.x, n.z, any_value(n.c) AS c, any_value(n.d) AS d, sum(q.v) / 3.0::DOUBLE AS s FROM nb n
  JOIN v0 q ON q.seg = n.seg AND q.y = n.y AND q.x = n.x AND q.z = n.nz GROUP BY n.seg, n.y, n.x, n.z),
g AS MATERIALIZED (SELECT *, CASE WHEN lag(s) OVER w IS NULL THEN lead(s) OVER w - s WHEN lead(s) OVER w IS NULL THEN s - lag(s) OVER w
    ELSE (lead(s) OVER w - lag(s) OVER w) / 2 END AS g FROM s WINDOW w AS (PARTITION BY seg, y, x ORDER BY z)),
k AS (SELECT seg, y, x, any_value(d) AS d, list(s ORDER BY z) AS p, arg_max(z, (round(g, 9), -z)) FILTER (z < c) AS fn,
    arg_min(z, (round(g, 9), z)) FILTER (z >= c) AS fp, max(g) FILTER (z < c) AS sn, -min(g) FILTER (z >= c) AS sp, greatest(avg(s), 1e-6) AS body
  FROM g GROUP BY ALL),
a AS (SELECT *, p[greatest(0, least(d - 1, fn - 2)) + 1] AS o_n, p[greatest(0, least(d - 1, fn + 2)) + 1] AS i_n,
    p[greatest(0, least(d - 1, fp + 2)) + 1] AS o_p FROM k),
f AS (SELECT seg, o_n / body AS col_shoulder_neg, o_p / body AS col_shoulder_pos, sn / body AS col_sharp_neg, sp / body AS col_sharp_pos,
    fn - median(fn) OVER (PARTITION BY seg) AS col_face_neg, fp - median(fp) OVER (PARTITION BY seg) AS col_face_pos,
    (fp - fn)::DOUBLE AS col_thick, (o_n - o_p) / body AS col_asym, (i_n - o_n) / body AS col_rise FROM a)""" + summary_sql("f", COLS)),
)
def f16(spark, sf):
    return summary(features.column_bank(grids.volume(spark, sf), span=6, smooth=1, shoulder=2), COLS)


RTI = ["rti_specvar", "rti_specmax", "rti_slope", "rti_curv", "rti_height"]
ELEV = math.radians(18.0)


def _light(i: int, n: int = 16) -> str:
    a = math.radians(360.0 * i / n)
    hx, hy, hz = math.cos(ELEV) * math.cos(a), math.cos(ELEV) * math.sin(a), math.sin(ELEV) + 1.0
    s = math.sqrt(hx * hx + hy * hy + hz * hz)
    return f"({i}, {hx / s!r}::DOUBLE, {hy / s!r}::DOUBLE, {hz / s!r}::DOUBLE)"


LIGHTS = "(VALUES " + ", ".join(_light(i) for i in range(16)) + ") l(i, hx, hy, hz)"


@query(
    "f17_relight_bank",
    with_volume(f"""{PEAK},
h AS (SELECT seg, y, x, sum(v * (z - pk)) / greatest(sum(v), 1e-6) * 2.5 AS h FROM volume JOIN pk USING (seg)
  WHERE z BETWEEN pk - 5 AND pk + 5 GROUP BY ALL),
hm AS MATERIALIZED (SELECT seg, y, x, h - avg(h) OVER (PARTITION BY seg) AS h FROM h),
{sbox('l1', 'hm', {'lo': 'h'}, 1, 16)}, {sbox('l2', 'hm', {'hi': 'h'}, 2, 16)},
b AS MATERIALIZED (SELECT seg, y, x, lo - hi AS h FROM l1 JOIN l2 USING (seg, y, x)),
n0 AS MATERIALIZED (SELECT *, -{GX('h')} / 2.5 AS nx, -{GY('h')} / 2.5 AS ny FROM b),
{sbox('ub', 'n0', {'bx': 'nx', 'bym': 'ny'}, 1, 16)},
n1 AS (SELECT seg, y, x, h, nx + 3 * (nx - bx) AS ux, ny + 3 * (ny - bym) AS uy FROM n0 JOIN ub USING (seg, y, x)),
n2 AS MATERIALIZED (SELECT seg, y, x, h, ux / sqrt(ux * ux + uy * uy + 1) AS nx, uy / sqrt(ux * ux + uy * uy + 1) AS ny,
  1 / sqrt(ux * ux + uy * uy + 1) AS nz FROM n1),
sp AS (SELECT seg, y, x, stddev_pop(pow(greatest(nx * hx + ny * hy + nz * hz, 0), 40)) AS rti_specvar,
  max(pow(greatest(nx * hx + ny * hy + nz * hz, 0), 40)) - avg(pow(greatest(nx * hx + ny * hy + nz * hz, 0), 40)) AS rti_specmax
  FROM n2 CROSS JOIN {LIGHTS} GROUP BY ALL),
cu AS (SELECT seg, y, x, -({GX('nx')} + {GY('ny')}) AS rti_curv, 1 - nz AS rti_slope, h AS rti_height FROM n2),
f AS (SELECT * FROM sp JOIN cu USING (seg, y, x))""" + summary_sql("f", RTI)),
)
def f17(spark, sf):
    vol = grids.volume(spark, sf)
    h = depth.height_map(vol, 5, 2.5).withColumns({"h": F.lit(grids.VOL_H), "w": F.lit(grids.VOL_W)})
    b = features.band_pass(h, "height", "bp", 1, 2)
    return summary(features.relight_bank(b, "bp", 2.5, 1, 3.0, 40.0, 18.0, 16), RTI)


@query(
    "f19_combine",
    with_plane("""
SELECT seg, y, x, round(0.7 * (a - avg(a) OVER w) / stddev_pop(a) OVER w - 0.5 * (b - avg(b) OVER w) / stddev_pop(b) OVER w, 4) AS score
FROM plane WINDOW w AS (PARTITION BY seg)"""),
)
def f19(spark, sf):
    return rounded(features.combine(grids.plane(spark, sf), {"a": 0.7, "b": -0.5}).select("seg", "y", "x", "score"), 4)


@query(
    "f20_covariates",
    with_volume(f"""{PEAK},
hh AS (SELECT seg, y, x, sum(v * (z - pk)) / greatest(sum(v), 1e-6) * 2.5 AS h FROM volume JOIN pk USING (seg)
  WHERE z BETWEEN pk - 5 AND pk + 5 GROUP BY ALL),
im AS (SELECT seg, y, x, avg(v) AS a FROM volume JOIN pk USING (seg)
  WHERE z BETWEEN greatest(2, least(pk, 18)) - 2 AND greatest(2, least(pk, 18)) + 2 GROUP BY ALL),
plane AS MATERIALIZED (SELECT seg, y, x, a, a * a AS sq, h - avg(h) OVER (PARTITION BY seg) AS h FROM im JOIN hh USING (seg, y, x)),
{TENSOR}, {sbox('t', 'g1', {'jxx_m': 'jxx', 'jyy_m': 'jyy', 'jxy_m': 'jxy', 'mu': 'a', 'sq_m': 'sq'}, 2, 16)}, {sbox('cv', 'plane', {'curv': 'h'}, 3, 16)},
f AS (SELECT seg, y, x, mu, sqrt(greatest(sq_m - mu * mu, 0)) AS sd, {COH} AS coh, curv FROM t JOIN cv USING (seg, y, x))
SELECT seg, y, x, round(mu, 4) AS mu, round(sd, 4) AS sd, round(coh, 4) AS coh, round(curv, 4) AS curv FROM f"""),
)
def f20(spark, sf):
    vol = grids.volume(spark, sf)
    cov = features.covariates(depth.band_mean(vol, 2), depth.height_map(vol, 5, 2.5), 2, 3)
    return rounded(cov, 4)
