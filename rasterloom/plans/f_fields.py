"""Registration, resampling, blending, tracking and stability."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import axis, components, depth, features, fields, quantiles, stats
from rasterloom.plans.common import refl, rounded, r6, with_components
from rasterloom.plans.c_joins import comps
from rasterloom.plans.f_windows import sbox
from rasterloom.plans.registry import query, with_plane, with_volume
from rasterloom.sources import grids


def shift_field(spark, sf):
    """Blocks of a plane against itself rolled by (3, -2)."""
    df = grids.plane(spark, sf)
    moved = df.select(
        "seg", F.pmod(F.col("y") + 3, F.col("h")).alias("y"), F.pmod(F.col("x") - 2, F.col("w")).alias("x"), F.col("a").alias("moved")
    )
    pair = df.join(moved, ["seg", "y", "x"]).withColumn("m", F.lit(True))
    return fields.block_shifts(pair, "a", "moved", "m", block=32, min_sharp=5.0, max_shift=8)


@query("f21_phase_field")
def f21(spark, sf):
    return rounded(fields.fill_field(shift_field(spark, sf)))


@query(
    "f22_warp",
    with_plane("""
, p AS (SELECT seg, y, x, least(63, greatest(0, y - 0.25e0 * (b % 4))) AS sy, least(63, greatest(0, x + 0.25e0 * (n % 3))) AS sx FROM plane),
w AS MATERIALIZED (SELECT seg, y, x, CAST(floor(sy) AS INT) AS y0, CAST(floor(sx) AS INT) AS x0, sy - floor(sy) AS fy, sx - floor(sx) AS fx FROM p),
c AS MATERIALIZED (SELECT seg, y, x, least(63, y0 + i) AS ny, least(63, x0 + j) AS nx, (CASE WHEN i = 1 THEN fy ELSE 1 - fy END)
  * (CASE WHEN j = 1 THEN fx ELSE 1 - fx END) AS k FROM w CROSS JOIN (VALUES (0), (1)) u(i) CROSS JOIN (VALUES (0), (1)) v(j))
SELECT c.seg, c.y, c.x, round(sum(k * q.a), 6) AS warped FROM c JOIN plane q ON q.seg = c.seg AND q.y = c.ny AND q.x = c.nx GROUP BY ALL"""),
)
def f22(spark, sf):
    w = fields.warp(grids.plane(spark, sf), "a", (F.col("b") % 4) * 0.25, (F.col("n") % 3) * -0.25, "warped")
    return rounded(w.select("seg", "y", "x", "warped"))


TEMPLATES = [np.array(t, float) for t in ([[1, 1, 1], [-1, 0, -1], [0, 0, 0]], [[1, -1, 0], [1, 0, -1], [1, -1, 0]])]
TEMPLATES = [t / math.sqrt((t * t).sum()) for t in TEMPLATES]
_TV = ", ".join(f"({i}, {y}, {x}, {t[y, x]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::") for i, t in enumerate(TEMPLATES) for y in range(3) for x in range(3))


@query(
    "f23_template_match",
    with_plane(f"""
, f AS MATERIALIZED (SELECT seg, y, x, a - avg(a) OVER (PARTITION BY seg) AS f, pow(a - avg(a) OVER (PARTITION BY seg), 2) AS q FROM plane),
{sbox('e', 'f', {'mu': 'f', 'e2': 'q'}, 1)},
o AS MATERIALIZED (SELECT f.seg, f.y, f.x, t.i, t.k, f.y + t.dy AS ny, f.x + t.dx AS nx FROM f CROSS JOIN (VALUES {_TV}) t(i, dy, dx, k)),
c AS (SELECT o.seg, o.y, o.x, o.i, sum(o.k * q.f) AS c FROM o JOIN f q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx GROUP BY ALL)
SELECT c.seg, c.y, c.x, round(max(c) / greatest(sqrt(greatest(any_value(e2) - any_value(mu) * any_value(mu), 1e-12)) * 3, 1e-9), 5) AS ncc
FROM c JOIN e USING (seg, y, x) GROUP BY c.seg, c.y, c.x"""),
)
def f23(spark, sf):
    return rounded(fields.ncc(grids.plane(spark, sf), "a", TEMPLATES).select("seg", "y", "x", "ncc"), 5)


@query(
    "f24_harvest_templates",
    with_components(
        "a > 150",
        """, t AS (SELECT *, y1 - y0 + 1 AS bh, x1 - x0 + 1 AS bw, area / ((y1 - y0 + 1) * (x1 - x0 + 1)) AS share FROM shape)
SELECT seg, comp, bh, bw, round((1 - share) / sqrt(area * (1 - share)), 6) AS on_value, round(-share / sqrt(area * (1 - share)), 6) AS off_value
FROM t WHERE bh BETWEEN 3 AND 9 AND bw BETWEEN 2 AND 11 AND share BETWEEN 0.12 AND 0.92""",
    ),
)
def f24(spark, sf):
    """Exemplar shapes: zero-mean, unit-norm values on and off the stroke."""
    s = components.shapes(comps(spark, sf), ["seg"])
    bh, bw = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    share = F.col("area") / (bh * bw)
    kept = s.where(bh.between(3, 9) & bw.between(2, 11) & share.between(0.12, 0.92))
    norm = F.sqrt(F.col("area") * (1 - share))
    return kept.select(
        "seg", "comp", bh.alias("bh"), bw.alias("bw"), r6((1 - share) / norm, "on_value"), r6(-share / norm, "off_value")
    )


KERNELS = [fields.line_kernel(5, 1, a) for a in (-45, 0, 45)]
_KV = ", ".join(f"({i}, {dy}, {dx}, {k!r}::DOUBLE)" for i, kr in enumerate(KERNELS) for (dy, dx), k in kr.items())


@query(
    "f25_line_response",
    with_plane(f"""
, o AS MATERIALIZED (SELECT p.seg, p.y, p.x, t.i, t.k, p.y + t.dy AS ny, p.x + t.dx AS nx FROM plane p CROSS JOIN (VALUES {_KV}) t(i, dy, dx, k)
  WHERE p.n > 0),
c AS (SELECT o.seg, o.y, o.x, o.i, sum(o.k * q.a) FILTER (q.n > 0) AS v, sum(o.k) FILTER (q.n > 0) AS d FROM o
  JOIN plane q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx GROUP BY ALL)
SELECT seg, y, x, round(max(v / d), 5) AS response FROM c WHERE d > 0.7 GROUP BY ALL"""),
)
def f25(spark, sf):
    df = grids.plane(spark, sf).withColumn("on", F.col("n") > 0)
    r = fields.line_response(df, "a", "on", KERNELS, cover=0.7)
    return rounded(r.where("response IS NOT NULL").select("seg", "y", "x", "response"), 5)


def mesh_plane(spark, sf, *keep: str):
    df = grids.plane(spark, sf)
    return df.select(
        "seg", "h", "w", "y", "x", *keep, (F.col("x") * 10 + F.col("b") % 3).alias("px"), (F.col("y") * 10 + F.col("a") % 4).alias("py"),
        F.floor(F.col("a") / 50).cast("int").alias("pz"), (F.col("n") > 0).alias("_on"),
    ).withColumn("valid", F.col("_on") | (F.col("y") % 8 < 6)).drop("_on")


MESH_SQL = """mesh AS MATERIALIZED (SELECT seg, y, x, x * 10 + b % 3 AS px, y * 10 + a % 4 AS py, a // 50 AS pz, n > 0 OR y % 8 < 6 AS valid
  FROM plane),
nb9 AS MATERIALIZED (SELECT p.seg, p.y, p.x, p.y + dy.range AS ny, p.x + dx.range AS nx FROM plane p
  CROSS JOIN range(-1, 2) dy CROSS JOIN range(-1, 2) dx),
er AS MATERIALIZED (SELECT o.seg, o.y, o.x, count(*) FILTER (q.valid) = 9 AS er FROM nb9 o
  JOIN mesh q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx GROUP BY ALL)"""
DIFF = lambda c, pos, oth: f"coalesce(lead({c}) OVER (PARTITION BY seg, {oth} ORDER BY {pos}) - lag({c}) OVER (PARTITION BY seg, {oth} ORDER BY {pos}), 0)"
NORMALS = f"""{MESH_SQL},
d AS (SELECT *, {DIFF('px', 'x', 'y')} AS ux, {DIFF('py', 'x', 'y')} AS uy, {DIFF('pz', 'x', 'y')} AS uz,
  {DIFF('px', 'y', 'x')} AS vx, {DIFF('py', 'y', 'x')} AS vy, {DIFF('pz', 'y', 'x')} AS vz FROM mesh),
k AS (SELECT d.*, er, uy * vz - uz * vy AS cx, uz * vx - ux * vz AS cy, ux * vy - uy * vx AS cz FROM d JOIN er USING (seg, y, x)),
u AS MATERIALIZED (SELECT seg, y, x, valid, valid AND er AND sqrt(cx * cx + cy * cy + cz * cz) > 1e-6 AS inn,
  CASE WHEN valid AND er AND sqrt(cx * cx + cy * cy + cz * cz) > 1e-6 THEN cx / sqrt(cx * cx + cy * cy + cz * cz) ELSE 0 END AS nx,
  CASE WHEN valid AND er AND sqrt(cx * cx + cy * cy + cz * cz) > 1e-6 THEN cy / sqrt(cx * cx + cy * cy + cz * cz) ELSE 0 END AS ny,
  CASE WHEN valid AND er AND sqrt(cx * cx + cy * cy + cz * cz) > 1e-6 THEN cz / sqrt(cx * cx + cy * cy + cz * cz) ELSE 0 END AS nz FROM k),
{sbox('sm', 'u', {'mx': 'nx', 'my': 'ny', 'mz': 'nz'}, 1, 64, refl)}"""


@query(
    "f26_mesh_normals",
    with_plane(f""", {NORMALS}
SELECT seg, y, x, round(CASE WHEN inn THEN nx WHEN l > 1e-6 THEN mx / l ELSE 0 END, 5) AS nx,
  round(CASE WHEN inn THEN ny WHEN l > 1e-6 THEN my / l ELSE 0 END, 5) AS ny,
  round(CASE WHEN inn THEN nz WHEN l > 1e-6 THEN mz / l ELSE 0 END, 5) AS nz
FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS l FROM u JOIN sm USING (seg, y, x))"""),
)
def f26(spark, sf):
    n = fields.mesh_normals(mesh_plane(spark, sf), spread=3)
    return rounded(n.select("seg", "y", "x", "nx", "ny", "nz"), 5)


@query("f27_patch_rim", with_plane(f", {MESH_SQL} SELECT seg, y, x FROM mesh JOIN er USING (seg, y, x) WHERE valid AND NOT er"))
def f27(spark, sf):
    return fields.mesh_normals(mesh_plane(spark, sf), spread=3).where("rim").select("seg", "y", "x")


@query(
    "f28_upsample",
    with_volume("""
, top AS MATERIALIZED (SELECT seg, y, x, max(v) AS v FROM volume GROUP BY ALL),
o AS (SELECT seg, oy.range AS oy, ox.range AS ox, oy.range * 15 / 47.0::DOUBLE AS sy, ox.range * 15 / 47.0::DOUBLE AS sx
  FROM (SELECT DISTINCT seg FROM top) CROSS JOIN range(48) oy CROSS JOIN range(48) ox),
c AS MATERIALIZED (SELECT seg, oy, ox, least(15, CAST(floor(sy) AS INT) + i) AS y, least(15, CAST(floor(sx) AS INT) + j) AS x,
  (CASE WHEN i = 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE WHEN j = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS k
  FROM o CROSS JOIN (VALUES (0), (1)) u(i) CROSS JOIN (VALUES (0), (1)) w(j))
SELECT seg, CAST(oy AS INTEGER) AS oy, CAST(ox AS INTEGER) AS ox, round(sum(k * v), 5) AS v FROM c JOIN top USING (seg, y, x) GROUP BY ALL"""),
)
def f28(spark, sf):
    top = grids.volume(spark, sf).groupBy("seg", "h", "w", "y", "x").agg(F.max("v").alias("v"))
    return rounded(fields.upsample(top, "v", 3, grids.VOL_H, grids.VOL_W), 5)


@query(
    "f29_line_profile",
    with_plane("""
, p AS (SELECT seg, CAST(i.range AS INTEGER) AS i, CAST(floor(5 + i.range * 60 / 79.0::DOUBLE + 0.5) AS INT) AS y,
  CAST(floor(-4 + i.range * 50 / 79.0::DOUBLE + 0.5) AS INT) AS x FROM (SELECT DISTINCT seg FROM plane) CROSS JOIN range(80) i)
SELECT p.seg, i, coalesce(a, 0) AS a FROM p LEFT JOIN plane q ON q.seg = p.seg AND q.y = p.y AND q.x = p.x"""),
)
def f29(spark, sf):
    return fields.profile(grids.plane(spark, sf), "a", (5.0, -4.0), (65.0, 46.0), 80)


def tracks(spark, sf):
    df = axis.box_mean(grids.plane(spark, sf), {"bg": ("a", 3)})
    df = df.withColumn("rg", F.when(F.col("a") == 0, -1000.0).otherwise(F.col("a") - F.col("bg")))
    t = features.structure_tensor(df, "rg", 2)
    t = t.withColumns({"vx": -F.sin("ang"), "vy": F.cos("ang")})
    # planes of the tables are small, so seeds stand closer and shorter tracks count
    return fields.ridge_tracks(t, "rg", "vy", "vx", "coh", spacing=6, least=8)


@query("f30_ridge_tracks")
def f30(spark, sf):
    return tracks(spark, sf)


@query(
    "f31_defog",
    with_plane("""
, g AS (SELECT seg, y, x, a / greatest(max(a) OVER (PARTITION BY seg), 1e-9) AS g FROM plane),
q AS (SELECT seg, quantile_cont(g, 0.7) AS p70 FROM g GROUP BY seg)
SELECT seg, y, x, CAST(trunc(255 / (1 + exp(-22 * (g - p70))) + 1e-9) AS INTEGER) AS s FROM g JOIN q USING (seg)"""),
)
def f31(spark, sf):
    df = grids.plane(spark, sf)
    m = df.groupBy("seg").agg(
        F.greatest(F.max("a").cast("double"), F.lit(1e-9)).alias("top"), F.percentile("a", F.lit(0.7)).alias("p")
    )
    g = (F.col("a") - F.col("p")) / F.col("top")
    return df.join(m, "seg").select("seg", "y", "x", (255.0 / (1 + F.exp(g * -22.0)) + 1e-9).cast("int").alias("s"))


WIN = """wn AS MATERIALIZED (SELECT p.seg, p.y, p.x, wy.range AS wy, wx.range AS wx, p.y - wy.range * 8 AS iy, p.x - wx.range * 8 AS ix,
  (a - 128) / 32e0 + (wy.range + wx.range) % 3 - 1 AS lg FROM plane p JOIN range(7) wy ON p.y BETWEEN wy.range * 8 AND wy.range * 8 + 15
  JOIN range(7) wx ON p.x BETWEEN wx.range * 8 AND wx.range * 8 + 15)"""
GAUSS_W = "exp(-(pow(iy - 7.5, 2) + pow(ix - 7.5, 2)) / 32)"
HANN_W = "((0.5 - 0.5 * cos(iy * 2 * pi() / 15)) * (0.5 - 0.5 * cos(ix * 2 * pi() / 15)) + 1e-6)"


def window_cells(spark, sf):
    cells = fields.windows_over(grids.plane(spark, sf), 16, 8)
    return cells.withColumn("lg", (F.col("a") - 128) / 32.0 + (F.col("wy") + F.col("wx")) % 3 - 1)


@query("f32_gauss_logit_blend", with_plane(f", {WIN} SELECT seg, y, x, round(1 / (1 + exp(-sum({GAUSS_W} * lg) / sum({GAUSS_W}))), 5) AS prob FROM wn GROUP BY ALL"))
def f32(spark, sf):
    return rounded(fields.blend(window_cells(spark, sf), F.col("lg"), "logit", "gauss", 16), 5)


@query(
    "f33_depth_coherence",
    with_volume(f"""
, plane AS MATERIALIZED (SELECT seg, y, x, arg_max(z, (v, -z)) AS dm FROM volume GROUP BY ALL), {sbox('lc', 'plane', {'lc': 'dm'}, 2, 16)},
shuf AS MATERIALIZED (SELECT seg, CAST(i // 16 AS INTEGER) AS y, CAST(i % 16 AS INTEGER) AS x, dm
  FROM (SELECT seg, ((y * 16 + x) * 7919 + 4242) % 256 AS i, dm FROM plane)), {sbox('ls', 'shuf', {'ls': 'dm'}, 2, 16)},
c AS (SELECT seg, avg(CAST(abs(dm - lc) <= 3 AS INT)) AS coherence FROM plane JOIN lc USING (seg, y, x) GROUP BY seg),
s AS (SELECT seg, avg(CAST(abs(dm - ls) <= 3 AS INT)) AS shuffled FROM shuf JOIN ls USING (seg, y, x) GROUP BY seg)
SELECT seg, round(coherence, 6) AS coherence, round(shuffled, 6) AS shuffled FROM c JOIN s USING (seg)"""),
)
def f33(spark, sf):
    r = depth.response_label(grids.volume(spark, sf), 0, 0).select(
        "seg", "y", "x", F.col("depth").alias("dm"), F.lit(grids.VOL_H).alias("h"), F.lit(grids.VOL_W).alias("w")
    )
    def coherence(df, name):
        lc = axis.box_mean(df, {"lc": ("dm", 2)})
        return lc.groupBy("seg").agg(r6(stats.share(F.abs(F.col("dm") - F.col("lc")) <= 3), name))

    # the baseline deals the same depths to other cells: a stride that shares no factor with the size
    to = F.pmod((F.col("y") * F.col("w") + F.col("x")) * 7919 + 4242, F.col("h") * F.col("w"))
    dealt = r.withColumn("i", to).withColumns({"y": F.floor(F.col("i") / F.col("w")).cast("int"), "x": (F.col("i") % F.col("w")).cast("int")})
    return coherence(r, "coherence").join(coherence(dealt.drop("i"), "shuffled"), "seg")


CUTS = [150, 160, 170, 180, 190]
_MASKS = ", ".join(f"a + (b % {i + 2}) * 9 > {c} AS m{i}" for i, c in enumerate(CUTS))


@query(
    "f34_stability",
    with_plane(f""", m AS (SELECT seg, {_MASKS} FROM plane),
j AS ({' UNION ALL '.join(f"SELECT seg, count(*) FILTER (m{i} AND m{j}) / nullif(count(*) FILTER (m{i} OR m{j}), 0) AS j FROM m GROUP BY seg" for i in range(5) for j in range(i + 1, 5))})
SELECT seg, round(median(j), 6) AS stability, (SELECT round(avg(({'+'.join(f'CAST(m{i} AS INT)' for i in range(5))}) / 5), 6) FROM m q WHERE q.seg = j.seg) AS consensus
FROM j GROUP BY seg"""),
)
def f34(spark, sf):
    """Median Jaccard over all pairs of mask variants, and the mean share of variants that call a cell.

    Cells collapse to how often each combination of variants occurs, a number
    bounded by the variants alone; pairs are counted on that table.
    """
    bits = F.lit(0)
    for i, c in enumerate(CUTS):
        bits = bits + F.when(F.col("a") + (F.col("b") % (i + 2)) * 9 > c, 1 << i).otherwise(0)
    combos = grids.plane(spark, sf).groupBy("seg", bits.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    on = lambda i: F.col("bits").bitwiseAND(1 << i) > 0
    pairs = [(i, j) for i in range(5) for j in range(i + 1, 5)]
    js = [
        F.sum(F.when(on(i) & on(j), F.col("n")).otherwise(0)) / F.nullif(F.sum(F.when(on(i) | on(j), F.col("n")).otherwise(0)), F.lit(0))
        for i, j in pairs
    ]
    share = F.sum(F.col("n") * F.bit_count("bits")) / F.sum("n") / len(CUTS)
    per = combos.groupBy("seg").agg(F.array(*js).alias("js"), share.alias("share"))
    return per.select("seg", "share", F.explode("js").alias("j")).groupBy("seg").agg(
        r6(F.median("j"), "stability"), r6(F.first("share"), "consensus")
    )


@query(
    "f35_branch_points",
    with_plane("""
, o AS MATERIALIZED (SELECT p.seg, p.y, p.x, p.y + dy.range AS ny, p.x + dx.range AS nx FROM plane p CROSS JOIN range(-1, 2) dy CROSS JOIN range(-1, 2) dx
  WHERE p.a > 150 AND p.y BETWEEN 1 AND 62 AND p.x BETWEEN 1 AND 62 AND NOT (dy.range = 0 AND dx.range = 0))
SELECT o.seg, o.y, o.x FROM o JOIN plane q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx WHERE q.a > 150 GROUP BY ALL HAVING count(*) > 2"""),
)
def f35(spark, sf):
    df = grids.plane(spark, sf).withColumn("c", (F.col("a") > 150).cast("int"))
    df = axis.sliding_sum(df, axis.ROW, {"r": ("c", 1, 1)}, "zero")
    df = axis.sliding_sum(df, axis.COL, {"s": ("r", 1, 1)}, "zero")
    inner = F.col("y").between(1, F.col("h") - 2) & F.col("x").between(1, F.col("w") - 2)
    return df.where(inner & (F.col("c") == 1) & (F.col("s") - 1 > 2)).select("seg", "y", "x")


CANDS = [(s, dy, dx) for s in range(8) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
_CV = ", ".join(f"({s}, {a}, {b})" for s, a, b in CANDS)


@query(
    "f36_registration_search",
    with_plane(f"""
, h AS (SELECT seg, y, x FROM plane WHERE a > 200),
t AS (SELECT h.seg, s, dy, dx, CASE WHEN s & 4 = 4 THEN x ELSE y END AS y1, CASE WHEN s & 4 = 4 THEN y ELSE x END AS x1 FROM h CROSS JOIN (VALUES {_CV}) c(s, dy, dx)),
m AS MATERIALIZED (SELECT seg, s, dy, dx, (CASE WHEN s & 1 = 1 THEN 63 - y1 ELSE y1 END + dy + 64) % 64 AS y,
  (CASE WHEN s & 2 = 2 THEN 63 - x1 ELSE x1 END + dx + 64) % 64 AS x, 1 AS hit FROM t),
k AS (SELECT m.seg, s, dy, dx, sum(b) AS sv, count(*) AS k FROM m JOIN plane USING (seg, y, x) GROUP BY ALL),
g AS (SELECT seg, avg(b) AS mu, stddev_pop(b) AS sd FROM plane GROUP BY seg),
r AS (SELECT seg, s, dy, dx, round((sv / 4096 - mu * k / 4096) / (sd * sqrt(k / 4096 * (1 - k / 4096))), 6) AS r FROM k JOIN g USING (seg))
SELECT seg, s, dy, dx, r FROM r QUALIFY row_number() OVER (PARTITION BY seg ORDER BY r DESC, s, dy, dx) = 1"""),
)
def f36(spark, sf):
    df = grids.plane(spark, sf)
    scored = fields.grid_search(df.where("a > 200"), df, "b", CANDS, grids.PLANE_H, grids.PLANE_W)
    best = F.max_by(F.struct("s", "dy", "dx", "r"), F.struct("r", -F.col("s"), -F.col("dy"), -F.col("dx")))
    return scored.withColumn("r", F.round("r", 6)).groupBy("seg").agg(best.alias("b")).select("seg", "b.*")


@query(
    "f37_depth_transform_sweep",
    with_volume("""
, l AS (SELECT seg, y, x, CAST(count(*) FILTER (v > 0) > 9 AS INT) AS ink FROM volume GROUP BY ALL),
c AS (SELECT seg, z, corr(v, ink) AS raw, corr(v * v, ink) AS sq, corr(CAST(v > 0 AS INT), ink) AS occ FROM volume JOIN l USING (seg, y, x) GROUP BY ALL),
u AS (UNPIVOT c ON raw, sq, occ INTO NAME transform VALUE r)
SELECT transform, z, round(median(r), 6) AS r, count(r) AS tiles FROM u WHERE isfinite(r) GROUP BY ALL HAVING count(r) >= 3"""),
)
def f37(spark, sf):
    vol = grids.volume(spark, sf)
    label = vol.groupBy("seg", "y", "x").agg((F.count_if(F.col("v") > 0) > 9).cast("int").alias("ink"))
    v = F.col("v")
    kinds = {"raw": v, "sq": v * v, "occ": (v > 0).cast("int")}
    c = vol.join(label, ["seg", "y", "x"]).groupBy("seg", "z").agg(
        F.array(*[F.struct(F.lit(k).alias("transform"), F.corr(e, F.col("ink")).alias("r")) for k, e in kinds.items()]).alias("es")
    )
    r = c.select("z", F.explode("es").alias("e")).select("z", "e.*").where("r IS NOT NULL AND NOT isnan(r)")
    n = r.groupBy("transform", "z").agg(F.count(F.lit(1)).alias("tiles")).where("tiles >= 3")
    return rounded(n.join(quantiles.medians(r, ["transform", "z"], {"r": "r"}), ["transform", "z"]))


@query(
    "f38_window_scan",
    with_plane(f", {WIN} SELECT seg, CAST(wy AS INTEGER) AS wy, CAST(wx AS INTEGER) AS wx, round(avg(a), 6) AS mean, count(*) FILTER (a > 200) AS hot FROM wn JOIN plane USING (seg, y, x) GROUP BY ALL HAVING count(*) FILTER (a > 200) >= 15"),
)
def f38(spark, sf):
    c = fields.windows_over(grids.plane(spark, sf), 16, 8)
    g = c.groupBy("seg", "wy", "wx").agg(r6(F.avg("a"), "mean"), F.count_if(F.col("a") > 200).alias("hot"))
    return g.where("hot >= 15")
