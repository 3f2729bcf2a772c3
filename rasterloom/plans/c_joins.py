"""Joins: attribute, substring, cell-aligned, spatial, gather."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import catalog, components, masks, spatial
from rasterloom.plans.common import r6, rounded, with_components
from rasterloom.plans.registry import BOTH, CELL, query, with_plane
from rasterloom.sources import grids


def comps(spark, sf, floor=150):
    cells = grids.plane(spark, sf).where(F.col("a") > floor)
    return components.label(cells, ["seg"], block=32)


@query("f08_components", with_components("a > 150", " SELECT seg, y, x, comp FROM lab"))
def f08(spark, sf):
    return comps(spark, sf)


SHAPE_COLS = "seg, comp, area, y0, y1, x0, x1, round(cy, 6) AS cy, round(cx, 6) AS cx, fill, aspect"


@query("f08_component_shapes", with_components("a > 150", f" SELECT {SHAPE_COLS} FROM shape"))
def f08_shapes(spark, sf):
    return rounded(components.shapes(comps(spark, sf), ["seg"]))


@query(
    "b11_strokelike",
    with_components(
        "a > 150",
        " SELECT seg, comp, area FROM shape WHERE fill BETWEEN 0.12 AND 0.60 AND aspect BETWEEN 0.35 AND 2.8 AND area >= 4",
    ),
)
def b11(spark, sf):
    s = components.shapes(comps(spark, sf), ["seg"], least=4)
    return s.where(components.strokelike()).select("seg", "comp", "area")


@query(
    "c01_attribute_join",
    """WITH s AS (SELECT o_custkey AS k, o_orderpriority AS m, o_totalprice AS v FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey DESC) = 1)
SELECT c_custkey, m, v FROM customer LEFT JOIN s ON k = c_custkey AND m = '2-HIGH'""",
)
def c01(spark, sf):
    last = catalog.last_wins(
        grids.table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderkey", ["o_totalprice"]
    ).where("o_orderpriority = '2-HIGH'")
    cust = grids.table(spark, sf, "customer").select("c_custkey")
    return cust.join(last, cust.c_custkey == last.o_custkey, "left").select(
        "c_custkey", F.col("o_orderpriority").alias("m"), F.col("o_totalprice").alias("v")
    )


STEMS = """stems AS (SELECT DISTINCT p_brand AS brand, p_type || '-' || replace(p_name, ' ', '-') AS stem FROM part
  UNION SELECT DISTINCT p_brand, p_type FROM part),
files AS (SELECT DISTINCT p_brand AS brand, p_type || '-' || replace(p_name, ' ', '-') || '-' || l_returnflag || l_linestatus
    || CASE WHEN l_linestatus = 'F' THEN '-tile32-stride8' ELSE '' END || '-ds8.jpg' AS base
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def stems_and_files(spark, sf):
    part = grids.table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("brand"), "p_type",
        F.concat("p_type", F.lit("-"), F.regexp_replace("p_name", " ", "-")).alias("stem"),
    )
    stems = part.select("brand", "stem").union(part.select("brand", "p_type")).distinct()
    line = grids.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus").distinct()
    tiled = F.when(F.col("l_linestatus") == "F", "-tile32-stride8").otherwise("")
    files = line.join(part, line.l_partkey == part.p_partkey).select(
        "brand", F.concat("stem", F.lit("-"), "l_returnflag", "l_linestatus", tiled, F.lit("-ds8.jpg")).alias("base")
    ).distinct()
    return stems, files


@query(
    "c02_substring_join",
    f"""WITH {STEMS} SELECT f.brand, base, arg_max(stem, (length(stem), stem)) AS stem
FROM files f JOIN stems s ON s.brand = f.brand AND contains(base, stem) GROUP BY ALL""",
)
def c02(spark, sf):
    stems, files = stems_and_files(spark, sf)
    return catalog.longest_stem(files, stems, ["brand"], "base", "stem").select("brand", "base", "stem")


@query(
    "c03_plane_overlay",
    with_plane("""
, p2 AS (SELECT left(seg, 1) AS flag, substr(seg, 2) AS blk, y, x, a FROM plane WHERE n > 0)
SELECT blk, u.flag || v.flag AS pair, count(*) AS cells, round(corr(u.a, v.a), 6) AS r
FROM p2 u JOIN p2 v USING (blk, y, x) WHERE u.flag < v.flag GROUP BY ALL"""),
)
def c03(spark, sf):
    on = grids.plane(spark, sf).where("n > 0").select(
        F.substring("seg", 1, 1).alias("flag"), F.expr("substring(seg, 2)").alias("blk"), "y", "x", "a"
    )
    # all planes come from one relation: gathering a cell's few sheets is one exchange, no join
    cell = on.groupBy("blk", "y", "x").agg(F.array_sort(F.collect_list(F.struct("flag", "a"))).alias("s"))
    later = lambda u: F.transform(F.filter("s", lambda v: v["flag"] > u["flag"]), lambda v: F.struct(u.alias("u"), v.alias("v")))
    pair = cell.select("blk", F.explode(F.flatten(F.transform("s", later))).alias("p"))
    return pair.groupBy("blk", F.concat("p.u.flag", "p.v.flag").alias("pair")).agg(
        F.count(F.lit(1)).alias("cells"), r6(F.corr("p.u.a", "p.v.a"), "r")
    )


@query(
    "c04_scaled_grid_join",
    with_plane("""
, g AS (SELECT DISTINCT seg, r.range AS r, c.range AS c, least(63, r.range * 20 // 8) AS y, least(63, c.range * 20 // 8) AS x
  FROM (SELECT DISTINCT seg FROM plane) CROSS JOIN range(30) r CROSS JOIN range(30) c)
SELECT g.seg, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, a FROM g JOIN plane p ON p.seg = g.seg AND p.y = g.y AND p.x = g.x"""),
)
def c04(spark, sf):
    df = grids.plane(spark, sf)
    axis = lambda: F.explode(F.sequence(F.lit(0), F.lit(29)))
    at = lambda c: F.least(F.lit((grids.PLANE_H if c == "r" else grids.PLANE_W) - 1), F.floor(F.col(c) * 20 / 8)).cast("int")
    grid = grids.segments(spark, sf).select("seg", axis().alias("r")).select("seg", "r", axis().alias("c"))
    grid = grid.withColumns({"y": at("r"), "x": at("c")})
    # merged, not broadcast: the grid is 900 times the segments it is estimated by
    return df.select("seg", "y", "x", "a").join(grid.hint("merge"), ["seg", "y", "x"]).select("seg", "r", "c", "a")


@query(
    "c05_grid_alignment",
    with_plane("""
, f AS (SELECT seg, y // 3 AS "by", x // 3 AS bx, avg(a) AS f FROM plane WHERE y < 63 AND x < 63 GROUP BY ALL)
SELECT f.seg, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, round(f, 6) AS f, b AS ink
FROM f JOIN plane p ON p.seg = f.seg AND p.y = "by" + 5 AND p.x = bx + 7"""),
)
def c05(spark, sf):
    df = grids.plane(spark, sf)
    binned = masks.block_reduce(df, ["seg"], 3, f=F.avg("a"))
    target = df.select("seg", (F.col("y") - 5).alias("by"), (F.col("x") - 7).alias("bx"), F.col("b").alias("ink"))
    return rounded(binned.join(target, ["seg", "by", "bx"]))


POINTS = """pts AS (SELECT left(seg, 1) AS flag, substr(seg, 2) AS blk, y * 2 AS py, x * 2 AS px, a // 16 AS pz,
  y AS r, x AS c FROM plane WHERE n > 0)"""


def points(spark, sf):
    return grids.plane(spark, sf).where("n > 0").select(
        F.substring("seg", 1, 1).alias("flag"), F.expr("substring(seg, 2)").alias("blk"),
        (F.col("y") * 2).alias("py"), (F.col("x") * 2).alias("px"), F.floor(F.col("a") / 16).cast("int").alias("pz"),
        F.col("y").alias("r"), F.col("x").alias("c"),
    )


#: Sheets of a block, one per flag; every two of them are a pair.
SHEETS = ["A", "N", "R"]


def in_pairs(df, place: int):
    """Rows of a sheet once for each pair (``pair``) whose first or second sheet it is."""
    pairs = F.array(*[F.lit(u + v) for u in SHEETS for v in SHEETS if u < v])
    mine = F.filter(pairs, lambda n: F.substring(n, place, 1) == F.col("flag"))
    return df.withColumn("pair", F.explode(mine)).drop("flag")


def neighbour_pairs(spark, sf, reach=4.0):
    """Nearest point of each later sheet of the block, for every point of a sheet."""
    p = points(spark, sf)
    rim = in_pairs(p, 1)
    body = in_pairs(p, 2).select("blk", "pair", "py", "px", "pz")
    return spatial.nearest_within(rim, body, ["blk", "pair"], ["r", "c", "py", "px", "pz"], ["pz", "py", "px"], reach, side=32)


NN_ALL = f""", {POINTS},
offs AS MATERIALIZED (SELECT u.*, dy.range * 2 AS dy, dx.range * 2 AS dx FROM pts u CROSS JOIN range(-2, 3) dy CROSS JOIN range(-2, 3) dx),
nn AS MATERIALIZED (SELECT u.blk, u.flag || v.flag AS pair, u.r, u.c, u.py, u.px, u.pz, pow(u.pz - v.pz, 2) + pow(u.py - v.py, 2) + pow(u.px - v.px, 2) AS d2,
    v.pz AS qz, v.py AS qy, v.px AS qx
  FROM offs u JOIN pts v ON v.flag > u.flag AND v.blk = u.blk AND v.py = u.py + u.dy AND v.px = u.px + u.dx
  WHERE pow(u.pz - v.pz, 2) + pow(u.py - v.py, 2) + pow(u.px - v.px, 2) <= 16
  QUALIFY row_number() OVER (PARTITION BY u.blk, u.flag, v.flag, u.r, u.c ORDER BY d2, v.pz, v.py, v.px) = 1)"""


@query(
    "c06_nearest_neighbour",
    with_plane(f"{NN_ALL} SELECT blk, pair, r, c, CAST(d2 AS INTEGER) AS d2, qz, qy, qx FROM nn"),
)
def c06(spark, sf):
    nn = neighbour_pairs(spark, sf)
    return nn.select(
        "blk", "pair", "r", "c", F.col("d2").cast("int").alias("d2"),
        F.col("r_pz").alias("qz"), F.col("r_py").alias("qy"), F.col("r_px").alias("qx"),
    )


@query(
    "c07_bbox_pairs",
    with_components(
        "a > 150",
        """ , s AS (SELECT * FROM shape WHERE area >= 6)
SELECT p.seg, p.comp AS a, q.comp AS b FROM s p JOIN s q ON p.seg = q.seg AND p.comp < q.comp
WHERE p.y0 <= q.y1 + 2 AND q.y0 <= p.y1 + 2 AND p.x0 <= q.x1 + 2 AND q.x0 <= p.x1 + 2""",
    ),
)
def c07(spark, sf):
    s = components.shapes(comps(spark, sf), ["seg"], least=6).select("seg", "comp", "y0", "y1", "x0", "x1")
    s = s.persist()
    pairs = spatial.overlapping_boxes(s, s, ["seg"], size=16, slack=2)
    return pairs.where("comp < r_comp").select("seg", F.col("comp").alias("a"), F.col("r_comp").alias("b"))


@query(
    "c08_overlap_largest",
    with_components(
        "a > 150",
        """ , k AS (SELECT seg, y // 8 AS ky, x // 8 AS kx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1
    FROM plane WHERE b > 200 GROUP BY ALL)
SELECT k.seg, CAST(ky AS INTEGER) AS ky, CAST(kx AS INTEGER) AS kx, arg_max(s.comp, (area, -s.comp)) AS comp, max(area) AS area
FROM k JOIN shape s ON s.seg = k.seg AND s.x0 <= k.x1 AND s.x1 >= k.x0 AND s.y0 <= k.y1 AND s.y1 >= k.y0 GROUP BY ALL""",
    ),
)
def c08(spark, sf):
    known = grids.plane(spark, sf).where("b > 200").groupBy(
        "seg", F.floor(F.col("y") / 8).cast("int").alias("ky"), F.floor(F.col("x") / 8).cast("int").alias("kx")
    ).agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    ours = components.shapes(comps(spark, sf), ["seg"]).select("seg", "comp", "area", "y0", "y1", "x0", "x1")
    hit = spatial.overlapping_boxes(known, ours, ["seg"], size=16)
    return hit.groupBy("seg", "ky", "kx").agg(
        F.max_by("r_comp", F.struct("r_area", -F.col("r_comp"))).alias("comp"), F.max("r_area").alias("area")
    )


@query(
    "c09_proximity_count",
    with_components(
        "a > 180",
        """, called AS (SELECT seg, y, x FROM plane WHERE b > 200)
SELECT seg, count(*) AS comps, count(*) FILTER (EXISTS (SELECT 1 FROM called c WHERE c.seg = s.seg
  AND pow(c.y - s.cy, 2) + pow(c.x - s.cx, 2) < 9)) AS near FROM shape s WHERE area >= 3 GROUP BY seg""",
    ),
)
def c09(spark, sf):
    s = components.shapes(comps(spark, sf, 180), ["seg"], least=3).select("seg", "comp", F.col("cy").alias("y"), F.col("cx").alias("x"))
    s = s.persist()
    called = grids.plane(spark, sf).where("b > 200").select("seg", "y", "x")
    near = spatial.has_within(s.withColumn("id", F.col("comp")), called, ["seg"], ["y", "x"], 3.0)
    tagged = s.join(near.select("seg", "comp", F.lit(1).alias("hit")), ["seg", "comp"], "left")
    return tagged.groupBy("seg").agg(F.count(F.lit(1)).alias("comps"), F.count("hit").alias("near"))


@query(
    "c10_injection_match",
    with_plane("""
, f AS (SELECT seg, y, x FROM plane WHERE a > 230), p AS (SELECT seg, y, x FROM plane WHERE b > 225)
SELECT seg, y, x FROM p WHERE EXISTS (SELECT 1 FROM f WHERE f.seg = p.seg AND pow(f.y - p.y, 2) + pow(f.x - p.x, 2) <= 20.25)"""),
)
def c10(spark, sf):
    df = grids.plane(spark, sf)
    planted = df.where("b > 225").select("seg", "y", "x", (F.col("y").cast("long") * F.col("w") + F.col("x")).alias("id"))
    found = df.where("a > 230").select("seg", "y", "x")
    return spatial.has_within(planted, found, ["seg"], ["y", "x"], 4.5, strict=False).select("seg", "y", "x")


@query(
    "c11_common_segments",
    f"""WITH {CELL} SELECT DISTINCT seg FROM (SELECT seg FROM cell WHERE q = 50 GROUP BY seg HAVING count(*) > 20
  INTERSECT SELECT seg FROM cell WHERE d = 10 GROUP BY seg HAVING count(*) > 20)""",
)
def c11(spark, sf):
    s = grids.samples(spark, sf)
    strong = lambda cond: s.where(cond).groupBy("seg").count().where("count > 20").select("seg")
    return strong("q = 50").intersect(strong("d = 10"))


GATHER = """, p AS (SELECT seg, y, x, (y % 16) * 1e0 AS pz0, y * 0.24 + 0.1 AS py0, x * 0.24 + 0.1 AS px0 FROM plane WHERE n > 1)
SELECT p.seg, p.y, p.x, coalesce(v.v, 0) AS v FROM p LEFT JOIN volume v ON v.seg = p.seg
AND v.z = CAST(round_even(pz0, 0) AS INT) AND v.y = CAST(round_even(py0, 0) AS INT) AND v.x = CAST(round_even(px0, 0) AS INT)"""

CHUNK = (8, 8, 8)


@query("c12_voxel_gather", f"WITH {BOTH}{GATHER}")
def c12(spark, sf):
    pts = grids.plane(spark, sf).where("n > 1").select(
        "seg", "y", "x", (F.col("y") % 16).cast("double").alias("pz"),
        (F.col("y") * 0.24 + 0.1).alias("py"), (F.col("x") * 0.24 + 0.1).alias("px"),
    )
    chunks = spatial.chunked(grids.volume(spark, sf), *CHUNK)
    return spatial.gather(pts, chunks, *CHUNK).select("seg", "y", "x", "v")


@query(
    "c13_normal_offsets",
    with_plane("""
SELECT seg, CAST(k.range AS INTEGER) AS k, count(*) AS pts, round(sum(y + 0.6e0 * (k.range - 31)), 4) AS sy,
  round(sum(x + 0.8e0 * (k.range - 31)), 4) AS sx FROM plane CROSS JOIN range(62) k WHERE n > 0 GROUP BY ALL"""),
)
def c13(spark, sf):
    pts = grids.plane(spark, sf).where("n > 0").select("seg", "y", "x")
    off = pts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(61))))
    step = F.col("k") - 31.0
    return off.groupBy("seg", "k").agg(
        F.count(F.lit(1)).alias("pts"), F.round(F.sum(F.col("y") + step * 0.6), 4).alias("sy"),
        F.round(F.sum(F.col("x") + step * 0.8), 4).alias("sx"),
    )


@query(
    "c14_seam_classes",
    with_plane(f"""{NN_ALL},
k AS (SELECT blk, pair, d2, (qy - py) * 0.6e0 + (qz - pz) * 0.8e0 AS perp FROM nn),
m AS (SELECT blk, pair, abs(perp) AS perp, sqrt(greatest(d2 - perp * perp, 0)) AS inplane FROM k)
SELECT blk, pair, count(*) AS near, count(*) FILTER (inplane > perp) AS seam,
  round(count(*) FILTER (inplane > perp) / count(*), 3) AS edge_on,
  round(median(perp) FILTER (inplane > perp), 6) AS perp, round(median(inplane) FILTER (inplane > perp), 6) AS inplane,
  CASE WHEN count(*) / (SELECT count(*) FROM pts p WHERE flag = left(m.pair, 1) AND p.blk = m.blk) > 0.5 THEN 'duplicate' ELSE 'seam' END AS kind
FROM m GROUP BY blk, pair HAVING count(*) FILTER (inplane > perp) >= 20"""),
)
def c14(spark, sf):
    sizes = points(spark, sf).groupBy("blk", "flag").agg(F.count(F.lit(1)).alias("body"))
    rim = in_pairs(sizes, 1)
    nn = neighbour_pairs(spark, sf)
    return rounded(
        catalog.seam_classes(nn, rim, ["blk", "pair"], {"pz": 0.8, "py": 0.6, "px": 0.0}, least=20)
    )


@query(
    "c15_unseen_candidates",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events e WHERE event_type = 'click'
AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'error' AND s.user_id = e.user_id
  AND json_extract_string(s.props, '$.k') = json_extract_string(e.props, '$.k'))""",
)
def c15(spark, sf):
    e = grids.table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    seen = e.where("event_type = 'error'").select("user_id", "k").distinct()
    return e.where("event_type = 'click'").join(seen, ["user_id", "k"], "left_anti").select("event_id", "k")


@query(
    "c16_chunk_liveness",
    with_plane("""
, c AS (SELECT seg, y // 8 AS cy, x // 8 AS cx, count(*) AS pts, max(b) AS top FROM plane WHERE n > 0 GROUP BY ALL)
SELECT seg, count(*) AS chunks, count(*) FILTER (top > 220) AS live_chunks, CAST(sum(pts) AS BIGINT) AS valid,
  round(sum(pts) FILTER (top > 220) / sum(pts), 6) AS livefrac FROM c GROUP BY seg"""),
)
def c16(spark, sf):
    key = lambda c: F.floor(F.col(c) / 8).cast("int")
    cells = grids.plane(spark, sf).where("n > 0").select("seg", key("y").alias("cy"), key("x").alias("cx"), "b")
    per = cells.groupBy("seg", "cy", "cx").agg(F.count(F.lit(1)).alias("pts"))
    stored = cells.where("b > 220").select("seg", "cy", "cx").distinct().withColumn("live", F.lit(True))
    j = per.join(stored, ["seg", "cy", "cx"], "left")
    live = F.sum(F.when(F.col("live"), F.col("pts")))
    return j.groupBy("seg").agg(
        F.count(F.lit(1)).alias("chunks"), F.count("live").alias("live_chunks"), F.sum("pts").alias("valid"),
        r6(live / F.sum("pts"), "livefrac"),
    )


@query(
    "c17_registration_check",
    with_plane("""
SELECT seg, round(avg(a) FILTER (b > 180), 6) AS occupied, round(avg(a) FILTER (b <= 60), 6) AS elsewhere,
  avg(a) FILTER (b > 180) < 0.55 * avg(a) FILTER (b <= 60) AS misregistered FROM plane GROUP BY seg"""),
)
def c17(spark, sf):
    occ, els = F.avg(F.when(F.col("b") > 180, F.col("a"))), F.avg(F.when(F.col("b") <= 60, F.col("a")))
    return grids.plane(spark, sf).groupBy("seg").agg(
        r6(occ, "occupied"), r6(els, "elsewhere"), (occ < els * 0.55).alias("misregistered")
    )
