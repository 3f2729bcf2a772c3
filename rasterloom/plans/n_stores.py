"""Stores of mixed arrays, label stores, certificates in place, crop pairs, budgeted reads (A2, A5, A34, J5, J6, L8, L9)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from rasterloom.operators import fields, masks
from rasterloom.plans.a_sources import stored
from rasterloom.plans.common import CALLED
from rasterloom.plans.f_fields import NORMALS, mesh_plane
from rasterloom.plans.g_ranking import consensus_labels
from rasterloom.plans.j_agreement import called_plane
from rasterloom.plans.j_pipelines import LABELS, j06
from rasterloom.plans.registry import BOTH, query, with_volume
from rasterloom.session import checkpoint, scratch
from rasterloom.sources import arraystore, grids

LONGS = "array<long>"


def longs(*values):
    return F.array(*[v if hasattr(v, "cast") else F.lit(v) for v in values]).cast(LONGS)


@query(
    "a02_mixed_windows",
    with_volume("""
, p AS (SELECT seg AS vol, z, y, x, CASE WHEN left(seg, 1) = 'R' THEN v * 200 ELSE v END AS v, CASE WHEN CAST(substr(seg, 2) AS INT) % 2 = 0 THEN [8, 8, 8] ELSE [4, 16, 5] END AS chunks,
  CASE WHEN left(seg, 1) = 'R' THEN '<u2' ELSE 'u1' END AS dtype, CASE WHEN CAST(substr(seg, 2) AS INT) % 3 = 0 THEN 13 ELSE 21 END AS depth FROM volume)
SELECT vol, CAST(depth AS BIGINT) AS depth, chunks, dtype, z, y, x, CAST(v AS BIGINT) AS v FROM p WHERE z < depth AND z BETWEEN 11 AND 14 AND y BETWEEN 2 AND 13 AND x BETWEEN 5 AND 7 AND v > 0"""),
)
def a02_mixed(spark, sf):
    """A window of every volume by its own sidecar: depths, chunk sizes and dtypes differ."""
    path = scratch(spark, "mixed")
    blk = F.expr("CAST(substring(seg, 2) AS INT)")
    cells = grids.volume(spark, sf).withColumn("depth", F.when(blk % 3 == 0, 13).otherwise(21)).where("z < depth")
    wide = F.substring("seg", 1, 1) == "R"
    cells = cells.select(
        F.col("seg").alias("vol"), F.lit(0).alias("level"), "z", "y", "x", F.when(wide, F.col("v") * 200).otherwise(F.col("v")).alias("v"),
        longs(F.col("depth"), grids.VOL_H, grids.VOL_W).alias("shape"),
        F.when(blk % 2 == 0, longs(8, 8, 8)).otherwise(longs(4, 16, 5)).alias("chunks"), wide.alias("wide"),
    )
    cells = checkpoint(cells.where("v > 0"))
    arraystore.write(arraystore.pack(cells.where("wide"), "<u2"), path)
    arraystore.write(arraystore.pack(cells.where("NOT wide")), path)
    levels = checkpoint(arraystore.levels(spark, path))
    box = levels.select("vol", "level", *[F.lit(n).alias(c) for c, n in zip(("z0", "z1", "y0", "y1", "x0", "x1"), (11, 15, 2, 14, 5, 8))])
    found = arraystore.voxels(arraystore.read(arraystore.wanted(levels, box), path), keep_zero=False)
    inside = F.col("z").between(11, 14) & F.col("y").between(2, 13) & F.col("x").between(5, 7)
    kinds = levels.select("vol", F.col("shape")[0].alias("depth"), "chunks", "dtype")
    return found.where(inside).join(kinds, "vol").select("vol", "depth", "chunks", "dtype", "z", "y", "x", F.col("v").cast("long").alias("v"))


CODES = ["unlabelled", "ink", "blank", "disputed"]


def label_store(spark, sf):
    """Consensus labels as two-axis arrays with their counts as attributes."""
    path = scratch(spark, "labels")
    coded = checkpoint(consensus_labels(called_plane(spark, sf)).select("seg", "h", "w", "y", "x", "code"))
    counts = masks.code_counts(coded, ["seg"], "code")
    attrs = F.to_json(
        F.struct(
            F.lit("consensus labels").alias("title"), F.col("seg").alias("segment"),
            F.struct(*CODES).alias("counts_px"), F.array(F.struct(F.array(F.struct(F.lit("0").alias("path"))).alias("datasets"))).alias("multiscales"),
        )
    )
    cells = coded.select(
        F.col("seg").alias("vol"), F.lit(0).alias("level"), F.lit(0).alias("z"), "y", "x", F.col("code").alias("v"),
        longs(1, F.col("h"), F.col("w")).alias("shape"), longs(1, 16, 16).alias("chunks"),
    )
    arraystore.write(arraystore.pack(cells), path, counts.select(F.col("seg").alias("vol"), attrs.alias("attrs")), flat=True)
    return path


@query(
    "j05_label_store",
    f"""WITH {CALLED}, {LABELS} SELECT seg AS vol, {', '.join(f'count(*) FILTER (code = {i}) AS {c}' for i, c in enumerate(CODES))},
  count(*) FILTER (code = 1) AS read_ink, count(*) FILTER (code = 2) AS read_blank, count(*) FILTER (code = 3) AS read_disputed, CAST(1 AS BIGINT) AS version,
  CAST(sum(code * (y * 3 + x)) AS BIGINT) AS moment FROM code GROUP BY seg""",
)
def j05_store(spark, sf):
    """Labels and attributes as they stand on disk: counts written and counts read must agree."""
    path = label_store(spark, sf)
    cells = arraystore.voxels(arraystore.read(arraystore.wanted(arraystore.levels(spark, path)), path), keep_zero=False)
    read = cells.groupBy("vol").agg(
        *[F.count_if(F.col("v") == i).alias(f"read_{c}") for i, c in enumerate(CODES) if i],
        F.sum(F.col("v") * (F.col("y") * 3 + F.col("x"))).cast("long").alias("moment"),
    )
    attrs = arraystore.read_attributes(spark, path)
    attrs = attrs.select("vol", "version", *[F.get_json_object("attrs", f"$.counts_px.{c}").cast("long").alias(c) for c in CODES])
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("read_ink", "read_blank", "read_disputed", "moment")]
    return attrs.join(read, "vol", "left").select("vol", *CODES, *none, "version")


@query(
    "a34_certificate_in_place",
    f"""WITH {CALLED}, {LABELS},
t AS (SELECT seg, count(*) FILTER (code = 1) AS ink, count(*) FILTER (ca AND m) AS own, count(*) FILTER (ca AND cb AND m) AS both_n FROM code GROUP BY seg)
SELECT seg AS vol, 'consensus labels' AS title, ink, own, CASE WHEN own > 0 THEN round(both_n / own, 3) END AS corroborated,
  CASE WHEN own = 0 THEN 'no ink footprint' WHEN both_n / own >= 0.5 THEN 'corroborated' WHEN both_n / own >= 0.2 THEN 'mixed' ELSE 'not corroborated' END AS verdict,
  CAST(2 AS BIGINT) AS version FROM t""",
)
def a34_place(spark, sf):
    """A second scan's certificate merged into stored labels under a version check; what was there stays."""
    path = label_store(spark, sf)
    held = arraystore.read_attributes(spark, path).select("vol", "version")
    called = called_plane(spark, sf).where("m").groupBy(F.col("seg").alias("vol")).agg(
        F.count_if("ca").alias("own"), F.count_if(F.col("ca") & F.col("cb")).alias("both")
    )
    cert = held.join(called, "vol", "left").na.fill(0, ["own", "both"])
    share = F.col("both") / F.col("own")
    verdict = F.when(F.col("own") == 0, "no ink footprint").when(share >= 0.5, "corroborated").when(share >= 0.2, "mixed").otherwise("not corroborated")
    patch = F.struct(F.struct("own", F.round(F.when(F.col("own") > 0, share), 3).alias("corroborated"), verdict.alias("verdict")).alias("cross_energy"))
    arraystore.merge_attributes(cert.select("vol", "version", F.to_json(patch).alias("attrs")), path)
    got = lambda p, t: F.get_json_object("attrs", f"$.{p}").cast(t)
    return arraystore.read_attributes(spark, path).select(
        "vol", got("title", "string").alias("title"), got("counts_px.ink", "long").alias("ink"), got("cross_energy.own", "long").alias("own"),
        got("cross_energy.corroborated", "double").alias("corroborated"), got("cross_energy.verdict", "string").alias("verdict"), "version",
    )


CROP = 4


@query(
    "j06_pair_stores",
    with_volume(f"""
, r AS (SELECT seg, y, x, max(v) >= 240 AS ink, max(v) < 150 AS blank, arg_max(z, (v, -z)) AS depth FROM volume GROUP BY ALL),
o AS (SELECT p.seg, p.y, p.x, p.y + dy.range AS ny, p.x + dx.range AS nx FROM r p CROSS JOIN range(4) dy CROSS JOIN range(4) dx WHERE p.y <= 12 AND p.x <= 12),
c AS (SELECT o.seg, o.y, o.x, count(*) FILTER (q.ink) AS ink, count(*) FILTER (q.blank) AS blank FROM o JOIN r q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx GROUP BY ALL),
i AS (SELECT seg, y, x, 'ink' AS kind FROM c QUALIFY row_number() OVER (PARTITION BY seg ORDER BY ink DESC, y, x) = 1),
b AS (SELECT seg, y, x, 'blank' AS kind FROM c QUALIFY row_number() OVER (PARTITION BY seg ORDER BY blank DESC, y, x) = 1),
w AS (SELECT * FROM i UNION ALL SELECT b.* FROM b JOIN i USING (seg) WHERE abs(b.y - i.y) + abs(b.x - i.x) > 2),
cen AS (SELECT seg, y, x, floor(sum(v * z) / sum(v) + 0.5) AS cz FROM volume GROUP BY ALL HAVING sum(v) > 0),
a AS (SELECT w.seg || '__' || kind AS pair, v.z, v.y - w.y AS y, v.x - w.x AS x, v.v, CASE WHEN r.blank THEN 2 WHEN r.ink AND abs(v.z - cz) <= 2 THEN 1 ELSE 0 END AS code
  FROM w JOIN volume v ON v.seg = w.seg AND v.y BETWEEN w.y AND w.y + 3 AND v.x BETWEEN w.x AND w.x + 3 JOIN r ON r.seg = v.seg AND r.y = v.y AND r.x = v.x
  LEFT JOIN cen ON cen.seg = v.seg AND cen.y = v.y AND cen.x = v.x)
SELECT pair, CAST(sum(v) AS BIGINT) AS mass, CAST(sum(v * (z + 1) * (y * 5 + x + 1)) AS BIGINT) AS moment, count(*) FILTER (code = 1) AS ink, count(*) FILTER (code = 2) AS blank,
  CAST(sum(CASE WHEN code = 1 THEN z ELSE 0 END) AS BIGINT) AS depth FROM a GROUP BY pair"""),
)
def j06_stores(spark, sf):
    """Image and label crops of every pair, written as two levels of one store and read back.

    Ink is labelled around each column's emission centroid, certified blank through all layers.
    """
    path = scratch(spark, "pairs")
    w = j06(spark, sf)
    crops = w.select("seg", F.explode(F.array(
        F.struct(F.lit("ink").alias("kind"), F.col("ink_y").alias("y0"), F.col("ink_x").alias("x0")),
        F.struct(F.lit("blank").alias("kind"), F.col("blank_y").alias("y0"), F.col("blank_x").alias("x0")),
    )).alias("c")).select("seg", "c.*").where("y0 IS NOT NULL")
    vol = grids.volume(spark, sf)
    col = Window.partitionBy("seg", "y", "x")
    mass, top = F.sum("v").over(col), F.max("v").over(col)
    centre = F.floor(F.sum(F.col("v") * F.col("z")).over(col) / mass + 0.5)
    code = F.when(top < 150, 2).when((top >= 240) & (F.abs(F.col("z") - centre) <= 2), 1).otherwise(0)
    vol = vol.select("seg", "d", "z", "y", "x", "v", code.alias("code"))
    inside = F.col("y").between(F.col("y0"), F.col("y0") + CROP - 1) & F.col("x").between(F.col("x0"), F.col("x0") + CROP - 1)
    cut = vol.join(crops, "seg").where(inside)
    both = F.explode(F.array(F.struct(F.lit(0).alias("level"), "v"), F.struct(F.lit(1).alias("level"), F.col("code").alias("v"))))
    cells = cut.select(
        F.concat("seg", F.lit("__"), "kind").alias("vol"), "z", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"),
        longs(F.col("d"), CROP, CROP).alias("shape"), longs(F.col("d"), 2, 2).alias("chunks"), both.alias("e"),
    ).select("vol", "e.level", "z", "y", "x", "e.v", "shape", "chunks")
    arraystore.write(arraystore.pack(cells), path)
    got = arraystore.voxels(arraystore.read(arraystore.wanted(arraystore.levels(spark, path)), path), keep_zero=False)
    image, label = F.col("level") == 0, F.col("level") == 1
    total = lambda c: F.coalesce(F.sum(c).cast("long"), F.lit(0))
    return got.groupBy(F.col("vol").alias("pair")).agg(
        total(F.when(image, F.col("v"))).alias("mass"),
        total(F.when(image, F.col("v") * (F.col("z") + 1) * (F.col("y") * 5 + F.col("x") + 1))).alias("moment"),
        F.count_if(label & (F.col("v") == 1)).alias("ink"), F.count_if(label & (F.col("v") == 2)).alias("blank"),
        total(F.when(label & (F.col("v") == 1), F.col("z"))).alias("depth"),
    )


BUDGET = 5000
WALK = f"""WITH {BOTH}, {NORMALS},
g AS MATERIALIZED (SELECT seg, y, x, CASE WHEN inn THEN nx ELSE mx / l END AS nx, CASE WHEN inn THEN ny ELSE my / l END AS ny, CASE WHEN inn THEN nz ELSE mz / l END AS nz
  FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS l FROM u JOIN sm USING (seg, y, x)) WHERE valid AND (inn OR l > 1e-6)),
p AS MATERIALIZED (SELECT seg, y, x, CAST(k.range AS INTEGER) AS k, CAST(floor(10 + round(nz, 6) * (k.range - 3) * 3 + 0.5) AS BIGINT) AS pz,
  CAST(floor(y / 4.0::DOUBLE + round(ny, 6) * (k.range - 3) + 0.5) AS BIGINT) AS py, CAST(floor(x / 4.0::DOUBLE + round(nx, 6) * (k.range - 3) + 0.5) AS BIGINT) AS px
  FROM g CROSS JOIN range(7) k WHERE g.y % 16 < 4 + CAST(substr(seg, 2) AS INT) % 3 * 6),
q AS MATERIALIZED (SELECT p.seg, k, f.level, pz AS iz, py // f.f AS iy, px // f.f AS ix FROM p CROSS JOIN (VALUES (0, 1), (1, 2)) f(level, f) WHERE pz BETWEEN 0 AND 20 AND py BETWEEN 0 AND 15 AND px BETWEEN 0 AND 15),
pr AS (SELECT seg, level, count(DISTINCT (iz // 8, iy // 8, ix // 8)) AS n_chunks FROM q GROUP BY ALL),
ch AS MATERIALIZED (SELECT seg, min(level) AS level, arg_min(n_chunks, level) AS n_chunks FROM pr WHERE n_chunks * 512 <= {BUDGET} GROUP BY seg),
vv AS (SELECT seg, 0 AS level, z, y, x, v FROM volume UNION ALL SELECT seg, 1, z, y // 2, x // 2, CAST(floor(avg(v)) AS INTEGER) FROM volume GROUP BY ALL)"""


def walked(spark, sf):
    """Points along the normals of a mesh's cells, in voxels of its volume; how much of a mesh is asked for differs by block."""
    part = F.col("y") % 16 < 4 + F.expr("CAST(substring(seg, 2) AS INT)") % 3 * 6
    n = fields.mesh_normals(mesh_plane(spark, sf), spread=3).where(F.col("valid") & part & (F.abs("nx") + F.abs("ny") + F.abs("nz") > 0.5))
    n = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    at = lambda base, c, by: F.floor(base + F.round(c, 6) * (F.col("k") - 3) * by + 0.5)
    return n.select(
        F.col("seg").alias("vol"), "y", "x", "k", at(F.lit(10), "nz", 3).alias("pz"), at(F.col("y") / 4.0, "ny", 1).alias("py"), at(F.col("x") / 4.0, "nx", 1).alias("px")
    )


@query(
    "l09_budgeted_gather",
    f"""{WALK} SELECT q.seg AS vol, q.level, k, count(*) AS pts, CAST(sum(coalesce(v, 0)) AS BIGINT) AS mass FROM q JOIN ch USING (seg, level)
LEFT JOIN vv ON vv.seg = q.seg AND vv.level = q.level AND vv.z = iz AND vv.y = iy AND vv.x = ix GROUP BY ALL""",
)
def l09(spark, sf):
    """Layers along the normals, each volume at the finest level that its byte budget allows; costs are known before a chunk is opened."""
    got = arraystore.gather(walked(spark, sf), stored(spark, sf), BUDGET)
    return got.groupBy("vol", "level", "k").agg(F.count(F.lit(1)).alias("pts"), F.sum("v").cast("long").alias("mass"))


@query("l09_gather_price", f"{WALK} SELECT seg AS vol, level, n_chunks, n_chunks * 512 AS cost, coalesce(ch.level = pr.level, false) AS chosen FROM pr LEFT JOIN (SELECT seg, level FROM ch) ch USING (seg)".replace("SELECT seg AS vol, level,", "SELECT pr.seg AS vol, pr.level,"))
def l09_price(spark, sf):
    """What the same request costs at every level, and which level is taken."""
    levels = arraystore.levels(spark, stored(spark, sf))
    costs = checkpoint(arraystore.price(arraystore.on_levels(arraystore.places(walked(spark, sf)), levels)))
    chosen = arraystore.affordable(costs, BUDGET).select("vol", "level", F.lit(True).alias("chosen"))
    return costs.join(chosen, ["vol", "level"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
