"""Scans, catalogs and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import axis, catalog, depth, fields, spatial
from rasterloom.plans.c_joins import CHUNK, STEMS, stems_and_files
from rasterloom.plans.common import r6, rounded
from rasterloom.plans.d_depth import PEAK
from rasterloom.plans.registry import CELL, query, with_plane, with_volume
from rasterloom.session import scratch
from rasterloom.sources import arraystore, chunkstore, files, grids

SHAPE = (grids.VOL_D, grids.VOL_H, grids.VOL_W)
HALF = (grids.VOL_D, grids.VOL_H // 2, grids.VOL_W // 2)


def stored(spark, sf):
    """The depth stacks as a two-level chunk store; depth is not downsampled."""
    path = scratch(spark, "store")
    levels = F.array(
        *[
            F.struct(F.lit(k).alias("level"), F.lit(1 << k).alias("step"), F.array(*map(F.lit, shape)).cast("array<long>").alias("shape"))
            for k, shape in enumerate((SHAPE, HALF))
        ]
    )
    cells = grids.volume(spark, sf).where("v > 0").select(F.col("seg").alias("vol"), "z", "y", "x", "v", F.explode(levels).alias("l"))
    at = lambda c: F.floor(F.col(c) / F.col("l.step")).cast("int").alias(c)
    # a coarse cell is the mean of its four, unwritten ones included
    mean = F.floor(F.sum("v") / F.first(F.col("l.step") * F.col("l.step"))).cast("int").alias("v")
    cells = cells.groupBy("vol", "l.level", "l.shape", "z", at("y"), at("x")).agg(mean)
    cells = cells.withColumn("chunks", F.array(*map(F.lit, CHUNK)).cast("array<long>"))
    arraystore.write(arraystore.pack(cells), path)
    return path


@query(
    "a01_open_levels",
    f"""WITH {CELL} SELECT DISTINCT seg AS vol, l.path, l.shape, [8, 8, 8] AS chunks, '|u1' AS dtype, l.factor, 1 AS z_factor
FROM cell CROSS JOIN (VALUES ('0', [21, 16, 16], 1), ('1', [21, 8, 8], 2)) l(path, shape, factor)""",
)
def a01(spark, sf):
    return chunkstore.read_levels(spark, stored(spark, sf))


@query(
    "a02_read_window",
    with_volume(" SELECT seg AS vol, y, x, v FROM volume WHERE z = 12 AND y BETWEEN 2 AND 13 AND x BETWEEN 5 AND 7 AND v > 0"),
)
def a02(spark, sf):
    """One plane cropped to a window: only the chunks it touches are opened."""
    z = min(max(int(11.6 + 0.5), 0), SHAPE[0] - 1)
    box = chunkstore.window(chunkstore.read_chunks(spark, stored(spark, sf)), CHUNK, 0, z, 2, 14, 5, 8)
    cells = chunkstore.voxels(box, SHAPE, CHUNK)
    hit = (F.col("z") == z) & F.col("y").between(2, 13) & F.col("x").between(5, 7) & (F.col("v") > 0)
    return cells.where(hit).select("vol", "y", "x", "v")


@query("a03_raw_decode", with_volume(" SELECT seg AS vol, z, y, x, v FROM volume WHERE v > 0"))
def a03(spark, sf):
    packed = spatial.chunked(grids.volume(spark, sf), *CHUNK).select(F.col("seg").alias("vol"), F.lit(0).alias("level"), "cz", "cy", "cx", "data")
    return chunkstore.voxels(packed, SHAPE, CHUNK).where("v > 0").select("vol", "z", "y", "x", "v")


@query(
    "a04_store_round_trip",
    with_volume("""
, c AS (SELECT seg, 0 AS level, z, y, x, v FROM volume UNION ALL
  SELECT seg, 1, z, y // 2, x // 2, CAST(floor(avg(v)) AS INTEGER) FROM volume GROUP BY ALL)
SELECT seg AS vol, level, count(*) FILTER (v > 0) AS cells, CAST(sum(v) AS BIGINT) AS mass,
  CAST(sum(v * (z + 1) * (y + 3) * (x + 7)) AS BIGINT) AS moment FROM c GROUP BY ALL"""),
)
def a04(spark, sf):
    path = stored(spark, sf)
    every = arraystore.voxels(arraystore.read(arraystore.wanted(arraystore.levels(spark, path)), path), keep_zero=False)
    every = every.withColumn("v", F.col("v").cast("int"))
    moment = F.col("v") * (F.col("z") + 1) * (F.col("y") + 3) * (F.col("x") + 7)
    return every.groupBy("vol", "level").agg(
        F.count_if(F.col("v") > 0).alias("cells"), F.sum("v").alias("mass"), F.sum(moment).alias("moment")
    )


@query(
    "a06_tile_load",
    with_volume("""
, c AS (SELECT seg, y // 4 AS cy, x // 4 AS cx, count(*) FILTER (v > 200) > 0 AS here FROM volume GROUP BY ALL),
k AS (SELECT seg FROM c WHERE here AND cy BETWEEN 1 AND 2 AND cx BETWEEN 1 AND 2 GROUP BY seg HAVING count(*) >= 3),
p AS (SELECT seg, z, avg(v) AS m FROM volume JOIN k USING (seg) WHERE y BETWEEN 4 AND 11 AND x BETWEEN 4 AND 11 GROUP BY ALL)
SELECT seg, arg_max(z, (m, -z)) AS pk, round(max(m), 6) AS level FROM p GROUP BY seg"""),
)
def a06(spark, sf):
    """Centred window of chunks; needs three quarters of them present."""
    nt, ch = 2, 4
    vol = grids.volume(spark, sf)
    first = SHAPE[1] // ch // 2 - nt // 2
    at = lambda c: F.floor(F.col(c) / ch)
    tile = vol.where(at("y").between(first, first + nt - 1) & at("x").between(first, first + nt - 1))
    got = tile.where("v > 200").select("seg", at("y").alias("cy"), at("x").alias("cx")).distinct()
    ok = got.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= nt * nt * 0.75)
    prof = depth.layer_profile(tile.join(ok, "seg", "left_semi"))
    return prof.groupBy("seg").agg(
        F.max_by("z", F.struct("mean", -F.col("z"))).alias("pk"), r6(F.max("mean"), "level")
    )


@query(
    "a07_depth_crop",
    with_volume(f"""{PEAK} SELECT seg, CAST(z - greatest(pk - 4, 0) AS INTEGER) AS z, CAST(sum(v) AS BIGINT) AS mass
FROM volume JOIN pk USING (seg) WHERE z BETWEEN pk - 4 AND pk + 4 GROUP BY ALL"""),
)
def a07(spark, sf):
    return depth.around_peak(grids.volume(spark, sf), 4).groupBy("seg", "z").agg(F.sum("v").alias("mass"))


AIMS = [0.05, 0.25, 0.40]
WINDOW_COVER = """, o AS (SELECT p.seg, p.y, p.x, p.y + dy.range AS ny, p.x + dx.range AS nx FROM plane p CROSS JOIN range(8) dy CROSS JOIN range(8) dx
  WHERE p.y <= 56 AND p.x <= 56),
c AS MATERIALIZED (SELECT o.seg, o.y, o.x, count(*) FILTER (q.b > 150) / 64.0::DOUBLE AS c FROM o
  JOIN plane q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx GROUP BY ALL)"""


def window_cover(spark, sf, k=8):
    df = grids.plane(spark, sf).withColumn("t", (F.col("b") > 150).cast("int"))
    return axis.valid_box(df, {"s": "t"}, k).select("seg", "y", "x", (F.col("s") / float(k * k)).alias("c"))


@query(
    "a08_aimed_window",
    with_plane(f"{WINDOW_COVER} SELECT seg, y, x, c AS cover FROM c WHERE c >= 0.08 QUALIFY row_number() OVER (PARTITION BY seg ORDER BY abs(c - 0.4), y, x) = 1"),
)
def a08(spark, sf):
    c = window_cover(spark, sf).where("c >= 0.08")
    best = F.min_by(F.struct("y", "x", F.col("c").alias("cover")), F.struct(F.abs(F.col("c") - 0.4), "y", "x"))
    return c.groupBy("seg").agg(best.alias("b")).select("seg", "b.*")


@query(
    "a09_multi_aim_windows",
    with_plane(f"""{WINDOW_COVER},
w AS (SELECT seg, a.aim, y, x, c FROM c CROSS JOIN (VALUES (0.05e0), (0.25e0), (0.4e0)) a(aim) WHERE c >= 0.02
  QUALIFY row_number() OVER (PARTITION BY seg, a.aim ORDER BY abs(c - a.aim), y, x) = 1)
SELECT seg, aim, CAST(round(y / 8) AS INTEGER) AS cy, CAST(round(x / 8) AS INTEGER) AS cx, c AS cover FROM w
QUALIFY row_number() OVER (PARTITION BY seg, round(y / 8), round(x / 8) ORDER BY aim) = 1"""),
)
def a09(spark, sf):
    c = window_cover(spark, sf).where("c >= 0.02").withColumn("aim", F.explode(F.array(*[F.lit(a) for a in AIMS])))
    best = F.min_by(F.struct("y", "x", "c"), F.struct(F.abs(F.col("c") - F.col("aim")), "y", "x"))
    w = c.groupBy("seg", "aim").agg(best.alias("b"))
    w = w.select("seg", "aim", F.round(F.col("b.y") / 8).cast("int").alias("cy"), F.round(F.col("b.x") / 8).cast("int").alias("cx"), F.col("b.c").alias("cover"))
    return w.groupBy("seg", "cy", "cx").agg(F.min_by(F.struct("aim", "cover"), "aim").alias("b")).select("seg", "b.aim", "cy", "cx", "b.cover")


@query(
    "a10_listing",
    """SELECT regexp_extract(url, '^https?://([^/?#]+/[^/?#]*)', 1) AS prefix, count(*) AS keys, CAST(sum(length(html)) AS BIGINT) AS chars
FROM pages GROUP BY 1""",
)
def a10(spark, sf):
    prefix = F.regexp_extract("url", "^https?://([^/?#]+/[^/?#]*)", 1)
    return grids.table(spark, sf, "pages").groupBy(prefix.alias("prefix")).agg(
        F.count(F.lit(1)).alias("keys"), F.sum(F.length("html").cast("long")).alias("chars")
    )


@query(
    "a11_finest_volume",
    "SELECT o_custkey AS seg, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS vol, min(o_totalprice) AS um FROM orders GROUP BY o_custkey",
)
def a11(spark, sf):
    o = grids.table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("seg")).agg(
        F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("vol"), F.min("o_totalprice").alias("um")
    )


@query(
    "a12_tiered_source",
    """WITH cache AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
seed AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT c_custkey AS k, coalesce(cache.v, seed.v, c_acctbal) AS v,
  CASE WHEN cache.v IS NOT NULL THEN 'cache' WHEN seed.v IS NOT NULL THEN 'seed' ELSE 'rebuild' END AS tier
FROM customer LEFT JOIN cache ON cache.k = c_custkey LEFT JOIN seed ON seed.k = c_custkey""",
)
def a12(spark, sf):
    # both tiers come out of one aggregation, so the big side is shuffled once
    status = lambda s: F.max(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    tiers = grids.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(status("F").alias("cache"), status("O").alias("seed"))
    c = grids.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    tier = F.when(F.col("cache").isNotNull(), "cache").when(F.col("seed").isNotNull(), "seed").otherwise("rebuild")
    return c.join(tiers, "k", "left").select("k", F.coalesce("cache", "seed", "c_acctbal").alias("v"), tier.alias("tier"))


@query(
    "a13_true_scale",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p_size % 4 > 0 THEN p_size / 4.0::DOUBLE END AS true_um,
  coalesce(CASE WHEN p_size % 4 > 0 THEN p_size / 4.0::DOUBLE END, l_quantity) AS um, p_size % 4 = 0 AS fell_back
FROM lineitem JOIN part ON p_partkey = l_partkey""",
)
def a13(spark, sf):
    """Measured scale where metadata has one; a missing one is reported, never stored."""
    meta = grids.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 4 > 0, F.col("p_size") / 4.0).alias("true_um"))
    li = grids.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return li.join(meta, li.l_partkey == meta.p_partkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "true_um", F.coalesce("true_um", "l_quantity").alias("um"), F.col("true_um").isNull().alias("fell_back")
    )


@query(
    "a14_map_catalog",
    f"""WITH {STEMS}, m AS (SELECT f.brand, base, arg_max(stem, (length(stem), stem)) AS stem FROM files f
  JOIN stems s ON s.brand = f.brand AND contains(base, stem) GROUP BY ALL),
n AS (SELECT brand, stem, regexp_replace(regexp_replace(regexp_replace(substr(base, length(stem) + 2), '\\.(jpg|tif)$', ''),
  '-ds[0-9]+$', ''), '-tile[0-9]+-stride[0-9]+$', '') AS model, base FROM m)
SELECT brand, stem AS volume, count(*) AS n_maps, string_agg(CASE WHEN model = '' THEN 'unnamed' ELSE model END || '=' || base, ';' ORDER BY model, base) AS maps
FROM n GROUP BY ALL""",
)
def a14(spark, sf):
    stems, names = stems_and_files(spark, sf)
    hit = catalog.longest_stem(names, stems, ["brand"], "base", "stem")
    hit = hit.withColumn("model", S.model_name(F.col("base"), F.col("stem")))
    nested = catalog.nested_maps(hit, ["brand", "stem"], "model", "base")
    text = F.array_join(F.transform("maps", lambda m: F.concat(m["model"], F.lit("="), m["url"])), ";")
    return nested.select("brand", F.col("stem").alias("volume"), F.size("maps").cast("long").alias("n_maps"), text.alias("maps"))


@query(
    "a15_model_name",
    f"""WITH {STEMS}, t AS (SELECT DISTINCT base, regexp_replace(regexp_replace(regexp_replace(substr(base, instr(base, '-') + 1), '\\.(jpg|tif)$', ''),
  '-ds[0-9]+$', ''), '-tile[0-9]+-stride[0-9]+$', '') AS m FROM files)
SELECT base, CASE WHEN m = '' THEN 'unnamed' ELSE m END AS model FROM t""",
)
def a15(spark, sf):
    _, names = stems_and_files(spark, sf)
    return names.select("base", S.model_name(F.col("base"), F.substring_index("base", "-", 1)).alias("model")).distinct()


@query(
    "a16_unique_ids",
    """SELECT s_suppkey, CASE WHEN s_nationkey = 3 AND s_suppkey % 2 = 0 THEN 'legacy-' || s_suppkey ELSE s_nationkey || '-' || right(s_name, 9)
  || CASE WHEN s_acctbal < 0 THEN '-L1' ELSE '' END END AS id, s_nationkey <> 15 AS later FROM supplier""",
)
def a16(spark, sf):
    legacy = (F.col("s_nationkey") == 3) & (F.col("s_suppkey") % 2 == 0)
    plain = F.concat(F.col("s_nationkey").cast("string"), F.lit("-"), F.expr("right(s_name, 9)"), F.when(F.col("s_acctbal") < 0, "-L1").otherwise(""))
    rows = grids.table(spark, sf, "supplier").select(
        "s_suppkey", F.when(legacy, F.concat(F.lit("legacy-"), F.col("s_suppkey").cast("string"))).otherwise(plain).alias("id"),
        (F.col("s_nationkey") != 15).alias("later"),
    )
    return catalog.assert_unique(rows, "id").orderBy("later", "id").select("s_suppkey", "id", "later")


@query(
    "a17_append_new",
    """SELECT p_partkey AS id, 'held' AS src FROM part WHERE p_size < 25 UNION ALL
SELECT DISTINCT l_partkey, 'new' FROM lineitem WHERE l_quantity > 45 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)""",
)
def a17(spark, sf):
    held = grids.table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("id"), F.lit("held").alias("src"))
    extra = grids.table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"), F.lit("new").alias("src")).distinct()
    return catalog.append_new(held, extra, "id")


@query(
    "a18_point_lookup",
    "SELECT p.page_id, p.url FROM pages p JOIN (SELECT max(url) AS url FROM pages GROUP BY page_id % 10) w USING (url)",
)
def a18(spark, sf):
    pages = grids.table(spark, sf, "pages").select("page_id", "url")
    wanted = pages.groupBy(F.col("page_id") % 10).agg(F.max("url").alias("url")).select("url").distinct()
    return pages.join(wanted, "url").select("page_id", "url")




@query(
    "a19_mesh_load",
    with_plane(" SELECT seg, y AS r, x AS c, CAST(a * 10 AS DOUBLE) AS px, CAST(b * 20 AS DOUBLE) AS py, CAST(n * 3 AS DOUBLE) AS pz FROM plane WHERE n > 0"),
)
def a19(spark, sf):
    """Three axis rasters, stored one after the other, become one row per mesh cell."""
    on = grids.plane(spark, sf).where("n > 0")
    raster = lambda ax, c, k: on.select("seg", F.col("y").alias("r"), F.col("x").alias("c"), F.lit(ax).alias("ax"), (F.col(c) * k).cast("double").alias("v"))
    every = raster("x", "a", 10).unionByName(raster("y", "b", 20)).unionByName(raster("z", "n", 3))
    pick = lambda ax: F.max(F.when(F.col("ax") == ax, F.col("v"))).alias(f"p{ax}")
    return every.groupBy("seg", "r", "c").agg(pick("x"), pick("y"), pick("z"))


@query(
    "a20_layout_probe",
    """SELECT o_custkey AS seg, coalesce(max(o_orderkey) FILTER (o_orderpriority = '1-URGENT'), max(o_orderkey) FILTER (o_orderpriority = '2-HIGH'),
  max(o_orderkey) FILTER (o_orderpriority = '5-LOW')) AS pre FROM orders GROUP BY o_custkey""",
)
def a20(spark, sf):
    at = lambda p: F.max(F.when(F.col("o_orderpriority") == p, F.col("o_orderkey")))
    return grids.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("seg")).agg(
        F.coalesce(at("1-URGENT"), at("2-HIGH"), at("5-LOW")).alias("pre")
    )


@query(
    "a21_aligned_crop",
    with_plane("""
, c AS MATERIALIZED (SELECT s.seg, CAST(i.range AS INT) AS y, CAST(j.range AS INT) AS x, coalesce(p.b, 0) AS v
  FROM (SELECT DISTINCT seg FROM plane) s CROSS JOIN range(16) i CROSS JOIN range(16) j LEFT JOIN plane p ON p.seg = s.seg AND p.y = i.range + 54 AND p.x = j.range + 8),
o AS (SELECT seg, oy.range AS oy, ox.range AS ox, least(15, greatest(0, (oy.range + 0.5) / 2 - 0.5))::DOUBLE AS sy, least(15, greatest(0, (ox.range + 0.5) / 2 - 0.5))::DOUBLE AS sx
  FROM (SELECT DISTINCT seg FROM c) CROSS JOIN range(32) oy CROSS JOIN range(32) ox),
k AS MATERIALIZED (SELECT seg, oy, ox, least(15, CAST(floor(sy) AS INT) + i) AS y, least(15, CAST(floor(sx) AS INT) + j) AS x,
  (CASE WHEN i = 1 THEN sy - floor(sy) ELSE 1 - sy + floor(sy) END) * (CASE WHEN j = 1 THEN sx - floor(sx) ELSE 1 - sx + floor(sx) END) AS w
  FROM o CROSS JOIN (VALUES (0), (1)) u(i) CROSS JOIN (VALUES (0), (1)) v(j))
SELECT seg, CAST(oy AS INTEGER) AS oy, CAST(ox AS INTEGER) AS ox, round(sum(w * v), 5) AS v FROM k JOIN c USING (seg, y, x) GROUP BY ALL"""),
)
def a21(spark, sf):
    """Crop located through the measured scale, zero-padded, resized to twice the size."""
    n, y0, x0 = 16, 54, 8
    df = grids.plane(spark, sf)
    ax = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    frame = grids.segments(spark, sf).withColumn("y", ax(n)).withColumn("x", ax(n))
    src = df.select("seg", (F.col("y") - y0).alias("y"), (F.col("x") - x0).alias("x"), "b")
    # Spark takes the frame, and the plane, for as small as the segments they are made from: never broadcast
    crop = frame.hint("merge").join(src.hint("merge"), ["seg", "y", "x"], "left").select(
        "seg", F.lit(n).alias("h"), F.lit(n).alias("w"), "y", "x", F.coalesce("b", F.lit(0)).alias("v")
    )
    out = crop.select("seg", "h", "w").distinct().withColumn("oy", ax(2 * n)).withColumn("ox", ax(2 * n))
    pts = out.withColumns({"sy": (F.col("oy") + 0.5) / 2 - 0.5, "sx": (F.col("ox") + 0.5) / 2 - 0.5})
    return rounded(fields.bilinear(pts, crop, "v").select("seg", "oy", "ox", F.col("value").alias("v")), 5)


@query(
    "a22_paired_maps",
    """SELECT l_partkey AS seg, min(l_orderkey) FILTER (l_linestatus = 'F') AS fine, min(l_orderkey) FILTER (l_linestatus = 'O') AS coarse
FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 5)
GROUP BY l_partkey HAVING count(DISTINCT l_linestatus) = 2""",
)
def a22(spark, sf):
    held = grids.table(spark, sf, "part").where("p_size < 5").select(F.col("p_partkey").alias("l_partkey"))
    li = grids.table(spark, sf, "lineitem").join(held, "l_partkey", "left_anti")
    at = lambda s: F.min(F.when(F.col("l_linestatus") == s, F.col("l_orderkey")))
    pairs = li.groupBy(F.col("l_partkey").alias("seg")).agg(at("F").alias("fine"), at("O").alias("coarse"))
    return pairs.where("fine IS NOT NULL AND coarse IS NOT NULL")


@query(
    "a23_image_half",
    with_volume("""
, l AS (SELECT DISTINCT seg, z // 8 AS cz, y // 8 AS cy, x // 8 AS cx FROM volume WHERE v > 245)
SELECT v.seg, CAST(sum(v) AS BIGINT) AS mass, count(*) FILTER (v > 0) AS cells FROM volume v
JOIN l ON l.seg = v.seg AND l.cz = v.z // 8 AND l.cy = v.y // 8 AND l.cx = v.x // 8 GROUP BY v.seg"""),
)
def a23(spark, sf):
    """Image chunks under the chunks a label occupies."""
    vol = grids.volume(spark, sf)
    at = lambda c: F.floor(F.col(c) / 8).cast("int")
    label = vol.where("v > 245").select("seg", at("z").alias("cz"), at("y").alias("cy"), at("x").alias("cx")).distinct()
    image = spatial.chunked(vol, *CHUNK).join(label, ["seg", "cz", "cy", "cx"])
    cells = chunkstore.voxels(image.select(F.col("seg").alias("vol"), F.lit(0).alias("level"), "cz", "cy", "cx", "data"), SHAPE, CHUNK)
    return cells.groupBy(F.col("vol").alias("seg")).agg(F.sum("v").alias("mass"), F.count_if(F.col("v") > 0).alias("cells"))


@query(
    "a24_merge_upsert",
    """WITH old AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
new AS (SELECT o_custkey AS k, min(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT coalesce(new.k, old.k) AS k, coalesce(new.v, old.v) AS v FROM old FULL JOIN new ON old.k = new.k""",
)
def a24(spark, sf):
    o = grids.table(spark, sf, "orders")
    old = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    new = o.where("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(F.min("o_totalprice").alias("v"))
    return catalog.upsert(old, new, ["k"], ["v"])


@query(
    "a25_jsonl_tolerant",
    """SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k,
  event_id % 13 = 0 AS bad FROM events""",
)
def a25(spark, sf):
    """JSON lines appended as text and read back; broken lines are kept and marked."""
    path = scratch(spark, "log") + "/log"
    e = grids.table(spark, sf, "events")
    broken = F.when(F.col("event_id") % 13 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    e.select(F.concat_ws("\t", F.col("event_id").cast("string"), broken)).write.mode("append").text(path)
    parsed = F.from_json(F.substring_index("value", "\t", -1), "k int, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return spark.read.text(path).select(
        F.substring_index("value", "\t", 1).cast("long").alias("event_id"), parsed.alias("j")
    ).select("event_id", F.when(F.col("j._corrupt").isNull(), F.col("j.k")).alias("k"), F.col("j._corrupt").isNotNull().alias("bad"))


_TAGS = [(256, 4, 16), (257, 4, 16), (258, 3, 8), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, 16), (279, 4, 256)]


def _ifd() -> str:
    import struct

    out = struct.pack("<H", len(_TAGS))
    for tag, kind, value in _TAGS:
        out += struct.pack("<HHI", tag, kind, 1) + (struct.pack("<HH", value, 0) if kind == 3 else struct.pack("<I", value))
    return (out + struct.pack("<I", 0)).hex().upper()


TIFF_SQL = f"""t AS (SELECT seg, z, count(*) FILTER (v > 240) AS painted,
    md5(unhex('49492A0008010000' || string_agg(CASE WHEN v > 240 THEN 'FF' ELSE '00' END, '' ORDER BY y, x) || '{_ifd()}')) AS sum
  FROM volume GROUP BY ALL HAVING count(*) FILTER (v > 240) > 0)"""


def painted(spark, sf):
    ink = F.when(F.col("v") > 240, 255).otherwise(0)
    return files.label_layers(grids.volume(spark, sf).withColumn("ink", ink), ["seg"], "z", "ink")


@query("a27_gray_tiff", with_volume(f", {TIFF_SQL} SELECT seg, z, painted, sum FROM t"))
def a27(spark, sf):
    return painted(spark, sf).select("seg", "z", "painted", F.md5("tiff").alias("sum"))


@query(
    "a28_label_manifest",
    with_volume(f""", {TIFF_SQL} SELECT seg, '[' || string_agg('{{"layer":' || z || ',"file":"' || seg || '-layer' || lpad(z::VARCHAR, 3, '0')
  || '-ink.tif","painted":' || painted || '}}', ',' ORDER BY z) || ']' AS manifest FROM t GROUP BY seg"""),
)
def a28(spark, sf):
    return files.manifest(painted(spark, sf), ["seg"], "z")


@query(
    "a30_track_lines",
    with_plane("""
, t AS (SELECT seg, x AS track, y AS step, a, b, y FROM plane WHERE n >= 2)
SELECT seg, track, step, track || ',' || printf('%.4f', b * 0.018064) || ',' || printf('%.4f', y * 0.018064) || ',' || printf('%.4f', a * 0.018064) AS line FROM t"""),
)
def a30(spark, sf):
    t = grids.plane(spark, sf).where("n >= 2").select(
        "seg", F.col("x").alias("track"), F.col("y").alias("step"), F.col("b").alias("z"), "y", F.col("a").alias("x")
    )
    return files.track_lines(t, 0.018064).select("seg", "track", "step", "line")


@query(
    "a32_artifact_harvest",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)""",
)
def a32(spark, sf):
    held = grids.table(spark, sf, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("o_orderkey"))
    return grids.table(spark, sf, "orders").where("o_orderstatus = 'O'").select("o_orderkey").join(held, "o_orderkey", "left_anti")


@query(
    "a33_assemble_parts",
    """SELECT conv_id, count(*) AS parts, CAST(sum(length(text)) AS BIGINT) AS bytes, md5(string_agg(text, '' ORDER BY turn)) AS md5 FROM conversations GROUP BY conv_id""",
)
def a33(spark, sf):
    parts = grids.table(spark, sf, "conversations")
    out = files.assemble(parts, "conv_id", "turn", "text")
    return out.withColumn("bytes", F.col("bytes").cast("long"))


@query(
    "a34_attach_certificate",
    with_plane("""SELECT seg, '{"segment":"' || seg || '","cells":' || count(*) FILTER (n > 0) || ',"check":{"both":' || count(*) FILTER (a > 150 AND b > 150)
  || ',"verdict":"' || CASE WHEN count(*) FILTER (a > 150 AND b > 150) > 300 THEN 'corroborated' ELSE 'mixed' END || '"}}' AS attrs FROM plane GROUP BY seg"""),
)
def a34(spark, sf):
    """Sidecar attributes with a nested certificate added, nothing else changed."""
    g = grids.plane(spark, sf).groupBy("seg").agg(
        F.count_if(F.col("n") > 0).alias("cells"), F.count_if((F.col("a") > 150) & (F.col("b") > 150)).alias("both")
    )
    attrs = F.struct(F.col("seg").alias("segment"), "cells")
    check = F.struct("both", F.when(F.col("both") > 300, "corroborated").otherwise("mixed").alias("verdict"))
    return g.select("seg", F.to_json(attrs.withField("check", check)).alias("attrs"))
