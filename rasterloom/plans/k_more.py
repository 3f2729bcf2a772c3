"""Further nulls, caches and catalog assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import catalog, controls, learn, nulls, quantiles, stats
from rasterloom.plans.a_sources import stored
from rasterloom.plans.c_joins import NN_ALL, STEMS, in_pairs, neighbour_pairs, stems_and_files
from rasterloom.plans.common import r6, rounded
from rasterloom.plans.d_depth import DSHIFTS
from rasterloom.plans.e_nulls import INJECT, planted_boxes
from rasterloom.plans.registry import query, with_plane, with_volume
from rasterloom.session import scratch
from rasterloom.sources import chunkstore, grids


@query(
    "a05_chunk_files",
    with_volume("""
, c AS (SELECT seg, 0 AS level, z, y, x, v FROM volume UNION ALL
  SELECT seg, 1, z, y // 2, x // 2, CAST(floor(avg(v)) AS INTEGER) FROM volume GROUP BY ALL)
SELECT seg AS vol, level, CAST(z // 8 AS INTEGER) AS cz, CAST(y // 8 AS INTEGER) AS cy, CAST(x // 8 AS INTEGER) AS cx, 512 AS size
FROM c GROUP BY ALL HAVING max(v) > 0"""),
)
def a05(spark, sf):
    """Written chunks: always full-sized, edge chunks padded, empty ones never stored."""
    ch = chunkstore.read_chunks(spark, stored(spark, sf))
    return ch.select("vol", "level", "cz", "cy", "cx", F.length("data").alias("size"))


@query(
    "a26_column_cache",
    with_volume("SELECT seg, z, count(*) FILTER (v > 0) AS solid, CAST(sum(v) AS BIGINT) AS mass FROM volume WHERE z BETWEEN 5 AND 15 GROUP BY ALL"),
)
def a26(spark, sf):
    """Stacks cached on shared storage, ordered so that readers skip layers they do not need."""
    path = scratch(spark, "cache") + "/stack"
    vol = grids.volume(spark, sf).select("seg", "z", "y", "x", "v")
    vol.repartitionByRange("seg", "y").sortWithinPartitions("seg", "z").write.parquet(path)
    cached = spark.read.schema("seg string, z int, y int, x int, v int").parquet(path).where(F.col("z").between(5, 15))
    return cached.groupBy("seg", "z").agg(F.count_if(F.col("v") > 0).alias("solid"), F.sum("v").alias("mass"))


@query(
    "e08_depth_label_null",
    with_volume(f"""
, l AS (SELECT seg, y, x, count(*) FILTER (v > 0) AS l FROM volume GROUP BY ALL),
q AS (SELECT seg, quantile_cont(l, 0.2) AS lo, quantile_cont(l, 0.8) AS hi FROM l GROUP BY seg),
k AS (SELECT seg, y, x, l >= hi AS ink, l <= lo AS bare FROM l JOIN q USING (seg)),
s AS (SELECT -1 AS k, 0 AS sy, 0 AS sx UNION ALL SELECT * FROM {nulls.sql_shifts(DSHIFTS)}),
m AS MATERIALIZED (SELECT seg, s.k, (y + sy) % 16 AS y, (x + sx) % 16 AS x, ink, bare FROM k CROSS JOIN s),
c AS (SELECT seg, k, z, (avg(v) FILTER (ink) - avg(v) FILTER (bare)) / stddev_pop(v) AS c FROM volume JOIN m USING (seg, y, x) GROUP BY ALL),
e AS (SELECT seg, z, max(c) FILTER (k = -1) AS v, quantile_cont(c, 0.025) FILTER (k >= 0) AS lo, quantile_cont(c, 0.975) FILTER (k >= 0) AS hi FROM c GROUP BY ALL)
SELECT seg, count(*) FILTER (v > hi OR v < lo) AS outside, round(max(CASE WHEN v > hi THEN v - hi WHEN v < lo THEN lo - v ELSE 0 END), 6) AS max_excursion FROM e GROUP BY seg"""),
)
def e08(spark, sf):
    """Layers whose contrast leaves the envelope of the rolled labels."""
    vol = grids.volume(spark, sf)
    label = vol.groupBy("seg", "y", "x", "h", "w").agg(F.count_if(F.col("v") > 0).alias("l"))
    cut = label.groupBy("seg").agg(quantiles.byte_percentile(F.col("l"), 20).alias("lo"), quantiles.byte_percentile(F.col("l"), 80).alias("hi"))
    m = label.join(cut, "seg").select("seg", "y", "x", "h", "w", (F.col("l") >= F.col("hi")).alias("ink"), (F.col("l") <= F.col("lo")).alias("bare"))
    c = learn.depth_contrast(vol, m, DSHIFTS)
    v, lo, hi = F.col("contrast"), F.col("null_lo"), F.col("null_hi")
    exc = F.when(v > hi, v - hi).when(v < lo, lo - v).otherwise(0.0)
    return c.groupBy("seg").agg(F.count_if((v > hi) | (v < lo)).alias("outside"), r6(F.max(exc), "max_excursion"))


NSHIFTS = nulls.draw_shifts(seed=11, n=8, lo=8, h=64, w=64)


@query(
    "e09_neighbour_auc_null",
    with_plane(f"""{NN_ALL},
q AS (SELECT left(seg, 1) AS flag, substr(seg, 2) AS blk, quantile_cont(b, 0.9) AS hi, quantile_cont(b, 0.5) AS lo FROM plane WHERE n > 0 GROUP BY 1, 2),
t AS MATERIALIZED (SELECT pair || nn.blk AS blk, left(pair, 1) || nn.blk AS seg, nn.r, nn.c, v.b >= hi AS pos
  FROM nn JOIN plane v ON v.seg = right(pair, 1) || nn.blk AND v.y = nn.qy // 2 AND v.x = nn.qx // 2
  JOIN q ON q.blk = nn.blk AND q.flag = right(pair, 1) WHERE v.b >= hi OR v.b < lo),
s AS (SELECT -1 AS k, 0 AS sy, 0 AS sx UNION ALL SELECT * FROM {nulls.sql_shifts(NSHIFTS)}),
d AS MATERIALIZED (SELECT blk, k, pos, seg, (r - sy + 64) % 64 AS y, (c - sx + 64) % 64 AS x FROM t CROSS JOIN s),
f AS (SELECT blk, k, pos, a AS f FROM d JOIN plane p ON p.seg = d.seg AND p.y = d.y AND p.x = d.x),
r AS (SELECT blk, k, pos, rank() OVER (PARTITION BY blk, k ORDER BY f) + (count(*) OVER (PARTITION BY blk, k, f) - 1) / 2.0 AS rk FROM f),
u AS (SELECT blk, k, round((sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 9) AS auc FROM r GROUP BY ALL),
o AS (SELECT blk, auc AS obs FROM u WHERE k = -1)
SELECT blk, round(obs, 6) AS auc, round(avg(auc), 6) AS null_mean, round((count(*) FILTER (auc >= obs) + 1) / (count(*) + 1), 6) AS p
FROM u JOIN o USING (blk) WHERE k >= 0 GROUP BY blk, obs"""),
)
def e09(spark, sf):
    """Neighbour-inked AUC against the sheet's own scores rolled out of register."""
    df = grids.plane(spark, sf).select(F.substring("seg", 1, 1).alias("flag"), F.expr("substring(seg, 2)").alias("blk"), "h", "w", "y", "x", "a", "b", "n")
    nn = neighbour_pairs(spark, sf).select("blk", "pair", "r", "c", F.floor(F.col("r_py") / 2).cast("int").alias("y"), F.floor(F.col("r_px") / 2).cast("int").alias("x"))
    other, pair = in_pairs(df, 2), ["blk", "pair"]
    cuts = other.where("n > 0").groupBy(*pair).agg(quantiles.byte_percentile(F.col("b"), 90).alias("hi"), quantiles.byte_percentile(F.col("b"), 50).alias("lo"))
    t = nn.join(other.select(*pair, "y", "x", "h", "w", "b"), [*pair, "y", "x"]).join(cuts, pair).where("b >= hi OR b < lo")
    t = t.withColumn("s", nulls.shift_column([(0, 0), *NSHIFTS])).select(
        *pair, F.col("s.k").alias("k"), (F.col("b") >= F.col("hi")).alias("pos"),
        F.pmod(F.col("r") - F.col("s.sy"), F.col("h")).alias("y"), F.pmod(F.col("c") - F.col("s.sx"), F.col("w")).alias("x"),
    )
    f = t.join(in_pairs(df, 1).select(*pair, "y", "x", "a"), [*pair, "y", "x"])
    f = f.withColumn("blk", F.concat("pair", "blk"))
    u = quantiles.auc(f, ["blk", "k"], "a", F.col("pos")).withColumn("auc", F.round("auc", 9))
    held = controls.against_draws(u, ["blk"], F.col("auc"))
    n = F.size("others")
    total = F.aggregate("others", F.lit(0.0), lambda s, v: s + v)
    return rounded(held.select("blk", F.col("obs").alias("auc"), (total / n).alias("null_mean"), ((F.col("p") * n + 1) / (n + 1)).alias("p")))


@query(
    "j20_sensitivity",
    with_plane(f""", {INJECT}, t AS (SELECT left(seg, 1) AS scroll, quantile_cont(m, 0.95) AS thr FROM bx WHERE alpha = 0 GROUP BY 1),
pw AS (SELECT left(seg, 1) AS scroll, alpha, count(*) FILTER (m > thr) / count(*) AS power, count(*) AS planted FROM bx JOIN t ON scroll = left(seg, 1) GROUP BY ALL)
SELECT scroll, alpha, planted, round(power, 6) AS power, (SELECT min(q.alpha) FROM pw q WHERE q.scroll = pw.scroll AND q.power >= 0.9) AS "limit" FROM pw"""),
)
def j20(spark, sf):
    """Planted letters recovered per strength over a whole scroll, and the weakest reliable one."""
    m = planted_boxes(spark, sf).withColumn("scroll", F.substring("seg", 1, 1)).persist()
    thr = quantiles.percentiles(m.where("alpha = 0"), ["scroll"], "m", {"thr": 95})
    power = stats.beside(m, thr, ["scroll"]).groupBy("scroll", "alpha").agg(
        F.count(F.lit(1)).alias("planted"), (F.count_if(F.col("m") > F.col("thr")) / F.count(F.lit(1))).alias("power")
    )
    return rounded(power.join(controls.detection_limit(power, ["scroll"]), "scroll"))


@query(
    "j21_catalog_build",
    f"""WITH {STEMS}, m AS (SELECT f.brand, base, arg_max(stem, (length(stem), stem)) AS stem FROM files f
  JOIN stems s ON s.brand = f.brand AND contains(base, stem) GROUP BY ALL),
e AS (SELECT brand, stem, count(*) AS maps FROM m GROUP BY ALL)
SELECT brand || '-' || stem AS id, brand, maps, brand <> 'Brand#1' AS later FROM e""",
)
def j21(spark, sf):
    """Catalog entries with unique ids, one scroll listed first."""
    stems, names = stems_and_files(spark, sf)
    hit = catalog.longest_stem(names, stems, ["brand"], "base", "stem")
    e = hit.groupBy("brand", "stem").agg(F.count(F.lit(1)).alias("maps"))
    e = e.select(F.concat_ws("-", "brand", "stem").alias("id"), "brand", "maps", (F.col("brand") != "Brand#1").alias("later"))
    return catalog.assert_unique(e, "id").orderBy("later", "brand", "id").select("id", "brand", "maps", "later")
