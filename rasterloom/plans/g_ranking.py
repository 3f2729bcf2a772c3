"""Sorts, limits, top-k and set algebra over masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import axis, catalog, components, masks, quantiles, ranking, spatial
from rasterloom.plans.c_joins import comps
from rasterloom.plans.common import CALLED, r6, rounded, with_components
from rasterloom.plans.d_core import CODE_SQL, simple_code
from rasterloom.plans.f_windows import sbox
from rasterloom.plans.j_agreement import called_plane
from rasterloom.plans.registry import query, with_plane
from rasterloom.sources import grids


def _pick(i: int) -> str:
    avoid = " AND ".join(
        f"NOT EXISTS (SELECT 1 FROM p{j} q WHERE q.seg = p.seg AND p.y >= q.y - 8 AND p.y < q.y + 8 AND p.x >= q.x - 8 AND p.x < q.x + 8)"
        for j in range(1, i)
    )
    return f"""p{i} AS MATERIALIZED (SELECT seg, {i} AS place, y, x, v FROM j p {'WHERE ' + avoid if avoid else ''}
  QUALIFY row_number() OVER (PARTITION BY seg ORDER BY v DESC, y, x) = 1)"""


@query(
    "g01_separated_peaks",
    with_plane(f""", j AS MATERIALIZED (SELECT seg, y, x, least(a, b) AS v FROM plane WHERE n > 0), {_pick(1)}, {_pick(2)}, {_pick(3)}
SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3"""),
)
def g01(spark, sf):
    df = grids.plane(spark, sf).where("n > 0").withColumn("v", F.least("a", "b"))
    return ranking.separated_peaks(df, ["seg"], "v", 3, 8)


@query(
    "g02_largest_components",
    with_components("a > 150", """ SELECT seg, comp, area, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER
  (PARTITION BY seg ORDER BY area DESC, comp) AS place FROM shape) WHERE place <= 5"""),
)
def g02(spark, sf):
    s = components.shapes(comps(spark, sf), ["seg"])
    return ranking.top_per_group(s, ["seg"], [F.desc("area"), F.col("comp")], 5).select("seg", "comp", "area", "place")


@query(
    "g03_best_feature_sets",
    """SELECT array_to_string(list_sort(list_distinct([event_type, CASE event_id % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view'
  WHEN 2 THEN 'error' WHEN 3 THEN 'signup' ELSE 'purchase' END])), ',') AS features, max(value) AS best FROM events
GROUP BY 1 ORDER BY best DESC, features LIMIT 8""",
)
def g03(spark, sf):
    other = F.element_at(F.array(*[F.lit(t) for t in ("click", "view", "error", "signup", "purchase")]), (F.col("event_id") % 5 + 1).cast("int"))
    v = grids.table(spark, sf, "events").select(F.array("event_type", other).alias("items"), "value")
    return ranking.best_per_set(v, "items", "value", 8)


@query(
    "g04_densest_window",
    with_plane("""
, o AS (SELECT p.seg, p.y, p.x, p.y + dy.range AS ny, p.x + dx.range AS nx FROM plane p CROSS JOIN range(8) dy CROSS JOIN range(8) dx
  WHERE p.y <= 56 AND p.x <= 56),
s AS (SELECT o.seg, o.y, o.x, count(*) FILTER (q.a > 180) AS hot FROM o JOIN plane q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx GROUP BY ALL)
SELECT seg, y, x, hot FROM s QUALIFY row_number() OVER (PARTITION BY seg ORDER BY hot DESC, y, x) = 1"""),
)
def g04(spark, sf):
    df = grids.plane(spark, sf).withColumn("c", (F.col("a") > 180).cast("int"))
    s = axis.valid_box(df, {"hot": "c"}, 8)
    best = F.max_by(F.struct("y", "x", F.col("hot").cast("long").alias("hot")), F.struct("hot", -F.col("y"), -F.col("x")))
    return s.groupBy("seg").agg(best.alias("b")).select("seg", "b.*")


@query(
    "g05_round_robin",
    with_plane("""
, c AS (SELECT left(seg, 1) AS scroll, seg, avg(CAST(b > 150 AS INT)) AS cov FROM plane GROUP BY seg),
t AS (SELECT *, row_number() OVER (PARTITION BY scroll ORDER BY cov, seg) AS turn FROM c)
SELECT scroll, seg, CAST(turn AS INTEGER) AS turn, round(cov, 6) AS cov FROM t ORDER BY turn, scroll LIMIT 8"""),
)
def g05(spark, sf):
    cov = grids.plane(spark, sf).groupBy("seg").agg(F.avg(F.when(F.col("b") > 150, 1.0).otherwise(0.0)).alias("cov"))
    cov = cov.withColumn("scroll", F.substring("seg", 1, 1))
    picked = catalog.round_robin(cov, "scroll", [F.col("cov"), F.col("seg")], 8)
    return rounded(picked.select("scroll", "seg", "turn", "cov"))


@query(
    "g06_null_aware_sort",
    "SELECT p_brand, p_type, CAST(sum(CASE WHEN p_size % 3 > 0 THEN p_size END) AS BIGINT) AS live FROM part GROUP BY ALL ORDER BY coalesce(live, 0) DESC, p_brand, p_type",
)
def g06(spark, sf):
    live = F.sum(F.when(F.col("p_size") % 3 > 0, F.col("p_size")))
    g = grids.table(spark, sf, "part").groupBy("p_brand", "p_type").agg(live.alias("live"))
    return g.orderBy(F.coalesce("live", F.lit(0)).desc(), "p_brand", "p_type")


@query(
    "g07_consensus_labels",
    f"""WITH {CALLED}, hot AS MATERIALIZED (SELECT seg, y, x, CAST(ca OR cb AS INT) AS c, CAST(NOT m AS INT) AS off FROM called),
{sbox('k', 'hot', {'k': 'c'}, 2, agg='max')}, {sbox('e', 'hot', {'e': 'off'}, 1, agg='max')}
SELECT seg, y, x, CASE WHEN m AND k = 0 AND e = 0 THEN 2 WHEN ca AND cb AND m THEN 1 WHEN (ca <> cb) AND m THEN 3 ELSE 0 END AS code
FROM called JOIN k USING (seg, y, x) JOIN e USING (seg, y, x)""",
)
def g07(spark, sf):
    return consensus_labels(called_plane(spark, sf)).select("seg", "y", "x", "code")


def consensus_labels(called, keep_out: int = 2, edge: float = 2.0):
    """Label codes; blank cells clear both the call keep-out and the sheet edge."""
    df = called.withColumn("_c", (F.col("ca") | F.col("cb")).cast("int"))
    df = axis.square_extreme(df, {"_k": ("_c", keep_out)}, "max")
    df = spatial.distance_within(df, "m", 2, "_d")
    blank = F.col("m") & (F.col("_k") == 0) & (F.col("_d").isNull() | (F.col("_d") >= edge))
    return df.withColumn("code", masks.consensus_code(F.col("ca"), F.col("cb"), F.col("m"), blank))


@query(
    "g08_qc_blocks",
    with_plane(f""", c AS (SELECT seg, y // 4 AS "by", x // 4 AS bx, {CODE_SQL} AS code FROM plane)
SELECT seg, CAST("by" AS INTEGER) AS "by", CAST(bx AS INTEGER) AS bx, CASE WHEN bool_or(code = 3) AND NOT bool_or(code = 1) THEN 3
  WHEN bool_or(code = 1) THEN 1 WHEN bool_or(code = 2) THEN 2 ELSE 0 END AS base, bool_or(code = 3) AS disputed FROM c GROUP BY ALL"""),
)
def g08(spark, sf):
    coded = grids.plane(spark, sf).withColumn("code", simple_code())
    base, disputed = masks.block_code(F.col("code"))
    return masks.block_reduce(coded, ["seg"], 4, base=base, disputed=disputed)


@query(
    "g09_mask_algebra",
    with_plane("""SELECT seg, count(*) FILTER (a > 150 OR b > 150) AS either, count(*) FILTER (a > 150 AND b > 150) AS two,
  count(*) FILTER ((a > 150) <> (b > 150)) AS one, count(*) FILTER (a > 150 AND NOT b > 150) AS only_a FROM plane GROUP BY seg"""),
)
def g09(spark, sf):
    a, b = F.col("a") > 150, F.col("b") > 150
    return grids.plane(spark, sf).groupBy("seg").agg(
        F.count_if(a | b).alias("either"), F.count_if(a & b).alias("two"), F.count_if(a != b).alias("one"), F.count_if(a & ~b).alias("only_a")
    )


@query(
    "g09_key_set_algebra",
    """SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'
EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49""",
)
def g09_sets(spark, sf):
    li = grids.table(spark, sf, "lineitem")
    keys = lambda cond: li.where(cond).select("l_partkey")
    return keys("l_returnflag = 'A'").intersect(keys("l_returnflag = 'N'")).subtract(keys("l_quantity > 49"))


@query(
    "g10_leaderboard",
    """SELECT user_id, count(*) AS n, round(median(value), 6) AS med, round(max(value), 6) AS best,
  count(*) FILTER (event_type = 'purchase') AS confirmed FROM events GROUP BY user_id HAVING count(*) >= 5
ORDER BY med DESC, user_id LIMIT 20""",
)
def g10(spark, sf):
    e = grids.table(spark, sf, "events").select("user_id", "value", "event_type")
    g = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("best"), F.count_if(F.col("event_type") == "purchase").alias("confirmed")
    )
    g = g.join(quantiles.medians(e, ["user_id"], {"med": "value"}), "user_id")
    return rounded(g.where("n >= 5").orderBy(F.desc("med"), "user_id").limit(20))


@query(
    "g11_strata",
    """WITH m AS (SELECT p_brand AS scroll, median(p_size / 8.0) AS um FROM part GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY 15 / um >= 4.8 ORDER BY um, scroll) AS k FROM m)
SELECT scroll, round(um, 6) AS um, CASE WHEN 15 / um < 4.8 THEN 'blind' WHEN k <= 2 THEN 'tune' ELSE 'held' END AS role FROM r""",
)
def g11(spark, sf):
    t = grids.table(spark, sf, "part").select(F.col("p_brand").alias("scroll"), (F.col("p_size") / 8.0).alias("size"))
    return rounded(ranking.strata(t, "scroll", "size", 4.8, 2))


@query(
    "g12_seeded_sample",
    "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5('seed7' || p_partkey), p_partkey) <= 6",
)
def g12(spark, sf):
    p = grids.table(spark, sf, "part").select("p_brand", "p_partkey")
    return ranking.hashed_sample(p, ["p_brand"], "p_partkey", "seed7", 6)
