"""Predicates, gates and the read-cost model."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import agreement, gates, masks, quantiles
from rasterloom.plans.common import CALLED, r6, rounded
from rasterloom.plans.registry import query, with_plane, with_volume
from rasterloom.sources import grids

BUDGET = 64 * S.CHUNK_BYTES

VIEWS = """v AS (SELECT o_orderkey AS id, o_custkey * 37 % 30000 AS bx, o_orderkey * 53 % 40000 AS "by",
    CAST(floor(o_totalprice) AS BIGINT) % 20000 + 1 AS bw, CAST(floor(o_totalprice) AS BIGINT) % 15000 + 1 AS bh,
    o_orderkey % 6 AS level FROM orders),
l AS (SELECT CAST(range AS BIGINT) AS level, 1 << range AS f, CAST(ceil(30000 / (1 << range)) AS BIGINT) AS w,
    CAST(ceil(40000 / (1 << range)) AS BIGINT) AS h FROM range(6))"""


def _lvl(name: str, start: str, size: str, lim: str) -> str:
    a = f"greatest(0, least({lim} - 1, floor({start} / f + 0.5)))"
    b = f"greatest({a} + 1, least({lim}, {a} + floor({size} / f + 0.5)))"
    return f"(floor(({b} - 1) / 128) - floor({a} / 128) + 1)"


COST_SQL = f"CAST({_lvl('x', 'bx', 'bw', 'w')} * {_lvl('y', '"by"', 'bh', 'h')} AS BIGINT)"


def views(spark, sf):
    """View requests: a box in level-0 coordinates per order."""
    price = F.floor("o_totalprice")
    return grids.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_custkey") * 37 % 30000).alias("bx"),
        (F.col("o_orderkey") * 53 % 40000).alias("by"),
        (price % 20000 + 1).alias("bw"),
        (price % 15000 + 1).alias("bh"),
        (F.col("o_orderkey") % 6).alias("level"),
    )


def at_level(df, level):
    f = F.pow(F.lit(2), level).cast("long")
    return df.withColumns(
        {"f": f, "w": F.ceil(F.lit(30000) / f), "h": F.ceil(F.lit(40000) / f)}
    )


def chunks_read(chunk: int = 128):
    c = F.lit(chunk)
    return (
        S.span_chunks(F.col("bx"), F.col("bw"), F.col("f"), F.col("w"), c)
        * S.span_chunks(F.col("by"), F.col("bh"), F.col("f"), F.col("h"), c)
    ).cast("long")


@query(
    "b01_read_cost",
    f"""WITH {VIEWS} SELECT id, {COST_SQL} AS chunks, {COST_SQL} * 2097152 AS bytes
FROM v JOIN l USING (level)""",
)
def b01(spark, sf):
    return at_level(views(spark, sf), F.col("level")).select(
        "id", chunks_read().alias("chunks"), (chunks_read() * S.CHUNK_BYTES).alias("bytes")
    )


@query(
    "b02_fit_budget",
    """WITH p AS (SELECT p_partkey AS id, 1 << (p_size % 6) AS f, 100 + p_partkey * 7919 % 5000 AS w,
    100 + p_partkey * 6007 % 7000 AS h FROM part),
t AS (SELECT p.*, i.range AS i,
    CASE WHEN i.range = 0 THEN w * f * 1e0 ELSE greatest(128e0 * f, w * f / pow(2, i.range)) END AS bw,
    CASE WHEN i.range = 0 THEN h * f * 1e0 ELSE greatest(128e0 * f, h * f / pow(2, i.range)) END AS bh
  FROM p CROSS JOIN range(13) i),
u AS (SELECT *, w * f / 2e0 - bw / 2 AS bx, h * f / 2e0 - bh / 2 AS "by" FROM t),
c AS (SELECT *, """
    + COST_SQL
    + """ AS cost FROM u)
SELECT id, CAST(i AS INTEGER) AS i, bx, "by", bw, bh, cost FROM c WHERE cost <= 64 OR i = 12
QUALIFY row_number() OVER (PARTITION BY id ORDER BY i) = 1""",
)
def b02(spark, sf):
    key = F.col("p_partkey")
    levels = grids.table(spark, sf, "part").select(
        key.alias("id"), F.pow(F.lit(2), F.col("p_size") % 6).cast("long").alias("factor"),
        (100 + key * 7919 % 5000).alias("w"), (100 + key * 6007 % 7000).alias("h"),
        F.lit(128).alias("cw"), F.lit(128).alias("ch"),
    )

    def cost(df):
        f, c = F.col("factor"), F.col("cw")
        return (
            S.span_chunks(F.col("bx"), F.col("bw"), f, F.col("w"), c)
            * S.span_chunks(F.col("by"), F.col("bh"), f, F.col("h"), F.col("ch"))
        ).cast("long")

    return gates.fit_budget(levels, cost, 64)


@query(
    "b03_pick_level",
    f"""WITH {VIEWS}, c AS (SELECT id, l.level, {COST_SQL} AS cost FROM v CROSS JOIN l)
SELECT id, CAST(coalesce(min(level) FILTER (cost <= 64), max(level)) AS INTEGER) AS level FROM c GROUP BY id""",
)
def b03(spark, sf):
    every = views(spark, sf).drop("level").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(5))))
    priced = at_level(every, F.col("level")).select("id", "level", chunks_read().alias("cost"))
    fits = F.min(F.when(F.col("cost") <= 64, F.col("level")))
    return priced.groupBy("id").agg(F.coalesce(fits, F.max("level")).alias("level"))


@query(
    "b04_snap_z",
    """SELECT p_partkey AS id, CAST(greatest(0, least(108, floor(p_size * 7 / (1 + p_partkey % 4) + 0.5))) AS BIGINT) AS z
FROM part""",
)
def b04(spark, sf):
    return grids.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        S.snap_z(F.col("p_size") * 7, 1 + F.col("p_partkey") % 4, F.lit(109)).cast("long").alias("z"),
    )


@query("b05_sheet_mask", f"WITH {CALLED} SELECT seg, y, x, m FROM base")
def b05(spark, sf):
    s = agreement.sheet(grids.plane(spark, sf), {"sa": "a", "sb": "b"}, 3, 40.0)
    return s.select("seg", "y", "x", (F.col("sa") & F.col("sb")).alias("m"))


MESH = """mesh AS (SELECT seg, y AS r, x AS c, CASE WHEN n = 1 AND a % 7 = 0 THEN -1 ELSE a END AS mx,
  CASE WHEN n = 1 AND a % 7 = 0 THEN -1 ELSE b END AS my, CASE WHEN n = 1 AND a % 7 = 0 THEN -1 ELSE n END AS mz
  FROM plane)"""


def mesh_of(df):
    """A mesh whose missing cells carry either fill value."""
    lost = (F.col("n") == 1) & (F.col("a") % 7 == 0)
    put = lambda c: F.when(lost, -1).otherwise(F.col(c))
    return df.select(
        "seg", F.col("y").alias("r"), F.col("x").alias("c"), put("a").alias("mx"), put("b").alias("my"), put("n").alias("mz")
    )


def mesh_valid(x="mx", y="my", z="mz"):
    """A cell holds a position unless all axes carry the same fill value, -1 or 0."""
    allv = lambda v: (F.col(x) == v) & (F.col(y) == v) & (F.col(z) == v)
    return ~(allv(-1) | allv(0))


@query(
    "b06_mesh_validity",
    with_plane(f""", {MESH} SELECT seg, count(*) FILTER (NOT ((mx = -1 AND my = -1 AND mz = -1)
  OR (mx = 0 AND my = 0 AND mz = 0))) AS valid, count(*) FILTER (mx <> 0 OR my <> 0 OR mz <> 0) AS naive,
  count(*) FILTER (mx > 0 AND my > 0 AND mz > 0) AS positive FROM mesh GROUP BY seg"""),
)
def b06(spark, sf):
    m = mesh_of(grids.plane(spark, sf))
    any_of = (F.col("mx") != 0) | (F.col("my") != 0) | (F.col("mz") != 0)
    positive = (F.col("mx") > 0) & (F.col("my") > 0) & (F.col("mz") > 0)
    return m.groupBy("seg").agg(
        F.count_if(mesh_valid()).alias("valid"), F.count_if(any_of).alias("naive"), F.count_if(positive).alias("positive")
    )


@query(
    "b07_air_exclusion",
    with_volume("""SELECT seg, z, count(*) FILTER (v <> 0) AS solid, min(v) FILTER (v <> 0) AS lo,
  round(avg(v) FILTER (v <> 0), 6) AS mean FROM volume GROUP BY ALL"""),
)
def b07(spark, sf):
    solid = F.when(F.col("v") != 0, F.col("v"))
    return grids.volume(spark, sf).groupBy("seg", "z").agg(
        F.count(solid).alias("solid"), F.min(solid).alias("lo"), r6(F.avg(solid), "mean")
    )


@query(
    "b08_coverage_gate",
    with_plane("""SELECT seg, round(avg(CAST(b > 180 AS INT)), 6) AS cov FROM plane GROUP BY seg
HAVING avg(CAST(b > 180 AS INT)) > 0.02 AND avg(CAST(b > 180 AS INT)) < 0.9 AND stddev_pop(a) > 1e-9
  AND max(y) - min(y) + 1 >= 24 AND max(x) - min(x) + 1 >= 24"""),
)
def b08(spark, sf):
    span = lambda c: F.max(c) - F.min(c) + 1
    g = grids.plane(spark, sf).groupBy("seg").agg(
        F.avg(F.when(F.col("b") > 180, 1.0).otherwise(0.0)).alias("cov"), F.stddev_pop("a").alias("sd"),
        span("y").alias("rows"), span("x").alias("cols"),
    )
    ok = "cov > 0.02 AND cov < 0.9 AND sd > 1e-9 AND rows >= 24 AND cols >= 24"
    return g.where(ok).select("seg", r6("cov", "cov"))


HOT = """, q AS (SELECT seg, quantile_cont(a, 0.96) AS t, max(a) AS top FROM plane GROUP BY seg),
hot AS (SELECT p.*, (CASE WHEN top > t THEN a > t ELSE a >= t END) AND a >= 120 AS hot FROM plane p JOIN q USING (seg))"""


def hot_plane(spark, sf, floor=120):
    h = masks.above_percentile(grids.plane(spark, sf), ["seg"], "a", 96, "hot")
    return h.withColumn("hot", F.col("hot") & (F.col("a") >= floor))


@query("b09_hot_mask", with_plane(f"{HOT} SELECT seg, y, x, hot FROM hot"))
def b09(spark, sf):
    return hot_plane(spark, sf).select("seg", "y", "x", "hot")


@query("b10_differential_mask", with_plane(f"{HOT} SELECT seg, y, x FROM hot WHERE hot AND b < 160"))
def b10(spark, sf):
    return hot_plane(spark, sf).where(F.col("hot") & (F.col("b") < 160)).select("seg", "y", "x")


@query(
    "b12_resolvability",
    """SELECT p_partkey AS id, round(15 / (p_size / 4.0), 6) AS voxels,
  CASE WHEN 15 / (p_size / 4.0) >= 3 THEN 'resolved' WHEN 15 / (p_size / 4.0) >= 1.5 THEN 'marginal'
    ELSE 'unresolved' END AS verdict FROM part""",
)
def b12(spark, sf):
    um = F.col("p_size") / 4.0
    return grids.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), r6(S.voxels_through_ink(um), "voxels"), S.resolvability(um).alias("verdict")
    )


NAMES_SQL = """names AS (SELECT p_partkey AS id, (p_size % 9) * 0.5 + 0.5 AS um0,
    CASE WHEN p_partkey % 3 = 0 THEN '0.22' ELSE '0.4' END AS prop0, CAST(59 + p_partkey % 20 AS VARCHAR) AS kev0,
    CASE WHEN p_partkey % 11 = 0 THEN 'scan-' || p_partkey
      WHEN p_partkey % 7 = 0 THEN printf('%.1f', (p_size % 9) * 0.5 + 0.5) || 'um-' || (59 + p_partkey % 20) || 'keV-v.zarr'
      ELSE printf('%.1f', (p_size % 9) * 0.5 + 0.5) || 'um-' || CASE WHEN p_partkey % 3 = 0 THEN '0.22' ELSE '0.4' END
        || 'm-' || (59 + p_partkey % 20) || 'keV-v.zarr' END AS name,
    CASE WHEN p_partkey % 5 <> 0 THEN CAST(floor(p_retailprice) AS BIGINT) % 100 END AS cov,
    p_partkey * 13 % 256 AS p99 FROM part),
parsed AS (SELECT *, TRY_CAST(nullif(regexp_extract(name, '^([0-9.]+)um-', 1), '') AS DOUBLE) AS um,
    TRY_CAST(nullif(regexp_extract(name, '^[0-9.]+um-([0-9.]+)m-', 1), '') AS DOUBLE) AS prop,
    TRY_CAST(nullif(regexp_extract(name, '-([0-9]+)keV', 1), '') AS INTEGER) AS kev FROM names)"""


def scan_names(spark, sf):
    key, um = F.col("p_partkey"), F.format_string("%.1f", (F.col("p_size") % 9) * 0.5 + 0.5)
    kev = (59 + key % 20).cast("string")
    prop = F.when(key % 3 == 0, "0.22").otherwise("0.4")
    name = (
        F.when(key % 11 == 0, F.concat(F.lit("scan-"), key.cast("string")))
        .when(key % 7 == 0, F.concat(um, F.lit("um-"), kev, F.lit("keV-v.zarr")))
        .otherwise(F.concat(um, F.lit("um-"), prop, F.lit("m-"), kev, F.lit("keV-v.zarr")))
    )
    return grids.table(spark, sf, "part").select(
        key.alias("id"), name.alias("name"),
        F.when(key % 5 != 0, F.floor("p_retailprice") % 100).alias("cov"), (key * 13 % 256).alias("p99"),
    )


@query(
    "b13_silence_reason",
    f"""WITH {NAMES_SQL}
SELECT id, CASE WHEN um >= 3.4 THEN 'PHYSICS' WHEN cov < 70 THEN 'DATA' WHEN p99 >= 200 THEN 'INK FOUND'
  WHEN abs(prop - 0.22) > 0.03 OR abs(kev - 78) > 6 THEN 'PROTOCOL' ELSE 'UNRECOVERED' END AS verdict,
  concat_ws('; ', CASE WHEN abs(prop - 0.22) > 0.03 THEN prop || ' m propagation' END,
    CASE WHEN abs(kev - 78) > 6 THEN kev || ' keV' END) AS off FROM parsed""",
)
def b13(spark, sf):
    n = scan_names(spark, sf)
    um, prop, kev = S.protocol(F.col("name"))
    n = n.select("id", "cov", "p99", um.alias("um"), prop.alias("prop"), kev.alias("kev"))
    verdict, off = gates.silence_reason(*[F.col(c) for c in ("um", "prop", "kev", "cov", "p99")])
    return n.select("id", verdict.alias("verdict"), off.alias("off"))


@query(
    "b14_pair_failures",
    with_volume("""
, s AS (SELECT seg, stddev_pop(v) AS sd, avg(v) FILTER (v > 200) AS occ, avg(CAST(v = 0 AS INT)) AS blank FROM volume
  GROUP BY seg),
c AS (SELECT seg, count(*) AS cols, stddev_pop(cen) AS dsd, count(DISTINCT round_even(cen, 0)) AS lev
  FROM (SELECT seg, y, x, avg(z) AS cen FROM volume WHERE v > 240 GROUP BY ALL) GROUP BY seg)
SELECT seg, concat_ws(';', CASE WHEN sd < 75 THEN 'image is flat' END,
  CASE WHEN coalesce(cols, 0) < 60 THEN 'few ink columns' END,
  CASE WHEN coalesce(cols, 0) >= 60 AND (dsd < 4.5 OR lev < 3) THEN 'depth does not vary' END,
  CASE WHEN blank < 0.57 THEN 'not enough blank' END) AS reasons,
  CAST((sd < 75)::INT + (coalesce(cols, 0) < 60)::INT + coalesce(coalesce(cols, 0) >= 60 AND (dsd < 4.5 OR lev < 3), false)::INT
    + (blank < 0.57)::INT AS INTEGER) AS n FROM s LEFT JOIN c USING (seg)"""),
)
def b14(spark, sf):
    vol = grids.volume(spark, sf)
    s = vol.groupBy("seg").agg(
        F.stddev_pop("v").alias("sd"), (F.count_if(F.col("v") == 0) / F.count(F.lit(1))).alias("blank")
    )
    cen = vol.where("v > 240").groupBy("seg", "y", "x").agg(F.avg("z").alias("cen"))
    c = cen.groupBy("seg").agg(
        F.count(F.lit(1)).alias("cols"), F.stddev_pop("cen").alias("dsd"), F.count_distinct(F.rint("cen")).alias("lev")
    )
    cols = F.coalesce("cols", F.lit(0))
    failures = gates.pair_failures(
        {
            "image is flat": F.col("sd") < 75,
            "few ink columns": cols < 60,
            "depth does not vary": (cols >= 60) & ((F.col("dsd") < 4.5) | (F.col("lev") < 3)),
            "not enough blank": F.col("blank") < 0.57,
        }
    )
    return s.join(c, "seg", "left").select(
        "seg", F.concat_ws(";", failures).alias("reasons"), F.size(failures).alias("n")
    )


@query(
    "b15_certificate",
    with_plane("""
, t AS (SELECT seg, y // 16 AS ty, x // 16 AS tx, CASE WHEN (y // 16 + x // 16) % 2 = 0 THEN 'ink' ELSE 'blank' END AS kind,
    count(*) FILTER (a > 180) AS foot, count(*) FILTER (a > 180 AND b > 140) AS home, count(*) FILTER (a > 180 AND b > 160) AS other,
    count(*) FILTER (n > 0 AND a <= 180) AS inside, count(*) FILTER (n > 0 AND a <= 180 AND b < 150 ) AS quiet,
    count(*) FILTER (n > 0 AND a <= 180 AND b >= 110) AS two FROM plane GROUP BY ALL)
SELECT seg, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, CASE WHEN kind = 'ink' THEN
  CASE WHEN foot = 0 THEN 'no ink footprint in this crop' WHEN home / foot < 0.2 THEN 'not called by its own source'
    WHEN other / foot >= 0.5 THEN 'corroborated' WHEN other / foot >= 0.2 THEN 'mixed' ELSE 'not corroborated' END
  ELSE CASE WHEN inside = 0 THEN 'no shared sheet in this crop' WHEN quiet / inside >= 0.9 THEN 'both agree blank'
    WHEN two / inside >= 0.5 THEN 'both call ink' ELSE 'partially disputed' END END AS verdict FROM t"""),
)
def b15(spark, sf):
    a, b, on = F.col("a"), F.col("b"), F.col("n") > 0
    tiles = masks.block_reduce(
        grids.plane(spark, sf), ["seg"], 16,
        foot=F.count_if(a > 180), home=F.count_if((a > 180) & (b > 140)), other=F.count_if((a > 180) & (b > 160)),
        inside=F.count_if(on & (a <= 180)), quiet=F.count_if(on & (a <= 180) & (b < 150)),
        both=F.count_if(on & (a <= 180) & (b >= 110)),
    )
    kind = F.when((F.col("by") + F.col("bx")) % 2 == 0, "ink").otherwise("blank")
    part = lambda c, n: F.col(c) / F.nullif(F.col(n), F.lit(0))
    n = F.when(kind == "ink", F.col("foot")).otherwise(F.col("inside"))
    verdict = gates.certificate(
        kind, n, part("home", "foot"), part("other", "foot"), part("quiet", "inside"), part("both", "inside")
    )
    return tiles.select("seg", F.col("by").alias("ty"), F.col("bx").alias("tx"), verdict.alias("verdict"))


@query(
    "b16_span_verdict",
    with_volume("""
, p AS (SELECT seg, z, avg(v) AS m FROM volume GROUP BY ALL)
SELECT seg, CASE WHEN max(m) - min(m) >= 8 THEN 'SHEET' WHEN max(m) - min(m) >= 3 THEN 'marginal'
  ELSE 'compressed / no sheet' END AS verdict FROM p GROUP BY seg"""),
)
def b16(spark, sf):
    from rasterloom.operators import depth

    peak = depth.layer_peak(grids.volume(spark, sf))
    return peak.select("seg", gates.span_verdict(F.col("span")).alias("verdict"))


@query(
    "b17_stride_sample",
    with_plane("SELECT seg, y, x, a FROM plane WHERE (y * 64 + x) % 7 = 0 AND a <> 0"),
)
def b17(spark, sf):
    return (
        grids.plane(spark, sf)
        .where(((F.col("y") * F.col("w") + F.col("x")) % 7 == 0) & (F.col("a") != 0))
        .select("seg", "y", "x", "a")
    )


@query(
    "b18_url_state",
    """SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
  TRY_CAST(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS DOUBLE) AS page,
  CASE WHEN regexp_extract(url, '^https?://([^/?#]+)', 1) LIKE 'm.%' THEN 'sheet' END AS source,
  greatest(0, least(3, coalesce(TRY_CAST(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS DOUBLE), 0))) AS level
FROM pages""",
)
def b18(spark, sf):
    host = F.parse_url("url", F.lit("HOST"))
    page = F.parse_url("url", F.lit("QUERY"), F.lit("page")).try_cast("double")
    return grids.table(spark, sf, "pages").select(
        "page_id", host.alias("host"), page.alias("page"), F.when(host.startswith("m."), "sheet").alias("source"),
        S.clamp(F.coalesce(page, F.lit(0.0)), 0.0, 3.0).alias("level"),
    )


@query(
    "b19_parameters",
    with_plane("SELECT seg, count(*) AS n FROM plane WHERE a >= 120 AND b < 100 GROUP BY seg"),
)
def b19(spark, sf):
    sql = "SELECT seg, count(*) AS n FROM {plane} WHERE a >= :floor AND b < :cold GROUP BY seg"
    return spark.sql(sql, args={"floor": 120, "cold": 100}, plane=grids.plane(spark, sf))
