"""Multi-step analyses assembled from the operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from rasterloom.functions import scalars as S
from rasterloom.operators import axis, components, controls, depth, fields, gates, learn, masks
from rasterloom.operators import nulls, quantiles, ranking, search, spatial, stats
from rasterloom.plans.b_filters import NAMES_SQL, scan_names
from rasterloom.plans.c_joins import CHUNK, NN_ALL, in_pairs, neighbour_pairs, points
from rasterloom.plans.common import CALLED, ROLLED, SHIFTS, r6, rounded, with_components
from rasterloom.plans.d_core import AUC_SQL, CODE_SQL, SILENCE_SQL, silence, simple_code
from rasterloom.plans.d_depth import PEAK
from rasterloom.plans.e_nulls import PAIRED
from rasterloom.plans.f_fields import NORMALS, mesh_plane
from rasterloom.plans.f_windows import sbox
from rasterloom.plans.g_ranking import consensus_labels
from rasterloom.plans.j_agreement import called_plane
from rasterloom.plans.registry import BOTH, PLANE, query, with_plane, with_volume
from rasterloom.sources import grids

# -- conjunction search -------------------------------------------------------

SEARCH = f"""hot AS MATERIALIZED (SELECT seg, y, x, CAST(ca OR cb AS INT) AS c FROM called),
{sbox('k', 'hot', {'k': 'c'}, 1, agg='max')},
srch AS MATERIALIZED (SELECT * FROM called JOIN k USING (seg, y, x)),
st AS (SELECT seg, avg(a) AS ma, stddev_pop(a) AS sda, avg(b) AS mb, stddev_pop(b) AS sdb FROM srch WHERE m AND k = 0
  GROUP BY seg HAVING count(*) >= 100),
zz AS MATERIALIZED (SELECT s.seg, y, x, (a - ma) / sda AS za, (b - mb) / sdb AS zb FROM srch s JOIN st USING (seg) WHERE m AND k = 0)"""


def search_region(called, keep_out: int = 1, edge: float = 1.0):
    """Shared sheet clear of every call and of its own edge, z-scored against itself."""
    df = called.withColumn("_c", (F.col("ca") | F.col("cb")).cast("int"))
    df = axis.square_extreme(df, {"_k": ("_c", keep_out)}, "max")
    df = spatial.distance_within(df, "m", 2, "_d")
    df = df.withColumn("region", F.col("m") & (F.col("_k") == 0) & (F.col("_d").isNull() | (F.col("_d") >= edge)))
    big = df.groupBy("seg").agg(F.count_if("region").alias("_n")).where(F.col("_n") >= 100).select("seg")
    return stats.zscore(df.join(big, "seg", "left_semi"), ["seg"], {"za": "a", "zb": "b"}, where=F.col("region"))


@query(
    "j02_conjunction",
    f"""WITH {CALLED}, {SEARCH},
mv AS MATERIALIZED (SELECT seg, k, (y + sy + 64) % 64 AS y, (x + sx + 64) % 64 AS x, zb AS zr FROM zz CROSS JOIN {nulls.sql_shifts(PAIRED)}),
d AS (SELECT seg, k, max(least(za, zb)) AS obs, max(least(za, zr)) AS nul FROM mv JOIN zz USING (seg, y, x) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT seg, count(*) AS draws, (count(*) FILTER (nul >= obs) + 1) / (count(*) + 1) AS p, avg(nul) AS null_mean FROM d GROUP BY seg HAVING count(*) >= 12),
t AS (SELECT seg, max(least(za, zb)) AS top, count(*) AS search_px FROM zz GROUP BY seg)
SELECT seg, search_px, round(top, 6) AS top_z, draws, round(null_mean, 6) AS null_mean, round(p, 6) AS p FROM t JOIN n USING (seg)""",
)
def j02(spark, sf):
    z = search_region(called_plane(spark, sf)).persist()
    on = z.where("region")
    top = on.groupBy("seg").agg(F.max(F.least("za", "zb")).alias("top_z"), F.count(F.lit(1)).alias("search_px"))
    d = controls.paired_maximum(on, ["seg"], "za", "zb", "region", PAIRED, least=100)
    n = d.groupBy("seg").agg(
        F.count(F.lit(1)).alias("draws"), F.avg("null").alias("null_mean"), nulls.exceedance(F.col("null"), F.col("obs"), True).alias("p")
    ).where(F.col("draws") >= 12)
    return rounded(top.join(n, "seg"))


# -- differential hunt --------------------------------------------------------


def differential(spark, sf):
    df = grids.plane(spark, sf).persist()
    hot = masks.above_percentile(df, ["seg"], "a", 80, "hot").where(F.col("hot") & (F.col("a") >= 100) & (F.col("b") < 120))
    return df, hot.select("seg", "y", "x", "h", "w")


DIFF = """, q AS (SELECT seg, quantile_cont(a, 0.8) AS t, max(a) AS top FROM plane GROUP BY seg),
mask AS MATERIALIZED (SELECT p.seg, y, x FROM plane p JOIN q USING (seg) WHERE (CASE WHEN top > t THEN a > t ELSE a >= t END) AND a >= 100 AND b < 120)"""


@query(
    "j03_differential_hunt",
    with_components(
        "true",
        """, s AS (SELECT seg, count(*) AS n_sized, count(*) FILTER (fill BETWEEN 0.12 AND 0.60 AND aspect BETWEEN 0.35 AND 2.8) AS n_comps,
  count(*) FILTER (fill BETWEEN 0.12 AND 0.60 AND aspect BETWEEN 0.35 AND 2.8 AND EXISTS (SELECT 1 FROM plane p WHERE p.b > 220 AND p.seg = shape.seg
    AND pow(p.y - cy, 2) + pow(p.x - cx, 2) < 16)) AS near FROM shape WHERE area >= 2 AND greatest(y1 - y0, x1 - x0) BETWEEN 1 AND 12 GROUP BY seg)
SELECT seg, n_sized, n_comps, near, round(near / nullif(n_comps, 0), 3) AS adjacency, n_comps BETWEEN 2 AND 9 AS passes FROM s""",
        source=PLANE + DIFF,
        frm="mask",
    ),
)
def j03(spark, sf):
    """Hot where we score, cold where it was published, sized and stroke-like, near known text."""
    df, cells = differential(spark, sf)
    s = components.shapes(components.label(cells, ["seg"]), ["seg"], least=2)
    span = F.greatest(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))
    s = s.where(span.between(1, 12)).withColumn("stroke", components.strokelike()).persist()
    cand = s.where("stroke").select("seg", "comp", F.col("cy").alias("y"), F.col("cx").alias("x"), F.col("comp").alias("id"))
    near = spatial.has_within(cand, df.where("b > 220").select("seg", "y", "x"), ["seg"], ["y", "x"], 4.0).select("seg", "comp", F.lit(1).alias("hit"))
    g = s.join(near, ["seg", "comp"], "left").groupBy("seg").agg(
        F.count(F.lit(1)).alias("n_sized"), F.count_if("stroke").alias("n_comps"), F.count("hit").alias("near")
    )
    return g.select(
        "*", F.round(F.col("near") / F.nullif("n_comps", F.lit(0)), 3).alias("adjacency"), F.col("n_comps").between(2, 9).alias("passes")
    )


# -- letter-scale hunt --------------------------------------------------------

HUNT = """, o5 AS MATERIALIZED (SELECT p.seg, p.y, p.x, p.y + dy.range AS ny, p.x + dx.range AS nx FROM plane p CROSS JOIN range(5) dy CROSS JOIN range(5) dx
  WHERE p.y <= 59 AND p.x <= 59),
bm AS MATERIALIZED (SELECT o.seg, o.y, o.x, sum(q.a) / 25.0::DOUBLE AS bm, count(*) FILTER (q.b > 190) = 0 AS legal FROM o5 o
  JOIN plane q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx GROUP BY ALL),
thr AS (SELECT left(seg, 1) AS scroll, quantile_cont(bm, 0.95) AS thr FROM bm WHERE legal GROUP BY 1),
hit AS MATERIALIZED (SELECT seg, y, x FROM bm JOIN thr ON scroll = left(seg, 1) WHERE legal AND bm > thr)"""


@query(
    "j04_letter_scale_hunt",
    with_components(
        "true", " SELECT seg, count(*) AS clusters, max(area) AS biggest FROM shape WHERE area >= 2 GROUP BY seg", source=PLANE + HUNT, frm="hit"
    ),
)
def j04(spark, sf):
    """Letter-sized box means above the blank boxes' own tail, clustered."""
    df = grids.plane(spark, sf).withColumn("called", (F.col("b") > 190).cast("int"))
    box = axis.valid_box(df, {"s": "a", "c": "called"}, 5).select(
        "seg", F.substring("seg", 1, 1).alias("scroll"), "y", "x", (F.col("s") / 25.0).alias("bm"), (F.col("c") == 0).alias("legal")
    ).where("legal").persist()
    thr = quantiles.percentiles(box, ["scroll"], "bm", {"thr": 95})
    hot = stats.beside(box, thr, ["scroll"]).where("bm > thr")
    s = components.shapes(components.label(hot, ["seg"]), ["seg"], least=2)
    return s.groupBy("seg").agg(F.count(F.lit(1)).alias("clusters"), F.max("area").alias("biggest"))


# -- labels and certificates --------------------------------------------------

LABELS = f"""hot AS MATERIALIZED (SELECT seg, y, x, CAST(ca OR cb AS INT) AS c, CAST(NOT m AS INT) AS off FROM called),
{sbox('k', 'hot', {'k': 'c'}, 2, agg='max')}, {sbox('e', 'hot', {'e': 'off'}, 1, agg='max')},
code AS MATERIALIZED (SELECT seg, y, x, ca, cb, m, CASE WHEN m AND k = 0 AND e = 0 THEN 2 WHEN ca AND cb AND m THEN 1 WHEN (ca <> cb) AND m THEN 3 ELSE 0 END AS code
  FROM called JOIN k USING (seg, y, x) JOIN e USING (seg, y, x))"""


@query(
    "j05_label_index",
    f"""WITH {CALLED}, {LABELS} SELECT seg, count(*) FILTER (code = 0) AS unlabelled, count(*) FILTER (code = 1) AS ink, count(*) FILTER (code = 2) AS blank,
  count(*) FILTER (code = 3) AS disputed, round(count(*) FILTER (code = 1) * pow(18.064 / 1000, 2) / 100, 8) AS ink_cm2 FROM code GROUP BY seg""",
)
def j05(spark, sf):
    coded = consensus_labels(called_plane(spark, sf))
    n = masks.code_counts(coded, ["seg"], "code").select("seg", "unlabelled", "ink", "blank", "disputed")
    return n.withColumn("ink_cm2", F.round(F.col("ink") * (18.064 / 1000) ** 2 / 100, 8))


@query(
    "j06_pair_crops",
    with_volume("""
, r AS (SELECT seg, y, x, max(v) >= 240 AS ink, max(v) < 150 AS blank, arg_max(z, (v, -z)) AS depth FROM volume GROUP BY ALL),
o AS (SELECT p.seg, p.y, p.x, p.y + dy.range AS ny, p.x + dx.range AS nx FROM r p CROSS JOIN range(4) dy CROSS JOIN range(4) dx WHERE p.y <= 12 AND p.x <= 12),
c AS (SELECT o.seg, o.y, o.x, count(*) FILTER (q.ink) AS ink, count(*) FILTER (q.blank) AS blank FROM o JOIN r q ON q.seg = o.seg AND q.y = o.ny AND q.x = o.nx GROUP BY ALL),
i AS (SELECT seg, y, x, ink FROM c QUALIFY row_number() OVER (PARTITION BY seg ORDER BY ink DESC, y, x) = 1),
b AS (SELECT seg, y, x, blank FROM c QUALIFY row_number() OVER (PARTITION BY seg ORDER BY blank DESC, y, x) = 1)
SELECT i.seg, i.y AS ink_y, i.x AS ink_x, ink, CASE WHEN abs(b.y - i.y) + abs(b.x - i.x) > 2 THEN b.y END AS blank_y,
  CASE WHEN abs(b.y - i.y) + abs(b.x - i.x) > 2 THEN b.x END AS blank_x FROM i JOIN b USING (seg)"""),
)
def j06(spark, sf):
    """Densest ink crop and densest certified-blank crop of every stack."""
    vol = grids.volume(spark, sf)
    r = vol.groupBy("seg", "h", "w", "y", "x").agg((F.max("v") >= 240).cast("int").alias("ink"), (F.max("v") < 150).cast("int").alias("blank"))
    c = axis.valid_box(r, {"ni": "ink", "nb": "blank"}, 4)
    best = lambda n: F.max_by(F.struct("y", "x", F.col(n).cast("long").alias("n")), F.struct(n, -F.col("y"), -F.col("x")))
    p = c.groupBy("seg").agg(best("ni").alias("i"), best("nb").alias("b"))
    far = F.abs(F.col("b.y") - F.col("i.y")) + F.abs(F.col("b.x") - F.col("i.x")) > 2
    return p.select(
        "seg", F.col("i.y").alias("ink_y"), F.col("i.x").alias("ink_x"), F.col("i.n").alias("ink"),
        F.when(far, F.col("b.y")).alias("blank_y"), F.when(far, F.col("b.x")).alias("blank_x"),
    )


@query(
    "j07_pair_manifest",
    with_volume("""
, c AS (SELECT seg, y, x, avg(z) AS cen FROM volume WHERE v > 230 GROUP BY ALL),
k AS (SELECT seg, count(*) AS cols, stddev_pop(cen) AS sd, count(DISTINCT round_even(cen, 0)) AS lev FROM c GROUP BY seg),
b AS (SELECT seg, avg(CAST(v = 0 AS INT)) AS blank, stddev_pop(v) AS isd FROM volume GROUP BY seg)
SELECT seg, cols AS ink_columns, round(sd, 2) AS depth_sd, lev AS depth_levels, round(blank, 4) AS blank_frac FROM k JOIN b USING (seg)
WHERE cols >= 40 AND sd >= 1 AND lev >= 3 AND isd >= 3"""),
)
def j07(spark, sf):
    """Pairs that pass every check, with their measured figures."""
    vol = grids.volume(spark, sf)
    cen = vol.where("v > 230").groupBy("seg", "y", "x").agg(F.avg("z").alias("cen"))
    k = cen.groupBy("seg").agg(
        F.count(F.lit(1)).alias("ink_columns"), F.stddev_pop("cen").alias("sd"), F.count_distinct(F.rint("cen")).alias("depth_levels")
    )
    b = vol.groupBy("seg").agg((F.count_if(F.col("v") == 0) / F.count(F.lit(1))).alias("blank"), F.stddev_pop("v").alias("isd"))
    fails = gates.pair_failures(
        {"few columns": F.col("ink_columns") < 40, "projection": (F.col("sd") < 1) | (F.col("depth_levels") < 3), "flat": F.col("isd") < 3}
    )
    ok = k.join(b, "seg").where(F.size(fails) == 0)
    return ok.select("seg", "ink_columns", F.round("sd", 2).alias("depth_sd"), "depth_levels", F.round("blank", 4).alias("blank_frac"))


@query(
    "j08_pair_certificate",
    f"""WITH {CALLED},
t AS (SELECT seg, y // 8 AS ty, x // 8 AS tx, count(*) FILTER (a > 230) AS foot, count(*) FILTER (a > 230 AND ca) AS home, count(*) FILTER (a > 230 AND cb) AS other
  FROM called GROUP BY ALL)
SELECT seg, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, foot, round(home / nullif(foot, 0), 3) AS home, round(other / nullif(foot, 0), 3) AS other,
  CASE WHEN foot = 0 THEN 'no ink footprint in this crop' WHEN home / foot < 0.2 THEN 'not called by its own source' WHEN other / foot >= 0.5 THEN 'corroborated'
  WHEN other / foot >= 0.2 THEN 'mixed' ELSE 'not corroborated' END AS verdict FROM t""",
)
def j08(spark, sf):
    a, ca, cb = F.col("a") > 230, F.col("ca"), F.col("cb")
    t = masks.block_reduce(called_plane(spark, sf), ["seg"], 8, foot=F.count_if(a), home=F.count_if(a & ca), other=F.count_if(a & cb))
    part = lambda c: F.col(c) / F.nullif(F.col("foot"), F.lit(0))
    verdict = gates.certificate(F.lit("ink"), F.col("foot"), part("home"), part("other"), F.lit(0.0), F.lit(0.0))
    return t.select(
        "seg", F.col("by").alias("ty"), F.col("bx").alias("tx"), "foot", F.round(part("home"), 3).alias("home"),
        F.round(part("other"), 3).alias("other"), verdict.alias("verdict"),
    )


@query(
    "j09_work_queue",
    with_components(
        f"{CODE_SQL} = 3",
        """ SELECT seg, CAST(round_even(cy, 0) * 8 AS INTEGER) AS y, CAST(round_even(cx, 0) * 8 AS INTEGER) AS x, area, round(area * pow(18.064 / 1000, 2), 6) AS area_mm2
FROM shape QUALIFY row_number() OVER (PARTITION BY seg ORDER BY area DESC, comp) <= 12""",
    ),
)
def j09(spark, sf):
    """Largest disputed regions per sheet in full-resolution coordinates."""
    disputed = grids.plane(spark, sf).withColumn("code", simple_code()).where("code = 3")
    s = components.shapes(components.label(disputed, ["seg"]), ["seg"])
    top = ranking.top_per_group(s, ["seg"], [F.desc("area"), F.col("comp")], 12)
    at = lambda c: (F.rint(c) * 8).cast("int")
    return top.select("seg", at("cy").alias("y"), at("cx").alias("x"), "area", r6(F.col("area") * (18.064 / 1000) ** 2, "area_mm2"))


@query(
    "j10_silence_audit",
    f"""WITH {NAMES_SQL}, {PLANE}, {SILENCE_SQL},
k AS (SELECT row_number() OVER (ORDER BY seg) - 1 AS id, seg, p99 FROM sil)
SELECT seg, CASE WHEN um >= 3.4 THEN 'PHYSICS' WHEN k.p99 < 247 AND cov < 70 THEN 'DATA' WHEN k.p99 >= 247 THEN 'INK FOUND'
  WHEN abs(prop - 0.22) > 0.03 OR abs(kev - 78) > 6 THEN 'PROTOCOL' ELSE 'UNRECOVERED' END AS verdict
FROM k JOIN parsed USING (id)""",
)
def j10(spark, sf):
    """Why each silent map is silent; tile coverage only counts where the map is silent."""
    n = scan_names(spark, sf)
    um, prop, kev = S.protocol(F.col("name"))
    scans = n.select("id", "cov", um.alias("um"), prop.alias("prop"), kev.alias("kev"))
    s = silence(spark, sf)
    keyed = number_rows(s.select("seg", "p99"), "seg").withColumnRenamed("rn", "id")
    j = keyed.join(scans, "id")
    cov = F.when(F.col("p99") < 247, F.col("cov"))
    p99 = F.when(F.col("p99") >= 247, F.lit(255)).otherwise(F.lit(0))
    verdict, _ = gates.silence_reason(F.col("um"), F.col("prop"), F.col("kev"), cov, p99)
    return j.select("seg", verdict.alias("verdict"))


def number_rows(df, order: str):
    """0-based row numbers in ``order``: counts per range, then places inside each range."""
    # a prefix long enough for about a thousand rows per range, however many there are
    b = df.withColumn("_b", F.substring(order, 1, max(4, len(str(df.count() // 1000)) + 2)))
    sizes = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return b.withColumn("_i", inside).join(base, "_b").withColumn("rn", F.col("_base") + F.col("_i")).drop("_b", "_n", "_i", "_base")


@query(
    "j11_model_disagreement",
    with_plane(f"""
, q AS (SELECT seg, CAST(trunc(quantile_cont(a, 0.9)) AS INT) AS ta, CAST(trunc(quantile_cont(b, 0.9)) AS INT) AS tb FROM plane WHERE n > 0 GROUP BY seg),
c AS MATERIALIZED (SELECT p.seg, y, x, n > 0 AND a >= ta AS ca, n > 0 AND b >= tb AS cb FROM plane p JOIN q USING (seg)), {ROLLED},
dq AS MATERIALIZED (SELECT r.seg, r.k, r.y, r.x, q.cb FROM rolled r JOIN c q ON q.seg = r.seg AND q.y = r.py AND q.x = r.px),
j AS (SELECT p.seg, r.k, coalesce(count(*) FILTER (p.ca AND r.cb) / nullif(count(*) FILTER (p.ca OR r.cb), 0), 0) AS j
  FROM dq r JOIN c p ON p.seg = r.seg AND p.y = r.y AND p.x = r.x GROUP BY ALL),
o AS (SELECT seg, count(*) FILTER (ca AND cb) / nullif(count(*) FILTER (ca OR cb), 0) AS obs,
  round(100.0 * count(*) FILTER (ca AND cb) / greatest(count(*) FILTER (ca OR cb), 1), 1) AS agree_pct FROM c GROUP BY seg)
SELECT seg, round(obs, 6) AS jaccard, agree_pct, round(avg(j), 6) AS null_mean, round((count(*) FILTER (j >= obs) + 1) / (count(*) + 1), 6) AS p
FROM j JOIN o USING (seg) GROUP BY seg, obs, agree_pct"""),
)
def j11(spark, sf):
    """Two checkpoints of one sheet, each at its own integer top decile."""
    df = grids.plane(spark, sf).persist()
    on = F.col("n") > 0
    cut = lambda c: quantiles.byte_percentile(F.when(on, F.col(c)), 90).cast("int")
    cuts = df.groupBy("seg").agg(cut("a").alias("ta"), cut("b").alias("tb"))
    c = df.join(cuts, "seg").withColumns({"ca": on & (F.col("a") >= F.col("ta")), "cb": on & (F.col("b") >= F.col("tb"))})
    a, b = F.col("ca"), F.col("cb")
    obs = c.groupBy("seg").agg(
        stats.jaccard(a, b).alias("jaccard"), F.round(F.count_if(a & b) * 100.0 / F.greatest(F.count_if(a | b), F.lit(1)), 1).alias("agree_pct")
    )
    d = nulls.plain_overlap_null(c, ["seg"], a, b, SHIFTS).join(obs, "seg")
    return rounded(d.groupBy("seg", "jaccard", "agree_pct").agg(
        F.avg("null_j").alias("null_mean"), nulls.exceedance(F.col("null_j"), F.col("jaccard"), True).alias("p")
    ))


@query(
    "j12_seam_finder",
    with_plane(f"""{NN_ALL}, bb AS (SELECT flag, blk, min(py) AS y0, max(py) AS y1, min(px) AS x0, max(px) AS x1, count(*) AS body FROM pts GROUP BY ALL)
SELECT nn.blk, nn.pair, count(*) AS near, round(count(*) / any_value(a.body), 3) AS overlap, CASE WHEN count(*) / any_value(a.body) > 0.5 THEN 'duplicate' ELSE 'seam' END AS kind
FROM nn JOIN bb a ON a.flag = left(nn.pair, 1) AND a.blk = nn.blk JOIN bb b ON b.flag = right(nn.pair, 1) AND b.blk = nn.blk
WHERE a.y0 <= b.y1 + 4 AND b.y0 <= a.y1 + 4 AND a.x0 <= b.x1 + 4 AND b.x0 <= a.x1 + 4 GROUP BY nn.blk, nn.pair HAVING count(*) >= 20"""),
)
def j12(spark, sf):
    """Sheet pairs whose boxes overlap, by how much of one lies on the other."""
    p = points(spark, sf).persist()
    box = p.groupBy("flag", "blk").agg(
        F.min("py").alias("y0"), F.max("py").alias("y1"), F.min("px").alias("x0"), F.max("px").alias("x1"), F.count(F.lit(1)).alias("body")
    )
    a, b = in_pairs(box, 1), in_pairs(box, 2).drop("body")
    pairs = spatial.overlapping_boxes(a, b, ["blk", "pair"], size=64, slack=4).select("blk", "pair", "body")
    near = neighbour_pairs(spark, sf).groupBy("blk", "pair").agg(F.count(F.lit(1)).alias("near")).where("near >= 20")
    share = F.col("near") / F.col("body")
    return near.join(pairs, ["blk", "pair"]).select(
        "blk", "pair", "near", F.round(share, 3).alias("overlap"), F.when(share > 0.5, "duplicate").otherwise("seam").alias("kind")
    )


# -- searches over variants ---------------------------------------------------

VARIANTS = [(0, {"a": 1.0}), (1, {"a": 1.0, "n": -20.0}), (2, {"n": 40.0}), (3, {"a": 0.5, "n": 30.0}), (4, {"a": -1.0})]
_VS = ", ".join(f"({i}, {w.get('a', 0.0)}::DOUBLE, {w.get('n', 0.0)}::DOUBLE)" for i, w in VARIANTS)
BARS = {"tune": 0.1, "held": 0.3, "blank": 0.05, "final": 0.8}


def variant_scores(spark, sf):
    df = grids.plane(spark, sf).withColumn("scroll", F.substring("seg", 1, 1))
    long = search.variants_long(df, VARIANTS, ["a", "n"], ["scroll", "seg", "b"])
    return search.separation(long, ["scroll", "seg"], F.col("b") > 150)


VAR_SQL = f""", l AS (SELECT left(seg, 1) AS scroll, seg, b > 150 AS t, v.i AS variant, v.wa * a + v.wn * n AS s FROM plane CROSS JOIN (VALUES {_VS}) v(i, wa, wn)),
d AS MATERIALIZED (SELECT variant, scroll, seg, (avg(s) FILTER (t) - avg(s) FILTER (NOT t)) / nullif(stddev_pop(s), 0) AS d FROM l GROUP BY ALL)"""


@query(
    "j13_variant_funnel",
    with_plane(f"""{VAR_SQL},
m AS (SELECT variant, median(d) FILTER (scroll = 'A') AS tune, median(d) FILTER (scroll = 'N') AS held, median(d) FILTER (scroll = 'R') AS blank FROM d GROUP BY variant),
f AS (SELECT *, held - 0.5 * greatest(0, abs(blank) - 0.05) AS final FROM m)
SELECT variant, round(tune, 6) AS tune, round(held, 6) AS held, round(blank, 6) AS blank, round(final, 6) AS penalised,
  CASE WHEN tune < 0.1 THEN 'rejected' WHEN held < 0.3 THEN 'screened' WHEN final >= 0.8 THEN 'gated' ELSE 'tested' END AS stage FROM f"""),
)
def j13(spark, sf):
    d = variant_scores(spark, sf).persist()
    f = search.funnel(d.where("scroll = 'A'"), d.where("scroll = 'N'"), d.where("scroll = 'R'"), BARS)
    return rounded(f.select("variant", "tune", "held", "blank", "penalised", "stage"))


@query(
    "j14_falsification",
    with_plane(f"""{VAR_SQL},
w AS (SELECT variant, scroll, median(d) AS m FROM d GROUP BY ALL)
SELECT variant, round(min(m), 6) AS worst, count(*) AS scrolls, min(m) >= 0.3 AND count(*) >= 2 AS holds FROM w GROUP BY variant"""),
)
def j14(spark, sf):
    """A variant must hold on its worst scroll, not on average."""
    w = search.partial_signs(variant_scores(spark, sf), ["scroll"])
    return rounded(w.withColumn("holds", (F.col("worst") >= 0.3) & (F.col("scrolls") >= 2)))


@query(
    "j15_frozen_detector",
    with_plane(f""", {sbox('bg', 'plane', {'bg': 'a'}, 2)},
f AS (SELECT p.seg, avg(CAST(b > 150 AS INT)) AS cov, corr(a - bg, CAST(b > 150 AS INT)) AS r FROM plane p JOIN bg USING (seg, y, x) GROUP BY p.seg)
SELECT seg, round(cov, 6) AS cov, round(r, 6) AS r, CASE WHEN cov <= 0.03 OR cov >= 0.9 THEN 'coverage' ELSE 'ok' END AS status FROM f"""),
)
def j15(spark, sf):
    """One fixed detector, every segment, no tuning."""
    m = axis.box_mean(grids.plane(spark, sf), {"bg": ("a", 2)})
    t = F.when(F.col("b") > 150, 1.0).otherwise(0.0)
    g = m.groupBy("seg").agg(F.avg(t).alias("cov"), F.corr(F.col("a") - F.col("bg"), t).alias("r"))
    status = F.when((F.col("cov") <= 0.03) | (F.col("cov") >= 0.9), "coverage").otherwise("ok")
    return rounded(g.withColumn("status", status))


@query("j16_ensemble")
def j16(spark, sf):
    """Linear ensemble fitted on one scroll, scored by AUC on the others."""
    df = grids.plane(spark, sf).where("n > 0").withColumn("scroll", F.substring("seg", 1, 1))
    z = stats.zscore(df.withColumn("yy", F.col("y")), ["seg"], {"za": "a", "zn": "n", "zy": "yy"}).withColumn("ink", F.col("b") > 128).persist()
    w = {r.term: r.weight for r in learn.fit_logistic(z.where("scroll = 'A'"), ["za", "zn", "zy"], "ink").collect()}
    score = F.lit(w["intercept"])
    for c in ("za", "zn", "zy"):
        score = score + F.col(c) * w[c]
    held = z.where("scroll <> 'A'").withColumn("score", F.round(score, 9))
    u = quantiles.auc(held, ["seg"], "score", F.col("ink"), least=50)
    return rounded(u.withColumn("auc", quantiles.folded(F.col("auc"))))


@query(
    "j17_depth_triage",
    with_volume(f"""{PEAK},
c AS (SELECT seg, y // 4 AS cy, x // 4 AS cx, count(*) AS pts, max(v) AS top FROM volume WHERE v > 0 GROUP BY ALL),
l AS (SELECT seg, sum(pts) FILTER (top > 200) / sum(pts) AS live FROM c GROUP BY seg)
SELECT seg, round(live, 6) AS livefrac, round(span, 6) AS span, CASE WHEN span >= 8 THEN 'SHEET' WHEN span >= 3 THEN 'marginal' ELSE 'compressed / no sheet' END AS verdict
FROM l JOIN pk USING (seg) WHERE live > 0.3"""),
)
def j17(spark, sf):
    """Depth contrast of the segments whose chunks are mostly written."""
    vol = grids.volume(spark, sf)
    at = lambda c: F.floor(F.col(c) / 4)
    per = vol.where("v > 0").groupBy("seg", at("y"), at("x")).agg(F.count(F.lit(1)).alias("pts"), F.max("v").alias("top"))
    live = per.groupBy("seg").agg((F.sum(F.when(F.col("top") > 200, F.col("pts"))) / F.sum("pts")).alias("livefrac")).where("livefrac > 0.3")
    j = live.join(depth.layer_peak(vol), "seg")
    return rounded(j.select("seg", "livefrac", "span", gates.span_verdict(F.col("span")).alias("verdict")))


BOTH_NORMALS = f"WITH {BOTH}, {NORMALS}"


@query(
    "j18_render_sheet",
    f"""{BOTH_NORMALS},
g AS MATERIALIZED (SELECT seg, y, x, CASE WHEN inn THEN nx ELSE mx / l END AS nx, CASE WHEN inn THEN ny ELSE my / l END AS ny, CASE WHEN inn THEN nz ELSE mz / l END AS nz
  FROM (SELECT *, sqrt(mx * mx + my * my + mz * mz) AS l FROM u JOIN sm USING (seg, y, x)) WHERE valid AND (inn OR l > 1e-6)),
p AS MATERIALIZED (SELECT seg, y, x, CAST(k.range AS INTEGER) AS k, CAST(round_even(10 + round(nz, 9) * (k.range - 3), 0) AS INT) AS vz,
  CAST(round_even(y / 4.0::DOUBLE + round(ny, 9) * (k.range - 3), 0) AS INT) AS vy, CAST(round_even(x / 4.0::DOUBLE + round(nx, 9) * (k.range - 3), 0) AS INT) AS vx FROM g CROSS JOIN range(7) k)
SELECT p.seg, k, count(*) AS pts, CAST(sum(coalesce(v, 0)) AS BIGINT) AS mass FROM p LEFT JOIN volume q ON q.seg = p.seg AND q.z = vz AND q.y = vy AND q.x = vx GROUP BY ALL""",
)
def j18(spark, sf):
    """Layers sampled along the mesh normals out of the chunked volume."""
    n = fields.mesh_normals(mesh_plane(spark, sf), spread=3).where(F.col("valid") & (F.abs("nx") + F.abs("ny") + F.abs("nz") > 0.5))
    pts = n.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6))))
    at = lambda base, c: base + F.round(c, 9) * (F.col("k") - 3)
    pts = pts.select(
        "seg", "k", at(F.lit(10.0), "nz").alias("pz"), at(F.col("y") / 4.0, "ny").alias("py"), at(F.col("x") / 4.0, "nx").alias("px")
    )
    got = spatial.gather(pts, spatial.chunked(grids.volume(spark, sf), *CHUNK), *CHUNK)
    return got.groupBy("seg", "k").agg(F.count(F.lit(1)).alias("pts"), F.sum("v").cast("long").alias("mass"))


@query(
    "j22_sandwich",
    with_plane(f"""{NN_ALL},
s AS (SELECT nn.blk, pair, a.a AS mine, v.b AS nb FROM nn JOIN plane a ON a.seg = left(pair, 1) || nn.blk AND a.y = nn.r AND a.x = nn.c
  JOIN plane v ON v.seg = right(pair, 1) || nn.blk AND v.y = nn.qy // 2 AND v.x = nn.qx // 2),
q AS (SELECT left(seg, 1) AS flag, substr(seg, 2) AS blk, quantile_cont(b, 0.9) AS hi, quantile_cont(b, 0.5) AS lo FROM plane WHERE n > 0 GROUP BY 1, 2),
scored AS (SELECT pair || s.blk AS seg, mine AS f, nb >= hi AS pos FROM s JOIN q ON q.blk = s.blk AND q.flag = right(pair, 1) WHERE nb >= hi OR nb < lo){AUC_SQL}"""),
)
def j22(spark, sf):
    """Do a sheet's scores rise where the touching sheet is inked?"""
    df = grids.plane(spark, sf).where("n > 0").select(F.substring("seg", 1, 1).alias("flag"), F.expr("substring(seg, 2)").alias("blk"), "y", "x", "a", "b")
    nn = neighbour_pairs(spark, sf).select(
        "blk", "pair", F.col("r").alias("y"), F.col("c").alias("x"), F.floor(F.col("r_py") / 2).cast("int").alias("ny"), F.floor(F.col("r_px") / 2).cast("int").alias("nx")
    )
    mine = nn.join(in_pairs(df, 1).select("blk", "pair", "y", "x", "a"), ["blk", "pair", "y", "x"])
    other = in_pairs(df, 2).select("blk", "pair", F.col("y").alias("ny"), F.col("x").alias("nx"), "b")
    cuts = in_pairs(df, 2).groupBy("blk", "pair").agg(
        quantiles.byte_percentile(F.col("b"), 90).alias("hi"), quantiles.byte_percentile(F.col("b"), 50).alias("lo")
    )
    s = mine.join(other, ["blk", "pair", "ny", "nx"]).join(cuts, ["blk", "pair"]).where("b >= hi OR b < lo")
    s = s.withColumn("seg", F.concat("pair", "blk"))
    return rounded(quantiles.auc(s, ["seg"], "a", F.col("b") >= F.col("hi")))


@query(
    "j23_depth_hunt",
    with_volume("""
, c AS (SELECT seg, y, x, max(v) FILTER (z = 9) AS fixed, max(v) AS best, count(*) FILTER (v > 0) > 9 AS pos FROM volume GROUP BY ALL),
u AS (SELECT seg, y, x, pos, fixed AS f, 'fixed' AS kind FROM c UNION ALL SELECT seg, y, x, pos, best, 'best' FROM c),
k AS (SELECT seg, kind, pos, rank() OVER (PARTITION BY seg, kind ORDER BY f) + (count(*) OVER (PARTITION BY seg, kind, f) - 1) / 2.0 AS rk FROM u),
a AS (SELECT seg, kind, (sum(rk) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auc
  FROM k GROUP BY ALL HAVING count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0)
SELECT seg, round(max(auc) FILTER (kind = 'fixed'), 6) AS fixed, round(max(auc) FILTER (kind = 'best'), 6) AS best FROM a GROUP BY seg"""),
)
def j23(spark, sf):
    """Fixed layer against the best layer of each column."""
    c = grids.volume(spark, sf).groupBy("seg", "y", "x").agg(
        F.max(F.when(F.col("z") == 9, F.col("v"))).alias("fixed"), F.max("v").alias("best"), (F.count_if(F.col("v") > 0) > 9).alias("pos")
    )
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("f")) for k in ("fixed", "best")])
    long = c.select("seg", "pos", F.explode(kinds).alias("e")).select("seg", "pos", "e.*")
    u = quantiles.auc(long, ["seg", "kind"], "f", F.col("pos")).where("auc IS NOT NULL")
    pick = lambda k: r6(F.max(F.when(F.col("kind") == k, F.col("auc"))), k)
    return u.groupBy("seg").agg(pick("fixed"), pick("best"))


@query(
    "j24_feature_screen",
    with_plane("""
, f AS (SELECT left(seg, 1) AS scroll, seg, corr(a, CAST(b > 150 AS INT)) AS raw, corr(n, CAST(b > 150 AS INT)) AS cnt, corr(a * a, CAST(b > 150 AS INT)) AS sq FROM plane GROUP BY ALL),
u AS (UNPIVOT f ON raw, cnt, sq INTO NAME feature VALUE r)
SELECT feature, round(median(r) FILTER (scroll <> 'R'), 6) AS ink_r, round(median(abs(r)) FILTER (scroll = 'R'), 6) AS blank, count(*) AS n,
  median(r) FILTER (scroll <> 'R') - 1.5 * median(abs(r)) FILTER (scroll = 'R') > 0 AS alive FROM u GROUP BY feature"""),
)
def j24(spark, sf):
    """Tile-by-feature table with the control subtracted inside the rule."""
    t = F.when(F.col("b") > 150, 1.0).otherwise(0.0)
    kinds = {"raw": F.col("a"), "cnt": F.col("n"), "sq": F.col("a") * F.col("a")}
    df = grids.plane(spark, sf).groupBy("seg").agg(
        F.array(*[F.struct(F.lit(k).alias("feature"), F.corr(c, t).alias("r")) for k, c in kinds.items()]).alias("fs")
    )
    u = df.select(F.substring("seg", 1, 1).alias("scroll"), F.explode("fs").alias("f")).select("scroll", "f.*")
    ink, blank = F.when(F.col("scroll") != "R", F.col("r")), F.when(F.col("scroll") == "R", F.abs("r"))
    mid = quantiles.medians(u, ["feature"], {"ink": ink, "blank_r": blank})
    n = u.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return n.join(mid, "feature").select(
        "feature", r6("ink", "ink_r"), r6("blank_r", "blank"), "n", (F.col("ink") - F.col("blank_r") * 1.5 > 0).alias("alive")
    )


@query(
    "j26_crack_geometry",
    with_plane(f""", {sbox('bg', 'plane', {'bg': 'a'}, 2)},
v AS MATERIALIZED (SELECT p.seg, p.y, p.x, p.a, p.b, bg - p.a AS val FROM plane p JOIN bg USING (seg, y, x)),
q AS (SELECT seg, quantile_cont(val, 0.88) AS t FROM v WHERE a > 0 GROUP BY seg),
c AS (SELECT v.*, CAST(val > t + 1e-9 AND a > 0 AS INT) AS crack FROM v JOIN q USING (seg)),
d AS (SELECT seg, y // 4 AS ky, x // 4 AS kx, avg(crack) AS dens, max(b) > 200 AS ink FROM c GROUP BY ALL)
SELECT seg, round(avg(dens) FILTER (ink), 6) AS inside, round(avg(dens) FILTER (NOT ink), 6) AS outside,
  round((avg(dens) FILTER (ink) - avg(dens) FILTER (NOT ink)) / sqrt((var_pop(dens) FILTER (ink) + var_pop(dens) FILTER (NOT ink)) / 2), 6) AS d FROM d GROUP BY seg"""),
)
def j26(spark, sf):
    """Thin dark valleys inside letters against outside, as an effect size."""
    m = axis.box_mean(grids.plane(spark, sf), {"bg": ("a", 2)}).withColumn("val", F.col("bg") - F.col("a")).persist()
    cut = quantiles.percentiles(m.where("a > 0"), ["seg"], "val", {"t": 88})
    c = m.join(cut, "seg").withColumn("crack", ((F.col("val") > F.col("t") + 1e-9) & (F.col("a") > 0)).cast("int"))
    d = masks.block_reduce(c, ["seg"], 4, dens=F.avg("crack"), ink=F.max("b") > 200)
    on = F.col("ink")
    return rounded(d.groupBy("seg").agg(
        F.avg(F.when(on, F.col("dens"))).alias("inside"), F.avg(F.when(~on, F.col("dens"))).alias("outside"), stats.cohens_d(F.col("dens"), on).alias("d")
    ))


@query(
    "d42_effective_area",
    with_plane("""
, dm AS (SELECT p.seg, p.y, p.x, min(pow(p.y - q.y, 2) + pow(p.x - q.x, 2)) AS d2 FROM plane p JOIN plane q ON q.seg = p.seg AND q.n >= 2 AND p.n < 2 GROUP BY ALL)
SELECT seg, round(count(*) * pow(0.018064, 2), 6) AS search_mm2, round(count(*) FILTER (sqrt(d2) >= 1.5) * pow(0.018064, 2), 6) AS hostable_mm2,
  round(count(*) FILTER (sqrt(d2) >= 2) * pow(0.018064, 2), 6) AS effective_mm2, round(max(sqrt(d2)) / 4, 2) AS max_letters,
  round(100.0 * count(*) FILTER (sqrt(d2) >= 2) / count(*), 2) AS effective_pct FROM dm GROUP BY seg"""),
)
def d42(spark, sf):
    """Area searched, area that can host a letter, area with room for a whole one."""
    letter, px = 4.0, 0.018064**2
    df = grids.plane(spark, sf).withColumn("m", F.col("n") < 2)
    d = spatial.distance(df, "m", "d").where(F.col("m") & F.col("d").isNotNull())
    n = F.count(F.lit(1))
    room = lambda k: F.count_if(F.col("d") >= k * letter)
    return d.groupBy("seg").agg(
        r6(n * px, "search_mm2"), r6(room(0.375) * px, "hostable_mm2"), r6(room(0.5) * px, "effective_mm2"),
        F.round(F.max("d") / letter, 2).alias("max_letters"), F.round(room(0.5) * 100.0 / n, 2).alias("effective_pct"),
    )
