"""Scalar functions over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.functions import scalars as S
from rasterloom.plans.b_filters import NAMES_SQL, scan_names
from rasterloom.plans.common import r6
from rasterloom.plans.registry import query, with_plane
from rasterloom.sources import grids


@query(
    "i01_format_bytes",
    """WITH b AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) * (CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 700 ELSE 90000 END) AS n FROM orders)
SELECT id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', floor(n / 102.4 + 0.5) / 10) || ' KB'
  WHEN n < 1073741824 THEN printf('%.1f', floor(n / 104857.6 + 0.5) / 10) || ' MB' ELSE printf('%.2f', floor(n / 10737418.24 + 0.5) / 100) || ' GB' END AS size FROM b""",
)
def i01(spark, sf):
    k = F.element_at(F.array(F.lit(1), F.lit(700), F.lit(90000)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return grids.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), S.format_bytes(F.floor("o_totalprice").cast("long") * k).alias("size")
    )


_STEPS = "[10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 100000]"


@query(
    "i02_scale_bar",
    f"""WITH c AS (SELECT p_partkey AS id, (p_size * 40 + 1) * (p_size % 9 + 0.5) / 4 AS target FROM part),
s AS (SELECT id, coalesce(list_min(list_filter({_STEPS}, lambda s: s >= target)), 100000) AS um FROM c)
SELECT id, um, CASE WHEN um >= 1000 THEN um // 1000 || ' mm' ELSE um || ' µm' END AS label FROM s""",
)
def i02(spark, sf):
    um, label = S.scale_bar(F.col("p_size") * 40 + 1, F.col("p_size") % 9 + 0.5)
    return grids.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), um.alias("um"), label.alias("label"))


LETTER, PITCH, ADVANCE = (int(S.HAND[k]) for k in ("letter_height", "line_pitch", "letter_advance"))
#: The fixed scribes, and names that have none.
SCROLLS = [*S.SCRIBES, "unknown", "unknown"]
_SCROLLS = str(SCROLLS)
_SCR = ", ".join(f"('{k}', {h}, {p})" for k, (h, p) in S.SCRIBES.items())


@query(
    "i03_hand_for_scroll",
    f"""WITH k AS (SELECT c_custkey AS id, ({_SCROLLS})[c_custkey % 8 + 1] AS scroll FROM customer)
SELECT id, coalesce(h, {LETTER}) AS letter_um, coalesce(p, {PITCH}) AS pitch_um, CAST(floor({ADVANCE} * coalesce(h, {LETTER}) / {LETTER} + 0.5) AS BIGINT) AS advance_um,
  h IS NOT NULL AS measured FROM k LEFT JOIN (VALUES {_SCR}) t(scroll, h, p) USING (scroll)""",
)
def i03(spark, sf):
    scroll = F.element_at(F.array(*[F.lit(n) for n in SCROLLS]), (F.col("c_custkey") % 8 + 1).cast("int"))
    # fixed lookup of a handful of scribes
    hand = lambda i: F.create_map(*[F.lit(v) for k, t in S.SCRIBES.items() for v in (k, t[i])])[scroll]
    h = F.coalesce(hand(0), F.lit(LETTER))
    return grids.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), h.alias("letter_um"), F.coalesce(hand(1), F.lit(PITCH)).alias("pitch_um"),
        S.round_half_up(h * ADVANCE / LETTER).alias("advance_um"), hand(0).isNotNull().alias("measured"),
    )


@query("i04_protocol_parse", f"WITH {NAMES_SQL} SELECT id, um, prop, kev FROM parsed")
def i04(spark, sf):
    um, prop, kev = S.protocol(F.col("name"))
    return scan_names(spark, sf).select("id", um.alias("um"), prop.alias("prop"), kev.alias("kev"))


@query(
    "i05_pair_name_parse",
    """WITH p AS (SELECT l_orderkey AS id, l_linenumber AS line, lpad(l_partkey::VARCHAR, 14, '2') || '-x__' || CASE WHEN l_returnflag = 'A' THEN 'ink' WHEN l_returnflag = 'N' THEN 'blank'
  ELSE 'other' END || '__y' || l_suppkey * 8 || '_x' || l_partkey AS name FROM lineitem)
SELECT id, line, nullif(regexp_extract(name, '^(\\d{14}).*?__(ink|blank)__y(\\d+)_x(\\d+)$', 1), '') AS seg,
  nullif(regexp_extract(name, '^(\\d{14}).*?__(ink|blank)__y(\\d+)_x(\\d+)$', 2), '') AS kind,
  TRY_CAST(nullif(regexp_extract(name, '^(\\d{14}).*?__(ink|blank)__y(\\d+)_x(\\d+)$', 3), '') AS INTEGER) AS y FROM p""",
)
def i05(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "ink").when(F.col("l_returnflag") == "N", "blank").otherwise("other")
    name = F.concat(
        F.lpad(F.col("l_partkey").cast("string"), 14, "2"), F.lit("-x__"), kind, F.lit("__y"), (F.col("l_suppkey") * 8).cast("string"),
        F.lit("_x"), F.col("l_partkey").cast("string"),
    )
    pat = r"^(\d{14}).*?__(ink|blank)__y(\d+)_x(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract("name", pat, i), F.lit(""))
    return grids.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), name.alias("name")).select(
        "id", "line", part(1).alias("seg"), part(2).alias("kind"), part(3).try_cast("int").alias("y")
    )


@query(
    "i06_display_window",
    with_plane(" SELECT seg, y, x, CAST(trunc(greatest(0, least(255, (a - 54) / 84.0::DOUBLE * 255))) AS INTEGER) AS idx FROM plane"),
)
def i06(spark, sf):
    return grids.plane(spark, sf).select("seg", "y", "x", S.lut_index(F.col("a"), F.lit(54.0), F.lit(138.0)).alias("idx"))


@query(
    "i07_math",
    """SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 6) AS hyp, round(atan2(l_tax, l_discount + 0.01), 6) AS ang,
  round(log2(l_quantity), 6) AS lg, round(exp(-l_discount), 6) AS ex, CAST(ceil(l_extendedprice / 1000) AS BIGINT) AS up, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS down,
  round(power(l_quantity, 1.5), 4) AS pw, greatest(5, least(40, l_quantity)) AS clip FROM lineitem""",
)
def i07(spark, sf):
    q, t, d, p = (F.col(c) for c in ("l_quantity", "l_tax", "l_discount", "l_extendedprice"))
    return grids.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(F.hypot(q, t), "hyp"), r6(F.atan2(t, d + 0.01), "ang"), r6(F.log2(q), "lg"), r6(F.exp(-d), "ex"),
        F.ceil(p / 1000).cast("long").alias("up"), F.floor(p / 1000).cast("long").alias("down"), F.round(F.pow(q, F.lit(1.5)), 4).alias("pw"),
        S.clamp(q, 5.0, 40.0).alias("clip"),
    )


@query(
    "i08_arrays",
    """WITH v AS (SELECT vec_id, [round(e::DOUBLE, 5) FOR e IN embedding] AS e FROM embeddings)
SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS argmax, round(list_sum(e[1:16]), 7) AS head, CAST(len(list_distinct(e)) AS INTEGER) AS uniq,
  round(e[10] + (e[11] - e[10]) * 0.5, 7) AS mid, round(list_max(list_transform(range(1, len(e)), lambda i: abs(e[i + 1] - e[i]))), 7) AS step FROM v""",
)
def i08(spark, sf):
    e = F.transform("embedding", lambda v: F.round(v.cast("double"), 5))
    v = grids.table(spark, sf, "embeddings").select("vec_id", e.alias("e"))
    total = F.aggregate(F.filter("e", lambda x, i: i < 16), F.lit(0.0), lambda s, x: s + x)
    diff = F.transform(F.sequence(F.lit(0), F.size("e") - 2), lambda i: F.abs(F.get("e", i + 1) - F.get("e", i)))
    return v.select(
        "vec_id", (F.array_position("e", F.array_max("e")) - 1).cast("int").alias("argmax"), F.round(total, 7).alias("head"),
        F.size(F.array_distinct("e")).alias("uniq"), F.round(F.get("e", F.lit(9)) + (F.get("e", F.lit(10)) - F.get("e", F.lit(9))) * 0.5, 7).alias("mid"),
        F.round(F.array_max(diff), 7).alias("step"),
    )


@query(
    "i09_json_map",
    """SELECT event_id, json_extract_string(props, '$.k') || '/' || event_type AS tag, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS next,
  json_extract_string(props, '$.missing') IS NULL AS absent FROM events""",
)
def i09(spark, sf):
    m = F.from_json("props", "map<string,int>")
    merged = F.map_concat(m, F.create_map(F.lit("extra"), F.lit(1)))
    return grids.table(spark, sf, "events").select("event_id", "event_type", merged.alias("m")).select(
        "event_id", F.concat_ws("/", F.col("m")["k"].cast("string"), "event_type").alias("tag"),
        (F.col("m")["k"] + F.col("m")["extra"]).alias("next"), F.col("m")["missing"].isNull().alias("absent"),
    )


@query("i10_cache_key", "SELECT page_id, md5(url) || '.npz' AS cache_key, left(url, 14) AS stem FROM pages")
def i10(spark, sf):
    return grids.table(spark, sf, "pages").select("page_id", F.concat(F.md5("url"), F.lit(".npz")).alias("cache_key"), F.expr("left(url, 14)").alias("stem"))
