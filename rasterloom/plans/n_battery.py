"""Staged search and falsification from tile moments (J13, J14, J15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import axis, experiments, nulls
from rasterloom.plans.common import SHIFTS, rounded
from rasterloom.plans.f_windows import sbox
from rasterloom.plans.registry import query, with_plane
from rasterloom.session import checkpoint
from rasterloom.sources import grids

FEATURES, COVARIATES, TILE = ["a0", "a1", "a2", "n1"], ["c1", "c2"], 8
#: The first roll stands for the label of a scroll whose ink the scan never saw, the rest are the null.
ROLLS = [(32, 32), (9, 50), (50, 9), (21, 37), (37, 21), (13, 13), (43, 11), (11, 43)]
TARGETS = ["t", *[f"t{k}" for k in range(len(ROLLS))]]
NULLS = TARGETS[2:]
MOMENTS = experiments.Moments(FEATURES, COVARIATES, TARGETS)
#: Correlations that a variant must reach (or stay below, for the controls).
BARS = {"physics": 0.15, "tune": 0.1, "held": 0.15, "blank": 0.3, "partial": 0.05, "worst": 0.1, "jitter": 0.5}
COVERED = "s_t > 0.02 * n AND s_t < 0.9 * n"
BLANK = "s_t <= 0.02 * n"


def variants() -> list[tuple]:
    """Single features, sums and differences, in weights of thousandths."""
    out = []
    for i, f in enumerate(FEATURES):
        unit = [0, 0, 0, 0]
        unit[i] = 1000
        out.append((f, *unit))
        for j in range(i + 1, len(FEATURES)):
            for name, w in (("plus", 500), ("minus", -500)):
                both = list(unit)
                both[j] = w
                out.append((f"{f} {name} {FEATURES[j]}", *both))
    return out


CANDIDATES = [("bright", 1000, 300, 0, 0), ("edge", 1000, 0, -1000, 0), ("count", 0, 0, 0, 1000), ("knife", 1000, -1000, 0, -1000)]


def jittered(k: int, weights: tuple) -> list[float]:
    """Each weight off by a few hundredths, and the scale one step away."""
    w = [x * (0.85, 0.92, 1.08, 1.15)[(k * 7 + i * 3 + k // 3) % 4] for i, x in enumerate(weights)]
    return [0.0, w[0], w[1] + w[2], w[3]] if k % 2 else [w[0] + w[1], w[2], 0.0, w[3]]


def trials() -> list[tuple]:
    """All experiments on the candidates: ``(candidate, experiment, weights…)``."""
    out = []
    for name, *w in CANDIDATES:
        out.append((name, "whole", *w))
        used = [i for i, x in enumerate(w) if x]
        for i in used:
            if len(used) > 1:
                out.append((name, f"drop {FEATURES[i]}", *[0 if j == i else x for j, x in enumerate(w)]))
            out.append((name, f"alone {FEATURES[i]}", *[x if j == i else 0 for j, x in enumerate(w)]))
        out += [(name, f"jitter {k}", *[round(x, 6) for x in jittered(k, tuple(w))]) for k in range(10)]
    return out


def described(spark, sf):
    """Cells with features at three scales, condition covariates, the label and its rolls."""
    df = grids.plane(spark, sf).withColumn("on", F.col("b") > 150)
    df = axis.box_mean(df, {"_m1": ("a", 1), "_m2": ("a", 2), "_n2": ("n", 2)})
    df = experiments.shifted_marks(df, "on", ROLLS)
    bit = lambda k: F.shiftright("marks", k).bitwiseAND(1).cast("int")
    return df.select(
        "seg", "h", "w", "y", "x", F.substring("seg", 1, 1).alias("scroll"), F.expr("CAST(substring(seg, 2) AS LONG)").alias("blk"),
        F.col("a").alias("a0"), F.floor("_m1").cast("int").alias("a1"), F.floor("_m2").cast("int").alias("a2"), (F.col("n") * 20).alias("n1"),
        F.floor(F.col("_n2") * 100).cast("int").alias("c1"), F.abs(F.col("a") - F.floor("_m2")).cast("int").alias("c2"),
        F.col("on").cast("int").alias("t"), *[bit(k).alias(f"t{k}") for k in range(len(ROLLS))],
    )


def tiles(spark, sf):
    """Moments of every tile, with two draws: ``u`` deals tiles to stages, ``fresh`` is one that no stage has used."""
    at = [F.floor(F.col(c) / TILE).cast("int").alias(f"t{c}") for c in "yx"]
    m = MOMENTS.collect(described(spark, sf), ["scroll", "blk", *at])
    number = F.col("blk") * 4096 + F.col("ty") * 64 + F.col("tx")
    return m.withColumns({"u": experiments.draw(number, 1), "fresh": experiments.draw(number, 777)})


_W = ", ".join(f"w_{f}" for f in FEATURES)
_SCORE = " + ".join(f"w_{f} * {f}" for f in FEATURES)
CELLS = f"""{sbox('m1', 'plane', {'m1': 'a'}, 1)}, {sbox('m2', 'plane', {'m2': 'a', 'n2': 'n'}, 2)},
roll(k, dy, dx) AS (VALUES {', '.join(f'({k}, {dy}, {dx})' for k, (dy, dx) in enumerate(ROLLS))}),
lbl AS (SELECT p.seg, p.y, p.x, {', '.join(f'max(CAST(q.b > 150 AS INT)) FILTER (k = {k}) AS t{k}' for k in range(len(ROLLS)))}
  FROM plane p CROSS JOIN roll JOIN plane q ON q.seg = p.seg AND q.y = (p.y - dy + 64) % 64 AND q.x = (p.x - dx + 64) % 64 GROUP BY ALL),
cells AS MATERIALIZED (SELECT p.seg, left(p.seg, 1) AS scroll, CAST(substr(p.seg, 2) AS BIGINT) AS blk, p.y // 8 AS ty, p.x // 8 AS tx,
  p.a AS a0, CAST(floor(m1) AS INT) AS a1, CAST(floor(m2) AS INT) AS a2, p.n * 20 AS n1, CAST(floor(n2 * 100) AS INT) AS c1,
  abs(p.a - CAST(floor(m2) AS INT)) AS c2, CAST(p.b > 150 AS INT) AS t, {', '.join(f't{k}' for k in range(len(ROLLS)))}
  FROM plane p JOIN m1 USING (seg, y, x) JOIN m2 USING (seg, y, x) JOIN lbl USING (seg, y, x)),
tl AS MATERIALIZED (SELECT scroll, blk, ty, tx, avg(t) AS cv, ((blk * 4096 + ty * 64 + tx) * 7919 + 1) * 2654435769 % 4294967296 / 4294967296 AS u,
  ((blk * 4096 + ty * 64 + tx) * 7919 + 777) * 2654435769 % 4294967296 / 4294967296 AS fresh FROM cells GROUP BY ALL)"""
_BOTH = lambda x: f"CASE WHEN var_pop({x}) > 0 AND var_pop(score) > 1e-12 THEN corr(score, {x}) END"


def _list(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{float(v)}::DOUBLE" for v in r) + ")" for r in rows)



@query(
    "j13_staged_funnel",
    with_plane(f""", {CELLS},
v(variant, {_W}) AS (VALUES {_list(variants())}),
s AS (SELECT v.variant, c.scroll, c.blk, c.ty, c.tx, {_SCORE} AS score, c1, c2, t, t0, {', '.join(NULLS)} FROM cells c CROSS JOIN v),
r AS MATERIALIZED (SELECT variant, scroll, blk, ty, tx, {_BOTH('t')} AS r, {_BOTH('t0')} AS blind, {', '.join(f'{_BOTH(t)} AS r_{t}' for t in NULLS)},
  var_pop(score) AS vs, var_pop(t) AS vt, covar_pop(score, t) AS vst, var_pop(c1) AS v1, var_pop(c2) AS v2, covar_pop(c1, c2) AS v12,
  covar_pop(score, c1) AS s1, covar_pop(score, c2) AS s2, covar_pop(t, c1) AS q1, covar_pop(t, c2) AS q2 FROM s GROUP BY ALL),
x1 AS (SELECT *, CASE WHEN v1 > 1e-12 THEN 1 / v1 ELSE 0 END AS i1 FROM r),
x2 AS (SELECT *, vs - s1 * s1 * i1 AS vs1, vt - q1 * q1 * i1 AS vt1, vst - s1 * q1 * i1 AS vst1, v2 - v12 * v12 * i1 AS v21, s2 - s1 * v12 * i1 AS s21, q2 - q1 * v12 * i1 AS q21 FROM x1),
x3 AS (SELECT *, CASE WHEN v21 > 1e-11 THEN 1 / v21 ELSE 0 END AS i2 FROM x2),
x AS MATERIALIZED (SELECT x3.*, cv, u, CASE WHEN vs1 - s21 * s21 * i2 > 1e-9 AND vt1 - q21 * q21 * i2 > 1e-9
  THEN (vst1 - s21 * q21 * i2) / sqrt(vs1 - s21 * s21 * i2) / sqrt(vt1 - q21 * q21 * i2) END AS pr,
  coalesce((SELECT median(abs(z)) FROM unnest([{', '.join(f'r_{t}' for t in NULLS)}]) w(z)), 0) AS nul FROM x3 JOIN tl USING (scroll, blk, ty, tx)),
st AS (SELECT variant,
  median(abs(blind)) FILTER (scroll = 'R') AS physics, count(abs(blind)) FILTER (scroll = 'R') AS physics_tiles,
  median(r) FILTER (scroll = 'A' AND u < 0.4 AND cv > 0.02 AND cv < 0.9) AS tune, count(r) FILTER (scroll = 'A' AND u < 0.4 AND cv > 0.02 AND cv < 0.9) AS tune_tiles,
  median(r - nul) FILTER (HELD) AS held, count(r - nul) FILTER (HELD) AS held_tiles,
  median(abs(blind)) FILTER (scroll <> 'R' AND cv <= 0.02) AS blank, count(abs(blind)) FILTER (scroll <> 'R' AND cv <= 0.02) AS blank_tiles,
  median(pr) FILTER (HELD) AS partial, count(pr) FILTER (HELD) AS partial_tiles FROM x GROUP BY variant),
e AS (SELECT *, physics <= {BARS['physics']} AS p1, tune >= {BARS['tune']} AS p2, held >= {BARS['held']} AS p3, coalesce(blank, 0) <= {BARS['blank']} AS p4, partial >= {BARS['partial']} AS p5 FROM st)
SELECT variant, round(physics, 6) AS physics, physics_tiles,
  CASE WHEN p1 THEN round(tune, 6) END AS tune, CASE WHEN p1 THEN tune_tiles END AS tune_tiles,
  CASE WHEN p1 AND p2 THEN round(held, 6) END AS held, CASE WHEN p1 AND p2 THEN held_tiles END AS held_tiles,
  CASE WHEN p1 AND p2 AND p3 THEN round(blank, 6) END AS blank, CASE WHEN p1 AND p2 AND p3 THEN blank_tiles END AS blank_tiles,
  CASE WHEN p1 AND p2 AND p3 AND p4 THEN round(partial, 6) END AS partial, CASE WHEN p1 AND p2 AND p3 AND p4 THEN partial_tiles END AS partial_tiles,
  CASE WHEN p1 AND p2 AND p3 AND p4 THEN round(held - 0.5 * greatest(coalesce(blank, 0) - 0.12, 0) - 1.5 * greatest(physics - 0.05, 0), 6) END AS penalised,
  CASE WHEN NOT coalesce(p1, false) THEN 'physics' WHEN NOT coalesce(p2, false) THEN 'tune' WHEN NOT coalesce(p3, false) THEN 'held' WHEN NOT p4 THEN 'blank' WHEN NOT coalesce(p5, false) THEN 'partial' ELSE 'gated' END AS stage FROM e
""".replace("HELD", "(scroll = 'N' OR (scroll = 'A' AND u >= 0.4)) AND cv > 0.02 AND cv < 0.9")),
)
def j13_staged(spark, sf):
    """Physics control, tuning, held-out excess over rolled labels, blank control, partial correlation; survivors only go on."""
    t = checkpoint(tiles(spark, sf))
    run = experiments.Funnel(MOMENTS, variants())
    null = F.array_sort(F.array_compact(F.array(*[F.abs(MOMENTS.r(c)) for c in NULLS])))
    half = F.size(null) / 2
    middle = (F.element_at(null, F.ceil(half).cast("int")) + F.element_at(null, (F.floor(half) + 1).cast("int"))) / 2
    excess = MOMENTS.r("t") - F.when(F.size(null) > 0, middle).otherwise(0.0)
    held = t.where(f"(scroll = 'N' OR (scroll = 'A' AND u >= 0.4)) AND {COVERED}")
    run.run("physics", t.where("scroll = 'R'"), F.abs(MOMENTS.r("t0")), F.col("physics") <= BARS["physics"])
    run.run("tune", t.where(f"scroll = 'A' AND u < 0.4 AND {COVERED}"), MOMENTS.r("t"), F.col("tune") >= BARS["tune"])
    run.run("held", held, excess, F.col("held") >= BARS["held"])
    run.run("blank", t.where(f"scroll <> 'R' AND {BLANK}"), F.abs(MOMENTS.r("t0")), F.coalesce("blank", F.lit(0.0)) <= BARS["blank"])
    run.run("partial", held, MOMENTS.partial_r("t"), F.col("partial") >= BARS["partial"])
    out = run.report()
    for name in ("physics", "tune", "held", "blank", "partial"):
        if name not in out.columns:
            out = out.withColumns({name: F.lit(None).cast("double"), f"{name}_tiles": F.lit(None).cast("long")})
    loss = 0.5 * F.greatest(F.coalesce("blank", F.lit(0.0)) - 0.12, F.lit(0.0)) + 1.5 * F.greatest(F.col("physics") - 0.05, F.lit(0.0))
    penalised = F.when(F.col("partial_tiles").isNotNull(), F.col("held") - loss)
    names = [c for n in ("physics", "tune", "held", "blank", "partial") for c in (n, f"{n}_tiles")]
    return rounded(out.withColumn("penalised", penalised).select("variant", *names, "penalised", "stage"))


FALSIFY = {"fresh": 0.15, "worst": 0.1, "jitter": 0.5, "blank": 0.3, "blind": 0.15}
SETS = {
    "fresh": f"scroll <> 'R' AND fresh < 0.5 AND {COVERED}",
    "jitter": "fresh < 0.25",
    "blank": f"scroll <> 'R' AND {BLANK}",
    "blind": "scroll = 'R'",
}
TRIAL_SQL = f"""{CELLS},
e(candidate, experiment, {_W}) AS (VALUES {_list(trials())}),
s AS (SELECT candidate, experiment, c.scroll, c.blk, c.ty, c.tx, {_SCORE} AS score, t, t0 FROM cells c CROSS JOIN e),
g AS (SELECT candidate, experiment, scroll, blk, ty, tx, {_BOTH('t')} AS r, {_BOTH('t0')} AS blind FROM s GROUP BY ALL),
k AS (SELECT candidate, experiment, scroll, CASE WHEN scroll = 'R' THEN 'blind' WHEN cv <= 0.02 THEN 'blank' WHEN fresh < 0.5 AND cv < 0.9 AND (experiment NOT LIKE 'jitter%' OR fresh < 0.25) THEN 'fresh' END AS kind,
  CASE WHEN scroll <> 'R' AND cv > 0.02 THEN r ELSE abs(blind) END AS r FROM g JOIN tl USING (scroll, blk, ty, tx)),
sc AS MATERIALIZED (SELECT * FROM k WHERE kind IS NOT NULL AND r IS NOT NULL AND (kind = 'fresh' OR experiment = 'whole')),
md AS MATERIALIZED (SELECT candidate, experiment, kind, median(r) AS m, count(*) AS tiles FROM sc GROUP BY ALL)"""


@query(
    "j14_ablation",
    with_plane(f", {TRIAL_SQL} SELECT candidate, experiment, round(m, 6) AS r, tiles FROM md WHERE kind = 'fresh'"),
)
def j14_ablation(spark, sf):
    """Every candidate without each of its terms, by each alone, and with jittered weights and scale."""
    return rounded(experiments.falsify(tiles(spark, sf), MOMENTS, trials(), SETS, "t", "t0", FALSIFY)[0])


@query(
    "j14_battery",
    with_plane(f""", {TRIAL_SQL},
mn AS (SELECT candidate, max(m) FILTER (kind = 'fresh') AS fresh, max(tiles) FILTER (kind = 'fresh') AS fresh_tiles, max(m) FILTER (kind = 'blank') AS blank,
  max(m) FILTER (kind = 'blind') AS blind FROM md WHERE experiment = 'whole' GROUP BY candidate),
sg AS (SELECT *, CASE WHEN fresh < 0 THEN -1 ELSE 1 END AS sign FROM mn),
ps AS (SELECT candidate, scroll, median(r) AS m FROM sc WHERE experiment = 'whole' AND kind = 'fresh' GROUP BY ALL),
pw AS (SELECT candidate, min(m * sign) AS worst, count(*) AS scrolls FROM ps JOIN sg USING (candidate) GROUP BY candidate),
jt AS (SELECT candidate, avg(CAST(m * sign >= {FALSIFY['fresh']} AS INT)) AS jitter FROM md JOIN sg USING (candidate) WHERE experiment LIKE 'jitter%' AND kind = 'fresh' GROUP BY candidate),
al AS (SELECT sg.*, worst, scrolls, jitter, CASE WHEN NOT coalesce(abs(fresh) >= {FALSIFY['fresh']}, false) THEN 'fresh'
  WHEN NOT coalesce(worst >= {FALSIFY['worst']} AND scrolls >= 2, false) THEN 'scroll' WHEN NOT coalesce(jitter >= {FALSIFY['jitter']}, false) THEN 'jitter'
  WHEN NOT coalesce(blank <= {FALSIFY['blank']}, false) THEN 'blank' WHEN NOT coalesce(blind <= {FALSIFY['blind']}, false) THEN 'blind' END AS killed_by
  FROM sg LEFT JOIN pw USING (candidate) LEFT JOIN jt USING (candidate))
SELECT candidate, round(fresh, 6) AS fresh, fresh_tiles, round(worst, 6) AS worst, scrolls, round(jitter, 6) AS jitter, round(blank, 6) AS blank, round(blind, 6) AS blind,
  killed_by, killed_by IS NULL AS survived FROM al"""),
)
def j14_battery(spark, sf):
    """Fresh draw, worst scroll, jitter, blank and blind: what survives all five."""
    return rounded(experiments.falsify(tiles(spark, sf), MOMENTS, trials(), SETS, "t", "t0", FALSIFY)[1])


FROZEN = experiments.Moments(["d"], [], ["t", *[f"t{k}" for k in range(len(SHIFTS))]])


@query(
    "j15_frozen_roll_null",
    with_plane(f""", {sbox('bg', 'plane', {'bg': 'a'}, 2)},
f AS MATERIALIZED (SELECT p.seg, p.y, p.x, a - bg AS d, CAST(b > 150 AS INT) AS t FROM plane p JOIN bg USING (seg, y, x)),
o AS (SELECT seg, avg(t) AS cov, CASE WHEN var_pop(t) > 0 THEN corr(d, t) END AS r FROM f GROUP BY seg),
z AS (SELECT p.seg, s.k, CASE WHEN var_pop(q.t) > 0 THEN corr(p.d, q.t) END AS r FROM f p CROSS JOIN {nulls.sql_shifts(SHIFTS)}
  JOIN f q ON q.seg = p.seg AND q.y = (p.y - s.sy + 6400) % 64 AND q.x = (p.x - s.sx + 6400) % 64 GROUP BY ALL),
n AS (SELECT seg, median(abs(z.r)) AS nul, (count(*) FILTER (abs(z.r) >= abs(o.r)) + 1) / (count(*) + 1) AS p FROM z JOIN o USING (seg) WHERE z.r IS NOT NULL GROUP BY seg)
SELECT seg, round(cov, 6) AS cov, round(r, 6) AS r, round(nul, 6) AS null_median, round(abs(r) - nul, 6) AS excess, round(p, 6) AS p,
  CASE WHEN cov <= 0.03 OR cov >= 0.9 THEN 'coverage' WHEN p < 0.05 THEN 'detected' ELSE 'null' END AS status FROM o LEFT JOIN n USING (seg)"""),
)
def j15_null(spark, sf):
    """One fixed detector on every segment, against its label rolled in place."""
    df = grids.plane(spark, sf).withColumn("on", F.col("b") > 150)
    df = axis.sliding_sum(df, axis.ROW, {"_r": ("a", 2, 2)})
    df = axis.sliding_sum(df, axis.COL, {"_s": ("_r", 2, 2)})
    df = experiments.shifted_marks(df, "on", SHIFTS)
    bit = lambda k: F.shiftright("marks", k).bitwiseAND(1).cast("int")
    cells = df.select("seg", (F.col("a") * 25 - F.col("_s")).alias("d"), F.col("on").cast("int").alias("t"), *[bit(k).alias(f"t{k}") for k in range(len(SHIFTS))])
    m = FROZEN.prepare(FROZEN.collect(cells, ["seg"]).withColumn("w_d", F.lit(1.0)))
    draws = F.array_compact(F.array(*[F.abs(F.round(FROZEN.r(f"t{k}"), 12)) for k in range(len(SHIFTS))]))
    m = m.select("seg", (F.col("s_t") / F.col("n")).alias("cov"), F.round(FROZEN.r("t"), 12).alias("r"), F.array_sort(draws).alias("z"))
    k = F.size("z")
    middle = (F.element_at("z", F.ceil(k / 2).cast("int")) + F.element_at("z", (F.floor(k / 2) + 1).cast("int"))) / 2
    p = (F.size(F.filter("z", lambda v: v >= F.abs("r"))) + 1) / (k + 1)
    m = m.withColumns({"null_median": F.when(k > 0, middle), "p": F.when(k > 0, p)})
    status = F.when((F.col("cov") <= 0.03) | (F.col("cov") >= 0.9), "coverage").when(F.col("p") < 0.05, "detected").otherwise("null")
    return rounded(m.select("seg", "cov", "r", "null_median", (F.abs("r") - F.col("null_median")).alias("excess"), "p", status.alias("status")))
