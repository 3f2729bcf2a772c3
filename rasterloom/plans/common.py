"""Pieces shared by the query modules: rounding and SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rasterloom.operators import nulls
from rasterloom.plans.registry import PLANE

SHIFTS = nulls.draw_shifts(seed=0, n=24, lo=9, h=64, w=64)
SHIFTS_SQL = nulls.sql_shifts(SHIFTS)


def r6(c, name: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6).alias(name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def refl(e: str, n: int) -> str:
    return f"(CASE WHEN {e} < 0 THEN -1 - ({e}) WHEN {e} >= {n} THEN {2 * n - 1} - ({e}) ELSE {e} END)"


def clip(e: str, n: int) -> str:
    return f"greatest(0, least({n - 1}, {e}))"


def around(r: int, name: str = "o") -> str:
    return (
        f"(SELECT dy.range AS dy, dx.range AS dx FROM range({-r}, {r + 1}) dy "
        f"CROSS JOIN range({-r}, {r + 1}) dx) {name}"
    )


def neighbours(source: str, name: str, r: int, n: int = 64, edge=refl, cols: str = "") -> str:
    """CTE listing, for every cell, the (2r+1)^2 cells its window reads."""
    return f"""{name} AS MATERIALIZED (
  SELECT p.seg, p.y, p.x, {edge('p.y + o.dy', n)} AS ny, {edge('p.x + o.dx', n)} AS nx{cols}
  FROM {source} p CROSS JOIN {around(r)})"""


# sheet mask (3x3 mirrored mean above 40 on both planes), box response and calls
CALLED = (
    PLANE
    + f""", {neighbours("plane", "nb", 1)},
sm AS MATERIALIZED (
  SELECT p.seg, p.y, p.x, sum(q.a) / 9.0 > 40 AND sum(q.b) / 9.0 > 40 AS m
  FROM nb p JOIN plane q ON q.seg = p.seg AND q.y = p.ny AND q.x = p.nx
  GROUP BY ALL),
base AS MATERIALIZED (SELECT p.*, sm.m FROM plane p JOIN sm USING (seg, y, x)),
resp AS MATERIALIZED (
  SELECT p.seg, p.y, p.x,
    CASE WHEN count(*) FILTER (q.m) = 9 THEN sum(q.a) / 9.0 ELSE 0.0 END AS la,
    CASE WHEN count(*) FILTER (q.m) = 9 THEN sum(q.b) / 9.0 ELSE 0.0 END AS lb
  FROM nb p JOIN base q ON q.seg = p.seg AND q.y = p.ny AND q.x = p.nx
  GROUP BY ALL),
cuts AS MATERIALIZED (
  SELECT seg, quantile_cont(la, 0.9) AS ta, quantile_cont(lb, 0.9) AS tb
  FROM resp JOIN base USING (seg, y, x) WHERE m GROUP BY seg),
called AS MATERIALIZED (
  SELECT b.*, la, lb, m AND la >= ta AS ca, m AND lb >= tb AS cb
  FROM base b JOIN resp USING (seg, y, x) JOIN cuts USING (seg))"""
)

# every cell next to the cell each circular shift brings there
ROLLED = f"""rolled AS MATERIALIZED (
  SELECT p.seg, p.y, p.x, s.k, (p.y - s.sy + 6400) % 64 AS py, (p.x - s.sx + 6400) % 64 AS px
  FROM plane p CROSS JOIN {SHIFTS_SQL})"""

# 4-connected components of the cells in ``cc``: smallest cell reachable
REACH = """edge AS MATERIALIZED (
  SELECT a.seg, a.y, a.x, b.y AS ny, b.x AS nx
  FROM (SELECT cc.*, d.* FROM cc CROSS JOIN (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) d(dy, dx)) a
  JOIN cc b ON b.seg = a.seg AND b.y = a.y + a.dy AND b.x = a.x + a.dx),
reach AS (
  SELECT seg, y, x, y * 2147483648 + x AS r FROM cc
  UNION SELECT e.seg, e.ny, e.nx, r.r FROM reach r JOIN edge e ON e.seg = r.seg AND e.y = r.y AND e.x = r.x),
lab AS MATERIALIZED (SELECT seg, y, x, min(r) AS comp FROM reach GROUP BY ALL),
shape AS MATERIALIZED (
  SELECT seg, comp, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1,
    avg(y) AS cy, avg(x) AS cx,
    round(count(*) / ((max(y) - min(y) + 1) * (max(x) - min(x) + 1)), 3) AS fill,
    round((max(x) - min(x) + 1) / (max(y) - min(y) + 1), 3) AS aspect
  FROM lab GROUP BY ALL)"""


def with_components(where: str, body: str, source: str = PLANE, frm: str = "plane") -> str:
    return f"WITH RECURSIVE {source}, cc AS MATERIALIZED (SELECT seg, y, x FROM {frm} WHERE {where}), {REACH}{body}"
