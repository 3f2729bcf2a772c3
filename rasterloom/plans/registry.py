"""Registry of named queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# Relations shared by the SQL twins, spelled with cross joins and left joins so
# that they do not mirror how the Spark side builds the same grids.
CELL = """cell AS MATERIALIZED (
  SELECT l_returnflag || CAST(l_orderkey // 2048 AS VARCHAR) AS seg,
         CAST(l_orderkey % 2048 AS INTEGER) AS key,
         l_partkey * 7 + l_suppkey + l_linenumber AS crs,
         CAST(l_linenumber - 1 AS INTEGER) AS layer,
         CAST(l_quantity AS INTEGER) AS q,
         CAST(round(l_discount * 100) AS INTEGER) AS d
  FROM lineitem)"""

PLANE = (
    CELL
    + """, pagg AS (
  SELECT seg, CAST(key // 32 AS INTEGER) AS y, CAST(crs % 64 AS INTEGER) AS x,
         CAST(sum(q) AS BIGINT) AS q, CAST(sum(d) AS BIGINT) AS d, count(*) AS n
  FROM cell GROUP BY ALL),
plane AS MATERIALIZED (
  SELECT s.seg, CAST(r.y AS INTEGER) AS y, CAST(c.x AS INTEGER) AS x,
         CAST(coalesce(q * 5 // n, 0) AS INTEGER) AS a,
         CAST(coalesce((q * 3 + d * 10) // n, 0) AS INTEGER) AS b,
         CAST(coalesce(n, 0) AS INTEGER) AS n
  FROM (SELECT DISTINCT seg FROM cell) s
  CROSS JOIN (SELECT range AS y FROM range(64)) r
  CROSS JOIN (SELECT range AS x FROM range(64)) c
  LEFT JOIN pagg p ON p.seg = s.seg AND p.y = r.y AND p.x = c.x)"""
)

VOLUME = (
    CELL
    + """, vagg AS (
  SELECT seg, CAST(layer * 3 + key % 3 AS INTEGER) AS z,
         CAST(key // 128 AS INTEGER) AS y, CAST(crs % 16 AS INTEGER) AS x,
         CAST(sum(q) AS BIGINT) AS q, count(*) AS n
  FROM cell GROUP BY ALL),
volume AS MATERIALIZED (
  SELECT s.seg, CAST(k.z AS INTEGER) AS z, CAST(r.y AS INTEGER) AS y,
         CAST(c.x AS INTEGER) AS x, CAST(coalesce(q * 5 // n, 0) AS INTEGER) AS v
  FROM (SELECT DISTINCT seg FROM cell) s
  CROSS JOIN (SELECT range AS z FROM range(21)) k
  CROSS JOIN (SELECT range AS y FROM range(16)) r
  CROSS JOIN (SELECT range AS x FROM range(16)) c
  LEFT JOIN vagg p ON p.seg = s.seg AND p.z = k.z AND p.y = r.y AND p.x = c.x)"""
)


BOTH = PLANE + VOLUME[len(CELL):]


def with_plane(body: str) -> str:
    return f"WITH {PLANE}{body}"


def with_volume(body: str) -> str:
    return f"WITH {VOLUME}{body}"
