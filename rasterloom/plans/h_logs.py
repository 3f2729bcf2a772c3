"""Logs: caches, telemetry, debouncing, tailing, supervision."""

from __future__ import annotations

from pyspark.sql import functions as F

from rasterloom.operators import ordered
from rasterloom.plans.common import r6
from rasterloom.plans.registry import query
from rasterloom.sources import grids
from rasterloom.streaming import logs

HOUR = 3_600_000_000


def requests(spark, sf):
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    return grids.table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
        ts.alias("t"), F.floor(ts / HOUR).alias("bucket"),
    )


EV = """ev AS (SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) AS t FROM events)"""


@query(
    "h01_lru_cache",
    f"""WITH {EV},
p AS MATERIALIZED (SELECT user_id, event_id, k, 1 + k % 7 AS s, lag(event_id) OVER (PARTITION BY user_id, k ORDER BY event_id) AS prev FROM ev),
b AS (SELECT p.user_id, p.event_id, count(DISTINCT q.k) AS others, sum(1 + q.k % 7) AS mass FROM p
  JOIN (SELECT user_id, event_id, k FROM p) q ON q.user_id = p.user_id AND q.event_id > p.prev AND q.event_id < p.event_id
  WHERE NOT EXISTS (SELECT 1 FROM p r WHERE r.user_id = p.user_id AND r.k = q.k AND r.event_id > q.event_id AND r.event_id < p.event_id)
  GROUP BY ALL)
SELECT p.user_id, p.event_id, CASE WHEN prev IS NULL THEN false WHEN b.event_id IS NULL THEN true ELSE mass + s <= 40 END AS hit
FROM p LEFT JOIN b USING (user_id, event_id)""",
)
def h01(spark, sf):
    like = grids.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    req = logs.tail(spark, like, f"{sf}/events*.parquet").select("user_id", "event_id", k.alias("k"), (1 + k % 7).cast("long").alias("size"))
    return logs.drain(logs.lru_cache(req, "user_id", "k", "size", "event_id", 40), "lru")


@query(
    "h02_burst_wall_clock",
    f"""WITH {EV}, i AS (SELECT user_id, t, t + CAST(round(value * 100) AS BIGINT) * 600000 AS e FROM ev),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY t, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i)
SELECT user_id, CAST(sum(greatest(e - greatest(t, coalesce(seen, t)), 0)) AS BIGINT) AS busy, count(*) AS requests FROM m GROUP BY user_id""",
)
def h02(spark, sf):
    e = F.col("t") + F.round(F.col("value") * 100).cast("long") * 600000
    return ordered.busy_time(requests(spark, sf).withColumn("e", e), ["user_id"], "t", "e", "bucket")


@query(
    "h03_debounce",
    f"""WITH {EV}, n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM ev)
SELECT event_id, user_id FROM n WHERE nxt IS NULL OR nxt - t > 3600000000""",
)
def h03(spark, sf):
    """Only the last event of each burst is committed."""
    n = ordered.next_value(requests(spark, sf), ["user_id"], ["t", "event_id"], "bucket", "t", "nxt")
    return n.where(F.col("nxt").isNull() | (F.col("nxt") - F.col("t") > HOUR)).select("event_id", "user_id")


@query(
    "h04_tailing_investigator",
    f"""WITH {EV}, c AS (SELECT DISTINCT user_id, k, event_type FROM ev WHERE value >= 20)
SELECT user_id, k, event_type, CASE WHEN k % 5 = 0 THEN 'fires on blank' WHEN k < 15 THEN 'tile draw' WHEN user_id % 4 = 0 THEN 'one scroll'
  WHEN k > 90 THEN 'sharp spike' ELSE 'SURVIVED' END AS verdict FROM c""",
)
def h04(spark, sf):
    """New candidates from a growing log, each judged once by ordered kill tests."""
    like = grids.table(spark, sf, "events")
    cand = logs.tail(spark, like, f"{sf}/events*.parquet").where("value >= 20").select(
        "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type"
    )
    verdict = (
        F.when(F.col("k") % 5 == 0, "fires on blank").when(F.col("k") < 15, "tile draw")
        .when(F.col("user_id") % 4 == 0, "one scroll").when(F.col("k") > 90, "sharp spike").otherwise("SURVIVED")
    )
    seen = logs.first_sightings(cand, ["user_id", "k", "event_type"])
    return logs.drain(seen.withColumn("verdict", verdict), "tail")


@query(
    "h05_best_so_far",
    f"""WITH {EV}, m AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ev)
SELECT user_id, event_id, value FROM m WHERE seen IS NULL OR value > seen""",
)
def h05(spark, sf):
    """Every time a worker's shared best improved."""
    m = ordered.running_max_before(requests(spark, sf), ["user_id"], ["t", "event_id"], "bucket", "value", "seen")
    return m.where("seen IS NULL OR value > seen").select("user_id", "event_id", "value")


@query(
    "h06_two_strikes",
    f"""WITH {EV}, n AS (SELECT *, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM ev WHERE event_type = 'error')
SELECT user_id, count(*) AS failures, count(*) FILTER (nxt - t <= 14400000000) AS strikes, count(*) FILTER (nxt - t <= 14400000000) >= 2 AS retired
FROM n GROUP BY user_id""",
)
def h06(spark, sf):
    errors = requests(spark, sf).where("event_type = 'error'")
    n = ordered.next_value(errors, ["user_id"], ["t", "event_id"], "bucket", "t", "nxt")
    quick = F.count_if(F.col("nxt") - F.col("t") <= 4 * HOUR)
    return n.groupBy("user_id").agg(F.count(F.lit(1)).alias("failures"), quick.alias("strikes"), (quick >= 2).alias("retired"))


@query(
    "h08_request_totals",
    f"""WITH {EV} SELECT event_type, count(*) AS requests, count(*) FILTER (k = 0) AS absent, CAST(sum(k) AS BIGINT) AS bytes, round(avg(value), 6) AS mean FROM ev GROUP BY 1""",
)
def h08(spark, sf):
    return requests(spark, sf).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("k") == 0).alias("absent"), F.sum("k").alias("bytes"), r6(F.avg("value"), "mean")
    )
