from collections import OrderedDict

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import ordered
from rasterloom.streaming import logs

RNG = np.random.default_rng(8)


def test_lru_keeps_its_state_between_runs(spark, tmp_path):
    rows = [(int(RNG.integers(0, 3)), i, int(RNG.integers(0, 9)), int(1 + RNG.integers(0, 4))) for i in range(200)]
    size = {k: s for _, _, k, s in rows}
    rows = [(u, i, k, size[k]) for u, i, k, _ in rows]
    cols = "user long, event long, key int, size long"
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for part in (rows[:90], rows[90:]):
        spark.createDataFrame(part, cols).coalesce(1).write.mode("append").parquet(src)
        req = spark.readStream.schema(cols).parquet(src)
        q = (
            logs.lru_cache(req, "user", "key", "size", "event", 8)
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        q.awaitTermination()
    got = {r.event: r.hit for r in spark.read.parquet(out).collect()}
    caches = {}
    for u, i, k, s in rows:
        c = caches.setdefault(u, OrderedDict())
        hit = k in c
        c[k] = s
        c.move_to_end(k)
        while not hit and sum(c.values()) > 8 and len(c) > 1:
            c.popitem(last=False)
        assert got[i] == hit, i


def test_first_sightings_survive_a_restart(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for part in ([("a",), ("b",), ("a",)], [("b",), ("c",)]):
        spark.createDataFrame(part, ["k"]).coalesce(1).write.mode("append").parquet(src)
        s = logs.first_sightings(spark.readStream.schema("k string").parquet(src), ["k"])
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_bursts_close_after_the_gap(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:05", 2.0), (1, "2024-01-01 00:10:00", 3.0), (1, "2024-01-02 00:00:00", 9.0)]
    df = spark.createDataFrame(rows, ["u", "ts", "v"]).withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "src"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "src"))
    got = logs.drain(logs.bursts(s, "u", "ts", "v", "1 minute", "0 seconds").select("last", "n"), "bursts")
    assert {(r["last"], r.n) for r in got.collect()} >= {(2.0, 2), (3.0, 1)}


def test_busy_time_crosses_buckets(spark):
    starts = np.sort(RNG.integers(0, 400, 60))
    ends = starts + RNG.integers(0, 90, 60)
    df = spark.createDataFrame([("u", int(a), int(b), int(a) // 25) for a, b in zip(starts, ends)], ["u", "s", "e", "b"])
    covered = np.zeros(600, bool)
    for a, b in zip(starts, ends):
        covered[a:b] = True
    assert ordered.busy_time(df, ["u"], "s", "e", "b").first().busy == covered.sum()


def test_next_value_skips_empty_buckets(spark):
    df = spark.createDataFrame([("u", t, t // 10) for t in (1, 3, 55, 56)], ["u", "t", "b"])
    got = {r.t: r.n for r in ordered.next_value(df, ["u"], ["t"], "b", "t", "n").collect()}
    assert got == {1: 3, 3: 55, 55: 56, 56: None}
