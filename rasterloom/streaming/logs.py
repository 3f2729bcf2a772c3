"""Structured Streaming over request and candidate logs.

Runs are ``availableNow``: everything present is processed, offsets and state
live in the checkpoint, and the next run continues from there.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rasterloom.session import scratch


def tail(spark: SparkSession, like: DataFrame, pattern: str) -> DataFrame:
    """Files matching the pattern as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).parquet(pattern)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there and return what it wrote."""
    spark = stream.sparkSession
    folder = scratch(spark, name)
    q = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def lru_cache(requests: DataFrame, client: str, key: str, size: str, order: str, budget: int) -> DataFrame:
    """Hit or miss of every request against a per-client byte-budgeted LRU cache.

    The state is the cache itself, so it never outgrows the budget. A hit
    refreshes its entry; the newest entry always stays.
    """

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = OrderedDict(zip(*state.get)) if state.exists else OrderedDict()
        total = sum(held.values())
        # a client's rows of one trigger come in several batches, in no order
        rows, hits = pd.concat(list(batches)).sort_values(order), []
        for name, n in zip(rows[key], rows[size]):
            hits.append(name in held)
            if hits[-1]:
                held.move_to_end(name)
                continue
            held[name] = int(n)
            total += int(n)
            while total > budget and len(held) > 1:
                total -= held.popitem(last=False)[1]
        yield pd.DataFrame({client: k[0], order: rows[order].to_numpy(), "hit": hits})
        state.update((list(held.keys()), list(held.values())))

    return requests.groupBy(client).applyInPandasWithState(
        run, f"{client} long, {order} long, hit boolean", "keys array<int>, sizes array<long>", "append",
        GroupStateTimeout.NoTimeout,
    )


def first_sightings(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Every key once, ever: the seen-set is streaming state and survives restarts."""
    return stream.dropDuplicates(keys)


def bursts(stream: DataFrame, client: str, ts: str, value: str, gap: str, late: str) -> DataFrame:
    """Last value of each burst of events closer together than ``gap`` (extension)."""
    w = F.session_window(ts, gap)
    return stream.withWatermark(ts, late).groupBy(client, w.alias("w")).agg(
        F.max_by(value, ts).alias("last"), F.count(F.lit(1)).alias("n")
    )
