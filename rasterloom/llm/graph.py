"""Connected components of a link list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rasterloom.llm.shared import written


def _large(e: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node it knows."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them; ``u > v`` in every row."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def roots(links: DataFrame) -> DataFrame:
    """``u, v``: every linked node but the smallest of its component, with that smallest node.

    ``links`` has ``u, v``; loops and repeats do no harm. Each round is written to the
    shared folder; rounds end when not one row changes.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "links")
    while True:
        now = written(_small(_large(edges)), "links")
        if now.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(now, ["u", "v"], "left_anti").isEmpty():
            return now
        edges = now
