"""Raster relations derived from the relational tables.

``plane``   (seg, h, w, y, x, a, b, n)  two co-registered score planes, 0 = off-sheet
``volume``  (seg, d, h, w, z, y, x, v)  a depth stack, 0 = air

A segment is one block of ``ORDERS_PER_SEG`` orders for one return flag, so the
number of segments grows with the data while each one keeps a bounded extent.
Repeated samples of a hot cell are combined before they are shuffled. The sums are
then dealt by segment over as many tasks as the frame (every cell of every segment)
needs, and the frame is added there: its rows carry count 0, so no join is needed to
make the grid dense, and no task holds more than a few dozen segments. Line windows
find their lines together already.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ORDERS_PER_SEG = 2048
PLANE_H = PLANE_W = 64
VOL_D, VOL_H, VOL_W = 21, 16, 16
#: Cells that a task fills, about.
CELLS_AT_ONCE = 1 << 17


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seg() -> Column:
    # the block number as it is: padding to a width would cut longer numbers
    return F.concat("l_returnflag", F.expr(f"l_orderkey div {ORDERS_PER_SEG}").cast("string"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measured sample per line item, addressed in segment coordinates."""
    key = F.col("l_orderkey") % ORDERS_PER_SEG
    cross = F.col("l_partkey") * 7 + F.col("l_suppkey") + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        _seg().alias("seg"),
        key.cast("int").alias("key"),
        cross.alias("cross"),
        (F.col("l_linenumber") - 1).alias("layer"),
        F.col("l_quantity").cast("int").alias("q"),
        F.round(F.col("l_discount") * 100).cast("int").alias("d"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(_seg().alias("seg")).distinct()


def dense(cells: DataFrame, extent: dict[str, int], sums: list[str]) -> DataFrame:
    """``sums`` of ``cells`` per place of every segment; 0 where ``extent`` has a place without a cell.

    Cells outside the extent, or without a place, stay as they are. The cells of a segment are sorted by place and each
    also makes the empty places up to the next one; the first one, or the last one without a place, those before it.
    """
    at, size = list(extent), math.prod(extent.values())
    n = cells.agg(F.approx_count_distinct("seg")).first()[0]
    step = {c: math.prod(list(extent.values())[k + 1 :]) for k, c in enumerate(at)}
    dealt = cells.groupBy("seg", *at).agg(*[F.sum(c).alias(c) for c in sums]).repartition(-(-n * size // CELLS_AT_ONCE) or 1, "seg")
    inside, number = F.lit(True), F.lit(0)
    for c in at:
        inside = inside & F.col(c).between(0, extent[c] - 1)
        number = number + F.col(c) * step[c]
    # -1: no place in the frame
    line = Window.partitionBy("seg").orderBy("_p")
    dealt = dealt.withColumn("_p", F.when(inside, number).otherwise(-1))
    dealt = dealt.withColumns({"_before": F.lag("_p").over(line), "_next": F.lead("_p", 1, size).over(line)})
    first = F.when(F.col("_before").isNull() & (F.col("_p") >= 0), 0).otherwise(F.col("_p"))
    filled = dealt.withColumn("_i", F.explode(F.sequence(first, F.greatest(F.col("_p"), F.col("_next") - 1))))
    own = F.col("_i") == F.col("_p")
    place = lambda c: F.expr(f"CAST(_i div {step[c]} % {extent[c]} AS INT)")
    return filled.select(
        "seg",
        *[F.when(own, F.col(c)).otherwise(place(c)).alias(c) for c in at],
        *[F.when(own & ((F.col("_p") < 0) | F.col(c).isNotNull()), F.col(c)).otherwise(0).alias(c) for c in sums],
    )


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, w = PLANE_H, PLANE_W
    cells = samples(spark, sf_dir).select(
        "seg",
        F.floor(F.col("key") / (ORDERS_PER_SEG // h)).cast("int").alias("y"),
        (F.col("cross") % w).cast("int").alias("x"),
        "q",
        "d",
        F.lit(1).alias("n"),
    )
    summed = dense(cells, {"y": h, "x": w}, ["q", "d", "n"])
    per = F.greatest(F.col("n"), F.lit(1))
    return summed.select(
        "seg",
        F.lit(h).alias("h"),
        F.lit(w).alias("w"),
        "y",
        "x",
        F.floor(F.col("q") * 5 / per).cast("int").alias("a"),
        F.floor((F.col("q") * 3 + F.col("d") * 10) / per).cast("int").alias("b"),
        F.col("n").cast("int").alias("n"),
    )


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, h, w = VOL_D, VOL_H, VOL_W
    cells = samples(spark, sf_dir).select(
        "seg",
        (F.col("layer") * 3 + F.col("key") % 3).cast("int").alias("z"),
        F.floor(F.col("key") / (ORDERS_PER_SEG // h)).cast("int").alias("y"),
        (F.col("cross") % w).cast("int").alias("x"),
        "q",
        F.lit(1).alias("n"),
    )
    summed = dense(cells, {"z": d, "y": h, "x": w}, ["q", "n"])
    per = F.greatest(F.col("n"), F.lit(1))
    return summed.select(
        "seg",
        F.lit(d).alias("d"),
        F.lit(h).alias("h"),
        F.lit(w).alias("w"),
        "z",
        "y",
        "x",
        F.floor(F.col("q") * 5 / per).cast("int").alias("v"),
    )
