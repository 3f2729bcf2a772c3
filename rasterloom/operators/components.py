"""4-connected components of called cells.

Cells are labelled inside bounded blocks first; only block borders leave
labels to be merged, and those merge in a logarithmic number of star
contractions over the (small) graph of block labels. No segment is ever
gathered whole, whatever its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rasterloom.session import checkpoint

BLOCK = 256
STRIDE = 1 << 31


def _label_block(ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Smallest linear index reachable from each cell, by hooking and halving."""
    y0, x0 = ys.min(), xs.min()
    w = int(xs.max() - x0) + 3
    idx = (ys - y0 + 1) * w + (xs - x0 + 1)
    n = int(ys.max() - y0 + 3) * w
    lab = np.full(n, n, np.int64)
    lab[idx] = idx
    while True:
        near = np.minimum(
            np.minimum(lab[idx - 1], lab[idx + 1]), np.minimum(lab[idx - w], lab[idx + w])
        )
        own = lab[idx]
        best = np.minimum(own, near)
        if np.array_equal(best, own) and np.array_equal(lab[own], own):
            break
        np.minimum.at(lab, own, best)
        lab[idx] = lab[np.minimum(lab[idx], best)]
    root = lab[idx]
    return (root // w - 1 + y0).astype(np.int64) * STRIDE + (root % w - 1 + x0)


def _stars(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Contract an edge list until every node points at its component's smallest."""
    key = [*keys, "u"]
    edges = edges.select(*keys, "u", "v").distinct()
    if edges.isEmpty():
        return edges
    edges = checkpoint(edges)

    while True:
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*key).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, key).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy(*key).agg(F.min("v").alias("m"))
        small = large.join(low, key).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select(*keys, "u", F.col("m").alias("v")))
        now = checkpoint(small.where("u <> v").distinct())
        same = [*keys, "u", "v"]
        # done when not one row has changed
        if now.join(edges, same, "left_anti").isEmpty() and edges.join(now, same, "left_anti").isEmpty():
            return now
        edges = now


def label(cells: DataFrame, keys: list[str], block: int = BLOCK) -> DataFrame:
    """Add ``comp``, equal for cells of one 4-connected component of a group."""
    types = dict(cells.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "y int, x int, comp bigint"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[*keys, "y", "x"]].copy()
        out["comp"] = _label_block(pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64))
        return out

    spread = cells.select(*keys, "y", "x").withColumns(
        {"_by": F.floor(F.col("y") / block), "_bx": F.floor(F.col("x") / block)}
    )
    local = spread.groupBy(*keys, "_by", "_bx").applyInPandas(run, schema).persist()

    def seam(pos: str) -> DataFrame:
        last = local.where(F.col(pos) % block == block - 1).withColumn(pos, F.col(pos) + 1)
        first = local.where(F.col(pos) % block == 0).withColumnRenamed("comp", "v")
        return last.withColumnRenamed("comp", "u").join(first, [*keys, "y", "x"]).select(*keys, "u", "v")

    roots = _stars(seam("x").unionByName(seam("y")), keys)
    merged = roots.select(*keys, F.col("u").alias("comp"), F.col("v").alias("_root"))
    return local.join(merged, [*keys, "comp"], "left").select(
        *keys, "y", "x", F.coalesce("_root", "comp").alias("comp")
    )


def shapes(labelled: DataFrame, keys: list[str], least: int = 1) -> DataFrame:
    """Area, box, centroid, fill and aspect of every component."""
    g = labelled.groupBy(*keys, "comp").agg(
        F.count(F.lit(1)).alias("area"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.avg("y").alias("cy"), F.avg("x").alias("cx"),
    )
    bh, bw = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    return g.where(F.col("area") >= least).withColumns(
        {"fill": F.round(F.col("area") / (bh * bw), 3), "aspect": F.round(bw / bh, 3)}
    )


def strokelike(fill="fill", aspect="aspect"):
    """Thin inside its box and not too elongated: a stroke rather than a patch."""
    return F.col(fill).between(0.12, 0.60) & F.col(aspect).between(0.35, 2.8)
