"""Templates cut from components, and the best match of a whole bank at every place."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rasterloom.session import checkpoint

#: Templates of a group, anchors along a side of a block, and blocks that meet a group in one task.
GROUP, BLOCK, STRIP = 1 << 15, 32, 1024
#: Templates that are compared with a block at once, and what single precision may be off by (unit vectors of a few hundred cells).
AT_ONCE, OFF = 4096, 1e-5
#: A cell that its block lacks.
ABSENT = np.iinfo(np.int64).min


def resample_shapes(cells: DataFrame, shapes: DataFrame, rows: int, cols: int, keys=("seg", "comp")) -> DataFrame:
    """Masks of ragged boxes brought to one box of ``rows`` x ``cols``, exact by area.

    ``cells`` are the mask's cells ``keys, y, x``, ``shapes`` the boxes ``keys, y0, y1, x0, x1``. A cell adds the area that it
    covers of each target cell; the result ``keys, r, c, v`` holds that share in 255ths, target cells without any
    mask left out. All in whole numbers.
    """

    def spread(df: DataFrame, pos: str, lo: str, n: str, target: int, to: str, over: str) -> DataFrame:
        i = F.col(pos) - F.col(lo)
        first, last = F.floor(i * target / F.col(n)), F.ceil((i + 1) * target / F.col(n)) - 1
        df = df.withColumn(to, F.explode(F.sequence(first, last)))
        near, far = F.greatest(i * target, F.col(to) * F.col(n)), F.least((i + 1) * target, (F.col(to) + 1) * F.col(n))
        return df.withColumn(over, far - near)

    box = shapes.select(*keys, "y0", "x0", (F.col("y1") - F.col("y0") + 1).alias("bh"), (F.col("x1") - F.col("x0") + 1).alias("bw"))
    df = cells.join(box, list(keys))
    df = spread(df, "y", "y0", "bh", rows, "r", "_oy")
    df = spread(df, "x", "x0", "bw", cols, "c", "_ox")
    whole = df.groupBy(*keys, "r", "c", "bh", "bw").agg(F.sum(F.col("_oy") * F.col("_ox")).alias("_s"))
    value = F.floor(F.col("_s") * 255 / (F.col("bh") * F.col("bw")))
    return whole.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), value.cast("int").alias("v"))


def bank_of(templates: DataFrame, rows: int, cols: int, keys=("seg", "comp")) -> DataFrame:
    """One row per template, ``id`` and ``t`` (its cells row by row), dealt to groups ``g`` of about ``GROUP``."""
    entries = F.collect_list(F.struct((F.col("r") * cols + F.col("c")).alias("at"), "v"))
    packed = templates.groupBy(*keys).agg(F.map_from_entries(entries).alias("m"))
    cell = F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    packed = checkpoint(packed.select(F.concat_ws(":", *keys).alias("id"), cell.alias("t")))
    return packed.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-packed.count() // GROUP)))))


def bank_response(plane: DataFrame, value: str, bank: DataFrame, rows: int, cols: int, least: float) -> DataFrame:
    """Best normalised correlation with any template of the bank: ``seg, y, x, id, r`` where it is ``least`` or more.

    ``y, x`` is the window's first cell. The plane is cut into blocks that overlap by a window, and equal templates count once.
    Every strip of blocks meets every group of templates in one task, so a packed block travels once for each
    of the few groups, a group once for each strip, and only the best match per place and group goes on; the
    bank may be as large as it likes. Flat windows and flat templates match nothing; equal matches go to the smallest id.
    """
    starts = lambda c, reach: F.explode(
        F.array_distinct(F.array(F.floor(F.greatest(F.col(c) - reach + 1, F.lit(0)) / BLOCK), F.floor(F.col(c) / BLOCK)))
    )
    cut = plane.select("seg", "y", "x", F.col(value).alias("v"), starts("y", rows).alias("by")).withColumn("bx", starts("x", cols))
    cells = F.collect_list(F.struct((F.col("y") - F.col("by") * BLOCK).alias("y"), (F.col("x") - F.col("bx") * BLOCK).alias("x"), "v"))
    blocks = cut.groupBy("seg", "by", "bx").agg(cells.alias("cells"))
    high, wide = BLOCK + rows - 1, BLOCK + cols - 1

    def pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for cells in batch.column(3):
                ys, xs, vs = (np.asarray(cells.values.field(c), np.int64) for c in ("y", "x", "v"))
                window = np.full((high, wide), ABSENT)
                window[ys, xs] = vs
                data.append(zlib.compress(window.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], ["seg", "by", "bx", "data"])

    def pack_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            names = pa.ListArray.from_arrays(lists.offsets, lists.values.field("id"))
            data = [zlib.compress(np.asarray(b.values.field("t").flatten(), np.int64).tobytes(), 1) for b in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), names, pa.array(data, pa.binary())], ["g", "names", "data"])

    one = bank.groupBy("t").agg(F.min(F.struct("id", "g")).alias("e")).select("e.id", "e.g", "t")
    groups = one.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("id", "t"))).alias("bank"))
    groups = checkpoint(groups.select("g", "bank").mapInArrow(pack_groups, "g long, names array<string>, data binary"))
    blocks = checkpoint(blocks.mapInArrow(pack_blocks, "seg string, by long, bx long, data binary"))
    strips = max(1, -(-blocks.count() // STRIP))
    tasks = max(1, min(strips * groups.count(), 1 << 14))
    numbers = F.array_sort(F.collect_set("g")).alias("gs")
    lefts = blocks.withColumn("s", F.pmod(F.xxhash64("seg", "by", "bx"), F.lit(strips))).crossJoin(F.broadcast(groups.agg(numbers)))
    lefts = lefts.select("s", F.explode("gs").alias("g"), "seg", "by", "bx", "data").repartition(tasks, "s", "g")
    rights = groups.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(strips - 1).cast("long"))).alias("s"), "g", "names", "data").repartition(tasks, "s", "g")

    def run(strip: pa.Table, group: pa.Table) -> pa.Table:
        found = [_FOUND.empty_table()]
        if strip.num_rows and group.num_rows:
            bank = _Bank(group["names"][0].values.to_pylist(), np.frombuffer(zlib.decompress(group["data"][0].as_py()), np.int64).reshape(-1, rows * cols))
            for r in strip.select(["seg", "by", "bx", "data"]).to_pylist():
                window = np.frombuffer(zlib.decompress(r["data"]), np.int64).reshape(high, wide)
                at, which, value = bank.best(window, rows, cols, least)
                y, x = at // BLOCK + r["by"] * BLOCK, at % BLOCK + r["bx"] * BLOCK
                names = [bank.names[k] for k in which]
                found.append(pa.table([pa.array([r["seg"]] * len(at), pa.string()), pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(names, pa.string()), pa.array(value, pa.float64())], schema=_FOUND))
        return pa.concat_tables(found)

    found = lefts.groupBy("s", "g").cogroup(rights.groupBy("s", "g")).applyInArrow(run, "seg string, y int, x int, id string, r double")
    best = F.min_by(F.struct("id", "r"), F.struct(-F.col("r"), F.col("id")))
    return found.groupBy("seg", "y", "x").agg(best.alias("b")).select("seg", "y", "x", "b.id", "b.r")


_FOUND = pa.schema([("seg", pa.string()), ("y", pa.int32()), ("x", pa.int32()), ("id", pa.string()), ("r", pa.float64())])


class _Bank:
    """A group of templates, smallest ids first, and their unit vectors."""

    def __init__(self, names: list[str], t: np.ndarray):
        n = t.shape[1]
        self.st = t.sum(axis=1)
        vt = n * (t * t).sum(axis=1) - self.st * self.st
        keep = np.flatnonzero(vt > 0)
        self.names, self.t, self.st, self.vt = [names[k] for k in keep], t[keep], self.st[keep], vt[keep]
        self.unit = ((n * self.t - self.st[:, None]) / np.sqrt(n * self.vt)[:, None]).astype(np.float32)

    def best(self, window: np.ndarray, rows: int, cols: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(anchors, templates, correlations)`` of a block, one for each anchor that reaches ``least``.

        Single precision proposes all templates that may be the best one; those are settled exactly.
        """
        n = rows * cols
        views = np.lib.stride_tricks.sliding_window_view(window, (rows, cols)).reshape(-1, n)
        at = np.flatnonzero((views != ABSENT).all(axis=1))
        p = views[at]
        sp = p.sum(axis=1)
        vp = n * (p * p).sum(axis=1) - sp * sp
        at, p, sp, vp = at[vp > 0], p[vp > 0], sp[vp > 0], vp[vp > 0]
        unit = ((n * p - sp[:, None]) / np.sqrt(n * vp)[:, None]).astype(np.float32)
        value, which = np.full(len(at), -2.0), np.zeros(len(at), np.int64)
        for k in range(0, len(self.names), AT_ONCE):
            near = unit @ self.unit[k : k + AT_ONCE].T
            top = near.max(axis=1)
            ok = np.flatnonzero(top >= np.maximum(least, value) - OFF)
            i, j = np.nonzero(near[ok] >= (top[ok] - 2 * OFF)[:, None])
            i, j = ok[i], j + k
            r = (n * (p[i] * self.t[j]).sum(axis=1) - sp[i] * self.st[j]) / (np.sqrt(vp[i]) * np.sqrt(self.vt[j]))
            r = np.round(r, 9)
            order = np.lexsort((j, -r, i))
            i, j, r = i[order], j[order], r[order]
            new = np.ones(len(i), bool)
            new[1:] = i[1:] != i[:-1]
            i, j, r = i[new], j[new], r[new]
            better = r > value[i]
            value[i[better]], which[i[better]] = r[better], j[better]
        hit = value >= least
        return at[hit], which[hit], value[hit]
