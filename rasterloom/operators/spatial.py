"""Distance, overlap and gather joins on bucketed coordinates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rasterloom.operators.axis import COL, KEYS


def bucket_pairs(left: DataFrame, right: DataFrame, keys, coords: list[str], reach: float) -> DataFrame:
    """Pairs whose buckets of size ``reach`` touch along every axis.

    ``left`` is sent to the 3^d buckets around each point, ``right`` stays in its
    own; equal points of ``right`` should be collapsed by the caller.
    """
    lt, names = left, []
    for i, c in enumerate(coords):
        own = F.floor(F.col(c) / reach)
        lt = lt.withColumn(f"_b{i}", F.explode(F.sequence(own - 1, own + 1)))
        names.append(f"_b{i}")
    rt = right.select(
        *keys,
        *[F.floor(F.col(c) / reach).alias(n) for c, n in zip(coords, names)],
        *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys],
    )
    return lt.join(rt, [*keys, *names]).drop(*names)


def square_distance(coords: list[str]) -> Column:
    total = F.lit(0)
    for c in coords:
        d = F.col(c) - F.col(f"r_{c}")
        total = total + d * d
    return total


#: Side of a tile in reaches: points go to the tiles that their reach touches, about 1.4 of them in three dimensions.
SIDE = 16
#: Pairs that a task compares at once.
AT_ONCE = 1 << 20


def _tiles(df: DataFrame, coords: list[str], reach: float, side: float) -> DataFrame:
    """Rows once for every tile ``_t0, _t1, …`` that ``reach`` around their point touches; rows without a place go."""
    for i, c in enumerate(coords):
        at = lambda g: F.floor((F.col(c) + g) / side)  # noqa: B023, E731
        df = df.withColumn(f"_t{i}", F.explode(F.sequence(at(-reach), at(reach))) if reach else at(0.0)).where(F.col(f"_t{i}").isNotNull())
    return df


def _near(left: list[np.ndarray], right: list[np.ndarray], reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(left rows, right rows, square distances)`` of pairs within ``reach``, all of a left row's together.

    Right points are sorted by cells of the size of the reach; the cells beside one another along the last axis are
    one stretch, so a point asks for 3^(d-1) stretches.
    """
    ok = np.flatnonzero(np.logical_and.reduce([np.isfinite(v) for v in left]))
    known = np.flatnonzero(np.logical_and.reduce([np.isfinite(v) for v in right]))
    if not len(ok) or not len(known):
        return
    cell = lambda v: np.floor(v / reach).astype(np.int64)
    low = [min(cell(lv[ok]).min(), cell(rv[known]).min()) - 1 for lv, rv in zip(left, right)]
    size = [max(cell(lv[ok]).max(), cell(rv[known]).max()) + 2 - lo for lv, rv, lo in zip(left, right, low)]
    code = lambda cells: sum(c * int(np.prod(size[i + 1 :], dtype=np.int64)) for i, c in enumerate(cells))
    theirs = code([cell(v[known]) - lo for v, lo in zip(right, low)])
    order = np.argsort(theirs, kind="stable")
    known, theirs = known[order], theirs[order]
    own = [cell(v[ok]) - lo for v, lo in zip(left, low)]
    steps = [code([*o, 0]) for o in product((-1, 0, 1), repeat=len(left) - 1)]
    mid = code(own)
    first = np.stack([np.searchsorted(theirs, mid + k - 1, "left") for k in steps], axis=1)
    count = np.stack([np.searchsorted(theirs, mid + k + 1, "right") for k in steps], axis=1) - first
    upto, start = np.cumsum(count.sum(axis=1)), 0
    while start < len(ok):
        before = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, before + AT_ONCE, "right")))
        n = count[start:end].ravel()
        rows = np.repeat(np.repeat(ok[start:end], len(steps)), n)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[start:end].ravel(), n)
        others = known[place]
        d2 = 0
        for lv, rv in zip(left, right):
            d = lv[rows] - rv[others]
            d2 = d2 + d * d
        hit = d2 <= reach * reach
        yield rows[hit], others[hit], d2[hit]
        start = end


def nearest_within(
    left, right, keys, ident: list[str], coords: list[str], reach: float, per: str | None = None, later: str | None = None, side: int = SIDE, lonely: bool = False
) -> DataFrame:
    """Nearest ``right`` point within ``reach`` of every ``left`` point that has one.

    Ties go to the smallest coordinates. With ``per`` the nearest is taken for each value of that column of ``right``, of
    those greater than the column ``later`` of ``left``. A left point goes to one tile of ``side`` reaches, a right point to
    the few that its reach touches, and a tile is settled in its task: nothing is copied to buckets around a point and no
    pair is shuffled. Equal points of ``right`` become one in their tile; a caller whose right side repeats places often drops them first, so that on
    a voxel lattice a tile holds a bounded number of them. With
    ``lonely`` a left point that finds nothing has a row too, with nulls; ``ident`` and ``keys`` must hold the coordinates then.
    """
    one = [*keys, *coords, *([per] if per else [])]
    right = right.select(*one, *[c for c in right.columns if c not in one])
    # points of one place meet in one tile, where equal ones become one; others are told apart before
    if len(right.columns) > len(one):
        right = right.dropDuplicates(one)
    extra = [*coords, *[c for c in right.columns if c not in (*keys, *coords)]]
    right = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in extra])
    own = [*keys, *dict.fromkeys([*ident, *coords])]
    left = left.select(*own)
    for k in keys:
        left, right = left.where(F.col(k).isNotNull()), right.where(F.col(k).isNotNull())
    # a little more than the reach, for places that division by the side rounds
    theirs = [f"r_{c}" for c in coords]
    lt, rt = _tiles(left, coords, 0.0, reach * side), _tiles(right, theirs, reach * 1.001, reach * side)
    both = left.select(*coords).crossJoin(right.select(*theirs)).select(square_distance(coords).alias("d2"))
    kind = both.schema["d2"].dataType
    schema = T.StructType([*left.schema.fields, T.StructField("d2", kind), *right.schema.fields[len(keys) :]])
    number = {"int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[kind.simpleString()]

    r_all = [f"r_{c}" for c in extra]

    def settle(lefts: pa.Table, rights: pa.Table) -> pa.Table:
        lefts, rights = lefts.select(own).group_by(own, use_threads=False).aggregate([]).select(own), rights.select(r_all)
        rights = rights.group_by(r_all, use_threads=False).aggregate([]).select(r_all)
        # whole numbers in 64 bits
        at = lambda t, names: [v if v.dtype.kind == "f" else v.astype(np.int64) for v in (t[c].to_numpy() for c in names)]
        lv, rv = at(lefts, coords), at(rights, theirs)
        group = np.zeros(rights.num_rows, np.int64)
        if per:
            names = sorted({*rights[f"r_{per}"].to_pylist(), *(lefts[later].to_pylist() if later else ())} - {None})
            rank = lambda col: pc.fill_null(pc.index_in(col, pa.array(names, col.type)), -1).to_numpy()
            group = rank(rights[f"r_{per}"])
            floor = rank(lefts[later]) if later else None
        found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j, d2 in _near(lv, rv, reach):
            if per and later:
                ok = (floor[i] >= 0) & (group[j] > floor[i])
                i, j, d2 = i[ok], j[ok], d2[ok]
            order = np.lexsort([*[v[j] for v in reversed(rv)], d2, group[j], i])
            i, j, d2 = i[order], j[order], d2[order]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (group[j[1:]] != group[j[:-1]])
            for to, v in zip(found, (i, j, d2)):
                to.append(v[new])
        i, j, d2 = (np.concatenate(v) for v in found)
        near = rights.take(j)
        columns = [*lefts.take(i).columns, pa.array(d2).cast(number), *near.columns]
        out = pa.table(columns, names=[*own, "d2", *near.column_names])
        if lonely:
            rest = np.ones(lefts.num_rows, bool)
            rest[i] = False
            out = pa.concat_tables([out, lefts.filter(pa.array(rest))], promote_options="default")
        return out

    tile = [*keys, *[f"_t{i}" for i in range(len(coords))]]
    pairs = lt.groupBy(*tile).cogroup(rt.groupBy(*tile)).applyInArrow(settle, schema)
    out = [*keys, *ident, "d2", *[f"r_{c}" for c in extra]]
    if set(coords) <= {*ident, *keys}:
        return pairs.select(*out)
    # rows of one identity may stand at several places
    by = [*keys, *ident, *([f"r_{per}"] if per else [])]
    rest = [c for c in out if c not in by]
    best = F.min_by(F.struct(*rest), F.struct("d2", *theirs)).alias("_n")
    return pairs.groupBy(*by).agg(best).select(*by, "_n.*").select(*out)


def has_within(left, right, keys, coords: list[str], reach: float, strict: bool = True) -> DataFrame:
    """Semi-join: ``left`` rows with some ``right`` point inside ``reach``."""
    marked = left.withColumn("_id", F.monotonically_increasing_id()) if "id" not in left.columns else left.withColumn("_id", F.col("id"))
    pairs = bucket_pairs(marked, right.dropDuplicates([*keys, *coords]), keys, coords, reach)
    d2 = square_distance(coords)
    hit = pairs.where(d2 < reach * reach if strict else d2 <= reach * reach)
    return hit.select(*left.columns).distinct()


def overlapping_boxes(left: DataFrame, right: DataFrame, keys, size: int, slack: int = 0) -> DataFrame:
    """Box pairs that overlap (within ``slack``) on both axes.

    Every box is listed in the coarse tiles it covers; a pair is kept only in the
    first tile both share, so no pair is repeated and nothing is compared across
    a whole segment.
    """

    def tiled(df: DataFrame, grow: int) -> DataFrame:
        lo = lambda c: F.floor((F.col(c) - grow) / size)
        hi = lambda c: F.floor((F.col(c) + grow) / size)
        return df.withColumn("_ty", F.explode(F.sequence(lo("y0"), hi("y1")))).withColumn(
            "_tx", F.explode(F.sequence(lo("x0"), hi("x1")))
        )

    rt = tiled(right, 0)
    rt = rt.select(*keys, "_ty", "_tx", *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    lt = tiled(left, slack)
    first = lambda a, b: F.floor(F.greatest(F.col(a) - slack, F.col(b)) / size)
    apart = (
        (F.col("y0") - slack > F.col("r_y1")) | (F.col("r_y0") - slack > F.col("y1"))
        | (F.col("x0") - slack > F.col("r_x1")) | (F.col("r_x0") - slack > F.col("x1"))
    )
    same_first = (F.col("_ty") == first("y0", "r_y0")) & (F.col("_tx") == first("x0", "r_x0"))
    return lt.join(rt, [*keys, "_ty", "_tx"]).where(~apart & same_first).drop("_ty", "_tx")


def line_distance(df: DataFrame, mask: str, keys=KEYS) -> DataFrame:
    """Steps to the nearest cell outside the mask along the column; null if none."""
    win = COL.window(keys)
    off = F.when(~F.col(mask), F.col("y"))
    above = F.last(off, ignorenulls=True).over(win.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(off, ignorenulls=True).over(win.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("_g", F.least(F.col("y") - above, below - F.col("y")))


def distance_within(df: DataFrame, mask: str, reach: int, out: str, keys=KEYS) -> DataFrame:
    """Euclidean distance to the outside, exact up to ``reach`` and null beyond.

    Enough for a threshold test, and stays in the JVM: the column pass is two
    running windows, the row pass looks at ``reach`` neighbours either side.
    """
    df = line_distance(df, mask, keys)
    win = Window.partitionBy(*keys, "y").orderBy("x")
    g2 = F.col("_g") * F.col("_g")
    df = df.withColumn("_g2", F.when(F.col("_g") <= reach, g2))
    terms = [F.col("_g2")]
    for k in range(1, reach + 1):
        terms += [F.lag("_g2", k).over(win) + k * k, F.lead("_g2", k).over(win) + k * k]
    d2 = F.least(*terms)
    return df.withColumn(out, F.when(d2 <= reach * reach, F.sqrt(d2))).drop("_g", "_g2")


def _envelope(f: np.ndarray) -> np.ndarray:
    """min over q of (p-q)^2 + f[q] along one line, by the lower envelope of parabolas."""
    n = len(f)
    seen = np.flatnonzero(np.isfinite(f))
    if len(seen) == 0:
        return np.full(n, np.nan)
    hull, cuts = [], []
    for q in seen:
        while hull:
            p = hull[-1]
            s = ((f[q] + q * q) - (f[p] + p * p)) / (2.0 * (q - p))
            if cuts and s <= cuts[-1]:
                hull.pop()
                cuts.pop()
                continue
            cuts.append(s)
            break
        hull.append(q)
    owner = np.asarray(hull)[np.searchsorted(np.asarray(cuts), np.arange(n), side="left")]
    return (np.arange(n) - owner) ** 2 + f[owner]


def distance(df: DataFrame, mask: str, out: str, keys=KEYS) -> DataFrame:
    """Exact Euclidean distance to the outside of the mask (null if nothing is outside)."""
    df = line_distance(df, mask, keys)
    line = df.groupBy(*keys, "y").agg(
        F.array_sort(F.collect_list(F.struct("x", (F.col("_g") * F.col("_g")).cast("double").alias("g")))).alias("line")
    )

    def solve(lines: pd.Series) -> pd.Series:
        res = []
        for cells in lines:
            g = np.array([np.nan if c["g"] is None else c["g"] for c in cells], float)
            g[np.isnan(g)] = np.inf
            res.append([None if np.isnan(v) else float(np.sqrt(v)) for v in _envelope(g)])
        return pd.Series(res)

    solved = line.withColumn("_d", F.pandas_udf(solve, "array<double>")("line"))
    dist = solved.select(*keys, "y", F.explode(F.arrays_zip(F.col("line.x").alias("x"), F.col("_d").alias("d"))).alias("e"))
    dist = dist.select(*keys, "y", F.col("e.x").alias("x"), F.col("e.d").alias(out))
    return df.drop("_g").join(dist, [*keys, "y", "x"])


def chunked(vol: DataFrame, cz: int, cy: int, cx: int) -> DataFrame:
    """Pack voxels into byte chunks, zero-filled, C order.

    Only non-zero voxels travel, each to the task that fills its chunk; an empty
    chunk is never stored. Values outside 0..255 are an error.
    """
    size = cz * cy * cx
    pos = (F.col("z") % cz * cy + F.col("y") % cy) * cx + F.col("x") % cx
    at = lambda c, n: F.floor(F.col(c) / n).cast("int")

    def fill(key, cells):
        v = cells["v"].to_numpy()
        if v.min() < 0 or v.max() > 255:
            raise ValueError(f"not a byte: {v.min() if v.min() < 0 else v.max()}")
        block = np.zeros(size, np.uint8)
        block[cells["p"].to_numpy()] = v
        return pa.table({**{n: [k.as_py()] for n, k in zip(CHUNK_KEY, key)}, "data": [block.tobytes()]}, _CHUNKS)

    cells = vol.where("v <> 0").select(
        "seg", at("z", cz).alias("cz"), at("y", cy).alias("cy"), at("x", cx).alias("cx"), pos.cast("int").alias("p"), F.col("v").cast("long").alias("v")
    )
    return cells.groupBy(*CHUNK_KEY).applyInArrow(fill, "seg string, cz int, cy int, cx int, data binary")


CHUNK_KEY = ["seg", "cz", "cy", "cx"]
_CHUNKS = pa.schema([("seg", pa.string()), ("cz", pa.int32()), ("cy", pa.int32()), ("cx", pa.int32()), ("data", pa.binary())])


def byte_sum(data: Column) -> Column:
    """Sum of the bytes of each payload."""

    def total(col: pd.Series) -> pd.Series:
        return col.map(lambda b: int(np.frombuffer(b, np.uint8).sum(dtype=np.int64)))

    return F.pandas_udf(total, "bigint")(data)


def gather(points: DataFrame, chunks: DataFrame, cz: int, cy: int, cx: int) -> DataFrame:
    """Nearest voxel of every point ``(seg, pz, py, px)``; 0 where nothing is stored.

    The points of a chunk meet its one payload in a task; no payload is copied per point.
    """
    z, y, x = (F.rint(c).cast("int") for c in ("pz", "py", "px"))
    p = points.withColumns({"_z": z, "_y": y, "_x": x}).withColumns(
        {
            "cz": F.floor(F.col("_z") / cz).cast("int"),
            "cy": F.floor(F.col("_y") / cy).cast("int"),
            "cx": F.floor(F.col("_x") / cx).cast("int"),
            "_p": ((F.pmod("_z", F.lit(cz)) * cy + F.pmod("_y", F.lit(cy))) * cx + F.pmod("_x", F.lit(cx))).cast("int"),
        }
    ).drop("_z", "_y", "_x")
    names = points.columns

    def read(left, right):
        own = left.select(names)
        at = left["_p"].to_numpy()
        v = np.frombuffer(right["data"][0].as_py(), np.uint8)[at] if right.num_rows else np.zeros(len(at), np.uint8)
        return own.append_column("v", pa.array(v.astype(np.int32)))

    schema = T.StructType([*points.schema.fields, T.StructField("v", T.IntegerType())])
    return p.groupBy(*CHUNK_KEY).cogroup(chunks.select(*CHUNK_KEY, "data").groupBy(*CHUNK_KEY)).applyInArrow(read, schema)
