"""Chunked array stores on any file system, read and written as relations.

A store is ``<root>/<volume>/<level>/`` with a ``.zarray`` sidecar and a file per chunk; volumes may
differ in shape, chunk size, dtype and packing, which travel as columns. Only the
names of volumes are listed on the driver. Sidecars are read in tasks, wanted chunks are
computed from them without listing, and partitions are cut by bytes over all volumes.

Writing has two steps. Tasks stage chunk files beside the store; when all are done, whole level
folders are moved into place and their sidecars follow. A reader finds a
level by its sidecar, so a job that dies, or a task that is killed, leaves nothing to be
seen. Files go through Arrow's file systems: ``file:``, ``hdfs:``, ``s3:``, ``gs:`` or a plain path.
"""

from __future__ import annotations

import json
import math
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rasterloom.session import checkpoint

LEVELS = "vol string, level int, path string, shape array<long>, chunks array<long>, dtype string, packed boolean, sep string"
CHUNK = "vol string, level int, cz long, cy long, cx long, shape array<long>, chunks array<long>, dtype string, data binary"
#: Dtypes that are read, and the attribute that counts a sidecar's versions.
DTYPES = {"|u1": "u1", "u1": "u1", "uint8": "u1", "<u2": "<u2", "uint16": "<u2", "<i2": "<i2", "<f4": "<f4"}
VERSION = "attributes_version"
#: Bytes of decoded chunks that one task should read.
SPLIT = 64 << 20
STAGE = ".staged-"


class Conflict(RuntimeError):
    """Attributes were changed by somebody else since they were read."""


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a root; a plain path is local."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def _load(fs: pafs.FileSystem, path: str) -> bytes | None:
    try:
        with fs.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


def _json(fs: pafs.FileSystem, path: str):
    raw = _load(fs, path)
    try:
        return None if raw is None else json.loads(raw)
    except ValueError:
        return None


def _save(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Whole or not at all: a reader never sees half a file."""
    tmp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as f:
        f.write(data)
    fs.move(tmp, path)


def names(root: str) -> list[str]:
    """Volumes of a store: its folders whose name does not start with a dot."""
    fs, base = opened(root)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    return sorted(i.base_name for i in found if i.type == pafs.FileType.Directory and not i.base_name.startswith("."))


def _mapped(spark: SparkSession, rows: list[str], run, schema: str) -> DataFrame:
    parts = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame([(r,) for r in rows], "name string").repartition(parts)
    return table.mapInArrow(run, schema)


def levels(spark: SparkSession, root: str) -> DataFrame:
    """One row per level of every volume, from its sidecars; levels that cannot be read are an error.

    Order and names come from the multiscale attributes, or are all numbered folders. A level needs three axes
    or two, which count as one layer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            out = []
            for vol in batch.column(0).to_pylist():
                attrs = _json(fs, f"{base}/{vol}/.zattrs") or {}
                sets = attrs.get("multiscales") or [{}]
                paths = [d["path"] for d in sets[0].get("datasets", []) if isinstance(d.get("path"), str)] if isinstance(sets[0], dict) else []
                ranked = list(enumerate(paths))
                if not paths:
                    # a folder's number is its level: one that holds nothing is missing, and the others keep theirs
                    held = fs.get_file_info(pafs.FileSelector(f"{base}/{vol}"))
                    ranked = sorted((int(i.base_name), i.base_name) for i in held if i.base_name.isdigit())
                for i, name in ranked:
                    meta = _json(fs, f"{base}/{vol}/{name}/.zarray")
                    if meta is not None and len(meta["shape"]) in (2, 3):
                        out.append(_level(vol, i, f"{vol}/{name}", meta))
            yield pa.RecordBatch.from_pylist(out, schema=_LEVELS)

    return _mapped(spark, names(root), run, LEVELS)


_LEVELS = pa.schema(
    [("vol", pa.string()), ("level", pa.int32()), ("path", pa.string()), ("shape", pa.list_(pa.int64())), ("chunks", pa.list_(pa.int64()))]
    + [("dtype", pa.string()), ("packed", pa.bool_()), ("sep", pa.string())]
)


def _level(vol: str, i: int, path: str, meta: dict) -> dict:
    kind = (meta.get("compressor") or {}).get("id")
    if kind not in (None, "zlib") or meta.get("filters") or meta.get("order", "C") != "C" or meta["dtype"] not in DTYPES:
        raise ValueError(f"unsupported array {path}: {meta}")
    one = [1] * (3 - len(meta["shape"]))
    sep = meta.get("dimension_separator", ".")
    return {
        "vol": vol, "level": i, "path": path, "shape": one + meta["shape"], "chunks": one + meta["chunks"],
        "dtype": DTYPES[meta["dtype"]], "packed": kind == "zlib", "sep": sep if not one else "2" + sep,
    }


def wanted(level_rows: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """Chunk places of the levels, or of those that touch the boxes ``vol, level, z0, z1, y0, y1, x0, x1`` (ends exclusive).

    Each level's own chunk size decides; boxes are cut to the array and a chunk wanted by several boxes appears once.
    """
    df = level_rows
    if boxes is not None:
        df = df.join(boxes.select("vol", "level", *[f"{c}{e}" for c in "zyx" for e in (0, 1)]), ["vol", "level"])
    for k, c in enumerate("zyx"):
        size, step = F.col("shape")[k], F.col("chunks")[k]
        lo = F.greatest(F.col(f"{c}0"), F.lit(0)) if boxes is not None else F.lit(0)
        hi = F.least(F.col(f"{c}1"), size) if boxes is not None else size
        first, last = F.floor(lo / step).cast("long"), F.floor((hi - 1) / step).cast("long")
        df = df.where(hi > lo).withColumn(f"c{c}", F.explode(F.sequence(first, last)))
    df = df.select(*level_rows.columns, "cz", "cy", "cx")
    return df.dropDuplicates(["vol", "level", "cz", "cy", "cx"]) if boxes is not None else df


def _bytes(dtype: Column) -> Column:
    return F.when(dtype == "u1", 1).when(dtype == "<f4", 4).otherwise(2)


def read(places: DataFrame, root: str, split: int = SPLIT) -> DataFrame:
    """The chunks at ``places`` that were written, with their shape, chunk size and dtype.

    Places are dealt to tasks so that each reads about ``split`` bytes once unpacked, however they lie over volumes.
    """
    volume = F.col("chunks")[0] * F.col("chunks")[1] * F.col("chunks")[2] * _bytes(F.col("dtype"))
    total, count = places.agg(F.sum(volume), F.count(F.lit(1))).first()
    # opening files costs too: small ones are spread over the cores that are there
    least = min(places.sparkSession.sparkContext.defaultParallelism, count // 32)
    dealt = places.repartition(max(1, math.ceil((total or 0) / split), least), "vol", "level", "cz", "cy", "cx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            out, held = [], 0
            for r in batch.to_pylist():
                flat = r["sep"].startswith("2")
                at = r["sep"][-1].join(str(r[c]) for c in (("cy", "cx") if flat else ("cz", "cy", "cx")))
                raw = _load(fs, f"{base}/{r['path']}/{at}")
                if raw is None:
                    continue
                data = zlib.decompress(raw) if r["packed"] else raw
                out.append({**{k: r[k] for k in ("vol", "level", "cz", "cy", "cx", "shape", "chunks", "dtype")}, "data": data})
                held += len(data)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema=_CHUNK)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=_CHUNK)

    return dealt.mapInArrow(run, CHUNK)


_CHUNK = pa.schema(
    [("vol", pa.string()), ("level", pa.int32()), ("cz", pa.int64()), ("cy", pa.int64()), ("cx", pa.int64())]
    + [("shape", pa.list_(pa.int64())), ("chunks", pa.list_(pa.int64())), ("dtype", pa.string()), ("data", pa.binary())]
)
_VOXEL = pa.schema([("vol", pa.string()), ("level", pa.int32()), ("z", pa.int32()), ("y", pa.int32()), ("x", pa.int32()), ("v", pa.float64())])


def voxels(chunks: DataFrame, keep_zero: bool = True) -> DataFrame:
    """Cells ``vol, level, z, y, x, v`` of chunks, each by its own size and dtype, trimmed to the array.

    A payload of another size than its chunk is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, held = [], 0
            for r in batch.to_pylist():
                dims = r["chunks"]
                if r["data"] is None or len(r["data"]) != np.prod(dims) * np.dtype(r["dtype"]).itemsize:
                    raise ValueError(f"chunk {r['cz']}.{r['cy']}.{r['cx']} of {r['vol']} has {len(r['data'] or b'')} bytes")
                block = np.frombuffer(r["data"], r["dtype"]).reshape(dims)
                start = [r[c] * d for c, d in zip(("cz", "cy", "cx"), dims)]
                block = block[tuple(slice(0, max(0, s - a)) for s, a in zip(r["shape"], start))]
                at = np.nonzero(block) if not keep_zero else np.indices(block.shape).reshape(3, -1)
                parts.append((r["vol"], r["level"], [a + s for a, s in zip(at, start)], block[tuple(at)]))
                held += len(at[0])
                if held > 1 << 19:
                    yield _cells(parts)
                    parts, held = [], 0
            if parts:
                yield _cells(parts)

    return chunks.mapInArrow(run, "vol string, level int, z int, y int, x int, v double")


def _cells(parts: list) -> pa.RecordBatch:
    n = [len(v) for *_, v in parts]
    vol = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(parts)), n), pa.array([p[0] for p in parts], pa.string())).dictionary_decode()
    level = np.repeat(np.array([p[1] for p in parts], np.int32), n)
    at = [pa.array(np.concatenate([p[2][k] for p in parts]).astype(np.int32)) for k in range(3)]
    return pa.RecordBatch.from_arrays([vol, pa.array(level), *at, pa.array(np.concatenate([p[3] for p in parts]).astype(np.float64))], schema=_VOXEL)


def pack(cells: DataFrame, dtype: str = "u1", run_bytes: int = 1 << 20) -> DataFrame:
    """Cells ``vol, level, z, y, x, v`` with ``shape`` and ``chunks`` (arrays) as chunks; those without any value are not made, nor levels without any.

    Runs of neighbouring chunks, about ``run_bytes`` together, are filled in one call, so small chunks do not cost a call each
    and a task never holds a plane.
    """
    dims = [F.col("chunks")[k] for k in range(3)]
    place = {c: F.floor(F.col(p) / d).cast("long") for c, p, d in zip(("cz", "cy", "cx"), "zyx", dims)}
    per = F.greatest(F.lit(1), F.floor(run_bytes / (dims[0] * dims[1] * dims[2] * np.dtype(dtype).itemsize)))
    wide = [F.ceil(F.col("shape")[k] / dims[k]) for k in range(3)]
    number = (F.col("cz") * wide[1] + F.col("cy")) * wide[2] + F.col("cx")
    df = cells.where("v <> 0").withColumns(place).withColumn("_n", number).withColumn("_run", F.floor(F.col("_n") / per))
    df = df.select("vol", "level", "cz", "cy", "cx", "_n", "_run", "z", "y", "x", "v", "shape", "chunks")

    def fill(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        d = first["chunks"]
        col = lambda c: table[c].to_numpy()
        at = ((col("z") % d[0]) * d[1] + col("y") % d[1]) * d[2] + col("x") % d[2]
        _, one, index = np.unique(col("_n"), return_index=True, return_inverse=True)
        blocks = np.zeros((len(one), int(np.prod(d))), dtype)
        blocks[index, at] = col("v")
        same = {k: first[k] for k in ("vol", "level", "shape", "chunks")} | {"dtype": dtype}
        places = zip(*[col(c)[one].tolist() for c in ("cz", "cy", "cx")], blocks)
        return pa.Table.from_pylist([{**same, "cz": z, "cy": y, "cx": x, "data": b.tobytes()} for z, y, x, b in places], schema=_CHUNK)

    return df.groupBy("vol", "level", "_run").applyInArrow(fill, CHUNK)


def write(chunks: DataFrame, root: str, attributes: DataFrame | None = None, flat: bool = False) -> int:
    """Write chunks as zlib-packed arrays, all or nothing per level; returns the number of chunk files.

    ``attributes`` are rows ``vol, attrs`` (JSON objects) merged into the volumes' ``.zattrs``. ``flat`` stores the single layer of two-axis
    arrays. A level that exists is replaced whole. On failure the staged files are removed and the store is as before.
    """
    stage = f"{STAGE}{uuid.uuid4().hex}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        made = set()
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                folder = f"{base}/{stage}/{r['vol']}/{r['level']}"
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                at = (r["cy"], r["cx"]) if flat else (r["cz"], r["cy"], r["cx"])
                _save(fs, f"{folder}/{'.'.join(map(str, at))}", zlib.compress(r["data"], 6))
                done.append({k: r[k] for k in ("vol", "level", "shape", "chunks", "dtype")})
            yield pa.RecordBatch.from_pylist(done, schema=_STAGED)

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            for r in batch.to_pylist():
                _publish(fs, base, stage, r, flat)
            yield batch.select(["vol", "level", "n"])

    fs, base = opened(root)
    fs.create_dir(f"{base}/{stage}", recursive=True)
    try:
        staged = chunks.mapInArrow(put, "vol string, level int, shape array<long>, chunks array<long>, dtype string")
        # the first action writes everything; only then is a level moved
        tally = checkpoint(staged.groupBy("vol", "level", "shape", "chunks", "dtype").agg(F.count(F.lit(1)).alias("n")))
        total = tally.repartition(max(1, min(64, tally.count()))).mapInArrow(publish, "vol string, level int, n long").agg(F.sum("n")).first()[0]
        if attributes is not None:
            merge_attributes(attributes, root)
        return total or 0
    finally:
        fs.delete_dir(f"{base}/{stage}")


_STAGED = pa.schema([("vol", pa.string()), ("level", pa.int32()), ("shape", pa.list_(pa.int64())), ("chunks", pa.list_(pa.int64())), ("dtype", pa.string())])


def _publish(fs, base: str, stage: str, r: dict, flat: bool) -> None:
    source, target = f"{base}/{stage}/{r['vol']}/{r['level']}", f"{base}/{r['vol']}/{r['level']}"
    cut = slice(1, None) if flat else slice(None)
    # The on-disk sidecar format, version 2.
    meta = {
        "zarr_format": 2, "shape": r["shape"][cut], "chunks": r["chunks"][cut], "dtype": "|u1" if r["dtype"] == "u1" else r["dtype"],
        "compressor": {"id": "zlib", "level": 6}, "fill_value": 0, "order": "C", "filters": None, "dimension_separator": ".",
    }
    if fs.get_file_info(source).type == pafs.FileType.Directory:
        if fs.get_file_info(target).type == pafs.FileType.Directory:
            # hidden first: a reader sees the old level, none, or the new one
            if fs.get_file_info(f"{target}/.zarray").type == pafs.FileType.File:
                fs.delete_file(f"{target}/.zarray")
            fs.delete_dir(target)
        fs.create_dir(f"{base}/{r['vol']}", recursive=True)
        fs.move(source, target)
    # also after a task that died between the move and here
    _save(fs, f"{target}/.zarray", json.dumps(meta).encode())


def read_attributes(spark: SparkSession, root: str) -> DataFrame:
    """``vol, version, attrs``: every volume's attributes as JSON text, and how often they were changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            vols = batch.column(0).to_pylist()
            found = [_json(fs, f"{base}/{v}/.zattrs") or {} for v in vols]
            versions = [int(a.pop(VERSION, 0)) for a in found]
            yield pa.RecordBatch.from_arrays([pa.array(vols, pa.string()), pa.array(versions, pa.int64()), pa.array(map(json.dumps, found), pa.string())], ["vol", "version", "attrs"])

    return _mapped(spark, names(root), run, "vol string, version long, attrs string")


def _merged(old: dict, new: dict) -> dict:
    out = dict(old)
    for k, v in new.items():
        out[k] = _merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def merge_attributes(patches: DataFrame, root: str) -> None:
    """Merge JSON objects (``vol, attrs`` and, if given, ``version``) into the stored attributes; all other keys survive.

    Nested objects are merged key by key. With a ``version`` a volume is changed only if nobody else has
    changed it since: else the job fails with ``Conflict`` for that volume. A patch that is already there changes nothing, so a
    task that is run again does no harm.
    """
    has_version = "version" in patches.columns
    rows = patches.select("vol", "attrs", (F.col("version") if has_version else F.lit(None)).cast("long").alias("version"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(root)
        for batch in batches:
            for r in batch.to_pylist():
                path, patch = f"{base}/{r['vol']}/.zattrs", json.loads(r["attrs"])
                old = _json(fs, path) or {}
                version = int(old.get(VERSION, 0))
                new = _merged(old, patch)
                if new == old:
                    continue
                if r["version"] is not None and r["version"] != version:
                    raise Conflict(f"attributes of {r['vol']} are at version {version}, not {r['version']}")
                fs.create_dir(f"{base}/{r['vol']}", recursive=True)
                _save(fs, path, json.dumps({**new, VERSION: version + 1}).encode())
            yield batch.select(["vol"])

    rows.mapInArrow(run, "vol string").agg(F.count("vol")).first()


class OverBudget(RuntimeError):
    """A request would read more than it may; nothing was read."""


def on_levels(points: DataFrame, level_rows: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Points ``vol, pz, py, px`` (cells of the finest level) as cells ``iz, iy, ix`` of every level, or of the levels ``only`` (``vol, level``), with their chunk; those outside are left out."""
    base = level_rows.where("level = 0").select("vol", F.col("shape").alias("_base"))
    df = level_rows.join(base, "vol")
    # points made by explode look small, so only the merge keeps them out of a broadcast
    df = points.hint("merge").join(df if only is None else df.join(only, ["vol", "level"]), "vol")
    for k, c in enumerate("zyx"):
        factor = F.greatest(F.floor(F.col("_base")[k] / F.col("shape")[k] + 0.5), F.lit(1))
        df = df.withColumn(f"i{c}", F.floor(F.col(f"p{c}") / factor).cast("long"))
        df = df.where((F.col(f"i{c}") >= 0) & (F.col(f"i{c}") < F.col("shape")[k]))
        df = df.withColumn(f"c{c}", F.floor(F.col(f"i{c}") / F.col("chunks")[k]).cast("long"))
    return df.drop("_base")


def places(points: DataFrame) -> DataFrame:
    """The places ``vol, pz, py, px`` that points ask for, each once: what they touch is told by these, however many points share one."""
    return points.select("vol", "pz", "py", "px").distinct()


def price(placed: DataFrame) -> DataFrame:
    """What gathering costs at each level: ``vol, level, n_chunks, cost`` in bytes once unpacked, from chunk numbers alone."""
    keys = placed.select("vol", "level", "chunks", "dtype", "cz", "cy", "cx").distinct()
    size = F.col("chunks")[0] * F.col("chunks")[1] * F.col("chunks")[2] * _bytes(F.col("dtype"))
    return keys.groupBy("vol", "level").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(size).cast("long").alias("cost"))


def affordable(costs: DataFrame, budget: int) -> DataFrame:
    """The finest level of each volume within the budget: ``vol, level, n_chunks, cost``; volumes too dear at every level have no row."""
    pick = F.min_by(F.struct("level", "n_chunks", "cost"), "level").alias("p")
    return costs.where(F.col("cost") <= budget).groupBy("vol").agg(pick).select("vol", "p.*")


def gather(points: DataFrame, root: str, budget: int, coarser: bool = True) -> DataFrame:
    """Values at points (``vol, pz, py, px`` and any others), at the finest level that ``budget`` bytes per volume allow.

    Costs come before any chunk is opened. A volume beyond the budget goes to a coarser level, or with
    ``coarser=False`` the request is refused (``OverBudget``), as is one that no level can meet. Returns the
    points' columns with ``level`` and ``v``; cells that were never written are 0, points outside have no row.
    Points are read twice, first for the chunks they touch and then on their chosen level, and never written on all levels: they
    must be the same both times.
    """
    level_rows = checkpoint(levels(points.sparkSession, root))
    touched = on_levels(places(points), level_rows).select(*level_rows.columns, "cz", "cy", "cx")
    touched = checkpoint(touched.dropDuplicates(["vol", "level", "cz", "cy", "cx"]))
    costs = checkpoint(price(touched))
    chosen = affordable(costs.where("level = 0") if not coarser else costs, budget)
    dear = costs.select("vol").distinct().join(chosen, "vol", "left_anti").limit(3).collect()  # a few to name in the message
    if dear:
        raise OverBudget(f"more than {budget} bytes: {', '.join(r.vol for r in dear)}")
    take = on_levels(points, level_rows, chosen.select("vol", "level"))
    found = voxels(read(touched.join(chosen.select("vol", "level"), ["vol", "level"]), root), keep_zero=False)
    found = found.select("vol", "level", *[F.col(c).cast("long").alias(f"i{c}") for c in "zyx"], "v")
    # unpacked voxels look as small as the list of chunks they are read from: they are never broadcast
    got = take.join(found.hint("merge"), ["vol", "level", "iz", "iy", "ix"], "left")
    return got.select(*points.columns, "level", F.coalesce("v", F.lit(0.0)).alias("v"))
