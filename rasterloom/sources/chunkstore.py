"""Chunked array stores as a Spark data source.

A store is a folder ``<path>/<volume>/<level>/`` with a ``.zarray`` sidecar and
one file per chunk, ``cz.cy.cx`` or ``cz/cy/cx``. Chunks are rows
``(vol, level, cz, cy, cx, data)``; a chunk that was never written is an absent
row, not a block of zeros. Chunk bytes are raw or zlib, C order, edge chunks
zero-padded. Partitions are runs of chunk indices taken from the sidecar, so no
directory listing of chunks is needed, and filters on level and chunk position
are applied before any file is opened.
"""

from __future__ import annotations

import json
import os
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    GreaterThanOrEqual,
    InputPartition,
    LessThanOrEqual,
    WriterCommitMessage,
)

SCHEMA = "vol string, level int, cz int, cy int, cx int, data binary"
RUN, MAX_RUNS = 64, 20000
#: Chunk places that a task reads at most, unless one run has more, and tasks that a smaller store is dealt to.
AT_ONCE, TASKS = 4096, 64


def read_sidecar(folder: str) -> dict | None:
    try:
        with open(os.path.join(folder, ".zarray")) as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def codec(meta: dict) -> bool:
    """Whether chunks are zlib-packed; formats that are not read here are an error."""
    kind = (meta.get("compressor") or {}).get("id")
    known = {"dtype": ("|u1", "u1", "uint8"), "order": ("C",)}
    for key, values in known.items():
        if meta.get(key, values[0]) not in values:
            raise ValueError(f"unsupported {key}: {meta[key]}")
    if kind not in (None, "zlib") or meta.get("filters"):
        raise ValueError(f"unsupported codec: {kind or meta['filters']}")
    return kind == "zlib"


def level_names(volume: str) -> list[str]:
    """Level folders from the multiscale attributes, or all numbered folders in order."""
    try:
        with open(os.path.join(volume, ".zattrs")) as f:
            sets = json.load(f)["multiscales"][0]["datasets"]
        names = [d["path"] for d in sets if isinstance(d.get("path"), str)]
        if names:
            return names
    except (OSError, ValueError, KeyError, IndexError, TypeError):
        pass
    return sorted((d for d in os.listdir(volume) if d.isdigit()), key=int)


@dataclass
class Run(InputPartition):
    vol: str
    level: int
    folder: str
    meta: str
    first: int
    last: int


@dataclass
class Runs(InputPartition):
    """Runs of several volumes and levels, so that small ones do not cost a task each."""

    runs: list[Run]


def together(runs: list[Run]) -> list[Runs]:
    """Neighbouring runs, up to ``AT_ONCE`` places or a share of all, as partitions."""
    most = max(RUN, min(AT_ONCE, -(-sum(r.last - r.first for r in runs) // TASKS)))
    out, held = [], most
    for r in runs:
        held += r.last - r.first
        if held > most:
            out.append(Runs([]))
            held = r.last - r.first
        out[-1].runs.append(r)
    return out or [Runs([])]


class ChunkReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.limits = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in ("level", "cz", "cy", "cx") and isinstance(f, (EqualTo, GreaterThanOrEqual, LessThanOrEqual)):
                lo, hi = self.limits.get(name, (0, 1 << 31))
                if not isinstance(f, LessThanOrEqual):
                    lo = max(lo, f.value)
                if not isinstance(f, GreaterThanOrEqual):
                    hi = min(hi, f.value)
                self.limits[name] = (lo, hi)
            # ranges only prune; Spark still evaluates every filter
            yield f

    def _span(self, name: str, n: int) -> tuple[int, int]:
        lo, hi = self.limits.get(name, (0, n - 1))
        return max(lo, 0), max(min(hi, n - 1) + 1 - max(lo, 0), 0)

    def partitions(self):
        """Runs of linear chunk numbers inside the wanted box, never a list of chunks."""
        out, texts = [], {}
        for vol in sorted(os.listdir(self.path)):
            for i, name in enumerate(level_names(os.path.join(self.path, vol))):
                folder = os.path.join(self.path, vol, name)
                meta = read_sidecar(folder)
                lo, hi = self.limits.get("level", (0, 1 << 31))
                if meta is None or len(meta["shape"]) != 3 or not lo <= i <= hi:
                    continue
                counts = (-(-s // c) for s, c in zip(meta["shape"], meta["chunks"]))
                box = [self._span(k, n) for k, n in zip(("cz", "cy", "cx"), counts)]
                total = box[0][1] * box[1][1] * box[2][1]
                step = max(RUN, -(-total // MAX_RUNS))
                text = json.dumps({**meta, "box": box})
                text = texts.setdefault(text, text)
                out += [Run(vol, i, folder, text, k, min(k + step, total)) for k in range(0, total, step)]
        return together(out)

    def read(self, part):
        for run in part.runs:
            yield from self._read(run)

    def _read(self, part):
        meta = json.loads(part.meta)
        sep = meta.get("dimension_separator", ".")
        packed = codec(meta)
        for k in range(part.first, part.last):
            (z0, _), (y0, ny), (x0, nx) = meta["box"]
            cz, cy, cx = z0 + k // (ny * nx), y0 + k // nx % ny, x0 + k % nx
            try:
                with open(os.path.join(part.folder, sep.join(map(str, (cz, cy, cx)))), "rb") as f:
                    raw = f.read()
            except FileNotFoundError:
                continue
            yield part.vol, part.level, cz, cy, cx, zlib.decompress(raw) if packed else raw


class ChunkWriter(DataSourceWriter):
    """Writes whole chunk files; a retried task rewrites the same names atomically."""

    def __init__(self, options):
        self.path = options["path"]
        self.shape = [int(v) for v in options["shape"].split(",")]
        self.chunks = [int(v) for v in options["chunks"].split(",")]

    def _meta(self) -> dict:
        # The on-disk sidecar format, version 2.
        return {
            "zarr_format": 2,
            "shape": self.shape,
            "chunks": self.chunks,
            "dtype": "|u1",
            "compressor": {"id": "zlib", "level": 6},
            "fill_value": 0,
            "order": "C",
            "filters": None,
            "dimension_separator": ".",
        }

    def write(self, rows):
        size = int(np.prod(self.chunks))
        seen = set()
        for r in rows:
            folder = os.path.join(self.path, r.vol, str(r.level))
            if folder not in seen:
                os.makedirs(folder, exist_ok=True)
                side = os.path.join(folder, f".zarray.{os.getpid()}")
                with open(side, "w") as f:
                    json.dump(self._meta(), f)
                os.replace(side, os.path.join(folder, ".zarray"))
                seen.add(folder)
            if len(r.data) != size:
                raise ValueError(f"chunk of {len(r.data)} bytes, expected {size}")
            name = os.path.join(folder, f"{r.cz}.{r.cy}.{r.cx}")
            tmp = f"{name}.{os.getpid()}"
            with open(tmp, "wb") as f:
                f.write(zlib.compress(bytes(r.data), 6))
            os.replace(tmp, name)
        return WriterCommitMessage()


class LevelReader(DataSourceReader):
    """One row per level: what a viewer learns when it opens a volume."""

    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        vols = sorted(os.listdir(self.path))
        return [Run(v, 0, os.path.join(self.path, v), "{}", 0, 0) for v in vols]

    def read(self, part):
        found = []
        for name in level_names(part.folder):
            meta = read_sidecar(os.path.join(part.folder, name))
            if meta is not None and len(meta["shape"]) == 3:
                found.append((name, meta))
        if not found:
            raise ValueError(f"no 3-D arrays in {part.vol}")
        bz, _, bx = found[0][1]["shape"]
        for name, m in found:
            z, y, x = m["shape"]
            factor, zf = (max(1, int(a / b + 0.5)) for a, b in ((bx, x), (bz, z)))
            yield part.vol, name, [z, y, x], list(m["chunks"]), m["dtype"], factor, zf


class ChunkStore(DataSource):
    @classmethod
    def name(cls):
        return "chunkstore"

    def schema(self):
        if self.options.get("kind") == "levels":
            return "vol string, path string, shape array<int>, chunks array<int>, dtype string, factor int, z_factor int"
        return SCHEMA

    def reader(self, schema):
        return LevelReader(self.options) if self.options.get("kind") == "levels" else ChunkReader(self.options)

    def writer(self, schema, overwrite):
        return ChunkWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ChunkStore)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("chunkstore").option("path", path).load()


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("chunkstore").option("path", path).option("kind", "levels").load()


def damaged(chunks: DataFrame, dims) -> DataFrame:
    """Chunks whose payload does not have the size of a chunk."""
    size = int(np.prod(dims))
    wrong = F.coalesce(F.octet_length("data") != size, F.lit(True))
    return chunks.where(wrong).select("vol", "level", "cz", "cy", "cx", F.octet_length("data").alias("bytes"))


def write_chunks(chunks: DataFrame, path: str, shape, dims) -> None:
    register(chunks.sparkSession)
    (
        chunks.write.format("chunkstore")
        .option("path", path)
        .option("shape", ",".join(map(str, shape)))
        .option("chunks", ",".join(map(str, dims)))
        .mode("append")
        .save()
    )


def window(chunks: DataFrame, dims, level: int, z: int, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Chunks that one plane of a box touches (ends exclusive), as filters the reader prunes by."""
    dz, dy, dx = dims
    rows = F.col("cy").between(y0 // dy, (y1 - 1) // dy) & F.col("cx").between(x0 // dx, (x1 - 1) // dx)
    return chunks.where((F.col("level") == level) & (F.col("cz") == z // dz) & rows)


def voxels(chunks: DataFrame, shape, dims, skip_damaged: bool = False) -> DataFrame:
    """Cells of decoded chunks, trimmed to the array.

    A payload of the wrong size is an error unless ``skip_damaged``; ``damaged`` lists those.
    """
    size = int(np.prod(dims))
    if skip_damaged:
        chunks = chunks.where(F.octet_length("data") == size)

    def decode(data: pd.Series) -> pd.Series:
        def cells(b: bytes) -> np.ndarray:
            if b is None or len(b) != size:
                raise ValueError(f"chunk of {0 if b is None else len(b)} bytes, expected {size}")
            return np.frombuffer(b, np.uint8).astype(np.int16)

        return data.map(cells)

    dz, dy, dx = dims
    cells = chunks.select(
        "vol", "level", "cz", "cy", "cx", F.posexplode(F.pandas_udf(decode, "array<smallint>")("data")).alias("p", "v")
    )
    z = F.col("cz") * dz + F.floor(F.col("p") / (dy * dx)).cast("int")
    y = F.col("cy") * dy + (F.floor(F.col("p") / dx) % dy).cast("int")
    x = F.col("cx") * dx + F.col("p") % dx
    out = cells.select("vol", "level", z.alias("z"), y.alias("y"), x.alias("x"), F.col("v").cast("int").alias("v"))
    return out.where((F.col("z") < shape[0]) & (F.col("y") < shape[1]) & (F.col("x") < shape[2]))

