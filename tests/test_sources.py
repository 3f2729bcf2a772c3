import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import Row, functions as F

from rasterloom.operators import catalog, spatial
from rasterloom.sources import chunkstore, files, grids
from tests.helpers import plane_df, volume_df

RNG = np.random.default_rng(3)
VOL = RNG.integers(0, 256, (10, 9, 11))
VOL[:4, :4, :4] = 0
DIMS = (4, 4, 4)


@pytest.fixture
def store(spark, tmp_path):
    ch = spatial.chunked(volume_df(spark, VOL), *DIMS).select(F.col("seg").alias("vol"), F.lit(0).alias("level"), "cz", "cy", "cx", "data")
    chunkstore.write_chunks(ch, str(tmp_path), VOL.shape, DIMS)
    return str(tmp_path)


def read(spark, path, where="true"):
    out = np.zeros(VOL.shape, int)
    for r in chunkstore.voxels(chunkstore.read_chunks(spark, path).where(where), VOL.shape, DIMS).collect():
        out[r.z, r.y, r.x] = r.v
    return out


def test_round_trip_with_ragged_edges_and_an_absent_chunk(spark, store):
    assert not os.path.exists(f"{store}/s/0/0.0.0")
    assert np.array_equal(read(spark, store), VOL)


def test_sidecar_and_levels(spark, store):
    meta = json.load(open(f"{store}/s/0/.zarray"))
    assert meta["shape"] == list(VOL.shape) and meta["dtype"] == "|u1" and meta["fill_value"] == 0
    lv = chunkstore.read_levels(spark, store).first()
    assert (lv.vol, lv.path, lv.shape, lv.factor, lv.z_factor) == ("s", "0", list(VOL.shape), 1, 1)


def test_filters_prune_chunks_before_files_open(spark, store):
    for name in os.listdir(f"{store}/s/0"):
        if name[0].isdigit() and not name.startswith("1."):
            with open(f"{store}/s/0/{name}", "wb") as f:
                f.write(b"not zlib")
    got = read(spark, store, "cz = 1")
    assert np.array_equal(got[4:8], VOL[4:8]) and not got[:4].any() and not got[8:].any()


def test_a_truncated_payload_is_an_error_or_listed(spark):
    df = spark.createDataFrame([("v", 0, 0, 0, 0, bytearray(b"abc"))], chunkstore.SCHEMA)
    with pytest.raises(Exception, match="expected 64"):
        chunkstore.voxels(df, VOL.shape, DIMS).collect()
    assert chunkstore.voxels(df, VOL.shape, DIMS, skip_damaged=True).isEmpty()
    assert [r.bytes for r in chunkstore.damaged(df, DIMS).collect()] == [3]


@pytest.mark.parametrize("change", [{"compressor": {"id": "blosc"}}, {"dtype": "<f4"}, {"order": "F"}])
def test_unread_formats_are_refused(change):
    with pytest.raises(ValueError, match="unsupported"):
        chunkstore.codec({"dtype": "|u1", "order": "C", "compressor": {"id": "zlib"}, **change})


def test_all_numbered_levels_are_found(tmp_path):
    for k in range(9):
        (tmp_path / str(k)).mkdir()
    assert chunkstore.level_names(str(tmp_path)) == [str(k) for k in range(9)]


@pytest.mark.parametrize("keys", [(204_799_999, 204_800_000), (1 << 33, (1 << 33) + 2048)])
def test_large_order_keys_make_segments_of_their_own(spark, tmp_path, keys):
    row = dict(l_partkey=1, l_suppkey=1, l_linenumber=1, l_quantity=1.0, l_discount=0.0, l_returnflag="A")
    near = [k // 2048 // 10 * 2048 for k in keys]
    rows = [Row(l_orderkey=k, **row) for k in (*keys, *near)]
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert grids.segments(spark, str(tmp_path)).count() == len({k // 2048 for k in (*keys, *near)})


def test_layers_beyond_999_and_values_beyond_a_byte(spark):
    df = spark.createDataFrame([(1000, 0, 0, 5), (1001, 0, 0, 5)], "z int, y int, x int, v int").withColumn("seg", F.lit("s"))
    names = {r.file for r in files.label_layers(df, ["seg"], "z", "v").collect()}
    assert names == {"s-layer1000-ink.tif", "s-layer1001-ink.tif"}
    with pytest.raises(Exception, match="not a byte"):
        files.label_layers(df.withColumn("v", F.lit(300)), ["seg"], "z", "v").collect()
    with pytest.raises(Exception, match="not a byte"):
        spatial.chunked(df.withColumn("v", F.lit(300)), 4, 4, 4).collect()


def test_writer_refuses_wrong_sizes(spark, tmp_path):
    df = spark.createDataFrame([("v", 0, 0, 0, 0, bytearray(b"abc"))], chunkstore.SCHEMA)
    with pytest.raises(Exception, match="expected 64"):
        chunkstore.write_chunks(df, str(tmp_path), VOL.shape, DIMS)


def test_tiff_parses(spark):
    a = RNG.integers(0, 256, (3, 5))
    t = files.label_layers(plane_df(spark, {"v": a}).withColumn("layer", F.lit(7)), ["seg"], "layer", "v").first()
    raw = bytes(t.tiff)
    assert raw[:4] == b"II*\0" and t.file == "s-layer007-ink.tif"
    (ifd,) = struct.unpack("<I", raw[4:8])
    (n,) = struct.unpack("<H", raw[ifd : ifd + 2])
    tags = {}
    for i in range(n):
        tag, kind, count, value = struct.unpack("<HHII", raw[ifd + 2 + 12 * i : ifd + 14 + 12 * i])
        tags[tag] = value & 0xFFFF if kind == 3 else value
    assert (tags[256], tags[257], tags[258], tags[277]) == (5, 3, 8, 1) and len(raw) == ifd + 2 + 12 * n + 4
    body = raw[tags[273] : tags[273] + tags[279]]
    assert np.array_equal(np.frombuffer(body, np.uint8).reshape(3, 5), a)


def test_upsert_never_drops(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], ["k", "v"])
    new = spark.createDataFrame([("b", 9)], ["k", "v"])
    assert {(r.k, r.v) for r in catalog.upsert(old, new, ["k"], ["v"]).collect()} == {("a", 1), ("b", 9)}


def test_duplicate_ids_fail_the_job(spark):
    df = spark.createDataFrame([("x",), ("x",)], ["id"])
    with pytest.raises(Exception, match="duplicate id"):
        catalog.assert_unique(df, "id").collect()
