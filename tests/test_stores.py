import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import curves
from rasterloom.sources import arraystore

RNG = np.random.default_rng(5)


def cells_of(spark, arrays, chunks, level=0):
    rows = []
    for vol, a in arrays.items():
        for (z, y, x), v in np.ndenumerate(a):
            rows.append((vol, level, z, y, x, int(v), list(a.shape), list(chunks[vol])))
    return spark.createDataFrame(rows, "vol string, level int, z int, y int, x int, v int, shape array<long>, chunks array<long>")


def back(df, shapes):
    out = {v: np.zeros(s) for v, s in shapes.items()}
    for r in df.collect():
        out[r.vol][r.z, r.y, r.x] = r.v
    return out


@pytest.fixture
def store(spark, tmp_path):
    arrays = {"a": RNG.integers(0, 200, (9, 11, 5)), "b": RNG.integers(0, 200, (4, 16, 17)), "c": RNG.integers(0, 60000, (5, 5, 5))}
    arrays["a"][:, :8, :] = 0
    chunks = {"a": (4, 4, 4), "b": (4, 8, 3), "c": (2, 5, 4)}
    df = cells_of(spark, arrays, chunks)
    arraystore.write(arraystore.pack(df.where("vol <> 'c'"), run_bytes=200), str(tmp_path))
    arraystore.write(arraystore.pack(df.where("vol = 'c'"), "<u2"), "file://" + str(tmp_path))
    return str(tmp_path), arrays, chunks


def test_mixed_shapes_in_one_read(spark, store):
    path, arrays, chunks = store
    levels = arraystore.levels(spark, path)
    assert {(r.vol, tuple(r.shape), tuple(r.chunks), r.dtype) for r in levels.collect()} == {
        (v, a.shape, chunks[v], "<u2" if v == "c" else "u1") for v, a in arrays.items()
    }
    got = back(arraystore.voxels(arraystore.read(arraystore.wanted(levels), path), keep_zero=False), {v: a.shape for v, a in arrays.items()})
    assert all(np.array_equal(got[v], a) for v, a in arrays.items())
    # chunks that hold nothing were never written
    assert not os.path.exists(f"{path}/a/0/0.0.0") and os.path.exists(f"{path}/a/0/0.2.0")
    tiny = arraystore.read(arraystore.wanted(levels), path, split=100)
    assert tiny.rdd.getNumPartitions() > 10


def test_a_level_without_values_leaves_the_others_their_numbers(spark, tmp_path):
    a = np.zeros((2, 4, 4), int)
    both = cells_of(spark, {"v": a}, {"v": (2, 2, 2)}).unionByName(cells_of(spark, {"v": a + 3}, {"v": (2, 2, 2)}, level=1))
    assert arraystore.write(arraystore.pack(both), str(tmp_path)) == 4
    assert [r.level for r in arraystore.levels(spark, str(tmp_path)).collect()] == [1]


def test_windows_by_each_sidecar(spark, store):
    path, arrays, _ = store
    levels = arraystore.levels(spark, path)
    box = spark.createDataFrame([("a", 0, 2, 7, 7, 99, -3, 2), ("b", 0, 0, 1, 0, 9, 16, 17), ("b", 0, 0, 2, 0, 9, 16, 17), ("c", 0, 9, 12, 0, 5, 0, 5)],
                                "vol string, level int, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int")
    places = arraystore.wanted(levels, box)
    assert {(r.vol, r.cz, r.cy, r.cx) for r in places.collect()} == {
        ("a", z, y, 0) for z in (0, 1) for y in (1, 2)
    } | {("b", 0, y, 5) for y in (0, 1)}
    cells = arraystore.voxels(arraystore.read(places, path)).where("vol = 'b' AND x = 16 AND z = 0 AND y < 9").collect()
    assert sorted((r.y, r.v) for r in cells) == [(y, float(arrays["b"][0, y, 16])) for y in range(9)]


def test_a_failed_write_leaves_nothing(spark, store):
    path, arrays, _ = store
    before = sorted(os.listdir(path))
    good = arraystore.pack(cells_of(spark, {"a": arrays["a"] + 1, "new": arrays["b"]}, {"a": (4, 4, 4), "new": (4, 4, 4)}))
    bad = good.withColumn("data", F.when(F.col("vol") == "new", F.expr("CAST(raise_error('killed') AS BINARY)")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="killed"):
        arraystore.write(bad, path)
    assert sorted(os.listdir(path)) == before
    got = back(arraystore.voxels(arraystore.read(arraystore.wanted(arraystore.levels(spark, path)), path)), {v: a.shape for v, a in arrays.items()})
    assert np.array_equal(got["a"], arrays["a"])


def test_staged_levels_are_not_seen_and_old_ones_are_replaced_whole(spark, store):
    path, arrays, _ = store
    os.makedirs(f"{path}/{arraystore.STAGE}dead/z/0")
    open(f"{path}/{arraystore.STAGE}dead/z/0/0.0.0", "wb").close()
    os.makedirs(f"{path}/half/0")
    open(f"{path}/half/0/0.0.0", "wb").close()
    assert "half" not in {r.vol for r in arraystore.levels(spark, path).collect()}
    small = {"a": np.pad(np.full((2, 2, 2), 7), ((0, 2), (0, 2), (0, 2)))}
    assert arraystore.write(arraystore.pack(cells_of(spark, small, {"a": (2, 2, 2)})), path) == 1
    levels = arraystore.levels(spark, path).where("vol = 'a'")
    assert np.array_equal(back(arraystore.voxels(arraystore.read(arraystore.wanted(levels), path)), {"a": (4, 4, 4)})["a"], small["a"])
    assert sorted(os.listdir(f"{path}/a/0")) == [".zarray", "0.0.0"]


def test_a_publishing_task_may_run_again(spark, store):
    path = store[0]
    fs, base = arraystore.opened(path)
    row = {"vol": "b", "level": 0, "shape": [4, 16, 17], "chunks": [4, 8, 3], "dtype": "u1"}
    arraystore._publish(fs, base, f"{arraystore.STAGE}gone", row, False)
    assert arraystore.levels(spark, path).where("vol = 'b'").count() == 1
    assert len(os.listdir(f"{path}/b/0")) > 1


def attrs_of(spark, path):
    return {r.vol: (r.version, json.loads(r.attrs)) for r in arraystore.read_attributes(spark, path).collect()}


def test_attributes_survive_a_certificate(spark, store):
    path = store[0]
    patch = lambda rows: spark.createDataFrame(rows, "vol string, attrs string, version long")
    first = {"title": "labels", "counts": {"ink": 3, "blank": 4}, "multiscales": [{"datasets": [{"path": "0"}]}]}
    arraystore.merge_attributes(patch([("a", json.dumps(first), None), ("b", "{}", None)]), path)
    arraystore.merge_attributes(patch([("a", '{"check": {"verdict": "mixed"}, "counts": {"ink": 5}}', 1)]), path)
    assert attrs_of(spark, path)["a"] == (2, {**first, "counts": {"ink": 5, "blank": 4}, "check": {"verdict": "mixed"}})
    assert attrs_of(spark, path)["b"] == (0, {})
    # the same patch again, as a task that is run twice, changes nothing; another one at the old version is refused
    arraystore.merge_attributes(patch([("a", '{"check": {"verdict": "mixed"}}', 1)]), path)
    with pytest.raises(Exception, match="at version 2, not 1"):
        arraystore.merge_attributes(patch([("a", '{"check": {"verdict": "corroborated"}}', 1)]), path)
    assert attrs_of(spark, path)["a"][1]["check"] == {"verdict": "mixed"}
    assert arraystore.levels(spark, path).where("vol = 'a'").first().path == "a/0"


def test_flat_arrays(spark, tmp_path):
    a = {"l": RNG.integers(0, 4, (1, 9, 7))}
    arraystore.write(arraystore.pack(cells_of(spark, a, {"l": (1, 4, 4)})), str(tmp_path), flat=True)
    meta = json.load(open(tmp_path / "l/0/.zarray"))
    assert meta["shape"] == [9, 7] and meta["chunks"] == [4, 4] and os.path.exists(tmp_path / "l/0/2.1")
    levels = arraystore.levels(spark, str(tmp_path))
    assert np.array_equal(back(arraystore.voxels(arraystore.read(arraystore.wanted(levels), str(tmp_path))), {"l": (1, 9, 7)})["l"], a["l"])


def test_wrong_payloads_and_formats_are_errors(spark, store):
    path = store[0]
    open(f"{path}/c/0/0.0.0", "wb").write(__import__("zlib").compress(b"short"))
    levels = arraystore.levels(spark, path)
    with pytest.raises(Exception, match="5 bytes"):
        arraystore.voxels(arraystore.read(arraystore.wanted(levels), path)).count()
    json.dump({"shape": [1, 1, 1], "chunks": [1, 1, 1], "dtype": "<f8"}, open(f"{path}/c/0/.zarray", "w"))
    with pytest.raises(Exception, match="unsupported array"):
        levels.count()


def test_gather_stays_in_budget_and_refuses_before_reading(spark, tmp_path):
    path = str(tmp_path)
    a = RNG.integers(1, 200, (8, 16, 16))
    coarse = a.reshape(8, 8, 2, 8, 2).mean((2, 4)).astype(int)
    both = cells_of(spark, {"v": a}, {"v": (4, 4, 4)}).unionByName(cells_of(spark, {"v": coarse}, {"v": (4, 4, 4)}, level=1))
    arraystore.write(arraystore.pack(both), path)
    at = [(z, y, x) for z in (0, 7) for y in range(0, 16, 3) for x in range(0, 16, 5)] + [(-1, 0, 0), (3, 16, 0)]
    points = spark.createDataFrame([("v", *p, i) for i, p in enumerate(at)], "vol string, pz int, py int, px int, id int")
    costs = {r.level: (r.n_chunks, r.cost) for r in arraystore.price(arraystore.on_levels(points, arraystore.levels(spark, path))).collect()}
    assert costs == {0: (32, 32 * 64), 1: (8, 8 * 64)}
    fine = {r.id: (r.level, r.v) for r in arraystore.gather(points, path, 4000).collect()}
    assert fine == {i: (0, float(a[p])) for i, p in enumerate(at[:-2])}
    less = {r.id: (r.level, r.v) for r in arraystore.gather(points, path, 600).collect()}
    assert less == {i: (1, float(coarse[p[0], p[1] // 2, p[2] // 2])) for i, p in enumerate(at[:-2])}
    # with every chunk gone a read would show; a refusal comes first
    for name in os.listdir(f"{path}/v/0"):
        if name[0] != ".":
            open(f"{path}/v/0/{name}", "wb").close()
    with pytest.raises(arraystore.OverBudget):
        arraystore.gather(points, path, 600, coarser=False)
    with pytest.raises(arraystore.OverBudget):
        arraystore.gather(points, path, 100)


def test_gather_writes_chunk_numbers_not_points(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    a = RNG.integers(1, 200, (4, 8, 8))
    arraystore.write(arraystore.pack(cells_of(spark, {"v": a}, {"v": (4, 4, 4)})), path)
    held, keep = [], arraystore.checkpoint
    monkeypatch.setattr(arraystore, "checkpoint", lambda df: held.append(keep(df)) or held[-1])
    rows = [("v", z, y, x, i) for i in range(3) for z, y, x in np.ndindex(4, 8, 4)]
    points = spark.createDataFrame([tuple(v if isinstance(v, str) else int(v) for v in r) for r in rows], "vol string, pz int, py int, px int, id int")
    got = sorted((r.pz, r.py, r.px, r.id, r.v) for r in arraystore.gather(points, path, 1000).collect())
    assert got == sorted((z, y, x, i, float(a[z, y, x])) for _, z, y, x, i in rows)
    # 384 points touch two chunks: only these, their price and the levels are written
    assert held and max(df.count() for df in held) == 2


def test_ragged_curves_on_one_axis(spark):
    ends = {"p": (-30, 24, 4), "q": (-12, 40, 6), "r": (-20, 33, 5)}
    data = {c: [(x, float(RNG.normal())) for x in range(a, b, s)] for c, (a, b, s) in ends.items()}
    rows = [("g", c, x, ends[c][2], v) for c, pts in data.items() for x, v in pts] + [("far", "s", 0, 5, 1.0), ("far", "s", 10, 5, 2.0), ("far", "t", 50, 5, 1.0), ("far", "t", 60, 5, 1.0)]
    df = spark.createDataFrame(rows, "grp string, curve string, at int, step int, v double")
    got = {r.at: (r.tiles, r.v) for r in curves.common_axis(df, "grp", "curve", "at", "step", ["v"]).collect()}
    grid = np.arange(max(p[0][0] for p in data.values()), min(p[-1][0] for p in data.values()), 4)
    want = np.median([np.interp(grid, *zip(*p)) for p in data.values()], axis=0)
    assert sorted(got) == grid.tolist() and all(n == 3 for n, _ in got.values())
    assert np.allclose([got[g][1] for g in grid.tolist()], want)
