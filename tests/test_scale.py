"""What must hold on tables far larger than the tests': plans that do not multiply rows, numbers that do not overflow."""

import re

import numpy as np
from pyspark.sql import functions as F

from rasterloom.operators import axis, catalog, controls, depth, experiments, features, fields, registration, seams, spatial
from rasterloom.plans import QUERIES, load_all, n_cracks
from rasterloom.sources import arraystore, chunkstore, grids
from tests.helpers import plane_df, volume_df

load_all()
RNG = np.random.default_rng(5)


def test_nearest_is_settled_in_tiles(spark, capsys):
    a, b = RNG.uniform(0, 300, (300, 3)).round(1), RNG.uniform(0, 300, (900, 3)).round(1)
    rows = lambda pts: [("k", i, *map(float, p)) for i, p in enumerate(pts)]
    kind = "k string, id int, z double, y double, x double"
    left = spark.createDataFrame([*rows(a), *rows(a[:9]), (None, 700, 1.0, 1.0, 1.0), ("k", 701, None, 1.0, 1.0)], kind)
    right = spark.createDataFrame([*rows(b), *rows(b[:9]), (None, 1, 1.0, 1.0, 1.0), ("k", 2, float("nan"), 1.0, 1.0)], kind).drop("id")
    near = spatial.nearest_within(left, right, ["k"], ["id", "z", "y", "x"], ["z", "y", "x"], 20.0, side=3)
    d2 = ((a[:, None] - b[None]) ** 2).sum(-1)
    got = [(r.id, round(r.d2, 6)) for r in near.collect()]
    assert sorted(got) == [(i, round(d, 6)) for i, d in enumerate(d2.min(1)) if d <= 400]
    near.explain()
    # no point is copied to the 27 buckets around it and joined
    plan = capsys.readouterr().out
    assert "CoGroups" in plan and "Join" not in plan


def test_nearest_on_every_later_sheet(spark):
    pts = RNG.integers(0, 40, (400, 3))
    cells = spark.createDataFrame([(f"s{i % 3}", i, 0, *map(int, p)) for i, p in enumerate(pts)], "seg string, y int, x int, pz int, py int, px int")
    got = {(r.seg, r.y, r.other): (r.d2, r.r_pz, r.r_py, r.r_px) for r in seams.nearest_on_sheets(cells, 6.0).collect()}
    want = {}
    for i, p in enumerate(pts):
        for other in range(i % 3 + 1, 3):
            best = min((int(((p - q) ** 2).sum()), *map(int, q)) for j, q in enumerate(pts) if j % 3 == other)
            if best[0] <= 36:
                want[f"s{i % 3}", i, f"s{other}"] = best
    assert got == want


def test_scaled_grid_is_not_sent_to_the_driver(spark, sf, capsys):
    QUERIES["c04_scaled_grid_join"](spark, sf).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_draws_of_late_tiles_do_not_overflow(spark):
    numbers = [-7_000_000, -5, 0, 1, 300_000, 1_800_000, 1_200_000_000, 1 << 45]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    got = {r.n: r.u for r in df.select("n", experiments.draw(F.col("n"), 777).alias("u")).collect()}
    for n in numbers:
        x = n * 7919 + 777
        want = abs(x) * 2654435769 % (1 << 32) / (1 << 32)
        assert got[n] == (want if x >= 0 else -want)


def test_layer_covariance_adds_up_each_segment_once(spark, capsys):
    sizes = {f"s{k}": (3, 2) for k in range(12)} | {"wide": (70, 66)}
    stacks = {seg: RNG.integers(0, 250, (4, *size)) for seg, size in sizes.items()}
    rows = [(seg, z, y, x, int(a[z, y, x])) for seg, a in stacks.items() for z, y, x in np.ndindex(a.shape)]
    cov = depth.layer_covariance(spark.createDataFrame(rows, "seg string, z int, y int, x int, v int"))
    cov.explain()
    # the sums are worked out once and joined with nothing
    plan = capsys.readouterr().out
    assert plan.count("MapInPandas") == 1 and "Join" not in plan
    got = {(r.seg, r.i, r.j): r.c for r in cov.collect()}
    want = {(seg, i, j): v for seg, a in stacks.items() for (i, j), v in np.ndenumerate(np.cov(a.reshape(4, -1), bias=True))}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_frame_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    rows = [(s * grids.ORDERS_PER_SEG + k * 50, 7 * k, k % 3, 1 + k % 7, 10.0 + k, 0.05, "A") for s in range(12) for k in range(20)]
    rows += [(5, None, 1, 1, 3.0, 0.0, "A"), (None, 1, 1, 1, 4.0, 0.0, "A"), (6, -9, 0, 1, 5.0, 0.0, "N")]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_returnflag string"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(grids, "CELLS_AT_ONCE", 1 << 13)
    for build, size, whole in ((grids.plane, 64 * 64, ["y", "x"]), (grids.volume, 21 * 16 * 16, ["z", "y", "x"])):
        df = build(spark, str(tmp_path))
        per_task = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) > 3 and max(per_task) < 8 * size
        inside = df.where(" AND ".join(f"{c} >= 0" for c in whole))
        assert {(r.seg, r["count"]) for r in inside.groupBy("seg").count().collect()} == {*[(f"A{s}", size) for s in range(12)], ("N0", size), (None, size)}
        # samples without a place, or beside the frame, keep their own rows
        assert df.count() == 14 * size + 3 and df.select("seg", *whole).distinct().count() == df.count()
    assert grids.plane(spark, str(tmp_path)).agg(F.sum("n")).first()[0] == len(rows)


def test_texture_keeps_only_its_maps(spark):
    df = plane_df(spark, {"a": RNG.integers(0, 200, (24, 24))})
    out = features.texture_bank(df, "a", r=2, hp=2, proud=3, chan=1, pct=30, plate=(1.0, 8.0))
    kept = re.findall(r"InMemoryRelation \[([^\]]*)\]", out._jdf.queryExecution().executedPlan().toString())
    assert kept and not any("gx" in k or "jxx" in k for k in kept)
    assert out.count() == 24 * 24 and out.columns[5:] == ["sharp", "offaxis", "disorder", "hfenergy", "localsd", "proud", "plate", "chandark"]


def test_candidates_meet_blocks_not_voxels(spark, monkeypatch):
    monkeypatch.setattr(registration, "SIDE", 5)
    monkeypatch.setattr(registration, "AT_ONCE", 100)
    field = {tuple(map(int, at)): tuple(map(int, RNG.integers(-9, 10, 4))) for at in RNG.integers(-4, 12, (900, 3))}
    pts = [(*map(int, RNG.integers(-6, 9, 3)), *map(float, RNG.integers(1, 9, 3))) for _ in range(60)]
    twice = [*field.items(), *list(field.items())[:40]]
    spots = [(int(t), float(s), *map(int, RNG.integers(-3, 7, 3))) for t in range(0, 48, 5) for s in (0.9, 1.0, 1.15)]
    make = lambda rows, kind: spark.createDataFrame([("s", *r) for r in rows] + [(None, *rows[0])], kind)
    found = registration.score(
        make(pts, "seg string, pz int, py int, px int, nz double, ny double, nx double"),
        make([(*at, *v) for at, v in twice], "seg string, z int, y int, x int, v int, gz int, gy int, gx int"),
        make(spots, "seg string, turn int, scale double, tz int, ty int, tx int"), inside=0.0, least=1,
    )
    want = {}
    for t, s, *shift in spots:
        order, sign = registration.TURNS[t]
        inb = bright = used = along = 0
        for r in pts:
            q, m = ([sign[k] * r[o + order[k]] for k in range(3)] for o in (0, 3))
            at = tuple(int(np.floor(q[k] * s + shift[k] + 0.5)) for k in range(3))
            for v, *g in [v for place, v in twice if place == at]:
                inb, bright = inb + 1, bright + v
                if np.dot(g, g) > 4:
                    used += 1
                    along += int(np.floor(abs(np.dot(m, g)) / (np.sqrt(np.dot(m, m)) * np.sqrt(np.dot(g, g))) * 1_000_000 + 0.5))
        if used:
            want[t, s, *shift] = (inb / 60, along / used / 1_000_000, along / used / 1_000_000 * min(inb / 60 / 0.6, 1) + bright / inb / 2550)
    got = {(r.turn, r.scale, r.tz, r.ty, r.tx): (r.inside, r.align, r.fit) for r in found.collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in got)


def test_frame_fills_gaps_without_a_second_grouping(spark, capsys):
    rows = [("a", 1, 1, 5), ("a", None, 2, 3), ("a", 9, 9, 2), ("b", None, None, 1), (None, 2, 2, 4), ("d", -1, 0, 7), ("e", 1, 2, None)]
    cells = spark.createDataFrame(rows, "seg string, y int, x int, q int")
    df = grids.dense(cells, {"y": 4, "x": 4}, ["q"])
    df.explain()
    assert "collect_list" not in capsys.readouterr().out
    got = sorted(((r.seg, r.y, r.x, r.q) for r in df.collect()), key=str)
    own = {(s, y, x): q for s, y, x, q in rows}
    frame = {(s, y, x): 0 for s in ("a", "b", None, "d", "e") for y in range(4) for x in range(4)}
    assert got == sorted(((*k, v or 0) for k, v in (frame | own).items()), key=str)


def test_short_windows_take_one_step(spark, capsys):
    a = RNG.integers(0, 99, (7, 9))
    df = axis.uniform_mean(plane_df(spark, {"a": a}), {"m": ("a", 3)})
    df.explain()
    plan = capsys.readouterr().out
    assert "Generate" not in plan and plan.count("- Window") == 2
    p = np.pad(a.astype(float), 1, mode="symmetric")
    want = sum(p[i : i + 7, j : j + 9] for i in range(3) for j in range(3)) / 9
    assert all(abs(r.m - want[r.y, r.x]) < 1e-9 for r in df.collect())


def test_track_maps_are_made_once(spark, monkeypatch):
    kept = []
    real = fields.checkpoint
    monkeypatch.setattr(fields, "checkpoint", lambda df: (kept.append(set(df.columns)), real(df))[1])
    up = np.zeros((30, 30))
    df = plane_df(spark, {"r": np.where(np.arange(30) == 15, 9.0, 0.0)[None] + up, "vy": up + 1.0, "vx": up, "c": up + 0.9})
    fields.ridge_tracks(df, "r", "vy", "vx", "c", spacing=6, least=8)
    assert {"r", "vy", "vx", "c", "y", "x"} <= kept[0]


def test_places_are_priced_once(spark):
    points = spark.range(1000).selectExpr("'v' AS vol", "id AS k", "id % 2 AS pz", "0L AS py", "3L AS px")
    assert sorted(map(tuple, arraystore.places(points).collect())) == [("v", 0, 0, 3), ("v", 1, 0, 3)]


def test_crop_is_not_broadcast_by_the_size_of_its_segments(spark, sf, capsys):
    QUERIES["a21_aligned_crop"](spark, sf).explain()
    plan = capsys.readouterr().out
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_gathered_points_and_voxels_are_not_broadcast(spark, tmp_path, capsys):
    cells = spark.createDataFrame([("v", 0, z, y, 1, 7, [4, 4, 4], [2, 2, 2]) for z in range(4) for y in range(4)], "vol string, level int, z int, y int, x int, v int, shape array<long>, chunks array<long>")
    arraystore.write(arraystore.pack(cells), str(tmp_path))
    points = spark.range(1).selectExpr("'v' AS vol", "explode(sequence(0L, 3L)) AS pz", "2L AS py", "1L AS px")
    got = arraystore.gather(points, str(tmp_path), 1000)
    got.explain()
    plan = capsys.readouterr().out
    assert plan.count("SortMergeJoin") >= 2 and "BroadcastHashJoin LeftOuter" not in plan and "BroadcastHashJoin [vol" not in plan
    assert sorted((r.pz, r.v) for r in got.collect()) == [(z, 7.0) for z in range(4)]


def test_places_are_looked_up_without_a_join(spark, capsys):
    rows = [("s", 0, 0, 1), ("s", 0, 1, 2), ("s", 0, 1, 3), ("s", 5, 5, 4), ("t", 0, 0, 5), (None, 0, 0, 6), ("s", None, 0, 7)]
    df = spark.createDataFrame(rows, "seg string, y int, x int, a int")
    at = [F.col("y"), F.col("x") + 1]
    got = fields.looked_up(df, at, [F.col("y"), F.col("x")], {"b": F.col("a")})
    right = df.select("seg", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("a").alias("b"))
    want = df.withColumns({"_y": at[0], "_x": at[1]}).join(right, ["seg", "_y", "_x"]).select("seg", "y", "x", "a", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("s", 0, 0, 1, 2), ("s", 0, 0, 1, 3)]
    a = RNG.integers(0, 99, (8, 9))
    # dealt by segment once, no pass over the cells moves them again
    cells = spark.createDataFrame([("s", 8, 9, y, x, int(v)) for (y, x), v in np.ndenumerate(a)], "seg string, h int, w int, y int, x int, a int")
    moved = fields.warp(cells.repartition(3, "seg"), "a", F.lit(0.25), F.lit(-1.5), "m")
    moved.explain()
    plan = capsys.readouterr().out
    assert "Join " not in plan and plan.count("Exchange hash") == 1
    for r in moved.collect():
        sy, sx = max(r.y - 0.25, 0), min(r.x + 1.5, 8)
        y, x, fy, fx = int(sy), int(sx), sy % 1, sx % 1
        rows, cols = (y, min(y + 1, 7)), (x, min(x + 1, 8))
        want = sum(a[i, j] * wy * wx for i, wy in zip(rows, (1 - fy, fy)) for j, wx in zip(cols, (1 - fx, fx)))
        assert abs(r.m - want) < 1e-9


def test_draws_make_no_rows_of_cells(spark, capsys):
    kind = "seg string, h int, w int, y int, x int, za double, zb double, r boolean"
    rows = [("s", 4, 4, 0, 0, 1.0, 2.0, True), ("s", 4, 4, 1, 1, 5.0, None, True), ("s", 4, 4, 1, 1, 3.0, 0.5, True), ("s", 4, 4, 2, 2, 9.0, 9.0, False)]
    rows += [(None, 4, 4, 0, 0, 1.0, 1.0, True), ("s", 4, 4, None, 0, 8.0, 8.0, True), ("t", 4, 4, 3, 3, None, None, True)]
    df = spark.createDataFrame(rows, kind)
    got = controls.paired_maximum(df.repartition(2, "seg"), ["seg"], "za", "zb", "r", [(1, 1), (0, 0), (2, 1)], 1)
    got.explain()
    # dealt by segment once, and neither copied per draw nor joined
    plan = capsys.readouterr().out
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange hash") == 1
    want = {("s", 0, 5.0, 2.0, 2), ("s", 1, 5.0, 5.0, 5), ("t", 1, None, None, 1)}
    assert {(r.seg, r.k, r.obs, r.null, r.area) for r in got.collect()} == want


def test_sheets_write_counts_not_cells(spark, monkeypatch):
    kept = []
    for m in (seams, catalog):
        monkeypatch.setattr(m, "checkpoint", lambda df: (kept.append(df), df.localCheckpoint())[1])
    rows = [(s, y, x, z, y * 10, x * 10, y in (0, 23), 1.0, 0.0, 0.0) for s, z in (("a", 0), ("b", 1)) for y in range(24) for x in range(24)]
    cells = spark.createDataFrame(rows, "seg string, y int, x int, pz int, py int, px int, rim boolean, nz double, ny double, nx double")
    assert seams.classify(cells, 12.0).isEmpty()
    assert kept[0].count() == 2 and kept[0].agg(F.sum("n")).first()[0] == 576
    nn = spark.range(60).selectExpr("'k' AS k", "1 AS d2", "0 AS p", "CAST(id % 3 > 0 AS INT) AS r_p")
    body = spark.createDataFrame([("k", 100)], "k string, body long")
    r = catalog.seam_classes(nn, body, ["k"], {"p": 0.6}, 20).first()
    assert kept[1].count() == 2 and (r.near, r.seam, r.perp, r.inplane, r.kind) == (60, 60, 0.6, 0.8, "duplicate")


def test_nearest_at_any_distance_joins_nothing(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(seams, "checkpoint", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), df.localCheckpoint())[1])
    left = spark.createDataFrame([("k", i, i * 40, 0, 0) for i in range(5)] * 2 + [("k", 9, None, 0, 0)], "key string, id int, pz int, py int, px int")
    right = spark.createDataFrame([("k", 3, 0, 0)] * 3, "key string, pz int, py int, px int")
    got = seams.nearest_any(left, right, ["key"], ["id", *seams.POINT], seams.POINT, 5.0)
    assert sorted((r.id, r.d2) for r in got.collect()) == [(i, (i * 40 - 3) ** 2) for i in range(5)]
    rounds = [p for p in plans if "CoGroup" in p]
    assert len(rounds) > 3 and not any("anti" in p.lower() or "Aggregate" in p for p in rounds)
    assert len(plans) == len(rounds) + 2


def test_small_volumes_share_a_task(spark, tmp_path):
    data = bytearray(b"\1" * 8)
    rows = [(f"v{i:03d}", 0, z, 0, 0, data) for i in range(300) for z in range(2)]
    chunkstore.write_chunks(spark.createDataFrame(rows, chunkstore.SCHEMA), str(tmp_path), (4, 2, 2), (2, 2, 2))
    got = chunkstore.read_chunks(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() < 20
    assert sorted((r.vol, r.cz) for r in got.collect()) == [(v, z) for v, _, z, *_ in rows]
    assert chunkstore.read_chunks(spark, str(tmp_path)).where("cz = 1").count() == 300


def test_valleys_of_the_crack_report_are_made_once(spark, sf, monkeypatch):
    calls = []
    real = n_cracks.valleys
    monkeypatch.setattr(n_cracks, "valleys", lambda *a: (calls.append(a), real(*a))[1])
    assert QUERIES["j26_crack_report"](spark, sf).columns and len(calls) == 1
