import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import axis, catalog, experiments, registration, seams, templates, thinning
from rasterloom.operators.registration import TURNS
from tests.helpers import plane_df, volume_df

RNG = np.random.default_rng(31)


def smooth(a, rounds=3):
    for _ in range(rounds):
        for k in range(3):
            a = (a + np.roll(a, 1, k) + np.roll(a, -1, k)) / 3
    return a


# -- registration -------------------------------------------------------------


@pytest.mark.parametrize("turn,shift", [(0, (9, 0, -3)), (13, (9, -9, 2)), (37, (-5, 9, -9)), (47, (1, 2, 9))])
def test_planted_turn_and_shift_are_found(spark, turn, shift):
    vol = smooth(RNG.random((34, 34, 34)) * 255, 9)
    vol = np.round((vol - vol.min()) / (vol.max() - vol.min()) * 255)
    g = [np.roll(vol, -1, k) - np.roll(vol, 1, k) for k in range(3)]
    # a sheet in one corner only: its centre lies nine cells from the volume's on every axis
    at = [(3 + (y + x) % 3 + y // 2, y, x) for y in range(2, 14) for x in range(2, 14)]
    order, sign = TURNS[turn]
    rows = []
    for q in at:
        n = [float(g[k][q]) for k in range(3)]
        p, m = [0, 0, 0], [0.0, 0.0, 0.0]
        for k in range(3):
            p[order[k]] = int(sign[k] * (q[k] - shift[k]))
            m[order[k]] = sign[k] * n[k]
        rows.append(("s", *p, *m))
    points = spark.createDataFrame(rows, "seg string, pz int, py int, px int, nz double, ny double, nx double")
    field = registration.gradient_field(volume_df(spark, vol), "v", F.col("v"))
    r = registration.register(points, field, reach=12, step=4, keep=6).first()
    assert (r.turn, r.tz, r.ty, r.tx, r.scale) == (turn, *shift, 1.0)
    assert r.align > 0.999 and r.inside == 1.0


def test_turns_are_undone(spark):
    assert len(set(TURNS)) == 48
    df = spark.range(48).select(F.col("id").cast("int").alias("t"), *[F.lit(float(v)).alias(c) for c, v in zip("zyx", (3, -7, 11))])
    once = registration.turned(F.col("t"), [F.col(c) for c in "zyx"])
    df = df.select("t", *[v.alias(c) for c, v in zip("zyx", once)])
    assert len({(r.z, r.y, r.x) for r in df.collect()}) == 48
    again = registration.unturned(F.col("t"), [F.col(c) for c in "zyx"])
    assert {tuple(r) for r in df.select(*again).collect()} == {(3.0, -7.0, 11.0)}


def test_points_outside_have_no_place(spark):
    field = registration.gradient_field(volume_df(spark, np.zeros((6, 6, 6))), "v", F.col("v"))
    points = spark.createDataFrame([("s", i, i, i, 1.0, 0.0, 0.0) for i in range(30)], "seg string, pz int, py int, px int, nz double, ny double, nx double")
    assert registration.register(points, field, reach=2, step=2).count() == 0


# -- nearest cells, boxes, seams ----------------------------------------------


def test_nearest_at_any_distance(spark):
    a, b = RNG.integers(0, 400, (60, 3)), np.concatenate([RNG.integers(0, 60, (40, 3)), RNG.integers(300, 400, (3, 3))])
    left = spark.createDataFrame([("k", i, *map(int, p)) for i, p in enumerate(a)] + [("lonely", 999, 1, 1, 1)], "key string, id int, pz int, py int, px int")
    right = spark.createDataFrame([("k", *map(int, p)) for p in b], "key string, pz int, py int, px int")
    got = {r.id: (r.d2, r.r_pz, r.r_py, r.r_px) for r in seams.nearest_any(left, right, ["key"], ["id"], seams.POINT, 5.0).collect()}
    want = {i: min((int(((p - q) ** 2).sum()), *map(int, q)) for q in b) for i, p in enumerate(a)}
    assert got == want


def test_boxes_of_all_sizes(spark):
    lo = RNG.uniform(0, 300, (70, 3))
    hi = lo + RNG.choice([1.0, 4.0, 30.0, 290.0], (70, 1)) * RNG.random((70, 3))
    cols = [f"{e}_{c}" for e in ("lo", "hi") for c in seams.AXES]
    df = spark.createDataFrame([(f"b{i:02d}", *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(lo, hi))], ["seg", *cols])
    for slack in (0.0, 7.0):
        got = [(r.a, r.b) for r in seams.touching_boxes(df, "seg", 16.0, slack).collect()]
        want = {(f"b{i:02d}", f"b{j:02d}") for i in range(70) for j in range(i + 1, 70) if (lo[i] - slack <= hi[j]).all() and (lo[j] - slack <= hi[i]).all()}
        assert len(got) == len(set(got)) and set(got) == want


def sheet(seg, y0, z, tilt=0.0, n=24):
    out = []
    for y in range(n):
        for x in range(n):
            rim = y in (0, n - 1) or x in (0, n - 1)
            k = (1 + tilt * tilt) ** 0.5
            out.append((seg, y, x, int(z + tilt * 10 * y), y0 + y * 10, x * 10, rim, 1 / k, -tilt / k, 0.0))
    return out


def test_seam_duplicate_and_winding(spark):
    rows = sheet("a", 0, 0) + sheet("b", 240, 1) + sheet("c", 0, 4) + sheet("d", 900, 0)
    cells = spark.createDataFrame(rows, "seg string, y int, x int, pz int, py int, px int, rim boolean, nz double, ny double, nx double")
    got = {(r.a, r.b): r for r in seams.classify(cells, 12.0).collect()}
    assert set(got) == {("a", "b"), ("b", "c")} or got[("a", "b")].kind == "seam"
    assert got[("a", "b")].kind == "seam" and got[("a", "b")].seam == 24 and got[("a", "b")].overlap == round(24 / 576, 3)
    # a sheet that lies on another is near everywhere, but above it, not beside
    assert ("a", "c") not in got and ("a", "d") not in got
    moved = spark.createDataFrame(rows[:576] + sheet("e", 5, 1), cells.schema)
    twin = seams.classify(moved, 12.0).first()
    assert twin.kind == "duplicate" and twin.overlap > 0.9


def test_normals_of_tilted_sheets_decide(spark):
    # both sheets climb; with a flat normal the offset would count as above
    rows = sheet("a", 0, 0, tilt=1.0) + [(s, y, x, z + 240, py, px, rim, nz, ny, nx) for s, y, x, z, py, px, rim, nz, ny, nx in sheet("b", 240, 0, tilt=1.0)]
    cells = spark.createDataFrame(rows, "seg string, y int, x int, pz int, py int, px int, rim boolean, nz double, ny double, nx double")
    r = seams.classify(cells, 15.0).first()
    assert r.kind == "seam" and r.edge_on == 1.0 and r.perp < 1e-6


# -- experiments --------------------------------------------------------------


def test_moments_give_the_correlations_of_the_cells(spark):
    n = 400
    f, c = RNG.integers(0, 200, (3, n)), RNG.integers(0, 50, (2, n))
    t = (f[0] + c[0] * 2 + RNG.integers(0, 150, n) > 190).astype(int)
    rows = [(i % 2, *map(int, (*f[:, i], *c[:, i], t[i]))) for i in range(n)]
    df = spark.createDataFrame(rows, ["tile", "f0", "f1", "f2", "c0", "c1", "t"])
    m = experiments.Moments(["f0", "f1", "f2"], ["c0", "c1"], ["t"])
    tiles = experiments.expand(m.collect(df, ["tile"]), [("v", 2.0, -1.0, 0.5)], ["variant"], m)
    for r in tiles.select("tile", m.r("t").alias("r"), m.partial_r("t").alias("pr")).collect():
        k = np.arange(n) % 2 == r.tile
        s = 2 * f[0, k] - f[1, k] + 0.5 * f[2, k]
        x = np.c_[np.ones(k.sum()), c[0, k], c[1, k]]
        res = lambda v: v - x @ np.linalg.lstsq(x, v, rcond=None)[0]
        assert r.r == pytest.approx(np.corrcoef(s, t[k])[0, 1])
        assert r.pr == pytest.approx(np.corrcoef(res(s.astype(float)), res(t[k].astype(float)))[0, 1])


def test_constant_tiles_have_no_correlation(spark):
    df = spark.createDataFrame([(1, 5, 7, 1)] * 4, ["tile", "f", "c", "t"])
    m = experiments.Moments(["f"], ["c"], ["t"])
    r = experiments.expand(m.collect(df, ["tile"]), [("v", 1.0)], ["variant"], m).select(m.r("t").alias("r"), m.partial_r("t").alias("p")).first()
    assert r.r is None and r.p is None


def test_shifted_marks(spark):
    a = RNG.random((7, 9)) < 0.3
    shifts = [(0, 0), (2, 5), (6, 8), (3, 0)]
    got = {(r.y, r.x): r.marks for r in experiments.shifted_marks(plane_df(spark, {"m": a}), "m", shifts).collect()}
    for k, s in enumerate(shifts):
        want = np.roll(a, s, (0, 1))
        assert all(bool(got[y, x] >> k & 1) == want[y, x] for y in range(7) for x in range(9))


def battery(spark, signal):
    """Two scrolls with a label, one whose label the features never saw."""
    rows = []
    for scroll in "ABR":
        for tile in range(60):
            t = RNG.random(64) < (0.0 if scroll != "R" and tile % 6 == 0 else 0.3)
            spot = RNG.random(64) < 0.3
            # the one feature follows the label, the other has nothing to do with it
            a = RNG.normal(100, 20, 64) + (signal if scroll != "R" else 0) * t
            b = RNG.normal(100, 20, 64)
            rows += [(scroll, tile, int(u), int(v), int(x), int(s)) for u, v, x, s in zip(a, b, t, spot)]
    df = spark.createDataFrame(rows, "scroll string, tile int, a int, b int, t int, t0 int")
    m = experiments.Moments(["a", "b"], [], ["t", "t0"])
    tiles = m.collect(df, ["scroll", "tile"]).withColumn("fresh", experiments.draw(F.col("tile").cast("long"), 777))
    return m, tiles


def trials():
    out = []
    for name, w in (("planted", (1.0, 0.2)), ("null", (0.0, 1.0)), ("knife", (1.0, -6.0))):
        out += [(name, "whole", *w), (name, "drop b", w[0], 0.0), (name, "alone b", 0.0, w[1])]
        out += [(name, f"jitter {k}", w[0] * (0.85 if k % 2 else 1.15), w[1] * (1.15 if k % 3 else 0.85)) for k in range(8)]
    return out


def test_battery_tells_planted_from_null(spark):
    m, tiles = battery(spark, 40)
    sets = {
        "fresh": "scroll <> 'R' AND s_t > 1 AND fresh < 0.7", "jitter": "fresh < 0.4", "blank": "scroll <> 'R' AND s_t = 0", "blind": "scroll = 'R'",
    }
    bars = {"fresh": 0.3, "worst": 0.25, "jitter": 0.5, "blank": 0.15, "blind": 0.15}
    ablation, verdict = experiments.falsify(tiles, m, trials(), sets, "t", "t0", bars)
    v = {r.candidate: r for r in verdict.collect()}
    assert v["planted"].survived and v["planted"].scrolls == 2 and v["planted"].jitter == 1.0
    assert v["null"].killed_by == "fresh" and not v["knife"].survived
    a = {(r.candidate, r.experiment): r.r for r in ablation.collect()}
    assert a["planted", "drop b"] > 0.5 and abs(a["planted", "alone b"]) < 0.15
    # without a measured control nothing survives
    sets["blank"] = "false"
    assert {r.killed_by for r in experiments.falsify(tiles, m, trials(), sets, "t", "t0", bars)[1].collect()} <= {"blank", "fresh"}


def test_funnel_runs_survivors_only(spark):
    m, tiles = battery(spark, 40)
    run = experiments.Funnel(m, [("good", 1.0, 0.0), ("bad", 0.0, 1.0), ("mixed", 1.0, 1.0)])
    run.run("tune", tiles.where("scroll = 'A' AND s_t > 1"), m.r("t"), F.col("tune") > 0.3)
    assert {v[0] for v in run.alive} == {"good", "mixed"}
    run.run("held", tiles.where("scroll = 'B' AND s_t > 1"), m.r("t"), F.col("held") > 0.9)
    assert run.alive == []
    run.run("never", tiles, m.r("t"), F.col("never") > 0)
    got = {r.variant: r for r in run.report().collect()}
    assert got["bad"].stage == "tune" and got["bad"].held_tiles is None
    assert got["good"].stage == got["mixed"].stage == "held" and got["good"].held_tiles == 50


# -- templates ----------------------------------------------------------------


def test_masks_are_resampled_by_area(spark):
    for h, w, rows, cols in ((3, 5, 6, 4), (9, 2, 6, 4), (6, 4, 6, 4), (1, 1, 3, 2), (11, 7, 2, 3)):
        m = RNG.random((h, w)) < 0.6
        m[0, :], m[:, 0], m[-1, -1] = True, True, True
        # every cell is cut into rows x cols parts, every target cell gathers h x w of them
        want = np.kron(m, np.ones((rows, cols))).reshape(rows, h, cols, w).sum((1, 3)) * 255 // (h * w)
        cells = spark.createDataFrame([("s", 1, 20 + int(y), 7 + int(x)) for y, x in np.argwhere(m)], ["seg", "comp", "y", "x"])
        shapes = spark.createDataFrame([("s", 1, 20, 19 + h, 7, 6 + w)], ["seg", "comp", "y0", "y1", "x0", "x1"])
        got = np.zeros((rows, cols))
        for r in templates.resample_shapes(cells, shapes, rows, cols).collect():
            got[r.r, r.c] = r.v
        assert np.array_equal(got, want)


def test_bank_of_any_size_finds_its_shapes(spark, monkeypatch):
    monkeypatch.setattr(templates, "GROUP", 8)
    bank_rows = [(f"t{i:02d}", int(i), r, c, int(v)) for i in range(40) for (r, c), v in np.ndenumerate(RNG.integers(0, 255, (4, 3)))]
    tpl = spark.createDataFrame(bank_rows, ["seg", "comp", "r", "c", "v"])
    plane = RNG.integers(0, 200, (50, 45))
    t = np.array([[v for s, i, r, c, v in bank_rows if i == k] for k in range(40)]).reshape(40, 4, 3)
    plane[30:34, 31:34], plane[5:9, 40:43] = t[7], t[21] // 2
    bank = templates.bank_of(tpl, 4, 3)
    assert bank.select("g").distinct().count() > 1
    got = {(r.y, r.x): (r.id, r.r) for r in templates.bank_response(plane_df(spark, {"a": plane}), "a", bank, 4, 3, 0.7).collect()}
    want = {}
    for y in range(47):
        for x in range(43):
            w = plane[y : y + 4, x : x + 3].ravel()
            r = max((round(np.corrcoef(w, t[k].ravel())[0, 1], 9), -k) for k in range(40))
            if r[0] >= 0.7:
                want[y, x] = (f"t{-r[1]:02d}:{-r[1]}", r[0])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
    assert got[30, 31] == ("t07:7", 1.0) and got[5, 40][0] == "t21:21"


def test_bank_in_strips_settles_ties_and_flat_ones(spark, monkeypatch):
    monkeypatch.setattr(templates, "GROUP", 4)
    monkeypatch.setattr(templates, "STRIP", 1)
    shapes = RNG.integers(0, 255, (12, 12))
    shapes[3], shapes[9], shapes[11] = 7, shapes[2], shapes[5] * 2 + 1  # flat, equal, and as good as another
    rows = [(f"t{i:02d}", i, k // 3, k % 3, int(v)) for i, t in enumerate(shapes) for k, v in enumerate(t)]
    plane = RNG.integers(0, 200, (40, 70))
    plane[30:34, 31:34], plane[5:9, 40:43], plane[20:30, 5:20] = shapes[9].reshape(4, 3), shapes[11].reshape(4, 3), 9
    bank = templates.bank_of(spark.createDataFrame(rows, ["seg", "comp", "r", "c", "v"]), 4, 3)
    out = templates.bank_response(plane_df(spark, {"a": plane}), "a", bank, 4, 3, 0.6)
    # strips meet groups in one task each: no row of a block is joined to a row of the bank
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroupsInArrow" in plan and "Join" not in plan.split("CoGroupsInArrow")[0]
    want = {}
    for y, x in np.ndindex(37, 68):
        w = plane[y : y + 4, x : x + 3].ravel()
        if w.std() > 0:
            r, k = max((round(np.corrcoef(w, t)[0, 1], 9), -k) for k, t in enumerate(shapes) if t.std() > 0)
            if r >= 0.6:
                want[y, x] = (f"t{-k:02d}:{-k}", r)
    got = {(r.y, r.x): (r.id, r.r) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)
    assert got[30, 31][0] == "t02:2" and got[5, 40][0] == "t05:5"


# -- thinning -----------------------------------------------------------------


def plain_skeleton(m):
    while True:
        before = m.copy()
        for half in (0, 1):
            gone = []
            for y, x in np.argwhere(m):
                n = [bool(0 <= y + a < m.shape[0] and 0 <= x + b < m.shape[1] and m[y + a, x + b])
                     for a, b in ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))]
                turns = sum(not p and q for p, q in zip(n, n[1:] + n[:1]))
                p2, p4, p6, p8 = n[0], n[2], n[4], n[6]
                open_ = not (p2 and p4 and (p8 if half else p6)) and not ((p2 if half else p4) and p6 and p8)
                if 2 <= sum(n) <= 6 and turns == 1 and open_:
                    gone.append((y, x))
            for y, x in gone:
                m[y, x] = False
        if (m == before).all():
            return m


@pytest.mark.parametrize("block,border", [(8, 4), (16, 8), (128, 8)])
def test_thinning_across_blocks(spark, block, border):
    m = np.zeros((40, 44), bool)
    m[4:13, 3:40], m[8:36, 18:27], m[30:38, 2:30] = True, True, True
    m |= RNG.random(m.shape) < 0.05
    want = plain_skeleton(m.copy())
    got = np.zeros_like(m)
    for r in thinning.skeleton(plane_df(spark, {"m": m}).where("m"), block=block, border=border).collect():
        got[r.y, r.x] = True
    assert np.array_equal(got, want)
    near = {(r.y, r.x): r.near for r in thinning.neighbours(plane_df(spark, {"m": want}).where("m").select("seg", "y", "x")).collect()}
    p = np.pad(want, 1).astype(int)
    assert near == {(int(y), int(x)): int(p[y : y + 3, x : x + 3].sum()) - 1 for y, x in np.argwhere(want)}


def test_smoothing_keeps_sums(spark):
    # the registration queries smooth with the axis windows along depth too
    v = RNG.integers(0, 9, (5, 4, 6))
    got = axis.sliding_sum(volume_df(spark, v), axis.DEPTH, {"s": ("v", 2, 2)}, "zero").collect()
    assert all(r.s == v[max(0, r.z - 2) : r.z + 3, r.y, r.x].sum() for r in got)


def test_longest_stem_with_one_short_stem(spark):
    """Stems of many lengths, one of a letter: every name gets the longest that it holds."""
    rnd = np.random.default_rng(3)
    word = lambda n: "".join(rnd.choice(list("abc"), n))
    stems = [(g, s) for g in "xy" for s in {word(int(n)) for n in rnd.integers(2, 12, 25)} | ({"a"} if g == "x" else {"", "cc"})]
    files = [(g, word(int(n)), k) for k, (g, n) in enumerate(zip("xy" * 40, rnd.integers(1, 30, 80)))]
    got = catalog.longest_stem(
        spark.createDataFrame(files, "g string, name string, k int"), spark.createDataFrame(stems, "g string, s string"), ["g"], "name", "s"
    )
    want = {}
    for g, name, k in files:
        held = [s for h, s in stems if h == g and s and s in name]
        if held:
            want[k] = max(held, key=lambda s: (len(s), s))
    assert {r.k: r.s for r in got.collect()} == want
