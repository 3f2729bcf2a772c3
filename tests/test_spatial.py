import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import agreement, components, fields, ranking, spatial
from tests.helpers import back, flood, plane_df, volume_df

RNG = np.random.default_rng(12)


def spiral(n):
    m = np.zeros((n, n), bool)
    y = x = 0
    dy, dx = 0, 1
    m[0, 0] = True
    for _ in range(n * n):
        ny, nx = y + dy, x + dx
        ahead = (ny + dy, nx + dx)
        free = 0 <= ny < n and 0 <= nx < n and not m[ny, nx]
        clear = not (0 <= ahead[0] < n and 0 <= ahead[1] < n and m[ahead])
        if free and clear:
            y, x = ny, nx
            m[y, x] = True
        else:
            dy, dx = dx, -dy
            ny, nx = y + dy, x + dx
            if not (0 <= ny < n and 0 <= nx < n) or m[ny, nx]:
                break
    return m


@pytest.mark.parametrize("mask", [RNG.random((24, 24)) < 0.55, spiral(21), np.ones((17, 17), bool)])
def test_components_across_blocks(spark, mask):
    df = plane_df(spark, {"m": mask}).where("m")
    want = flood(mask)
    for block in (4, 256):
        got = back(components.label(df, ["seg"], block), "comp", mask.shape, fill=-1)
        pairs = {(g, w) for g, w in zip(got[mask], want[mask])}
        assert len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs}) == want.max()


def test_component_shapes(spark):
    m = np.zeros((9, 9), bool)
    m[2:5, 3] = m[4, 3:7] = True
    s = components.shapes(components.label(plane_df(spark, {"m": m}).where("m"), ["seg"]), ["seg"]).first()
    assert (s.area, s.y0, s.y1, s.x0, s.x1, s.fill, s.aspect) == (6, 2, 4, 3, 6, 0.5, 1.333)


def test_distance_transform(spark):
    m = RNG.random((15, 18)) < 0.85
    bg = np.argwhere(~m)
    want = np.array([[np.sqrt(((bg - (y, x)) ** 2).sum(1).min()) for x in range(18)] for y in range(15)])
    df = plane_df(spark, {"m": m})
    assert np.allclose(back(spatial.distance(df, "m", "d"), "d", m.shape), want)
    near = back(spatial.distance_within(df, "m", 2, "d"), "d", m.shape)
    assert np.allclose(np.nan_to_num(near, nan=99), np.where(want <= 2, want, 99))


def test_distance_without_any_outside_is_null(spark):
    assert spatial.distance(plane_df(spark, {"m": np.ones((3, 3), bool)}), "m", "d").where("d IS NOT NULL").isEmpty()


def test_nearest_within_bound(spark):
    a, b = RNG.integers(0, 30, (60, 3)), RNG.integers(0, 30, (80, 3))
    mk = lambda pts: spark.createDataFrame([("k", i, *map(int, p)) for i, p in enumerate(pts)], ["k", "id", "z", "y", "x"])
    got = spatial.nearest_within(mk(a), mk(b).drop("id"), ["k"], ["id"], ["z", "y", "x"], 5.0).collect()
    d2 = ((a[:, None] - b[None]) ** 2).sum(-1).min(1)
    assert {r.id: r.d2 for r in got} == {i: d for i, d in enumerate(d2) if d <= 25}


def test_overlapping_boxes_match_brute_force(spark):
    lo = RNG.integers(0, 60, (40, 2))
    hi = lo + RNG.integers(0, 25, (40, 2))
    rows = [("s", i, *map(int, (p[0], q[0], p[1], q[1]))) for i, (p, q) in enumerate(zip(lo, hi))]
    df = spark.createDataFrame(rows, ["seg", "id", "y0", "y1", "x0", "x1"])
    got = [(r.id, r.r_id) for r in spatial.overlapping_boxes(df, df, ["seg"], 8, slack=2).collect()]
    want = {(i, j) for i in range(40) for j in range(40) if (lo[i] <= hi[j] + 2).all() and (lo[j] <= hi[i] + 2).all()}
    assert len(got) == len(set(got)) and set(got) == want


def test_gather_reads_nearest_voxel_and_zero_outside(spark):
    vol = RNG.integers(0, 256, (9, 10, 11))
    vol[:4, :4, :4] = 0
    pts = RNG.uniform(-3, 13, (200, 3))
    df = spark.createDataFrame([("s", i, *map(float, p)) for i, p in enumerate(pts)], ["seg", "id", "pz", "py", "px"])
    got = {r.id: r.v for r in spatial.gather(df, spatial.chunked(volume_df(spark, vol), 4, 4, 4), 4, 4, 4).collect()}
    for i, p in enumerate(np.rint(pts).astype(int)):
        inside = (p >= 0).all() and (p < vol.shape).all()
        assert got[i] == (vol[tuple(p)] if inside else 0)


def test_separated_peaks(spark):
    a = RNG.normal(size=(20, 20))
    got = {r.place: (r.y, r.x) for r in ranking.separated_peaks(plane_df(spark, {"a": a}), ["seg"], "a", 4, 5).collect()}
    work = a.copy()
    for k in range(1, 5):
        y, x = np.unravel_index(work.argmax(), work.shape)
        assert got[k] == (y, x)
        work[max(0, y - 5) : y + 5, max(0, x - 5) : x + 5] = -np.inf


def test_phase_field_recovers_a_planted_shift_and_warp_improves(spark):
    a = RNG.integers(0, 256, (64, 64)).astype(float)
    b = np.roll(a, (3, -2), (0, 1))
    df = plane_df(spark, {"a": a, "b": b}).withColumn("m", F.lit(True))
    f = fields.block_shifts(df, "a", "b", "m", 32, 5.0, 8).collect()
    assert all(r.ok and (r.fy, r.fx) == (-3, 2) for r in f)
    w = fields.warp(df, "b", F.lit(-3.0), F.lit(2.0), "wb")
    before, after = df.select(F.corr("a", "b")).first()[0], w.select(F.corr("a", "wb")).first()[0]
    assert after > before + 0.2


def test_untrusted_blocks_take_the_median(spark):
    rows = [("s", 0, 0, 4.0, 1.0, 9.0, True), ("s", 0, 1, 4.0, 1.0, 9.0, True), ("s", 1, 0, 4.0, 1.0, 9.0, True), ("s", 1, 1, 0.0, 0.0, 0.0, False)]
    df = spark.createDataFrame(rows, "seg string, by int, bx int, fy double, fx double, sharp double, ok boolean")
    assert all(abs(r.fy - 4) < 1e-9 and abs(r.fx - 1) < 1e-9 for r in fields.fill_field(df).collect())


def test_trilinear_is_exact_on_a_ramp(spark):
    z, y, x = np.mgrid[0:5, 0:5, 0:5]
    df = spark.createDataFrame([("s", 0, 1.25, 2.5, 3.75), ("s", 1, 0.0, 0.0, 1.0)], ["seg", "id", "pz", "py", "px"])
    got = {r.id: r.v for r in fields.trilinear(df, volume_df(spark, z * 3 + y * 5 + x * 7)).collect()}
    assert got[0] == pytest.approx(1.25 * 3 + 2.5 * 5 + 3.75 * 7) and got[1] == pytest.approx(7)


def test_registration_raises_agreement(spark):
    a = RNG.integers(60, 256, (64, 64))
    b = np.roll(a, (3, -2), (0, 1))
    df = plane_df(spark, {"a": a, "b": b, "n": np.ones((64, 64), int)})
    plain, moved = (agreement.agreement_report(agreement.prepared(d), [(20, 20), (30, -25)]).first() for d in (df, agreement.registered(df)))
    assert moved.r > plain.r + 0.5 and moved.jaccard > 0.7 > plain.jaccard + 0.3
    # the null of the registered pair is still that of unrelated calls
    assert moved.null_mean < 0.3


def follow(r, vy, vx, c, node):
    """One step of a directed cell (y, x, way), written out plainly."""
    y, x, s = node
    h, w = r.shape
    if not (1 <= y < h - 1 and 1 <= x < w - 1) or r[y, x] < 0.5 or c[y, x] < 0.25:
        return None
    ay, ax = round(1000 * vy[y, x]), round(1000 * vx[y, x])
    best = None
    for o in range(-4, 5):
        ny, nx = (2000 * y + 2 * s * ay - ax * o + 1000) // 2000, (2000 * x + 2 * s * ax + ay * o + 1000) // 2000
        if 1 <= ny < h - 1 and 1 <= nx < w - 1 and (best is None or r[ny, nx] > r[best]):
            best = (ny, nx)
    if best is None or best == (y, x):
        return None
    by, bx = round(1000 * vy[best]), round(1000 * vx[best])
    return (*best, s if ay * by + ax * bx >= 0 else -s)


def test_tracks_run_across_the_sheet(spark):
    h, w = 40, 700
    ys, xs = np.mgrid[0:h, 0:w]
    crest = 20 + 8 * np.sin(xs / 25)
    r = np.round(12 - 3 * np.abs(ys - crest), 6)
    slope = 8 / 25 * np.cos(xs / 25)
    vy, vx = slope / np.hypot(1, slope), 1 / np.hypot(1, slope)
    flip = RNG.random((h, w)) < 0.5  # directions have no sign
    vy, vx = np.where(flip, -vy, vy), np.where(flip, -vx, vx)
    c = np.where(xs == 650, 0.1, 0.9)
    df = plane_df(spark, {"r": r, "vy": vy, "vx": vx, "c": c})
    rows = fields.ridge_tracks(df, "r", "vy", "vx", "c", spacing=12, least=40).collect()
    tracks = {}
    for t in rows:
        tracks.setdefault((t.track_y, t.track_x), {})[t.step] = (t.y, t.x)
    assert tracks and max(map(len, tracks.values())) > 600
    for (y, x), places in tracks.items():
        want = {0: (y, x)}
        for way in (1, -1):
            node, seen, k = (y, x, way), {(y, x, way)}, 0
            while (node := follow(r, vy, vx, c, node)) is not None and node not in seen:
                seen.add(node)
                k += 1
                want[way * k] = node[:2]
        assert places == want
    # seeds keep apart: taken strongest first, none beside another
    grid = sorted(((r[y, x], -y, -x) for y in range(10, h - 10, 12) for x in range(10, w - 10, 12) if r[y, x] > 3 and c[y, x] > 0.4), reverse=True)
    taken = []
    for _, y, x in grid:
        if all(max(abs(-y - a), abs(-x - b)) > 12 for a, b in taken):
            taken.append((-y, -x))
    seeds = {(t.y, t.x) for t in fields.separated_seeds(df, "r", "c", 12).collect()}
    assert seeds == set(taken)


def test_tracks_stop_where_they_meet_themselves(spark):
    n = 41
    ys, xs = np.mgrid[0:n, 0:n] - 20
    rad = np.hypot(ys, xs)
    r = np.round(12 - 4 * np.abs(rad - 12), 6)
    vy, vx = xs / np.maximum(rad, 1), -ys / np.maximum(rad, 1)
    df = plane_df(spark, {"r": r, "vy": vy, "vx": vx, "c": np.ones((n, n))})
    t = fields.ridge_tracks(df, "r", "vy", "vx", "c", spacing=6, least=20)
    sizes = [x["count"] for x in t.groupBy("track_y", "track_x").count().collect()]
    assert sizes and all(60 < k < 400 for k in sizes)
