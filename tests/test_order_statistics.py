import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import controls, learn, nulls, quantiles, stats
from tests.helpers import back, plane_df, tie_auc

RNG = np.random.default_rng(9)


def frame(spark, values, seg="s"):
    return spark.createDataFrame([(seg, float(v)) for v in values], ["seg", "v"])


@pytest.mark.parametrize("values", [RNG.normal(0, 50, 999), RNG.integers(0, 5, 400), np.r_[np.full(500, 3.0), RNG.uniform(3, 3.001, 500)], [7.0]])
def test_percentiles_are_exact(spark, values):
    ps = {"a": 0, "b": 37.5, "c": 90, "d": 99.9, "e": 100}
    got = quantiles.percentiles(frame(spark, values), ["seg"], "v", ps).first()
    for n, p in ps.items():
        assert got[n] == pytest.approx(np.percentile(values, p), rel=1e-12, abs=1e-12)


def test_hot_group_beside_a_small_one(spark):
    big, small = RNG.normal(size=5000), RNG.normal(size=7)
    df = frame(spark, big, "hot").unionByName(frame(spark, small, "cold"))
    got = {r.seg: r.p for r in quantiles.percentiles(df, ["seg"], "v", {"p": 90}).collect()}
    assert got["hot"] == pytest.approx(np.percentile(big, 90)) and got["cold"] == pytest.approx(np.percentile(small, 90))


def test_ranks_average_ties(spark):
    v = RNG.integers(-20, 20, 300)
    rows = quantiles.ranked_values(frame(spark, v), ["seg"], "v").collect()
    for r in rows:
        assert r.lt == (v < r.v).sum() and r.n == (v == r.v).sum()


def test_auc_with_ties_and_class_floor(spark):
    score, pos = RNG.integers(0, 12, 500), RNG.random(500) < 0.3
    df = spark.createDataFrame([("s", int(a), bool(b)) for a, b in zip(score, pos)], ["seg", "f", "p"])
    assert quantiles.auc(df, ["seg"], "f", F.col("p")).first().auc == pytest.approx(tie_auc(score, pos))
    assert quantiles.auc(df, ["seg"], "f", F.col("p"), least=400).first().auc is None


def test_display_window_edge_cases(spark):
    got = quantiles.floor_index_window(plane_df(spark, {"a": np.zeros((4, 4), int)}), ["seg"], "a").first()
    assert (got.lo, got.hi) == (0.0, 255.0)
    got = quantiles.floor_index_window(plane_df(spark, {"a": np.full((4, 4), 9)}), ["seg"], "a").first()
    assert (got.lo, got.hi) == (9.0, 10.0)


def test_decile_of_an_empty_map_is_the_default(spark):
    h = quantiles.histogram(plane_df(spark, {"a": np.zeros((3, 3), int)}), ["seg"], "a")
    assert h.count() == 256 and quantiles.histogram_decile(h, ["seg"]).first().cut == 128


def test_overlap_null_equals_rolling_whole_planes(spark):
    a, b, m = (RNG.random((12, 16)) < p for p in (0.3, 0.3, 0.8))
    shifts = nulls.draw_shifts(1, 6, 2, 12, 16)
    got = nulls.overlap_null(plane_df(spark, {"a": a, "b": b, "m": m}), ["seg"], F.col("a"), F.col("b"), F.col("m"), shifts)
    for r in got.collect():
        mr = m & np.roll(m, shifts[r.k], (0, 1))
        x, y = a & m & mr, np.roll(b & m, shifts[r.k], (0, 1)) & mr
        assert r.null_j == pytest.approx((x & y).sum() / (x | y).sum())


def test_auc_null_equals_rolling_the_target(spark):
    s, t = RNG.integers(0, 40, (14, 15)), RNG.random((14, 15)) < 0.25
    shifts = nulls.draw_shifts(2, 4, 3, 14, 15)
    got = controls.auc_null(plane_df(spark, {"a": s, "t": t}), ["seg"], "a", F.col("t"), shifts)
    want = {k: tie_auc(s.ravel(), (np.roll(t, sh, (0, 1))).ravel()) for k, sh in enumerate([(0, 0), *shifts])}
    assert {r.k: round(r.auc, 9) for r in got.collect()} == {k: round(max(v, 1 - v), 9) for k, v in want.items()}


def test_corr_null_equals_rolling_the_target(spark):
    s, t = RNG.integers(0, 99, (14, 15)), RNG.random((14, 15)) < 0.25
    shifts = nulls.draw_shifts(2, 3, 3, 14, 15)
    for r in controls.corr_null(plane_df(spark, {"a": s, "t": t}), ["seg"], "a", F.col("t"), shifts).collect():
        rolled = np.roll(t, [(0, 0), *shifts][r.k], (0, 1))
        assert r.r == pytest.approx(np.corrcoef(s.ravel(), rolled.ravel())[0, 1])


def test_paired_maximum_uses_one_area_for_both(spark):
    za, zb, reg = RNG.normal(size=(12, 12)), RNG.normal(size=(12, 12)), RNG.random((12, 12)) < 0.7
    shifts = [(3, -2), (-4, 5)]
    got = controls.paired_maximum(plane_df(spark, {"za": za, "zb": zb, "r": reg}), ["seg"], "za", "zb", "r", shifts, 1)
    for r in got.collect():
        area = reg & np.roll(reg, shifts[r.k], (0, 1))
        assert r.obs == pytest.approx(np.minimum(za, zb)[area].max()) and r.area == area.sum()
        assert r.null == pytest.approx(np.minimum(za, np.roll(zb, shifts[r.k], (0, 1)))[area].max())


def test_roll_then_flip(spark):
    a = RNG.integers(0, 99, (8, 9))
    for flip in range(4):
        got = back(controls.rolled_flipped(plane_df(spark, {"a": a}), ["seg"], [(3, 4, flip)]), "a", a.shape)
        want = np.roll(a, (3, 4), (0, 1))
        want = want[::-1] if flip in (1, 3) else want
        want = want[:, ::-1] if flip in (2, 3) else want
        assert np.array_equal(got, want)


def test_partial_corr_is_least_squares_on_both_sides(spark):
    n = 400
    c1, c2 = RNG.normal(size=n), RNG.normal(size=n)
    x, y = c1 + 0.5 * c2 + RNG.normal(size=n), c1 - c2 + RNG.normal(size=n)
    A = np.column_stack([np.ones(n), c1, c2])
    rx, ry = (v - A @ np.linalg.lstsq(A, v, rcond=None)[0] for v in (x, y))
    df = spark.createDataFrame([("s", *map(float, r)) for r in zip(x, y, c1, c2)], ["seg", "x", "y", "c1", "c2"])
    got = stats.partial_corr(df, ["seg"], "x", "y", ["c1", "c2"]).first().partial_r
    assert got == pytest.approx(np.corrcoef(rx, ry)[0, 1], abs=1e-9)


def test_sign_test_matches_binomial_tail(spark):
    from math import comb

    for k, n in ((0, 5), (1, 1), (5, 5), (3, 5), (30, 47), (1200, 2300), (1100, 2300), (900, 900), (6, 5)):
        got = spark.range(1).select(learn.sign_test(F.lit(k).cast("long"), F.lit(n).cast("long")).alias("p")).first().p
        assert got == pytest.approx(sum(comb(n, i) for i in range(k, n + 1)) / 2**n, rel=1e-8)
    # no array of n terms is built: two deviations above the middle of 10^10
    far = spark.range(1).select(learn.sign_test(F.lit(5 * 10**9 + 10**5), F.lit(10**10)).alias("p")).first().p
    assert far == pytest.approx(0.02275, rel=1e-3)


def test_logistic_fit_reaches_the_gradient_descent_optimum(spark):
    n = 600
    X = RNG.normal(size=(n, 2))
    y = RNG.random(n) < 1 / (1 + np.exp(-(1.5 * X[:, 0] - X[:, 1] - 1)))
    lam = 1 / (0.02 * n)
    sw = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, b = np.zeros(2), 0.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(X @ w + b)))
        w, b = w - 0.5 * (X.T @ (sw * (p - y)) / n + lam * w), b - 0.5 * (sw * (p - y)).mean()
    df = spark.createDataFrame([(*map(float, r), bool(t)) for r, t in zip(X, y)], ["p", "q", "t"])
    got = {r.term: r.weight for r in learn.fit_logistic(df, ["p", "q"], "t").collect()}
    assert got["p"] == pytest.approx(w[0], abs=1e-3) and got["q"] == pytest.approx(w[1], abs=1e-3)
    assert got["intercept"] == pytest.approx(b, abs=1e-3)


def test_planted_bump_raises_only_its_surroundings(spark):
    a = np.zeros((11, 11))
    df = plane_df(spark, {"a": a})
    out = controls.planted(df, df.where("y = 5 AND x = 5"), ["seg"], ["a"], controls.stamp(1.0, 2), F.array(F.lit(0.0), F.lit(2.0)), 10.0)
    none = back(out.where("alpha = 0"), "a", a.shape)
    some = back(out.where("alpha = 2"), "a", a.shape)
    assert not none.any() and some[5, 5] == pytest.approx(20) and some[5, 8] == 0 and some[5, 6] < some[5, 5]
