import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators import agreement, axis, features, fields
from tests.helpers import back, box_edge, plane_df, uniform_mirror

RNG = np.random.default_rng(4)
A = RNG.integers(0, 256, (13, 17))


@pytest.mark.parametrize("r", [1, 3, 6])
def test_box_mean_replicates_edges(spark, r):
    got = back(axis.box_mean(plane_df(spark, {"a": A}), {"m": ("a", r)}), "m", A.shape)
    assert np.allclose(got, box_edge(A, r))


@pytest.mark.parametrize("size", [3, 4, 7])
def test_uniform_mean_mirrors_and_shifts_even_sizes(spark, size):
    for first in (axis.ROW, axis.COL):
        got = back(axis.uniform_mean(plane_df(spark, {"a": A}), {"m": ("a", size)}, first=first), "m", A.shape)
        assert np.allclose(got, uniform_mirror(A, size))


def test_valid_box_only_where_it_fits(spark):
    got = back(axis.valid_box(plane_df(spark, {"a": A}), {"s": "a"}, 4), "s", (10, 14))
    want = sum(A[i : i + 10, j : j + 14] for i in range(4) for j in range(4))
    assert np.array_equal(got, want)


def test_gradient_matches_numpy(spark):
    df = features.gradients(plane_df(spark, {"a": A}), "a", second=True)
    gy, gx = np.gradient(A.astype(float))
    assert np.allclose(back(df, "gx", A.shape), gx) and np.allclose(back(df, "gy", A.shape), gy)
    assert np.allclose(back(df, "gyy", A.shape), np.gradient(gy, axis=0))


def test_gaussian_mirrors(spark):
    w = np.array(axis.gauss_weights(1.2))
    r = len(w) // 2
    p = np.pad(A.astype(float), r, mode="symmetric")
    rows = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 1, p)
    want = np.apply_along_axis(lambda v: np.convolve(v, w, "valid"), 0, rows)
    got = back(axis.gaussian(plane_df(spark, {"a": A}), {"g": "a"}, 1.2), "g", A.shape)
    assert np.allclose(got, want)


def test_square_extremes(spark):
    df = axis.square_extreme(plane_df(spark, {"a": A}), {"hi": ("a", 2)}, "max")
    p = np.pad(A, 2, mode="constant", constant_values=-1)
    want = np.max([p[i : i + 13, j : j + 17] for i in range(5) for j in range(5)], axis=0)
    assert np.array_equal(back(df, "hi", A.shape), want)


def test_letter_box_is_zero_at_the_edge_of_a_half_mask(spark):
    a = np.full((20, 20), 100)
    m = np.zeros((20, 20), bool)
    m[:, :10] = True
    df = agreement.box_response(plane_df(spark, {"a": a, "m": m}), {"l": "a"}, "m", 5)
    got = back(df, "l", a.shape)
    assert got[10, 9] == 0 and got[10, 15] == 0 and got[10, 5] == pytest.approx(100)


def test_convolve_and_line_kernels(spark):
    k = {(0, 0): 0.5, (-1, 1): 2.0, (2, 0): -1.0}
    got = back(fields.convolve(plane_df(spark, {"a": A}), "a", k, "c"), "c", A.shape)
    p = np.pad(A.astype(float), 3)
    want = sum(w * p[3 + dy : 16 + dy, 3 + dx : 20 + dx] for (dy, dx), w in k.items())
    assert np.allclose(got, want)
    flat = fields.line_kernel(5, 1, 0)
    assert set(flat) == {(0, d) for d in range(-2, 3)} and sum(flat.values()) == pytest.approx(1)


def test_ridge_answers_bars_of_either_polarity(spark):
    a = np.zeros((21, 21))
    a[:, 10] = 100
    got = back(features.ridge(plane_df(spark, {"a": a}), "a", 1), "ridge", a.shape)
    neg = back(features.ridge(plane_df(spark, {"a": -a}), "a", 1), "ridge", a.shape)
    assert got[10, 10] > 0 and neg[10, 10] < 0 and abs(got[10, 2]) < 1e-9


def test_structure_tensor_sees_stripes(spark):
    a = np.tile((np.arange(24) % 4 < 2) * 100.0, (24, 1))
    df = features.structure_tensor(plane_df(spark, {"a": a}), "a", 3)
    assert back(df, "coh", a.shape)[12, 12] == pytest.approx(1.0)


def test_combine_is_null_where_a_map_is_missing(spark):
    df = plane_df(spark, {"a": A, "b": A[::-1]}).withColumn("b", F.when(F.col("x") > 0, F.col("b")))
    got = features.combine(df, {"a": 1.0, "b": 0.5})
    assert got.where("x = 0 AND score IS NOT NULL").isEmpty() and got.where("x > 0 AND score IS NULL").isEmpty()
