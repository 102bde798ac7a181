"""Neighbourhood operators against NumPy brute force, across block borders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import grid as G
from ridgeline.operators.skeleton import soft_skeleton

H, W = 37, 45


@pytest.fixture(scope="module")
def plane():
    rng = np.random.default_rng(3)
    return np.linspace(0, 40, H)[:, None] + np.linspace(0, 25, W)[None, :] + rng.normal(0, 3, (H, W))


def frame(spark, a, tile=1, name="z"):
    rows = [(tile, r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1]) if not np.isnan(a[r, c])]
    return spark.createDataFrame(rows, f"tile bigint, row bigint, col bigint, {name} double")


def meta(spark, h=H, w=W):
    return spark.createDataFrame([(1, h, w)], "tile bigint, height bigint, width bigint")


def array(df, name, h=H, w=W):
    out = np.full((h, w), np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r["row"], r["col"]] = r[name]
    return out


def windows(a, k, mode):
    b, e = k // 2, k - 1 - k // 2
    p = np.pad(a, ((b, e), (b, e)), mode={"replicate": "edge", "reflect": "symmetric"}[mode])
    return np.lib.stride_tricks.sliding_window_view(p, (k, k)).reshape(*a.shape, k * k)


@pytest.mark.parametrize("k", [3, 4, 10, 20])
@pytest.mark.parametrize("border", ["replicate", "reflect"])
def test_median(spark, plane, k, border):
    got = array(G.median_filter(frame(spark, plane), meta(spark), k, border, block=16), "median")
    want = np.sort(windows(plane, k, border), axis=-1)[..., k * k // 2]
    np.testing.assert_array_equal(got, want)


def test_even_median_takes_the_upper_middle(spark):
    a = np.arange(16, dtype=float).reshape(4, 4)
    got = array(G.median_filter(frame(spark, a), meta(spark, 4, 4), 4), "median", 4, 4)
    assert got[2, 2] == 8


@pytest.mark.parametrize("k", [3, 4, 15])
def test_box_mean(spark, plane, k):
    got = array(G.box_mean(frame(spark, plane), meta(spark), {"m": "z"}, k, block=16), "m")
    np.testing.assert_allclose(got, windows(plane, k, "replicate").mean(-1), rtol=1e-12)


def test_reflect_wider_than_the_raster(spark):
    a = np.random.default_rng(0).normal(size=(5, 6))
    got = array(G.box_mean(frame(spark, a), meta(spark, 5, 6), {"m": "z"}, 15, "reflect", block=4), "m", 5, 6)
    np.testing.assert_allclose(got, windows(a, 15, "reflect").mean(-1), rtol=1e-12)


@pytest.mark.parametrize("radius", [1, 5])
def test_dilate_fills_holes_first(spark, radius):
    rng = np.random.default_rng(5)
    a = (rng.random((H, W)) < 0.05).astype(float)
    a[rng.random((H, W)) < 0.1] = np.nan
    got = array(G.dilate(frame(spark, a), meta(spark), {"m": "z"}, radius, block=8), "m")
    p = np.pad(np.nan_to_num(a), radius)
    want = np.lib.stride_tricks.sliding_window_view(p, (2 * radius + 1,) * 2).max((2, 3))
    np.testing.assert_array_equal(np.nan_to_num(got), want)


def test_slope_one_sided_matches_gradient(spark, plane):
    got = array(G.slope(frame(spark, plane), meta(spark), 0.5, block=16), "slope")
    gy, gx = np.gradient(plane, 0.5)
    np.testing.assert_allclose(got, np.degrees(np.arctan(np.hypot(gx, gy))), rtol=1e-12)


def test_slope_beside_a_hole_is_unknown(spark, plane):
    a = plane.copy()
    a[10, 10] = np.nan
    d = G.densify(frame(spark, a), meta(spark))
    got = array(G.slope(d, meta(spark), 1.0), "slope")
    assert np.isnan(got[10, 9]) and np.isnan(got[11, 10]) and not np.isnan(got[11, 11])


def test_block_reduce_codes_take_the_lowest(spark):
    a = np.array([[3, 2, 0, 0], [0, 0, 0, 0], [0, 0, 3, 3], [0, 0, 3, 3]], dtype=float)
    got = array(G.block_reduce(frame(spark, a), meta(spark, 4, 4), 2, {"c": ("z", "min_nonzero")}), "c", 2, 2)
    np.testing.assert_array_equal(got, [[2, 0], [0, 3]])


@pytest.mark.parametrize("k", range(4))
@pytest.mark.parametrize("flip", [False, True])
def test_d4_and_back(spark, k, flip):
    a = np.arange(15, dtype=float).reshape(3, 5)
    there = G.d4(frame(spark, a), k, flip, F.lit(3), F.lit(5))
    want = np.rot90(a[:, ::-1] if flip else a, k)
    np.testing.assert_array_equal(array(there, "z", *want.shape), want)
    np.testing.assert_array_equal(array(G.d4_inverse(there, k, flip, F.lit(3), F.lit(5)), "z", 3, 5), a)


def test_reflect_pad_ramp(spark):
    a = np.arange(20, dtype=float).reshape(5, 4) * 0.5 - 3.0
    got = array(G.reflect_pad(frame(spark, a), meta(spark, 5, 4), 2, 3), "z", 7, 7)
    np.testing.assert_array_equal(got, np.pad(a, ((0, 2), (0, 3)), mode="reflect"))


def test_reflect_pad_refuses_too_much(spark):
    a = np.ones((3, 3))
    with pytest.raises(Exception, match="smaller than the raster"):
        G.reflect_pad(frame(spark, a), meta(spark, 3, 3), 3, 0).collect()


def test_shift_exposes_zero(spark):
    a = np.arange(1, 13, dtype=float).reshape(3, 4)
    got = array(G.shift(frame(spark, a), meta(spark, 3, 4), 1, -2, ["z"]), "z", 3, 4)
    np.testing.assert_array_equal(got, [[0, 0, 0, 0], [3, 4, 0, 0], [7, 8, 0, 0]])


def brute_skeleton(x, iters):
    def erode(x):
        p = np.pad(x, 1, constant_values=np.inf)
        return np.minimum.reduce([p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])

    def dilate(x):
        p = np.pad(x, 1, constant_values=-np.inf)
        return np.lib.stride_tricks.sliding_window_view(p, (3, 3)).max((2, 3))

    relu = lambda v: np.maximum(v, 0)
    skel = relu(x - dilate(erode(x)))
    for _ in range(iters):
        x = erode(x)
        delta = relu(x - dilate(erode(x)))
        skel = skel + relu(delta - skel * delta)
    return skel


@pytest.mark.parametrize("iters", [1, 8])
def test_soft_skeleton(spark, iters):
    x = np.random.default_rng(2).random((H, W))
    got = array(soft_skeleton(frame(spark, x), meta(spark), {"s": "z"}, iters, block=16), "s")
    np.testing.assert_allclose(got, brute_skeleton(x, iters), atol=1e-12)


def test_fill_median_of_an_empty_tile_is_an_error_row(spark):
    d = G.densify(frame(spark, np.full((2, 2), np.nan)), meta(spark, 2, 2))
    rows = G.fill_median(d).collect()
    assert len(rows) == 4 and all(r["error"] for r in rows)


def test_bilinear_beyond_the_edge_repeats_it(spark):
    a = np.array([[0.0, 10.0], [20.0, 30.0]])
    pts = spark.createDataFrame([(1, 1, -3.0, 0.5), (2, 1, 0.5, 0.5), (3, 1, 9.0, 9.0)], "pid int, tile bigint, row_f double, col_f double")
    got = {r["pid"]: r["sampled"] for r in G.bilinear_sample(frame(spark, a), meta(spark, 2, 2), pts).collect()}
    assert got == {1: 5.0, 2: 15.0, 3: 30.0}


@pytest.mark.parametrize("few", [True, False])
def test_lines_are_sampled_like_their_points(spark, few, monkeypatch):
    """A row that stands for several positions meets one block with all of them, also across blocks and beyond the edge."""
    if not few:
        monkeypatch.setattr(G, "BROADCAST_BYTES", 0)
    a = np.random.default_rng(3).normal(size=(70, 150))
    cells, size = frame(spark, a), meta(spark, 70, 150)
    lines = [(i, float(r), float(c), float(dr), float(dc)) for i, (r, c, dr, dc) in enumerate(
        [(63.4, 63.7, 0.9, 0.4), (0.2, 0.1, -0.7, 0.7), (69.0, 149.0, 0.3, 1.0), (64.0, 127.5, 1.0, 0.0), (30.0, 64.0, 0.0, 1.0)])]
    d = spark.createDataFrame(lines, "pid int, r double, c double, dr double, dc double").withColumn("tile", F.lit(1).cast("bigint"))

    def position(off):
        return F.col("r") + F.col("dr") * (off - 2), F.col("c") + F.col("dc") * (off - 2)

    got = {(x["pid"], x["off"]): x["sampled"] for x in G.bilinear_sample(cells, size, d, line=(5, position), reach=2).collect()}
    row_f, col_f = position(F.col("off"))
    pts = d.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumns({"row_f": row_f, "col_f": col_f})
    want = {(x["pid"], x["off"]): x["sampled"] for x in G.bilinear_sample(cells, size, pts).collect()}
    assert got.keys() == want.keys() and len(got) == 25
    np.testing.assert_allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(got)], rtol=0, atol=0)
