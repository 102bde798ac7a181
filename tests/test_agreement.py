"""A hole must take its neighbours out of the comparison."""

import numpy as np
import pytest

from ridgeline.operators import agreement as A
from ridgeline.operators import grid as G
from tests.test_grid import frame, meta


def test_cells_beside_a_hole_do_not_count(spark):
    h, w = 30, 40
    z = np.add.outer(np.sin(np.arange(h) / 3), np.cos(np.arange(w) / 4))
    pub = z + np.random.default_rng(0).normal(0, .05, z.shape) + 2.0
    holed = pub.copy()
    holed[10:14, 10:14] = np.nan
    d = G.densify(frame(spark, holed), meta(spark, h, w))
    got = A.dem_agreement(frame(spark, z), d, meta(spark, h, w), 1, margin=3, min_cells=100).first()

    gy, gx = np.gradient(z)
    py, px = np.gradient(holed)
    so, sp = np.hypot(gx, gy), np.hypot(px, py)
    m = np.zeros(z.shape, bool)
    m[3:-3, 3:-3] = True
    m &= np.isfinite(holed) & np.isfinite(so) & np.isfinite(sp)
    assert got["slope_corr"] == round(float(np.corrcoef(so[m], sp[m])[0, 1]), 3)
    assert got["median_offset_m"] == round(float(np.median((holed - z)[m])), 3)
    assert got["error"] is None


def test_margins_are_those_of_the_common_ground(spark):
    """A published raster one row short: the row it lacks is no hole, and margins count from its own edge."""
    rng = np.random.default_rng(3)
    z = rng.normal(size=(12, 12)).cumsum(axis=0)
    ours = spark.createDataFrame([(1, r, c, float(z[r, c])) for r in range(12) for c in range(12)], "tile bigint, row bigint, col bigint, z double")
    short = ours.where("row < 9")
    meta = spark.createDataFrame([(1, 12, 12)], "tile bigint, height bigint, width bigint")
    got = A.dem_agreement(ours, short, meta, 1, margin=2, min_cells=40).first()
    assert got["nan_frac"] == 0.0 and got["slope_corr"] == pytest.approx(1.0) and got["error"] is None
    assert A.dem_agreement(ours, short, meta, 1, margin=2, min_cells=41).first()["error"] is not None


def test_signal_is_recorded_and_never_decides(spark):
    from ridgeline.operators.registry import vet

    m = spark.createDataFrame([("a", True, None, 9.0, 0.9, 5.0), ("b", True, None, 9.0, 0.9, 5.0)],
                              "key string, built boolean, error string, ground_density double, valid_frac double, trail_km double")
    s = spark.createDataFrame([("a", "faint", 1.234), ("a", "active", 9.876), ("b", "faint", None)], "tile string, vclass string, snr double")
    got = {r["key"]: r for r in vet(m, signal=s).collect()}
    assert got["a"]["snr"] == {"faint": 1.23, "active": 9.88} and got["b"]["snr"] == {} and got["a"]["accepted"] and got["b"]["accepted"]
