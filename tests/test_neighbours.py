"""Neighbour searches in blocks against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import neighbours as NB
from ridgeline.operators import points as P


def cloud(seed, n=400):
    """A dense patch, an even spread, copies, a line and a few lonely points."""
    rng = np.random.default_rng(seed)
    xy = np.vstack([rng.normal(20, 0.05, (n, 2)), rng.uniform(0, 100, (n, 2)), rng.uniform(0, 100, (8, 2)) + [900, 0],
                    np.column_stack([np.linspace(0, 50, 60), np.full(60, 7.0)]), [[5000.0, 5000.0], [-700.0, 3.0]]])
    xy = np.vstack([xy, xy[:30], xy[:30], xy[-1:].repeat(12, axis=0)])
    return np.column_stack([xy, np.round(rng.uniform(0, 9, len(xy)), 1)])


def mean_distances(p, k):
    out = []
    for i in range(len(p)):
        d = np.sqrt(((np.delete(p, i, axis=0) - p[i]) ** 2).sum(axis=1))
        out.append(np.sort(d)[:k].mean() if len(d) else np.nan)
    return np.array(out)


@pytest.mark.parametrize("halo", [0.3, 4.0, 60.0])
def test_mean_of_nearest(spark, halo):
    clouds = {1: cloud(1), 2: cloud(2, 50), 3: np.array([[0.0, 0.0, 0.0]]), 4: np.array([[0.0, 0.0, 0.0]] * 3 + [[400.0, 0.0, 0.0]])}
    rows = [(t, *map(float, r)) for t, p in clouds.items() for r in p]
    got = P.neighbour_distance(spark.createDataFrame(rows, "tile int, x double, y double, z double"), halo, 8)
    got = {(r.tile, r.x, r.y, r.z): (r.m, r.mean_dist) for r in got.collect()}
    for t, p in clouds.items():
        want = mean_distances(p, 8)
        for r, w in zip(p, want, strict=True):
            m, d = got[(t, *map(float, r))]
            assert m == (p == r).all(axis=1).sum() and (d is None if np.isnan(w) else d == pytest.approx(w, abs=1e-9))
    assert len(got) == sum(len(np.unique(p, axis=0)) for p in clouds.values())


@pytest.mark.parametrize("halo", [0.3, 4.0, 60.0])
def test_height_above_ground(spark, halo):
    p = cloud(3)
    cls = np.where(np.arange(len(p)) % 5 == 0, 2, 1)
    rows = [(1, i, *map(float, r), int(c)) for i, (r, c) in enumerate(zip(p, cls, strict=True))] + [(2, 0, 1.0, 1.0, 3.0, 1)]
    d = spark.createDataFrame(rows, "tile int, i int, x double, y double, z double, cls int")
    got = {(r.tile, r.i): r.hag for r in P.height_above_ground(d, halo).collect()}
    g = p[cls == 2]
    for i, r in enumerate(p):
        d2 = (r[0] - g[:, 0]) * (r[0] - g[:, 0]) + (r[1] - g[:, 1]) * (r[1] - g[:, 1])
        assert got[1, i] == pytest.approx(r[2] - g[d2 == d2.min(), 2].min(), abs=1e-9)
    assert got[2, 0] is None


def test_no_pairs_are_rows(spark):
    """The first plan of either search has no join of points with points."""
    d = spark.createDataFrame([(1, float(i % 40), float(i // 40), 0.0, 2) for i in range(1600)], "tile int, x double, y double, z double, cls int")
    blocks = NB.into_blocks(d, 4.0)
    assert blocks.where("home").count() == 1600
    assert blocks.groupBy("bx", "by").count().agg(F.max("count")).first()[0] <= 24 * 24


def test_uneven_points_are_searched_in_proportion():
    """Work follows the number of points: a block of 200,000 uneven points takes seconds."""
    import time

    rng = np.random.default_rng(0)
    xy = np.vstack([rng.normal(10, 0.01, (100_000, 2)), rng.uniform(0, 60, (100_000, 2))])
    n = len(xy)
    t = time.perf_counter()
    mean, sure = NB.mean_of_nearest(xy[:, 0], xy[:, 1], np.zeros(n), np.ones(n, np.int64), np.ones(n, bool), np.full(n, n - 1), 8, 8.0)
    assert sure.all() and not np.isnan(mean).any() and time.perf_counter() - t < 60


def test_points_above_each_other_are_far_apart(monkeypatch):
    """Distances are in space: the points of a column are not all looked at for each of them."""
    rng = np.random.default_rng(5)
    n, seen, around = 20_000, [], NB.Cells.around

    def counted(self, *a):
        for own, candidates, real in around(self, *a):
            seen.append(int(real.sum()))
            yield own, candidates, real

    monkeypatch.setattr(NB.Cells, "around", counted)
    p = np.column_stack([rng.integers(0, 5, (n, 2)) * 10.0, rng.uniform(0, 500, n)])
    mean, sure = NB.mean_of_nearest(*p.T, np.ones(n, np.int64), np.ones(n, bool), np.full(n, n - 1), 8, 16.0)
    assert sure.all() and sum(seen) < 400 * n
    for i in range(0, n, 997):
        assert mean[i] == pytest.approx(np.sort(np.sqrt(((p - p[i]) ** 2).sum(axis=1)))[1:9].mean(), abs=1e-9)


def test_a_lonely_point_looks_at_few_points_of_a_dense_patch(spark):
    """Boxes that hold enough nearer points rule out the others."""
    rng = np.random.default_rng(6)
    p = np.vstack([rng.uniform(0, 100, (3000, 3)) * [1, 1, 0.01], [[50.0, 50.0, 60.0], [51.0, 49.0, 300.0]]])
    d = spark.createDataFrame([(1, *map(float, r)) for r in p], "tile int, x double, y double, z double")
    spots = d.groupBy("tile", "x", "y", "z").agg(F.count("*").alias("m"))
    todo = spots.where("z > 50").withColumn("_others", F.lit(len(p) - 1))
    boxes = P._boxes_in_reach(todo.where("z < 100"), P._boxes(spots, 8.0), 64.0, 8)
    held = boxes.join(P._boxes(spots, 8.0), ["tile", "cx", "cy", "cz"]).agg(F.sum("_n")).first()[0]
    assert 8 < held < 1000
    got = {(r.x, r.y, r.z): r.mean_dist for r in P.neighbour_distance(d, 2.0, 8).collect()}
    for i in [0, 1, 2, len(p) - 2, len(p) - 1]:
        assert got[tuple(map(float, p[i]))] == pytest.approx(np.sort(np.sqrt(((p - p[i]) ** 2).sum(axis=1)))[1:9].mean(), abs=1e-9)
    assert len(got) == len(p)
