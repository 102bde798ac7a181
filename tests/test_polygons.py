"""Points in polygons against an even-odd loop over all edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import polygons as PG

SCHEMA = "name string, rings array<array<struct<x: double, y: double>>>"


def inside(rings, x, y):
    odd = np.zeros(len(x), bool)
    for ring in rings:
        if len(ring) < 3:
            continue
        for (xi, yi), (xj, yj) in zip(ring, ring[-1:] + ring[:-1], strict=True):
            if yi != yj:
                odd ^= (y >= min(yi, yj)) & (y < max(yi, yj)) & (x < xi + (y - yi) * (xj - xi) / (yj - yi))
    return odd


def star(rng, cx, cy, r, n):
    t = np.sort(rng.uniform(0, 2 * np.pi, n))
    d = r * rng.uniform(0.3, 1, n)
    return [(float(cx + a * np.cos(b)), float(cy + a * np.sin(b))) for a, b in zip(d, t, strict=True)]


def polygons():
    rng = np.random.default_rng(2)
    yield "star", [star(rng, 3, 2, 9, 40)]
    yield "hole", [star(rng, 0, 0, 12, 25), star(rng, 0, 0, 3, 12)]
    yield "square", [[(-4.0, -4.0), (4.0, -4.0), (4.0, 4.0), (-4.0, 4.0)]]
    yield "steps", [[(0.0, 0.0), (6.0, 0.0), (6.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 6.0), (0.0, 6.0)]]
    yield "diamond", [[(0.0, -8.0), (8.0, 0.0), (0.0, 8.0), (-8.0, 0.0)]]
    yield "sliver", [[(-9.0, 1.0), (9.0, 1.01), (9.0, 1.02)]]
    yield "inside one bucket", [[(0.2, 0.2), (0.9, 0.3), (0.5, 0.8)]]
    yield "two", [star(rng, -7, -7, 3, 9), star(rng, 7, 7, 3, 9)]
    yield "crossed", [[(-6.0, -6.0), (6.0, 6.0), (6.0, -6.0), (-6.0, 6.0)]]
    yield "flat", [[(0.0, 0.0), (1.0, 0.0)], []]


@pytest.mark.parametrize("cell", [1.0, 2.0, 5.5, 100.0])
def test_points_in_polygons(spark, cell):
    rng = np.random.default_rng(1)
    xy = np.vstack([rng.uniform(-14, 14, (900, 2)), rng.integers(-9, 9, (300, 2)), rng.integers(-18, 18, (300, 2)) / 2])
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "i int, x double, y double")
    shapes = dict(polygons())
    polys = spark.createDataFrame(list(shapes.items()), SCHEMA)
    got = {(r.i, r.name) for r in PG.point_in_polygon_join(points, polys, cell).collect()}
    x, y = points.toPandas()[["x", "y"]].to_numpy().T
    want = {(int(i), n) for n, rings in shapes.items() for i in np.flatnonzero(inside(rings, x, y))}
    assert got == want
    semi = {r.i for r in PG.point_in_polygon_join(points, polys, cell, "left_semi").collect()}
    assert semi == {i for i, _ in want}


def test_a_long_outline_makes_rows_in_proportion_to_its_edges(spark):
    rng = np.random.default_rng(5)
    t = np.linspace(0, 2 * np.pi, 50_000, endpoint=False)
    r = 20 + rng.normal(0, 0.02, len(t)).cumsum() * 0.01
    ring = [(float(a * np.cos(b)), float(a * np.sin(b))) for a, b in zip(r, t, strict=True)]
    polys = spark.createDataFrame([("long", [ring])], SCHEMA)
    q = PG._poly_buckets(polys, 1.0)
    edges, most, rows = q.agg(F.sum(F.size("_edges")), F.max(F.size("_edges")), F.count("*")).first()
    assert edges < 1.3 * len(ring) and most < 4000 and rows < 2000
    xy = rng.uniform(-25, 25, (400, 2))
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "i int, x double, y double")
    got = {r.i for r in PG.point_in_polygon_join(points, polys, 1.0, "left_semi").collect()}
    assert got == set(np.flatnonzero(inside([ring], *xy.T)).tolist())


def test_covered_fraction_of_any_footprints(spark):
    """Against every sample and every footprint: copies, holes, overlaps, views without area and beyond all footprints."""
    shapes = [r for n, r in polygons() if n != "flat"]
    rings = [[[(100 * x, 100 * y) for x, y in ring] for ring in r] for r in shapes]
    catalog = [(float(1 + (i % 5 == 4)), r) for i, r in enumerate(rings * 2)]
    fine = [r for p, r in catalog if p <= 1.5]
    rng = np.random.default_rng(3)
    views = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(
        np.vstack([np.hstack([rng.uniform(-1500, 1000, (20, 2)), rng.uniform(1, 1500, (20, 2))]), [[-400, -400, 800, 800], [0, 0, 0, 0], [0, 0, 0, 300], [9000, 0, 50, 50]]]))]
    v = spark.createDataFrame(views, "view_id int, x0 double, y0 double, x1 double, y1 double")
    c = spark.createDataFrame(catalog, "low_ps double, rings array<array<struct<x: double, y: double>>>")
    for cell in (150.0, 1000.0):
        got = {r.view_id: r.covered for r in PG.covered_fraction(v, c, cell).collect()}
        for i, x0, y0, x1, y1 in views:
            nx, ny = (int(min(max(np.ceil(s / 50), 16), 128)) for s in (x1 - x0, y1 - y0))
            x, y = np.meshgrid(x0 + (x1 - x0) * np.arange(nx) / (nx - 1.0), y0 + (y1 - y0) * np.arange(ny) / (ny - 1.0))
            want = np.any([inside(r, x.ravel(), y.ravel()) for r in fine], axis=0).mean()
            assert got[i] == pytest.approx(want, abs=1e-12), (cell, i)


def test_copies_of_footprints_make_no_more_rows(spark):
    """A view meets each box once, however many sources share it; the figures are those of all."""
    ring = PG.rect_ring(*[F.lit(float(c)) for c in (0, 0, 9000, 9000)])
    c = spark.range(500).select(F.col("id").alias("object_id"), (2.0 - F.col("id") / 499).alias("low_ps"), F.concat(F.lit("t"), F.col("id")).alias("title"),
                                F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("acquired"), F.array(ring).alias("rings"))
    v = spark.range(40).select(F.col("id").alias("view_id"), F.col("id").cast("double").alias("x0"), F.lit(5.0).alias("y0"), (F.col("id") + 99.0).alias("x1"), F.lit(95.0).alias("y1"))
    seen = []
    meet = PG.boxes_meeting
    PG.boxes_meeting = lambda *a: seen.append(meet(*a)) or seen[-1]
    try:
        rows = PG.coverage_summary(v, c).collect()
    finally:
        PG.boxes_meeting = meet
    assert seen[0].count() == 40
    assert {(r.best_m, r.title, r.sources, r.covered, r.usable) for r in rows} == {(1.0, "t499", 500, 1.0, True)}
    assert {(str(r["first"]), str(r["last"])) for r in rows} == {("2020-09-07", "2021-05-14")}
