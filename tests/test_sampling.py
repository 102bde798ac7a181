"""Crop plans, noise and augmentation: properties a seed must keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import sampling as S

CROP = 8


@pytest.fixture(scope="module")
def labels(spark):
    """Two tiles; tile 1 is nearly all class 1, tile 2 holds a little of 2 and 3."""
    rows = [(1, r, c, 1, 1) for r in range(40) for c in range(0, 120, 2)]
    rows += [(2, r, c, 1, 2 if c < 40 else 3) for r in range(10, 14) for c in range(20, 110, 3)]
    return spark.createDataFrame(rows, "tile bigint, row bigint, col bigint, target bigint, class bigint")


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame([(1, 40, 120), (2, 40, 120)], "tile bigint, height bigint, width bigint")


@pytest.fixture(scope="module")
def bands(labels, meta):
    return S.split_bands(S.split_boundary(labels, meta, CROP), CROP, "train")


@pytest.fixture(scope="module")
def centres(labels, bands):
    return S.legal_centres(labels, bands, CROP)


@pytest.fixture(scope="module")
def plan(centres, bands):
    return S.draw_crops(centres, bands, 3000, CROP, 2).cache()


def test_plan_is_complete_and_repeatable(plan, centres, bands):
    assert plan.count() == 3000
    again = S.draw_crops(centres.repartition(7), bands, 3000, CROP, 2)
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, again.collect()))


def test_plan_ignores_supply(plan):
    n = {r["class"]: r["count"] for r in plan.groupBy("class").count().collect()}
    assert abs(n[0] - 1500) < 150
    for c in (1, 2, 3):
        assert abs(n[c] - 500) < 90


def test_crops_are_legal(plan, bands):
    d = plan.join(bands.withColumnsRenamed({"col0": "lo", "col1": "hi"}), "tile")
    bad = d.where((F.col("row0") < 0) | (F.col("row0") + CROP > F.col("height")) | (F.col("col0") < F.col("lo") - 1)
                  | (F.col("col0") + CROP > F.col("hi")) | (F.col("row0") % 2 != 0) | (F.col("col0") % 2 != 0))
    assert bad.count() == 0


def test_boundary_cases(spark):
    m = spark.createDataFrame([(1, 10, 100), (2, 10, 100), (3, 10, 20)], "tile bigint, height bigint, width bigint")
    lab = spark.createDataFrame([(2, 0, c, 1) for c in range(100)] + [(3, 0, 5, 1)], "tile bigint, row bigint, col bigint, target bigint")
    got = {r["tile"]: r["boundary"] for r in S.split_boundary(lab, m, 16).collect()}
    # no labels: four fifths; even labels: cut at 80 % clamped below 100 - 24; too narrow: half
    assert got == {1: 80, 2: 76, 3: 10}


def test_band_noise_has_the_asked_deviation(spark, meta):
    d = spark.range(40 * 120).select(F.lit(1).cast("bigint").alias("tile"), F.floor(F.col("id") / 120).alias("row"), (F.col("id") % 120).alias("col"), F.lit(0.0).alias("z"))
    z = S.add_band_noise(d, meta, 0.05, 6.0, 3)
    assert z.select(F.stddev_pop("z")).first()[0] == pytest.approx(0.05, rel=1e-9)
    # neighbours resemble each other, which white noise would not
    a = np.zeros((40, 120))
    for r in z.collect():
        a[r["row"], r["col"]] = r["z"]
    assert np.corrcoef(a[:, :-1].ravel(), a[:, 1:].ravel())[0, 1] > 0.8
    w = S.add_noise(d, 0.05, 3)
    assert w.select(F.stddev_pop("z")).first()[0] == pytest.approx(0.05, rel=0.05)


def test_augment_keeps_cells_and_unknown_labels_weigh_nothing(spark):
    n = 12
    d = spark.range(50 * n * n).select(F.floor(F.col("id") / (n * n)).alias("crop_id"), (F.floor(F.col("id") / n) % n).alias("row"), (F.col("id") % n).alias("col"))
    d = d.withColumns({"z": F.lit(1.0), "y": F.lit(1).cast("bigint"), "w": F.lit(1.0), "class": F.lit(1).cast("bigint"), "chm": F.lit(1.0)})
    a = S.augment(d, n, seed=5, canopy=("chm",))
    assert a.count() == 50 * n * n
    assert a.select("crop_id", "row", "col").distinct().count() == 50 * n * n
    gone = a.where(F.col("y") == 0)
    assert gone.count() > 0 and gone.where(F.col("w") != 0).count() == 0
    per = [r[0] for r in a.groupBy("crop_id").agg(F.avg("chm")).select("avg(chm)").collect()]
    assert set(per) == {0.0, 1.0}


def test_crops_without_centres_are_uniform(spark):
    bands = spark.createDataFrame([(1, 64, 0, 64), (2, 64, 0, 64)], "tile bigint, height bigint, col0 bigint, col1 bigint")
    none = spark.createDataFrame([], "tile bigint, row bigint, col bigint, class bigint")
    got = S.draw_crops(none, bands, 100, 16).collect()
    assert sorted(r["crop_id"] for r in got) == list(range(100)) and all(0 <= r["row0"] <= 48 and 0 <= r["col0"] <= 48 for r in got)


def test_crop_noise_has_its_drawn_strength_on_the_native_grid(spark):
    d = spark.range(6 * 1600).select(F.floor(F.col("id") / 1600).alias("crop_id"), (F.floor(F.col("id") / 40) % 40).alias("row"), (F.col("id") % 40).alias("col"), F.lit(0.0).alias("z"))
    got = S.crop_noise(d, 4, 0.5, noise_m=0.0, band_noise_m=0.05).groupBy("crop_id").agg(F.stddev_pop("z").alias("sd"))
    got = got.withColumn("want", S.uniform(4, F.col("crop_id"), F.lit("band")) * 0.05).collect()
    assert len(got) == 6 and all(r["sd"] == pytest.approx(r["want"], rel=1e-9) for r in got)
