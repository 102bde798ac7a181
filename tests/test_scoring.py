"""Scenes that pooled and stratified scoring must tell apart."""

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import scoring as S

ACTIVE, FAINT = 1, 2


@pytest.fixture(scope="module")
def scene(spark):
    """Three long active lines the model finds, one short faint line it misses."""
    lines = [(10, 10, 118, ACTIVE), (20, 10, 118, ACTIVE), (30, 10, 118, ACTIVE), (100, 50, 71, FAINT)]
    d = spark.range(128 * 128).select(F.lit(1).cast("bigint").alias("tile"), F.floor(F.col("id") / 128).alias("row"), (F.col("id") % 128).alias("col"))
    code = F.lit(0)
    for r, c0, c1, k in lines:
        code = F.when((F.col("row") == r) & (F.col("col") >= c0) & (F.col("col") < c1), k).otherwise(code)
    d = d.withColumn("code", code)
    return d.select("*", (F.col("code") > 0).cast("int").alias("y"), F.lit(1.0).alias("w"),
                    F.when(F.col("code") == ACTIVE, 0.9).otherwise(0.05).alias("prob"))


@pytest.fixture(scope="module")
def meta(spark):
    return spark.createDataFrame([(1, 128, 128)], "tile bigint, height bigint, width bigint")


def test_pooled_hides_what_stratified_shows(scene, meta):
    sweep = {r["t"]: r["f1"] for r in S.threshold_sweep(scene, meta, 1.0).collect()}
    assert sweep[0.5] > 0.95
    result = S.stratified_result(S.stratified_counts(scene, meta, 1.0))
    assert S.stratified_score(result).first()["score"] == pytest.approx(0.5, abs=0.01)


def test_absent_class_is_dropped_not_zero(scene, meta):
    result = S.stratified_result(S.stratified_counts(scene, meta, 1.0)).collect()
    assert sorted(r["code"] for r in result) == [ACTIVE, FAINT]


def test_first_threshold_wins_ties(scene, meta):
    got = S.stratified_result(S.stratified_counts(scene, meta, 1.0)).where(F.col("code") == ACTIVE).first()
    assert got["t"] == 0.2


def test_a_tile_without_labels_still_counts_its_predictions(spark):
    cells = [(t, r, c, 0.9 if (t == 2 or r == 5) else 0.0, int(t == 1 and r == 5), 1.0, int(t == 1 and r == 5))
             for t in (1, 2) for r in range(12) for c in range(12)]
    d = spark.createDataFrame(cells, "tile bigint, row bigint, col bigint, prob double, y int, w double, code int")
    m = spark.createDataFrame([(1, 12, 12), (2, 12, 12)], "tile bigint, height bigint, width bigint")
    got = S.stratified_result(S.sum_counts(S.stratified_counts(d, m, 1.0), [])).first()
    assert got["p"] == pytest.approx(12 / (12 + 144), abs=1e-3)


def test_ignored_prediction_finds_nothing(spark):
    # the label is excused by a label next door, but an ignored prediction does not find it
    rows = [(1, 0, c, 0.9 if c == 2 else 0.0, int(c == 4), 0.0 if c == 2 else 1.0) for c in range(8)]
    d = spark.createDataFrame(rows, "tile bigint, row bigint, col bigint, prob double, y int, w double")
    m = spark.createDataFrame([(1, 1, 8)], "tile bigint, height bigint, width bigint")
    got = S.relaxed_pr(d, m, 0.5, 3).first()
    assert got["recall"] == 0.0
    flipped = d.withColumn("w", F.when(F.col("col") == 4, 0.0).otherwise(1.0))
    assert S.relaxed_pr(flipped, m, 0.5, 3).first()["precision"] == pytest.approx(1.0, abs=1e-5)


def test_ignored_region_is_inert(scene, meta):
    ignored = scene.withColumn("w", F.when(F.col("row") > 64, 0.0).otherwise(1.0))
    noisy = ignored.withColumn("prob", F.when(F.col("row") > 64, 0.5).otherwise(F.col("prob")))
    for fn in (lambda d: S.cldice(d, meta, 2), lambda d: S.tversky(d, meta)):
        assert fn(ignored).first()[1] == pytest.approx(fn(noisy).first()[1], abs=1e-12)


def test_ap_of_a_perfect_ranking_and_of_one_class(spark):
    d = spark.createDataFrame([(1, 0.9, 1, 1.0), (1, 0.8, 1, 1.0), (1, 0.1, 0, 1.0), (2, 0.4, 0, 1.0)], "tile int, prob double, y int, w double")
    got = {r["tile"]: r["ap"] for r in S.average_precision(d).collect()}
    assert got == {1: pytest.approx(1.0), 2: None}


def test_ap_collapses_ties(spark):
    d = spark.createDataFrame([(1, 0.5, y, 1.0) for y in (1, 0, 0, 0)], "tile int, prob double, y int, w double")
    assert S.average_precision(d).first()["ap"] == pytest.approx(0.25)


def spread_rows(spark, rows):
    return spark.createDataFrame(rows, "variant string, tile string, class string, f1 double, px int, advisory string")


def test_spread_leaves_out_advisories_and_thin_tiles(spark):
    d = spread_rows(spark, [
        ("dem1", "a", "faint", 0.2, 9000, ""), ("dem1", "b", "faint", 0.8, 9000, ""), ("dem1", "c", "faint", 0.1, 10, ""),
        ("dem1", "d", "faint", 0.0, 9000, "traced from a map"), ("dem1", "e", "faint", 0.5, None, "")])
    got = S.held_out_spread(d).first()
    assert (got["n"], got["median"], got["min"], got["max"], got["too_thin"]) == (3, 0.5, 0.2, 0.8, 1)


def test_selection_falls_back_to_every_variant(spark):
    d = spark.createDataFrame([(0, 0.4, True), (0, 0.6, True), (1, 0.9, True), (1, 0.5, False)], "epoch int, score double, canopy boolean")
    got = {r["epoch"]: (r["score"], r["deployable"]) for r in S.selection_score(d).collect()}
    assert got == {0: (0.5, False), 1: (0.5, True)}


def test_best_epoch_needs_a_strictly_better_score(spark):
    d = spark.createDataFrame([(0, 0.1), (1, 0.7), (2, 0.7), (3, 0.6)], "epoch int, score double")
    assert S.best_epoch(d).first()["epoch"] == 1


def test_topology_term_is_withheld_before_the_ramp(spark):
    d = spark.createDataFrame([(0, 1.0, 1.0, 0.4), (4, 1.0, 1.0, 0.4)], "epoch int, bce double, tversky double, cldice double")
    got = {r["epoch"]: r for r in S.combined_score(d, S.ramp(F.col("epoch"), 3)).collect()}
    assert got[0]["cldice"] is None and got[0]["total"] == 2.0
    assert got[4]["total"] == pytest.approx(2.0 + 0.5 * (2 / 3) * 0.4)


def test_relaxed_bce_is_not_above_strict(scene, meta):
    d = scene.withColumn("logit", F.log(F.col("prob") / (1 - F.col("prob"))))
    assert S.weighted_bce(d, meta, radius=5).first()["bce"] <= S.weighted_bce(d, None).first()["bce"] + 1e-9
