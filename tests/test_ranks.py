"""Quantiles and running counts on values that crowd together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import ranks as R
from ridgeline.operators import scoring as S


@pytest.mark.parametrize("most", [5, 1 << 18])
def test_quantiles_behind_a_far_outlier(spark, most):
    """One value of 1e9 leaves all others in one bin; rounds of histograms part them."""
    rng = np.random.default_rng(1)
    groups = {"far": np.r_[rng.normal(0, 1, 3000), 1e9], "ties": np.repeat([1.0, 2.0, 5.0], [400, 3, 500]), "one": np.array([7.0]),
              "twice": np.r_[rng.normal(0, 1e-6, 500), rng.normal(1e3, 1e-6, 500), -1e12], "none": np.array([np.nan])}
    rows = [(k, None if np.isnan(v) else float(v)) for k, a in groups.items() for v in a]
    d = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r.k: r for r in R.exact_quantiles(d, ["k"], "v", {"a": 0.02, "b": 0.5, "c": 0.98}, buckets=8, most=most).collect()}
    assert set(got) == set(groups) - {"none"}
    for k, r in got.items():
        assert [r.a, r.b, r.c] == pytest.approx(np.quantile(groups[k], [0.02, 0.5, 0.98]).tolist(), rel=1e-12, abs=1e-15)


def test_spans_hold_about_as_many_rows_each(spark):
    """Nearly all values below 1e-5, as a real model's probabilities are."""
    d = spark.range(20000).select((F.when(F.col("id") % 100 == 0, F.rand(1)).otherwise(F.rand(2) * 1e-5)).alias("v"))
    edges = R.measured_edges(d, "v", rows_each=500)
    n = [r["count"] for r in d.groupBy(R.span_of(F.col("v"), edges).alias("s")).count().collect()]
    assert 35 <= len(n) <= 41 and max(n) < 2 * 500
    few = spark.createDataFrame([(float(x),) for x in (-1, 0, 2.5, 3, 9, 10)], "v double")
    assert [r.s for r in few.select(R.span_of(F.col("v"), [0.0, 1.0, 3.0, 4.0, 9.0]).alias("s")).collect()] == [0, 1, 2, 3, 5, 5]
    assert R.measured_edges(few, "v") == [] and few.select(R.span_of(F.col("v"), []).alias("s")).distinct().count() == 1


def test_average_precision_of_crowded_probabilities(spark):
    rng = np.random.default_rng(3)
    prob = np.where(rng.uniform(size=4000) < 0.99, rng.uniform(0, 1e-5, 4000), rng.uniform(0, 1, 4000))
    prob[:50] = prob[50:100]
    y = (rng.uniform(size=4000) < 0.1 + prob).astype(int)
    d = spark.createDataFrame([(1, float(p), int(v), 1.0) for p, v in zip(prob, y, strict=True)], "tile int, prob double, y int, w double")
    total = 0.0
    for p in np.unique(prob):
        total += y[prob == p].sum() * y[prob >= p].mean()
    for rows in (100, 1 << 16):
        assert S.average_precision(d, rows_each=rows).first()["ap"] == pytest.approx(total / y.sum(), rel=1e-9)
