"""Hot keys, exact ranks, and plans that must keep their shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import grid as G
from ridgeline.operators import points as P
from ridgeline.operators.ranks import bucket_rank, exact_quantiles, hashed_rank, running_totals


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["normal", "copies", "one", "tail"])
def test_exact_quantiles(spark, kind):
    rng = np.random.default_rng(4)
    v = {"normal": rng.normal(size=2001), "copies": rng.integers(0, 3, 1000).astype(float), "one": np.array([7.0]),
         "tail": np.concatenate([rng.normal(size=500), [1e9]])}[kind]
    d = spark.createDataFrame([(1, float(x)) for x in v] + [(1, None), (2, 5.0)], "k int, v double")
    got = exact_quantiles(d, ["k"], "v", {"a": 0.02, "b": 0.5, "c": 0.98}, buckets=64).where("k = 1").first()
    np.testing.assert_allclose([got["a"], got["b"], got["c"]], np.percentile(v, [2, 50, 98]), rtol=1e-12)


def test_ranks_across_buckets(spark):
    d = spark.range(1000).select(F.lit("k").alias("k"), (F.col("id") * 37 % 1000).alias("v"), F.floor((F.col("id") * 37 % 1000) / 50).alias("b"))
    assert bucket_rank(d, ["k"], "b", ["v"]).where(F.col("rank") != F.col("v") + 1).count() == 0
    h = [r["rank"] for r in hashed_rank(d, ["k"], ["v"]).collect()]
    assert sorted(h) == list(range(1, 1001))
    t = running_totals(d, ["k"], "b", ["v"], {"s": "v"})
    assert t.where(F.col("s") != F.col("v") * (F.col("v") + 1) / 2).count() == 0


def test_one_shuffle_serves_both_window_passes(spark):
    cells = spark.range(10000).select((F.col("id") % 2).alias("tile"), F.floor(F.col("id") / 100).alias("row"), (F.col("id") % 100).alias("col"), F.lit(1.0).alias("z"))
    meta = spark.createDataFrame([(0, 100, 100), (1, 100, 100)], "tile bigint, height bigint, width bigint").hint("broadcast")
    p = plan_of(G.dilate(cells, meta, {"m": "z"}, 5, dense=True))
    assert p.count("Exchange hashpartitioning(tile") == 1 and "CartesianProduct" not in p and "BroadcastNestedLoop" not in p


def brute_hag(pts):
    out = []
    g = [p for p in pts if p[3] == 2]
    for x, y, z, _ in pts:
        d = min(((x - a) ** 2 + (y - b) ** 2, c) for a, b, c, _ in g)
        out.append(z - d[1])
    return sorted(out)


def test_height_above_ground_widens_for_lonely_points(spark):
    rng = np.random.default_rng(1)
    pts = [(float(x), float(y), float(z), 2) for x, y, z in rng.uniform(0, 20, (60, 3))]
    pts += [(float(x), float(y), 30.0, 1) for x, y in rng.uniform(0, 100, (80, 2))] + [(5.0, 5.0, 9.0, 1)] * 50
    d = spark.createDataFrame([(1, *p) for p in pts], "tile int, x double, y double, z double, cls int")
    got = sorted(r["hag"] for r in P.height_above_ground(d, 2.0).collect())
    np.testing.assert_allclose(got, brute_hag(pts), rtol=1e-12)


def test_neighbour_distance_counts_copies(spark):
    rng = np.random.default_rng(2)
    pts = [tuple(map(float, p)) for p in rng.uniform(0, 30, (120, 3))] + [(1.0, 1.0, 1.0)] * 200 + [(90.0, 90.0, 5.0)]
    d = spark.createDataFrame([(1, *p) for p in pts], "tile int, x double, y double, z double")
    got = {(r["x"], r["y"], r["z"]): r["mean_dist"] for r in P.neighbour_distance(d, 3.0, 8).collect()}
    a = np.array(pts)
    for i in list(range(0, 120, 17)) + [125, 320]:
        dist = np.sort(np.sqrt(((a - a[i]) ** 2).sum(1)))[1:9]
        assert got[pts[i]] == pytest.approx(dist.mean(), rel=1e-12)


def test_many_small_tiles_spread_over_tasks(spark):
    """Sizes take few bytes, so adaptive execution merges them; their cells must not come from one task."""
    meta = spark.range(4000).select((F.col("id") % 400).alias("tile"), F.lit(16).cast("bigint").alias("height"), F.lit(16).cast("bigint").alias("width")).distinct()
    shares = [r["count"] for r in G._skeleton(meta).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 400 * 256 and max(shares) < 0.5 * sum(shares)


def test_halo_blocks_spread_over_tasks(spark):
    """Copies in blocks compress well, so adaptive execution merges them; one task must not sort most of them."""
    cells = spark.range(400 * 64).select(F.floor(F.col("id") / 64).alias("tile"), F.floor(F.col("id") % 64 / 8).alias("row"), (F.col("id") % 8).alias("col"), F.lit(1.0).alias("z"))
    meta = spark.range(400).select(F.col("id").alias("tile"), F.lit(8).cast("bigint").alias("height"), F.lit(8).cast("bigint").alias("width"))
    for fill in (False, True):
        d = G.haloed(cells, meta, ["z"], 1, 1, "truncate", fill=fill)
        shares = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(shares) == 400 * 64 and max(shares) < 0.5 * sum(shares)


def test_samples_of_transects_are_not_shuffled(spark):
    """Samples are many times the ways' own data; with few tiles they are looked up and summed where the ways are."""
    from ridgeline.operators import transects as TR

    seg = spark.createDataFrame([(i, 0, 5.0, 5.0 + i, 395.0, 9.0 + i, 390.0, "active") for i in range(50)],
                                "id bigint, seg bigint, x0 double, y0 double, x1 double, y1 double, len double, vclass string")
    meta = spark.createDataFrame([(1, 0.0, 400.0, 10.0, 40, 40)], "tile bigint, x0 double, y1 double, res double, height bigint, width bigint")
    relief = G._skeleton(meta).withColumn("relief", (F.col("row") * 7 + F.col("col")) % 5 / 2.0)
    p = TR.sample_profiles(seg, relief, meta, 30.0, 10.0, 20.0, 25.0)
    d = TR.profile_stats(p, ["tile", "vclass"], ["id", "part", "station"], 30.0, 10.0, 10.0)
    moved = [line for line in plan_of(d).splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "station#" in line or ", col#" in line]
    r = d.first()
    assert r.n_transects == p.select("id", "part", "station").distinct().count() and p.groupBy("id", "part", "station").count().where("count <> 7").isEmpty()
