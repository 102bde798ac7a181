"""Tags, ways, footprints, projections and registries."""

import pytest
from pyspark.sql import functions as F

from ridgeline import constants as K
from ridgeline.functions import geodesy as GD
from ridgeline.functions import rasters as R
from ridgeline.functions import tags as T
from ridgeline.operators import polygons as PG
from ridgeline.operators import registry as RG
from ridgeline.operators import ways as W

CASES = [
    ({"highway": "path"}, "trail", 1.0, "active", None),
    ({"highway": "path", "trail_visibility": "bad"}, "trail", 0.7, "faint", "faint"),
    ({"highway": "path", "trail_visibility": "intermediate"}, "trail", 0.9, "active", None),
    ({"highway": "path", "trail_visibility": "odd"}, "trail", 1.0, "active", None),
    ({"abandoned:highway": "path"}, "trail", 0.6, "lifecycle", "lifecycle"),
    ({"disused:highway": "service", "trail_visibility": "no"}, "trail", 0.6, "lifecycle", "lifecycle"),
    ({"was:highway": "motorway", "trail_visibility": "no"}, None, None, "lifecycle", None),
    ({"highway": "service"}, None, None, "active", None),
    ({"highway": "path", "surface": "wood"}, "excluded", 0.0, "active", None),
    ({"highway": "path", "bridge": "boardwalk"}, "excluded", 0.0, "active", None),
    ({"highway": "path", "tunnel": "yes", "trail_visibility": "bad"}, "excluded", 0.0, "faint", None),
    ({"waterway": "river", "highway": "path"}, "water", 0.0, "active", None),
    ({"waterway": "canal"}, None, None, "active", None),
    ({}, None, None, "active", None),
]


@pytest.mark.parametrize("tags,kind,weight,vclass,evidence", CASES)
def test_tags(spark, tags, kind, weight, vclass, evidence):
    d = spark.createDataFrame([(tags,)], "tags map<string,string>")
    t = F.col("tags")
    got = d.select(T.classify_way(t).alias("c"), T.visibility_class(t).alias("v"), T.evidence_kind(t).alias("e")).first()
    assert (got["c"]["kind"], got["c"]["weight"], got["v"], got["e"]) == (kind, weight, vclass, evidence)


def way(spark, *xy, tags=None):
    return spark.createDataFrame([(1, tags or {"abandoned:highway": "path"}, [{"x": float(a), "y": float(b)} for a, b in xy])],
                                 "id bigint, tags map<string,string>, geometry array<struct<x double, y double>>")


def test_midpoints_share_the_length(spark):
    d = W.walk(W.way_segments(way(spark, (0, 0), (30, 40), (30, 90))))
    rows = sorted(d.collect(), key=lambda r: r["k"])
    assert len(rows) == 5 and sum(r["share_m"] for r in rows) == pytest.approx(100.0)
    assert (rows[0]["x"], rows[0]["y"]) == (pytest.approx(6.0), pytest.approx(8.0))
    assert (rows[4]["x"], rows[4]["y"]) == (30.0, pytest.approx(80.0))


def test_short_and_pointlike_ways_are_dropped(spark):
    assert W.way_segments(way(spark, (0, 0), (0.5, 0))).count() == 0
    assert W.way_segments(way(spark, (0, 0))).count() == 0


def test_way_cells_agree_with_the_walk(spark):
    w = way(spark, (950, 10), (1060, 10), (1060, 990), (1060, 1010), (1500, 2300))
    a = {(r["gx"], r["gy"]): r["m"] for r in W.way_cells(w).collect()}
    b = {(r["gx"], r["gy"]): r["m"] for r in W.walk_to_cells(W.way_segments(w)).groupBy("gx", "gy").agg(F.sum("share_m").alias("m")).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_touching_a_zone_counts(spark):
    cells = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 0)], "gx bigint, gy bigint")
    zones = spark.createDataFrame([(2500.0, 500.0, 400)], "x double, y double, size_m int")
    left = {r["gx"] for r in W.exclude_zones(cells, zones, 1000.0, 300.0).collect()}
    assert left == {0}  # the zone spans 2000..3000 and touches cells 1 and 3
    assert {r["gx"] for r in W.exclude_zones(cells, zones, 1000.0, 299.0).collect()} == {0, 1, 3}


def test_clip_makes_parts_where_a_way_leaves(spark):
    w = way(spark, (-10, 5), (5, 5), (5, 20), (8, 20), (8, 5), (9, 5))
    parts = W.clipped_parts(W.clip_segments(W.way_segments(w), 0.0, 0.0, 10.0, 10.0), ["id"])
    got = {r["part"]: r["m"] for r in parts.groupBy("part").agg(F.sum("clen").alias("m")).collect()}
    assert got == {1: pytest.approx(10.0), 2: pytest.approx(6.0)}


def test_donut(spark):
    ring = lambda a, b: [{"x": x, "y": y} for x, y in ((a, a), (b, a), (b, b), (a, b))]
    polys = spark.createDataFrame([("d", [ring(0.0, 10.0), ring(4.0, 6.0)])], "name string, rings array<array<struct<x double, y double>>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 20.0, 5.0), (4, 8.0, 5.0)], "pid int, x double, y double")
    assert {r["pid"] for r in PG.point_in_polygon_join(pts, polys, 3.0).collect()} == {1, 4}
    assert {r["pid"] for r in PG.point_in_polygon_join(pts, polys, 3.0, "left_semi").collect()} == {1, 4}


def catalog(spark, rows):
    d = spark.createDataFrame(rows, "object_id bigint, low_ps double, title string, x0 double, y0 double, x1 double, y1 double")
    return d.select("object_id", "low_ps", "title", F.lit("2021-01-02").cast("date").alias("acquired"),
                    F.array(PG.rect_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("rings"))


def test_half_covered_window_is_refused_and_a_seam_is_not(spark):
    views = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 1000.0)], "view_id bigint, x0 double, y0 double, x1 double, y1 double")
    half = PG.coverage_summary(views, catalog(spark, [(1, 1.0, "fine", -10.0, -10.0, 500.0, 1010.0), (2, 10.3, "coarse", -10.0, -10.0, 1010.0, 1010.0)])).first()
    assert half["covered"] == pytest.approx(0.5, abs=0.05) and half["fine"] and not half["usable"]
    four = [(i, 1.0, "t", x, y, x + 513.0, y + 513.0) for i, (x, y) in enumerate([(-10.0, -10.0), (497.0, -10.0), (-10.0, 497.0), (497.0, 497.0)])]
    seam = PG.coverage_summary(views, catalog(spark, four)).first()
    assert seam["covered"] == 1.0 and seam["usable"] and seam["sources"] == 4
    none = PG.coverage_summary(views, catalog(spark, [(1, 1.0, "far", 9e4, 9e4, 9.1e4, 9.1e4)])).first()
    assert none["sources"] == 0 and none["covered"] == 0.0 and none["reason"] == "no source"


# eight published grid-cell centres, five decimals of latitude and longitude
KNOWN = [(38.19046, -119.32371), (37.34732, -118.52982), (36.54291, -118.69255), (36.87239, -118.29591),
         (37.03385, -118.36611), (36.42302, -118.16570), (37.65968, -118.75160), (36.20579, -118.25146)]


def test_known_cells_land_on_half_kilometres(spark):
    d = spark.createDataFrame(KNOWN, "lat double, lon double")
    for r in GD.with_utm(d, "lon", "lat", F.lit(11)).collect():
        for v in (r["x"], r["y"]):
            assert abs((v - 500) % 1000 - round(((v - 500) % 1000) / 1000) * 1000) < 0.6


def test_projection_round_trip_is_under_a_millimetre(spark):
    d = spark.createDataFrame([(a, b) for a in (-45.0, -1.0, 12.0, 38.0, 70.0) for b in (-120.0, -117.0, -114.5)], "lat double, lon double")
    south = F.col("lat") < 0
    there = GD.with_utm(d.withColumn("south", south), "lon", "lat", F.lit(11), south=F.col("south"))
    back = GD.with_lonlat(there.select("lat", F.col("lon").alias("lon0"), F.col("lat").alias("lat0"), "south", "x", "y"), "x", "y", F.lit(11), south=F.col("south"))
    for r in back.collect():
        assert abs(r["lat"] - r["lat0"]) < 5e-9 and abs(r["lon"] - r["lon0"]) < 5e-9


def test_zone_labels(spark):
    d = spark.createDataFrame([(37.0, -118.0), (-37.0, 175.0), (5.0, -179.0)], "lat double, lon double")
    assert [r[0] for r in d.select(GD.utm_epsg(F.col("lat"), F.col("lon"))).collect()] == ["EPSG:32611", "EPSG:32760", "EPSG:32601"]


def test_cells_floor_below_zero(spark):
    got = spark.range(1).select(R.ground_to_cell(F.lit(-0.2), F.lit(10.2), F.lit(0.0), F.lit(10.0), F.lit(1.0)).alias("c")).first()["c"]
    assert (got["row"], got["col"]) == (-1, -1)


def test_nodata(spark):
    d = spark.createDataFrame([(float("nan"),), (-3.4e38,), (0.0,), (-86.0,)], "z double")
    assert [r[0] for r in d.select(R.sanitize_nodata(F.col("z"))).collect()] == [None, None, 0.0, -86.0]
    assert [r[0] for r in d.select(R.sanitize_nodata(F.col("z"), True)).collect()] == [None, None, None, -86.0]


def test_palette_hides_below_threshold_and_keeps_colour(spark):
    low = {r["level"]: r["argb"] for r in R.palette(spark, 0.2, 1.0).collect()}
    high = {r["level"]: r["argb"] for r in R.palette(spark, 0.8, 1.0).collect()}
    assert high[100] == 0 and low[100] != 0 and low[250] == high[250] and low[255] & 0xFFFFFF == 0xF0F921
    lum = [((c >> 16) & 255) * .2126 + ((c >> 8) & 255) * .7152 + (c & 255) * .0722 for c in (R_ for _, R_ in sorted(R.palette(spark, 0.0, 1.0).rdd.map(tuple).collect()))]
    assert all(b >= a - 1 for a, b in zip(lum, lum[1:]))


def test_nodata_never_paints(spark):
    d = spark.createDataFrame([(None,), (1.5,), (-1.0,)], "prob double")
    assert [bool(r["argb"]) for r in R.paint(d, spark, 0.0, 1.0).orderBy(F.col("prob").asc_nulls_first()).collect()] == [False, True, True]


def test_keys_and_notes(spark):
    d = spark.createDataFrame(KNOWN, "lat double, lon double")
    keys = [r[0] for r in d.select(R.harvest_key(F.col("lat"), F.col("lon"))).collect()]
    assert keys[0] == "h_381905_s1193237" and keys[6] == "h_376597_s1187516"


def test_unknown_area_is_named(spark):
    d = spark.createDataFrame([("a", "train"), ("b", "eval")], "key string, role string")
    with pytest.raises(KeyError, match="nowhere.*known: a, b"):
        RG.select_aois(d, ["a", "nowhere"])
    assert [r["key"] for r in RG.select_aois(d, ["b", "a"]).orderBy("pos").collect()] == ["b", "a"]


def test_curated_beats_harvested(spark):
    cur = spark.createDataFrame([("a", "eval")], "key string, role string")
    har = spark.createDataFrame([("a", "harvest"), ("n", "harvest")], "key string, role string")
    assert sorted(map(tuple, RG.merge_registry(cur, har).collect())) == [("a", "eval"), ("n", "harvest")]


def test_vet_reasons(spark):
    d = spark.createDataFrame([
        ("ok", True, None, 5.0, 0.9, 1.0), ("thin", True, None, 1.5, 0.5, 0.1), ("unknown", True, None, None, None, None),
        ("bad", True, "boom", 5.0, 0.9, 1.0), ("none", False, None, None, None, None)],
        "key string, built boolean, error string, ground_density double, valid_frac double, trail_km double")
    got = {r["key"]: (r["accepted"], r["reasons"]) for r in RG.vet(d).collect()}
    assert got["ok"] == (True, []) and len(got["thin"][1]) == 3
    assert got["unknown"][1] == ["only 0.00 km of trail in tile"]
    assert got["bad"][1] == ["build error: boom"] and got["none"][1] == ["not built"]


def test_plan_refuses_oversize(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 0.0, 0.0, 8000.5, 10.0)], "view_id int, x0 double, y0 double, x1 double, y1 double")
    got = {r["view_id"]: r for r in PG.plan_requests(d, 1.0, 256).collect()}
    assert (got[1]["width"], got[1]["px0"], got[1]["px1"]) == (256, -123.0, 133.0)
    assert got[2]["reason"] == "too large"


def test_windows_in_pixels_round_half_even():
    assert [K.window_px(m, r, f) for m, r, f in ((2, 1, 3), (2, .5, 3), (10, 1, 5), (10, .5, 5), (1.5, 1, 3), (2.5, 1, 1))] == [3, 4, 10, 20, 3, 2]
