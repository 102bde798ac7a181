"""Readers and sinks: table-derived files are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import inputs as I
from checks.registry import check
from ridgeline import schemas as SC
from ridgeline.operators.lineage import shared_base
from ridgeline.sources import rasters as SR
from ridgeline.sources import readers as RD

#: Elements that a dump holds, on average.
DUMP_ELEMENTS = 2000


def _folder(spark, name: str) -> str:
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def _dumps(rows: DataFrame, key: str, field: str, path: str) -> str:
    """JSON documents of about ``DUMP_ELEMENTS`` rows each, at least four, each in a file of its own."""
    dumps = max(4, -(-rows.count() // DUMP_ELEMENTS))
    d = rows.groupBy(F.pmod(F.xxhash64(key), F.lit(dumps)).alias("part")).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != key])).alias(field))
    d = d.select("part", F.to_json(F.struct(field)).alias("value"))
    d.repartition("part").write.partitionBy("part").text(path)
    return f"{path}/*/*.txt"


@check("read_ways", I.oracle("""
select v.id, count(*) as vertices, round(min(y/1E5), 6) as south, round(max(x/1E5), 6) as east, any_value(t.hw_val) as highway
from fx_vertices v join (select * from fx_tags where hw_key = 'highway') t using (id) group by v.id having count(*) >= 2""", "fx_vertices", "fx_tags"))
def read_ways(spark, sf):
    """Dumps of neighbouring boxes: every fifth way is in two of them."""
    w = I.ways(spark, sf).where(F.map_contains_key("tags", F.lit("highway")))
    spots = F.transform("geometry", lambda p: F.struct((p["y"] / 1e5).alias("lat"), (p["x"] / 1e5).alias("lon")))
    w = w.select(F.col("id").alias("key"), F.col("id"), "tags", spots.alias("geometry"))
    again = w.where(F.col("id") % 5 == 0).withColumn("key", F.col("key") + 1)
    d = RD.read_ways(spark, _dumps(w.unionByName(again), "key", "elements", _folder(spark, "ways")))
    lat, lon = F.transform("geometry", lambda p: p["lat"]), F.transform("geometry", lambda p: p["lon"])
    return d.select("id", F.size("geometry").cast("bigint").alias("vertices"), F.round(F.array_min(lat), 6).alias("south"),
                    F.round(F.array_max(lon), 6).alias("east"), F.col("tags")["highway"].alias("highway"))


@check("read_coverage_index", I.oracle("""
select name, cnt as count, x0 as west, y1 as north, cast(1 as bigint) as rings, cast(5 as bigint) as vertices from fx_coverage""", "fx_coverage"))
def read_coverage_index(spark, sf):
    c = I.view(spark, sf, "fx_coverage")
    spot = lambda a, b: F.array(F.col(a), F.col(b))
    ring = F.array(spot("x0", "y0"), spot("x1", "y0"), spot("x1", "y1"), spot("x0", "y1"), spot("x0", "y0"))
    d = c.select(F.col("name").alias("key"), F.struct("name", F.col("cnt").alias("count")).alias("properties"),
                 F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    d = RD.read_coverage_index(spark, _dumps(d, "key", "features", _folder(spark, "coverage")))
    xs, ys = F.transform(F.col("rings")[0], lambda p: p["x"]), F.transform(F.col("rings")[0], lambda p: p["y"])
    return d.select("name", "count", F.array_min(xs).alias("west"), F.array_max(ys).alias("north"),
                    F.size("rings").cast("bigint").alias("rings"), F.size(F.col("rings")[0]).cast("bigint").alias("vertices"))


@check("read_catalog", I.oracle("""
select object_id, low_ps, title, cast(make_timestamp(acquired_ms*1000) as date) as acquired, fx0 as west, fy1 as north from fx_catalog where object_id % 7 <> 0""", "fx_catalog"))
def read_catalog(spark, sf):
    """Every seventh raster has no pixel size and is left out."""
    c = I.view(spark, sf, "fx_catalog")
    spot = lambda a, b: F.array(F.col(a), F.col(b))
    ring = F.array(spot("fx0", "fy0"), spot("fx1", "fy0"), spot("fx1", "fy1"), spot("fx0", "fy1"), spot("fx0", "fy0"))
    size = F.when(F.col("object_id") % 7 != 0, F.col("low_ps").cast("string")).otherwise("unknown")
    d = c.select(F.col("object_id").alias("key"), F.struct(
        F.col("object_id").alias("OBJECTID"), size.alias("LowPS"), "title", F.col("acquired_ms").alias("AcquisitionDate")).alias("attributes"),
        F.struct(F.array(ring).alias("rings")).alias("geometry"))
    d = RD.read_catalog(spark, _dumps(d, "key", "features", _folder(spark, "catalog")))
    xs, ys = F.transform(F.col("rings")[0], lambda p: p["x"]), F.transform(F.col("rings")[0], lambda p: p["y"])
    return d.select("object_id", "low_ps", "title", "acquired", F.array_min(xs).alias("west"), F.array_max(ys).alias("north"))


@check("read_points", I.oracle("select cast(tile as varchar) as tile, x, y, z, cls from fx_points", "fx_points"))
def read_points(spark, sf):
    """All tiles of a point table partitioned by tile."""
    p = I.view(spark, sf, "fx_points").select(
        F.col("tile").cast("string").alias("tile"), "x", "y", "z", F.col("cls").cast("int").alias("cls"), F.lit(None).cast("float").alias("hag"))
    path = _folder(spark, "points")
    p.repartition("tile").write.partitionBy("tile").parquet(path)
    return RD.read_points(spark, path).select("tile", "x", "y", "z", F.col("cls").cast("bigint").alias("cls"))


TILE = T.StructType([T.StructField(c, t) for c, t in (("row", T.LongType()), ("col", T.LongType()), ("z", T.DoubleType()), ("tile", T.LongType()))])


@check("write_tiles_twice", I.oracle("""
select tile, row, col, z + case when tile % 3 = 0 then 1 else 0 end as z from fx_cells""", "fx_cells"))
def write_tiles_twice(spark, sf):
    """All tiles, then every third again: the others stay as they were."""
    c = I.view(spark, sf, "fx_cells").select("tile", "row", "col", "z")
    path = _folder(spark, "tiles")
    SR.write_tiles(c, path)
    SR.write_tiles(c.where(F.col("tile") % 3 == 0).withColumn("z", F.col("z") + 1), path)
    return SR.read_tiles(spark, path, TILE).select("tile", "row", "col", "z")


@check("write_registry", I.oracle("""
select cast(key as varchar) as key, name, lat, lon, case when key % 2 = 0 then 'again' else role end as role from fx_aois""", "fx_aois"))
def write_registry(spark, sf):
    """Registry documents kept apart by role; the even keys are then written again under their own."""
    a = I.view(spark, sf, "fx_aois").select(
        F.col("key").cast("string").alias("key"), "name", "lat", "lon", "role", F.col("size_m").cast("int").alias("size_m"), F.lit("").alias("notes"),
        F.array(F.lit("b"), F.lit("a")).alias("flags"), F.lit("").alias("advisory"))
    even = F.col("key").cast("bigint") % 2 == 0
    path = _folder(spark, "registry")
    RD.write_documents(a.where(~even), path, by="role")
    RD.write_documents(a.where(even).withColumn("role", F.lit("again")), path, by="role")
    return spark.read.schema(SC.AOI).json(path).select("key", "name", "lat", "lon", "role")
