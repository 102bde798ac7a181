"""Checks for point clouds, footprints and map projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import check
from ridgeline.functions import geodesy as GD
from ridgeline.functions import rasters as R
from ridgeline.operators import grid as G
from ridgeline.operators import points as P
from ridgeline.operators import polygons as PG
from ridgeline.operators import registry as RG

RES = 2.0


def _points(spark, sf):
    return I.view(spark, sf, "fx_points")


def _clean(spark, sf):
    return P.drop_noise(_points(spark, sf))


BOUNDS_SQL = """
select tile, floor(min(x)/2)*2 as x0, floor(min(y)/2)*2 as y0, ceil(max(x)/2)*2 as x1, ceil(max(y)/2)*2 as y1,
  greatest(cast(round_even((ceil(max(y)/2)*2 - floor(min(y)/2)*2)/2, 0) as bigint), 1) as height,
  greatest(cast(round_even((ceil(max(x)/2)*2 - floor(min(x)/2)*2)/2, 0) as bigint), 1) as width
from clean group by tile"""

#: every (point, cell centre) pair within sqrt(2) cells, by brute force over the offsets
REACH_SQL = """
select * from (select p.*, floor((b.y1-p.y)/2) + a.a as row, floor((p.x-b.x0)/2) + o.o as col,
  sqrt(power(p.x - (b.x0 + (floor((p.x-b.x0)/2) + o.o + 0.5)*2), 2) + power(p.y - (b.y1 - (floor((b.y1-p.y)/2) + a.a + 0.5)*2), 2)) as dist,
  b.height, b.width
 from clean p join bounds b using (tile), range(-3,4) a(a), range(-3,4) o(o))
where dist <= 2*sqrt(2.0::double) and row >= 0 and row < height and col >= 0 and col < width"""

CLEAN_SQL = "select * from fx_points where cls not in (7, 18)"

#: nearest ground point in plan, lowest first among equals
HAG_SQL = """
select p.event_id, any_value(p.z) - arg_min(g.z, {d: (p.x-g.x)*(p.x-g.x)+(p.y-g.y)*(p.y-g.y), z: g.z}) as hag
from clean p join (select * from clean where cls = 2) g using (tile) group by p.event_id"""


def pts(body: str, **extra: str) -> str:
    return I.oracle(body, "fx_points", clean=CLEAN_SQL, bounds=BOUNDS_SQL, **extra)


@check("drop_noise_ground", I.oracle("""
select tile, count(*) as kept, count(*) filter (cls = 2) as ground from fx_points where cls not in (7, 18) group by tile""", "fx_points"))
def drop_noise_ground(spark, sf):
    d = _clean(spark, sf)
    g = P.ground(d).groupBy("tile").agg(F.count("*").alias("ground"))
    return d.groupBy("tile").agg(F.count("*").alias("kept")).join(g, "tile")


@check("grid_bounds", pts("select * from bounds"))
def grid_bounds(spark, sf):
    return P.grid_bounds(_clean(spark, sf), RES)


@check("grid_idw", pts("""
select tile, cast(row as bigint) as row, cast(col as bigint) as col,
  round(coalesce(avg(case when dist = 0 then z end), sum(case when dist > 0 then z/power(dist, 6) end)/sum(case when dist > 0 then 1/power(dist, 6) end)), 5) as z
from reach group by 1, 2, 3""", reach=REACH_SQL))
def grid_idw(spark, sf):
    c = _clean(spark, sf)
    return P.grid_idw(c, P.grid_bounds(c, RES), RES).withColumn("z", F.round("z", 5))


@check("grid_max", pts("select tile, cast(row as bigint) as row, cast(col as bigint) as col, max(z) as max from reach group by 1, 2, 3",
                       reach=REACH_SQL))
def grid_max(spark, sf):
    c = _clean(spark, sf)
    return P.grid_max(c, P.grid_bounds(c, RES), RES, "z")


@check("grid_count", pts("""
select tile, cast(row as bigint) as row, cast(col as bigint) as col, count(*) filter (z < 100) as low, count(*) filter (z <= 300) as high
from reach group by 1, 2, 3""", reach=REACH_SQL))
def grid_count(spark, sf):
    c = _clean(spark, sf)
    return P.grid_count(c, P.grid_bounds(c, RES), RES, {"low": F.col("z") < 100, "high": F.col("z") <= 300})


@check("height_above_ground", pts("select event_id, round(hag, 6) as hag from hag", hag=HAG_SQL))
def height_above_ground(spark, sf):
    d = P.height_above_ground(_clean(spark, sf), cell=8.0)
    return d.select("event_id", F.round("hag", 6).alias("hag"))


#: every fiftieth point is moved kilometres away from the rest of its tile
FAR_SQL = "select * replace (x + (case when event_id % 50 = 0 then 3000.0 + event_id % 7 * 900 else 0 end) as x) from ({})"


def _far(d):
    return d.withColumn("x", F.col("x") + F.when(F.col("event_id") % 50 == 0, 3000.0 + F.col("event_id") % 7 * 900).otherwise(0.0))


@check("height_above_ground_far", I.oracle("select event_id, round(hag, 6) as hag from hag", "fx_points", clean=FAR_SQL.format(CLEAN_SQL), hag=HAG_SQL))
def height_above_ground_far(spark, sf):
    """Points far from any ground still find the nearest one."""
    d = P.height_above_ground(_far(_clean(spark, sf)), cell=8.0)
    return d.select("event_id", F.round("hag", 6).alias("hag"))


@check("canopy_grids", pts("""
select tile, cast(row as bigint) as row, cast(col as bigint) as col, round(max(hag), 6) as chm,
  cast(nullif(count(*) filter (hag < 0.8), 0) as double) as low, cast(nullif(count(*) filter (hag <= 12), 0) as double) as high
from reach join (select event_id, hag from hag) using (event_id) group by 1, 2, 3""", reach=REACH_SQL, hag=HAG_SQL))
def canopy_grids(spark, sf):
    d = P.height_above_ground(_clean(spark, sf), cell=8.0)
    return P.canopy_grids(d, P.grid_bounds(d, RES), RES).withColumn("chm", F.round("chm", 6))


NEIGHBOUR_SQL = """
select event_id, tile, x, y, z, avg(d) as md from (
  select p.event_id, p.tile, p.x, p.y, p.z, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) as d,
    row_number() over (partition by p.event_id order by (p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) as rn
  from clean p join clean q on p.tile = q.tile and p.event_id <> q.event_id) where rn <= 8 group by all"""


@check("height_above_ground_survey", I.oracle("select event_id, round(hag, 6) as hag from hag", "fx_survey", clean="select * from fx_survey", hag=HAG_SQL))
def height_above_ground_survey(spark, sf):
    """Ten times the points of the other checks, all searched in blocks."""
    d = P.height_above_ground(I.view(spark, sf, "fx_survey"), cell=8.0)
    return d.select("event_id", F.round("hag", 6).alias("hag"))


@check("neighbour_distance", pts("select event_id, round(md, 5) as mean_dist from nd", nd=NEIGHBOUR_SQL))
def neighbour_distance(spark, sf):
    c = _clean(spark, sf)
    d = P.neighbour_distance(c, cell=16.0, k=8)
    return c.join(d, ["tile", "x", "y", "z"]).select("event_id", F.round("mean_dist", 5).alias("mean_dist"))


@check("neighbour_distance_far", I.oracle("select event_id, round(md, 5) as mean_dist from nd", "fx_points", clean=FAR_SQL.format(CLEAN_SQL), nd=NEIGHBOUR_SQL))
def neighbour_distance_far(spark, sf):
    c = _far(_clean(spark, sf))
    d = P.neighbour_distance(c, cell=16.0, k=8)
    return c.join(d, ["tile", "x", "y", "z"]).select("event_id", F.round("mean_dist", 5).alias("mean_dist"))


@check("drop_outliers", pts("""
select event_id from nd join (select tile, avg(md) + 3*stddev_samp(md) as lim from nd group by tile) using (tile) where md <= lim""",
                            nd=NEIGHBOUR_SQL))
def drop_outliers(spark, sf):
    return P.drop_outliers(_clean(spark, sf), cell=16.0).select("event_id")


@check("fill_window", I.dense_oracle("""
select d.tile, d.row, d.col, round(coalesce(max(d.z), sum(s.z/sqrt(a.a*a.a+b.b*b.b))/sum(case when s.z is not null then 1/sqrt(a.a*a.a+b.b*b.b) end)), 6) as z
from dense d, range(-3,4) a(a), range(-3,4) b(b) left join dense s on s.tile=d.tile and s.row=d.row+a.a and s.col=d.col+b.b
where a.a*a.a+b.b*b.b between 1 and 9 group by 1, 2, 3"""))
def fill_window(spark, sf):
    d = G.densify(I.view(spark, sf, "fx_cells").select("tile", "row", "col", "z"), I.view(spark, sf, "fx_meta"))
    return P.fill_window(d, I.view(spark, sf, "fx_meta"), {"z": 3}).withColumn("z", F.round("z", 6))


@check("point_stats", I.oracle("""
select tile, count(*) as points, round(count(*)/1E2, 1) as density, round(count(*) filter (cls=2)/1E2, 1) as ground_density,
  round(100*count(*) filter (cls=2)/count(*), 1) as ground_frac,
  case when count(*) filter (cls=2) >= 200 then round(median(z) filter (cls=2), 1) end as elev_median,
  case when count(*) filter (cls=2) < 200 then 'only ' || (count(*) filter (cls=2)) || ' ground points' end as error
from fx_points group by tile""", "fx_points"))
def point_stats(spark, sf):
    return P.point_stats(_points(spark, sf), 10.0, min_ground=200)


@check("check_complete", I.oracle("""
select tile, n + case when tile % 4 = 1 then 3 else 0 end as declared, n as decoded, tile % 4 = 1 as truncated
from (select tile, count(*) as n from fx_points group by tile)""", "fx_points"))
def check_complete(spark, sf):
    p = _points(spark, sf)
    declared = p.groupBy("tile").agg((F.count("*") + F.when(F.col("tile") % 4 == 1, 3).otherwise(0)).alias("declared"))
    return P.check_complete(declared, p)


# --- footprints ----------------------------------------------------------------

def _coverage(spark, sf, hole: bool = False):
    c = I.view(spark, sf, "fx_coverage")
    outer = PG.rect_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    inner = PG.rect_ring(F.col("x0") + 0.05, F.col("y0") + 0.125, F.col("x1") - 0.05, F.col("y1") - 0.125)
    return c.select("name", F.col("cnt").alias("count"), (F.array(outer, inner) if hole else F.array(outer)).alias("rings"))


HITS_SQL = """
select a.key, c.name, c.cnt from fx_aois a join fx_coverage c on a.lon >= c.x0 and a.lon < c.x1 and a.lat >= c.y0 and a.lat < c.y1"""


@check("point_in_polygon", I.oracle(
    "select key, name from hits", "fx_aois", "fx_coverage", hits=HITS_SQL))
def point_in_polygon(spark, sf):
    pts_ = I.view(spark, sf, "fx_aois").select("key", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return PG.point_in_polygon_join(pts_, _coverage(spark, sf), 0.25).select("key", "name")


@check("point_in_donut", I.oracle("""
select h.key, h.name from hits h join fx_aois a using (key) join fx_coverage c on c.name = h.name
where not (a.lon >= c.x0 + 0.05 and a.lon < c.x1 - 0.05 and a.lat >= c.y0 + 0.125 and a.lat < c.y1 - 0.125)""",
    "fx_aois", "fx_coverage", hits=HITS_SQL))
def point_in_donut(spark, sf):
    pts_ = I.view(spark, sf, "fx_aois").select("key", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return PG.point_in_polygon_join(pts_, _coverage(spark, sf, True), 0.25).select("key", "name")


@check("find_project", I.oracle("""
select a.key, arg_max(h.name, {p: h.name = 'NATION_07', c: h.cnt, n: h.name}) as project, count(h.name) as candidates,
  case when count(h.name) = 0 then 'no coverage' end as reason from fx_aois a left join hits h using (key) group by a.key""",
    "fx_aois", "fx_coverage", hits=HITS_SQL))
def find_project(spark, sf):
    d = PG.find_project(I.view(spark, sf, "fx_aois"), _coverage(spark, sf), prefer="NATION_07", cell=0.25)
    return d.select("key", "project", "candidates", "reason")


def _views(spark, sf):
    return I.view(spark, sf, "fx_views")


def _catalog(spark, sf):
    c = I.view(spark, sf, "fx_catalog")
    ring = PG.rect_ring(F.col("fx0"), F.col("fy0"), F.col("fx1"), F.col("fy1"))
    return c.select("object_id", "low_ps", "title", F.to_date(F.timestamp_millis("acquired_ms")).alias("acquired"),
                    F.array(ring).alias("rings"))


SAMPLES_SQL = """
select v.view_id, x0 + (x1-x0)*i.i/(nx-1.0::double) as x, y0 + (y1-y0)*j.j/(ny-1.0::double) as y, nx*ny as total
from (select *, least(greatest(cast(ceil((x1-x0)/50) as bigint), 16), 128) as nx,
             least(greatest(cast(ceil((y1-y0)/50) as bigint), 16), 128) as ny from fx_views) v
join range(128) i(i) on i.i < v.nx join range(128) j(j) on j.j < v.ny"""

COVERED_SQL = """
select v.view_id, coalesce(h.hit, 0)/c.total as covered from fx_views v
join (select view_id, count(*) as total from samples group by 1) c using (view_id)
left join (select s.view_id, count(*) as hit from samples s semi join (select * from fx_catalog where low_ps <= 1.5) f
  on s.x >= fx0 and s.x < fx1 and s.y >= fy0 and s.y < fy1 group by 1) h using (view_id)"""


@check("covered_fraction", I.oracle("select view_id, round(covered, 6) as covered from cov", "fx_views", "fx_catalog",
                                    samples=SAMPLES_SQL, cov=COVERED_SQL))
def covered_fraction(spark, sf):
    return PG.covered_fraction(_views(spark, sf), _catalog(spark, sf)).withColumn("covered", F.round("covered", 6))


MET_SQL = """
select v.view_id, min(low_ps) as best_m, arg_min(title, {p: low_ps, o: object_id}) as title, count(*) as sources,
  min(case when low_ps <= 1.5 then acquired end) as first, max(case when low_ps <= 1.5 then acquired end) as last
from fx_views v join (select *, cast(make_timestamp(acquired_ms*1000) as date) as acquired from fx_catalog) f
on v.x0 <= fx1 and v.x1 >= fx0 and v.y0 <= fy1 and v.y1 >= fy0 group by 1"""


@check("coverage_summary", I.oracle("""
select view_id, best_m, title, coalesce(sources, 0) as sources, round(covered, 6) as covered, first, last,
  coalesce(best_m <= 1.5, false) as fine, covered >= 1 as complete, coalesce(best_m <= 1.5, false) and covered >= 1 as usable,
  case when best_m is null then 'no source' when best_m > 1.5 then 'source is resampled: ' || title
    when covered < 1 then 'only ' || cast(floor(covered*100+0.5) as bigint) || '% of this view is fine enough' end as reason
from fx_views left join met using (view_id) join cov using (view_id)""",
    "fx_views", "fx_catalog", samples=SAMPLES_SQL, cov=COVERED_SQL, met=MET_SQL))
def coverage_summary(spark, sf):
    d = PG.coverage_summary(_views(spark, sf), _catalog(spark, sf))
    return d.select("view_id", "best_m", "title", "sources", F.round("covered", 6).alias("covered"), "first", "last", "fine",
                    "complete", "usable", "reason")


@check("describe_source", I.oracle("""
select view_id, title || ' · ' || case when best_m >= 9.95 then printf('%.0f', best_m) when best_m >= 0.995 then printf('%.1f', best_m) else printf('%.2f', best_m) end || ' m' ||
  case when first is null then '' when first = last then ' · flown ' || first else ' · flown ' || first || ' to ' || last end as text
from met""", "fx_views", "fx_catalog", met=MET_SQL))
def describe_source(spark, sf):
    m = PG.met_sources(_views(spark, sf), _catalog(spark, sf))
    return m.select("view_id", R.describe_source(F.col("title"), F.col("best_m"), F.col("first"), F.col("last")).alias("text"))


@check("plan_requests", I.oracle("""
select view_id, w as width, h as height, round((x0+x1)/2 - w/2.0::double, 6) as px0, round((y0+y1)/2 - h/2.0::double, 6) as py0,
  round((x0+x1)/2 + w/2.0::double, 6) as px1, round((y0+y1)/2 + h/2.0::double, 6) as py1, case when greatest(w, h) > 8000 then 'too large' end as reason
from (select *, greatest(cast(ceil(x1-x0) as bigint), 256) as w, greatest(cast(ceil(y1-y0) as bigint), 256) as h from fx_views)""", "fx_views"))
def plan_requests(spark, sf):
    d = PG.plan_requests(_views(spark, sf), 1.0, 256)
    return d.withColumns({c: F.round(c, 6) for c in ("px0", "py0", "px1", "py1")})


# --- projections -----------------------------------------------------------------

def utm_sql(lon: str, lat: str, zone: str = "11") -> tuple[str, str]:
    """Series form of transverse Mercator, written out for SQL."""
    a, b, c = GD.ALPHA
    dl = f"radians({lon} - ({zone}*6-183))"
    phi = f"radians({lat})"
    t = f"sinh(atanh(sin({phi})) - {GD.ECC!r}*atanh({GD.ECC!r}*sin({phi})))"
    xi, eta = f"atan2({t}, cos({dl}))", f"atanh(sin({dl})/sqrt(1+{t}*{t}))"
    s = repr(GD.K0 * GD.RECTIFYING_M)
    east = f"500000 + {s}*({eta} + {a!r}*cos(2*{xi})*sinh(2*{eta}) + {b!r}*cos(4*{xi})*sinh(4*{eta}) + {c!r}*cos(6*{xi})*sinh(6*{eta}))"
    north = f"{s}*({xi} + {a!r}*sin(2*{xi})*cosh(2*{eta}) + {b!r}*sin(4*{xi})*cosh(4*{eta}) + {c!r}*sin(6*{xi})*cosh(6*{eta}))"
    return east, north


E_SQL, N_SQL = utm_sql("lon", "lat")
ZE_SQL, ZN_SQL = utm_sql("lon", "lat", "zone")
AOI_XY_SQL = f"select *, {E_SQL} as x, {N_SQL} as y from fx_aois"


@check("utm_epsg", I.oracle("""
select key, 'EPSG:' || case when lat >= 0 then '326' else '327' end || lpad(cast(cast(floor((lon+180)/6) as bigint)+1 as varchar), 2, '0') as epsg
from (select key, case when key % 2 = 0 then lat else -lat end as lat, lon + (key % 60)*6 as lon from fx_aois)""", "fx_aois"))
def utm_epsg(spark, sf):
    d = I.view(spark, sf, "fx_aois").select("key", F.when(F.col("key") % 2 == 0, F.col("lat")).otherwise(-F.col("lat")).alias("lat"),
                                            (F.col("lon") + (F.col("key") % 60) * 6).alias("lon"))
    return d.select("key", GD.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


@check("lonlat_to_utm", I.oracle(
    f"select key, round({ZE_SQL}, 3) as x, round({ZN_SQL}, 3) as y from (select *, cast(floor((lon+180)/6) as bigint)+1 as zone from fx_aois)", "fx_aois"))
def lonlat_to_utm(spark, sf):
    d = I.view(spark, sf, "fx_aois").withColumn("zone", GD.utm_zone(F.col("lon")))
    return GD.with_utm(d, "lon", "lat", "zone").select("key", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@check("utm_to_lonlat", I.oracle("select key, round(lon, 8) as lon, round(lat, 8) as lat from fx_aois", "fx_aois"))
def utm_to_lonlat(spark, sf):
    d = GD.with_utm(I.view(spark, sf, "fx_aois").select("key", "lon", "lat"), "lon", "lat", F.lit(11))
    back = GD.with_lonlat(d.select("key", "x", "y"), "x", "y", F.lit(11))
    return back.select("key", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@check("to_web_mercator", I.oracle("""
select key, round(6378137.0::double*radians(lon), 4) as x, round(6378137.0::double*ln(tan(pi()/4 + radians(lat)/2)), 4) as y from fx_aois""", "fx_aois"))
def to_web_mercator(spark, sf):
    d = I.view(spark, sf, "fx_aois").select("key", GD.to_web_mercator(F.col("lon"), F.col("lat")).alias("m"))
    return d.select("key", F.round("m.x", 4).alias("x"), F.round("m.y", 4).alias("y"))


def inv_sql(x: str, y: str) -> tuple[str, str]:
    b1, b2, b3 = GD.BETA
    d1, d2, d3 = GD.DELTA
    s = repr(GD.K0 * GD.RECTIFYING_M)
    xi, eta = f"(({y})/{s})", f"((({x})-500000)/{s})"
    xp = f"({xi} - {b1!r}*sin(2*{xi})*cosh(2*{eta}) - {b2!r}*sin(4*{xi})*cosh(4*{eta}) - {b3!r}*sin(6*{xi})*cosh(6*{eta}))"
    ep = f"({eta} - {b1!r}*cos(2*{xi})*sinh(2*{eta}) - {b2!r}*cos(4*{xi})*sinh(4*{eta}) - {b3!r}*cos(6*{xi})*sinh(6*{eta}))"
    chi = f"asin(sin({xp})/cosh({ep}))"
    return (f"degrees(atan2(sinh({ep}), cos({xp}))) - 117",
            f"degrees({chi} + {d1!r}*sin(2*{chi}) + {d2!r}*sin(4*{chi}) + {d3!r}*sin(6*{chi}))")


LON_SQL, LAT_SQL = inv_sql("cx", "cy")
HAR_LON_SQL, HAR_LAT_SQL = LON_SQL, LAT_SQL


@check("aoi_bbox", I.oracle(f"""
select key, round(min({LAT_SQL}), 7) as south, round(min({LON_SQL}), 7) as west, round(max({LAT_SQL}), 7) as north, round(max({LON_SQL}), 7) as east
from (select key, x + i.i*580 as cx, y + j.j*580 as cy from xy, (select unnest([-1, 1]) as i) i, (select unnest([-1, 1]) as j) j) group by key""",
    "fx_aois", xy=AOI_XY_SQL))
def aoi_bbox(spark, sf):
    d = RG.aoi_bbox(I.view(spark, sf, "fx_aois"), 11)
    return d.select("key", *[F.round(c, 7).alias(c) for c in ("south", "west", "north", "east")])


@check("request_bounds", I.oracle(f"""
select key, round(min(6378137.0::double*radians({LON_SQL})), 3) as wx0, round(min(6378137.0::double*ln(tan(pi()/4 + radians({LAT_SQL})/2))), 3) as wy0,
  round(max(6378137.0::double*radians({LON_SQL})), 3) as wx1, round(max(6378137.0::double*ln(tan(pi()/4 + radians({LAT_SQL})/2))), 3) as wy1
from (select key, x + i.i*560 as cx, y + j.j*560 as cy from xy, (select unnest([-1, 1]) as i) i, (select unnest([-1, 1]) as j) j) group by key""",
    "fx_aois", xy=AOI_XY_SQL))
def request_bounds(spark, sf):
    d = RG.request_bounds(I.view(spark, sf, "fx_aois"), 11)
    return d.select("key", *[F.round(c, 3).alias(c) for c in ("wx0", "wy0", "wx1", "wy1")])


@check("true_scale_check", I.oracle("""
select key, kind, round(scale, 6) as scale, case when abs(scale-1) > 0.01 then 'projected metres are not ground metres' end as reason
from (select key, 'mercator' as kind, 2*6371008.8::double*asin(sin(radians(0.01)/2))/(6378137.0::double*(ln(tan(pi()/4+radians(lat+0.01)/2)) - ln(tan(pi()/4+radians(lat)/2)))) as scale from fx_aois
 union all select key, 'local', 0.9996::double from fx_aois)""", "fx_aois"))
def true_scale_check(spark, sf):
    a = I.view(spark, sf, "fx_aois")
    up = GD.to_web_mercator(F.col("lon"), F.col("lat") + 0.01)["y"] - GD.to_web_mercator(F.col("lon"), F.col("lat"))["y"]
    g = GD.great_circle_m(F.col("lon"), F.col("lat"), F.col("lon"), F.col("lat") + 0.01)
    spans = a.select("key", F.lit("mercator").alias("kind"), up.alias("projected_m"), g.alias("ground_m")).unionByName(
        a.select("key", F.lit("local").alias("kind"), F.lit(1000.0).alias("projected_m"), F.lit(999.6).alias("ground_m")))
    return PG.true_scale_check(spans).select("key", "kind", F.round("scale", 6).alias("scale"), "reason")
