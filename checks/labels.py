"""Checks for label burning, transects and elevation agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import check
from ridgeline import constants as K
from ridgeline.operators import agreement as A
from ridgeline.operators import grid as G
from ridgeline.operators import labels as L
from ridgeline.operators import transects as TR
from ridgeline.operators.lineage import cut

#: kilometre tiles over the mapped area, 40 x 40 cells of 25 m; radii are scaled to match
WORLD_SQL = """
select distinct cast(floor(x/1000)*100 + floor(y/1000) as bigint) as tile, floor(x/1000)*1000 as x0, floor(y/1000)*1000 + 1000 as y1
from fx_vertices"""
META_SQL = "select *, 25::double as res, 40 as height, 40 as width from world"
# a hair over the round radii, so that a square exactly on the rim counts in both engines
POS, IGN, EXC, WAT = 20.000001, 50.000001, 40.000001, 30.000001

SEGK_SQL = """
select c.*, k.kind, case when k.kind='trail' then k.trail_weight else 0 end as weight, k.vclass,
  case k.vclass when 'active' then 1 when 'faint' then 2 else 3 end as code
from cums c join kinds k using (id) where k.kind is not null"""

#: candidate cells from the expanded bounding box, then the exact squared distance
NEARC_SQL = """
select tile, r as row, c as col, id, kind, weight, vclass, code,
 case when ok and t0 <= t1 then 0 else least(d1, d2, d3, d4, e0, e1) end as dd from (
 select *,
  (abs(x1-x0) > 0 or (x0 >= qx0 and x0 <= qx1)) and (abs(y1-y0) > 0 or (y0 >= qy0 and y0 <= qy1)) as ok,
  greatest(0::double, case when x1<>x0 then least((qx0-x0)/(x1-x0), (qx1-x0)/(x1-x0)) else 0 end, case when y1<>y0 then least((qy0-y0)/(y1-y0), (qy1-y0)/(y1-y0)) else 0 end) as t0,
  least(1::double, case when x1<>x0 then greatest((qx0-x0)/(x1-x0), (qx1-x0)/(x1-x0)) else 1 end, case when y1<>y0 then greatest((qy0-y0)/(y1-y0), (qy1-y0)/(y1-y0)) else 1 end) as t1,
  {d1} as d1, {d2} as d2, {d3} as d3, {d4} as d4,
  power(greatest(qx0-x0, x0-qx1, 0), 2) + power(greatest(qy0-y0, y0-qy1, 0), 2) as e0,
  power(greatest(qx0-x1, x1-qx1, 0), 2) + power(greatest(qy0-y1, y1-qy1, 0), 2) as e1
 from (
  select s.*, m.tile, m.x0 + c.c*25 as qx0, m.x0 + c.c*25 + 25 as qx1, m.y1 - r.r*25 - 25 as qy0, m.y1 - r.r*25 as qy1, r.r as r, c.c as c
  from segk s join (select tile, x0, y1 as ytop from meta) mm on least(s.x0, s.x1) - 50 <= mm.x0 + 1000 and greatest(s.x0, s.x1) + 50 >= mm.x0
     and least(s.y0, s.y1) - 50 <= mm.ytop and greatest(s.y0, s.y1) + 50 >= mm.ytop - 1000
  join meta m on m.tile = mm.tile
  join range(40) r(r) on r.r between floor((m.y1 - greatest(s.y0, s.y1) - 50)/25) - 1 and floor((m.y1 - least(s.y0, s.y1) + 50)/25) + 1
  join range(40) c(c) on c.c between floor((least(s.x0, s.x1) - 50 - m.x0)/25) - 1 and floor((greatest(s.x0, s.x1) + 50 - m.x0)/25) + 1))"""


def _d(px: str, py: str) -> str:
    t = f"least(greatest(coalesce((({px}-x0)*(x1-x0)+({py}-y0)*(y1-y0))/nullif((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0), 0), 0), 0), 1)"
    return f"(power(x0+(x1-x0)*{t}-{px}, 2) + power(y0+(y1-y0)*{t}-{py}, 2))"


NEARC_SQL = NEARC_SQL.format(d1=_d("qx0", "qy0"), d2=_d("qx0", "qy1"), d3=_d("qx1", "qy0"), d4=_d("qx1", "qy1"))

PLANES_SQL = """
select w.tile, r.r as row, c.c as col, case when b.code is not null then 1 else 0 end::bigint as target,
  case when b.code is null and b.near > 0 then 0 when b.code is not null then greatest(b.weight, 0.05) else 1 end::double as weight,
  case when b.code is null and b.near > 0 then 1 else 0 end::bigint as ignore, coalesce(b.code, 0)::bigint as class
from meta w, range(40) r(r), range(40) c(c) left join (
  select tile, row, col, min(case when kind='trail' and dd <= 400.00004 then code end) as code,
    max(case when kind='trail' and dd <= 400.00004 then weight end) as weight,
    max(case when (kind='trail' and dd <= 2500.0001) or (kind='excluded' and dd <= 1600.00008) or (kind='water' and dd <= 900.00006) then 1 else 0 end) as near
  from nearc group by 1, 2, 3) b on b.tile = w.tile and b.row = r.r and b.col = c.c"""

BASE = {"world": WORLD_SQL, "meta": META_SQL, "segk": SEGK_SQL, "nearc": NEARC_SQL, "planes": PLANES_SQL}


def _meta(spark, sf):
    v = I.view(spark, sf, "fx_vertices")
    gx, gy = F.floor(F.col("x") / 1000), F.floor(F.col("y") / 1000)
    d = v.select(gx.alias("gx"), gy.alias("gy")).distinct()
    return d.select((F.col("gx") * 100 + F.col("gy")).alias("tile"), (F.col("gx") * 1000.0).alias("x0"),
                    (F.col("gy") * 1000.0 + 1000).alias("y1"), F.lit(25.0).alias("res"),
                    F.lit(40).cast("bigint").alias("height"), F.lit(40).cast("bigint").alias("width"))


def _segments(spark, sf):
    return L.classified_segments(I.ways(spark, sf))


def _planes(spark, sf):
    return L.label_planes(_segments(spark, sf), _meta(spark, sf), POS, IGN, EXC, WAT)


@check("burn_ways", I.ways_oracle("select distinct tile, row, col from nearc where dd <= 400.00004", **BASE))
def burn_ways(spark, sf):
    return L.burn_ways(_segments(spark, sf), _meta(spark, sf), POS)


@check("label_planes", I.ways_oracle("select * from planes", **BASE))
def label_planes(spark, sf):
    return _planes(spark, sf)


CLIPT_SQL = """
select * from (select *,
   greatest(0, case when x1>x0 then (tx0-x0)/(x1-x0) when x1<x0 then (tx0+1000-x0)/(x1-x0) else 0 end,
               case when y1>y0 then (ty1-1000-y0)/(y1-y0) when y1<y0 then (ty1-y0)/(y1-y0) else 0 end) as t0,
   least(1, case when x1>x0 then (tx0+1000-x0)/(x1-x0) when x1<x0 then (tx0-x0)/(x1-x0) else 1 end,
            case when y1>y0 then (ty1-y0)/(y1-y0) when y1<y0 then (ty1-1000-y0)/(y1-y0) else 1 end) as t1
   from (select s.*, m.tile, m.x0 as tx0, m.y1 as ty1 from segk s join meta m on least(s.x0, s.x1) <= m.x0 + 1000 and greatest(s.x0, s.x1) >= m.x0
     and least(s.y0, s.y1) <= m.y1 and greatest(s.y0, s.y1) >= m.y1 - 1000))
where t0 < t1 and (x0 <> x1 or (x0 >= tx0 and x0 <= tx0+1000)) and (y0 <> y1 or (y0 >= ty1-1000 and y0 <= ty1))"""


@check("label_stats", I.ways_oracle("""
select p.tile, round(avg(p.target), 6) as positive_frac, round(avg(p.ignore), 6) as ignore_frac,
  round(avg(case when class=1 then 1.0 else 0.0 end), 6) as positive_frac_active, round(avg(case when class=2 then 1.0 else 0.0 end), 6) as positive_frac_faint,
  round(avg(case when class=3 then 1.0 else 0.0 end), 6) as positive_frac_lifecycle,
  coalesce(any_value(k.km), 0) as km, coalesce(any_value(k.a), 0) as km_active, coalesce(any_value(k.f), 0) as km_faint, coalesce(any_value(k.l), 0) as km_lifecycle,
  coalesce(any_value(w.t), 0) as ways_trail, coalesce(any_value(w.l), 0) as ways_lifecycle, coalesce(any_value(w.e), 0) as ways_excluded, coalesce(any_value(w.u), 0) as km_untrimmed
from planes p
left join (select tile, round(sum(len*(t1-t0))/1000, 5) as km, round(coalesce(sum(len*(t1-t0)) filter (vclass='active'), 0)/1000, 5) as a,
   round(coalesce(sum(len*(t1-t0)) filter (vclass='faint'), 0)/1000, 5) as f, round(coalesce(sum(len*(t1-t0)) filter (vclass='lifecycle'), 0)/1000, 5) as l
   from clipt where kind='trail' group by tile) k using (tile)
left join (select tile, count(*) filter (kind='trail') as t, count(*) filter (kind='trail' and vclass='lifecycle') as l, count(*) filter (kind='excluded') as e,
   round(coalesce(sum(total) filter (kind='trail'), 0)/1000, 5) as u from (
   select distinct m.tile, s.id, s.kind, s.vclass, s.total from segk s join meta m on least(s.x0, s.x1) - 50 <= m.x0 + 1000 and greatest(s.x0, s.x1) + 50 >= m.x0
     and least(s.y0, s.y1) - 50 <= m.y1 and greatest(s.y0, s.y1) + 50 >= m.y1 - 1000) group by tile) w using (tile)
group by p.tile""", **BASE, clipt=CLIPT_SQL))
def label_stats(spark, sf):
    d = L.label_stats(_planes(spark, sf), _segments(spark, sf), _meta(spark, sf), IGN)
    six = ("positive_frac", "ignore_frac", "positive_frac_active", "positive_frac_faint", "positive_frac_lifecycle")
    five = ("km", "km_active", "km_faint", "km_lifecycle", "km_untrimmed")
    return d.withColumns({**{c: F.round(c, 6) for c in six}, **{c: F.round(c, 5) for c in five}})


# --- transects ---------------------------------------------------------------

STEP, HALF, MARGIN, AHEAD, MINPART = 20.0, 75.0, 20.0, 10.0, 60.0

PARTS_SQL = """
select *, sum(plen) over (partition by tile, id, part order by seg) - plen as c0, sum(plen) over (partition by tile, id, part) as ptotal from (
 select *, sum(fresh) over (partition by tile, id order by seg) as part, len*(t1-t0) as plen, x0+(x1-x0)*t0 as px0, y0+(y1-y0)*t0 as py0,
   x0+(x1-x0)*t1 as px1, y0+(y1-y0)*t1 as py1 from (
  select *, case when lag(seg) over (partition by tile, id order by seg) = seg-1 and lag(t1) over (partition by tile, id order by seg) = 1 and t0 = 0 then 0 else 1 end as fresh
  from clipt where kind = 'trail'))"""

STATIONS_SQL = f"""
select p.*, qx, qy from (
 select tile, id, part, vclass, station, s, tx0, ty1, px0+(px1-px0)*least((s-c0)/plen, 1) as x, py0+(py1-py0)*least((s-c0)/plen, 1) as y from (
  select *, row_number() over (partition by tile, id, part, station order by seg desc) as rk from (
   select p.*, k.k as station, {MARGIN}::double + k.k*{STEP}::double as s from parts p, range(400) k(k)
   where ptotal >= {MINPART} and k.k < ceil((greatest(ptotal-{MARGIN}, {MARGIN}+1)-{MARGIN})/{STEP}) and c0 <= {MARGIN}::double + k.k*{STEP}::double)) where rk = 1) p
join (
 select tile, id, part, station, px0+(px1-px0)*least((s-c0)/plen, 1) as qx, py0+(py1-py0)*least((s-c0)/plen, 1) as qy from (
  select *, row_number() over (partition by tile, id, part, station order by seg desc) as rk from (
   select p.*, k.k as station, least({MARGIN}::double + k.k*{STEP}::double + {AHEAD}, ptotal) as s from parts p, range(400) k(k)
   where ptotal >= {MINPART} and k.k < ceil((greatest(ptotal-{MARGIN}, {MARGIN}+1)-{MARGIN})/{STEP}) and c0 <= least({MARGIN}::double + k.k*{STEP}::double + {AHEAD}, ptotal))) where rk = 1) q
using (tile, id, part, station) where sqrt((qx-x)*(qx-x)+(qy-y)*(qy-y)) >= 1e-6"""

TBASE = {"world": WORLD_SQL, "meta": META_SQL, "segk": SEGK_SQL, "clipt": CLIPT_SQL, "parts": PARTS_SQL, "stations": STATIONS_SQL}


def _parts(spark, sf):
    s = _segments(spark, sf)
    return TR.tile_parts(s.where(F.col("kind") == "trail"), _meta(spark, sf), MINPART)


@check("transect_stations", I.ways_oracle("""
select tile, id, cast(part as bigint) as part, station, round(x, 5) as x, round(y, 5) as y, round(-(qy-y)/sqrt((qx-x)*(qx-x)+(qy-y)*(qy-y)), 5) + 0.0 as nx,
  round((qx-x)/sqrt((qx-x)*(qx-x)+(qy-y)*(qy-y)), 5) + 0.0 as ny from stations""", **TBASE))
def transect_stations(spark, sf):
    d = TR.stations(_parts(spark, sf), STEP, MARGIN, AHEAD)
    return d.select("tile", "id", "part", "station", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"),
                    (F.round("nx", 5) + 0.0).alias("nx"), (F.round("ny", 5) + 0.0).alias("ny"))


DTM_SQL = "select m.tile, r.r as row, c.c as col, ((m.tile*31 + r.r*17 + c.c*29) % 97)/1E1 as z from meta m, range(40) r(r), range(40) c(c)"

RELIEF_SQL = """
select d.tile, d.row, d.col, d.z - list_sort(list(s.z))[13] as relief from dtm d, range(-2,3) a(a), range(-2,3) b(b)
join dtm s on s.tile = d.tile and s.row = (case when d.row+a.a < 0 then -1-d.row-a.a when d.row+a.a >= 40 then 79-d.row-a.a else d.row+a.a end)
 and s.col = (case when d.col+b.b < 0 then -1-d.col-b.b when d.col+b.b >= 40 then 79-d.col-b.b else d.col+b.b end) group by d.tile, d.row, d.col, d.z"""

PROFILES_SQL = f"""
select s.tile, s.vclass, s.id, s.part, s.station, o.o as off, s.rf, s.cf, sum(f.relief*(case when a.a=1 then rf-floor(rf) else 1-(rf-floor(rf)) end)*(case when b.b=1 then cf-floor(cf) else 1-(cf-floor(cf)) end)) as v
from (select *, least(greatest((ty1 - (y + (qx-x)/n*(o*25-{HALF})))/25, 0), 39) as rf, least(greatest((x - (qy-y)/n*(o*25-{HALF}) - tx0)/25, 0), 39) as cf
      from (select *, sqrt((qx-x)*(qx-x)+(qy-y)*(qy-y)) as n from stations), range(7) o(o)) s, range(7) o(o), range(2) a(a), range(2) b(b)
join relief f on f.tile = s.tile and f.row = least(floor(s.rf) + a.a, 39) and f.col = least(floor(s.cf) + b.b, 39)
where o.o = s.o group by all"""

SIGNAL_SQL = """
select tile, vclass, n as n_transects, case when n >= 40 then inc end as incision_mm, case when n >= 40 then noise end as noise_mm,
  case when n >= 40 then case when noise > 0 then inc/noise*sqrt(n) else 0 end end as snr, case when n < 40 then 'too few transects' end as note
from (select tile, vclass, count(*) as n, stddev_pop(d)*1000 as noise from (
   select tile, vclass, id, part, station, max(v) filter (off=3) - max(v) filter (off between 0 and 6) as d from profiles group by 1,2,3,4,5) group by 1, 2)
join (select tile, vclass, (max(v) - max(v) filter (off=3))*1000 as inc from (select tile, vclass, off, avg(v) as v from profiles group by 1,2,3) group by 1,2) using (tile, vclass)"""

PBASE = {**TBASE, "dtm": DTM_SQL, "relief": RELIEF_SQL, "profiles": PROFILES_SQL, "signal": SIGNAL_SQL}


def _dtm(meta):
    d = G._skeleton(meta)
    return d.select("tile", "row", "col", (((F.col("tile") * 31 + F.col("row") * 17 + F.col("col") * 29) % 97) / 10.0).alias("z"))


def _signal(spark, sf):
    meta = cut(_meta(spark, sf))
    return TR.signal_by_class(_segments(spark, sf), _dtm(meta), meta, 25.0, HALF, STEP, 75.0, MINPART,
                              relief_px=5, margin=MARGIN, ahead=AHEAD)


@check("signal_by_class", I.ways_oracle("""
select tile, vclass, n_transects, round(incision_mm, 3) as incision_mm, round(noise_mm, 3) as noise_mm, round(snr, 3) as snr, note from signal""", **PBASE))
def signal_by_class(spark, sf):
    d = _signal(spark, sf)
    return d.withColumns({c: F.round(c, 3) + 0.0 for c in ("incision_mm", "noise_mm", "snr")})


@check("mean_profile", I.ways_oracle(f"""
select vclass, off, round(avg(v)*1000, 3) as mean_mm, off*25-{HALF}::double as offset_m from profiles group by 1, 2""", **PBASE))
def mean_profile(spark, sf):
    meta = cut(_meta(spark, sf))
    relief = G.median_filter(_dtm(meta), meta, 5, "reflect", "z", "_m", keep=("z",)).select(
        "tile", "row", "col", (F.col("z") - F.col("_m")).alias("relief"))
    p = TR.sample_profiles(_segments(spark, sf).where(F.col("kind") == "trail"), relief, meta, HALF, 25.0, STEP,
                           MINPART, MARGIN, AHEAD)
    return TR.mean_profile(p, ["vclass"], HALF, 25.0).withColumn("mean_mm", F.round("mean_mm", 3) + 0.0)


@check("snr_verdict", I.ways_oracle("""
select tile, vclass, case when snr > 8 then 'STRONG' when snr > 3 then 'usable' else 'weak' end as verdict from signal where note is null""", **PBASE))
def snr_verdict(spark, sf):
    from ridgeline.functions.rasters import snr_verdict as op

    return _signal(spark, sf).where(F.col("note").isNull()).select("tile", "vclass", op(F.col("snr")).alias("verdict"))


# --- elevation agreement ---------------------------------------------------------

AGREE_SQL = {
    "bodyz": "select tile, row//2 as row, col//2 as col, avg(z/200) as z from dense group by 1, 2, 3",
    "pub": "select tile, row, col, case when (row*7 + col*3) % 41 = 0 then null else coalesce(z, 0) + ((row*13 + col*7 + tile) % 11)/16.0::double end as zp from bodyz",
    "two": "select b.tile, b.row, b.col, b.z, p.zp from bodyz b join pub p using (tile, row, col)",
    "sl": """
select d.*, case when r.z is not null and l.z is not null and b.z is not null and u.z is not null
    then least(sqrt(power((r.z-l.z)/2, 2) + power((b.z-u.z)/2, 2)), tan(radians(60))) end as so,
  case when r.zp is not null and l.zp is not null and b.zp is not null and u.zp is not null
    then least(sqrt(power((r.zp-l.zp)/2, 2) + power((b.zp-u.zp)/2, 2)), tan(radians(60))) end as sp
from two d left join two l on l.tile=d.tile and l.row=d.row and l.col=d.col-1 left join two r on r.tile=d.tile and r.row=d.row and r.col=d.col+1
 left join two u on u.tile=d.tile and u.row=d.row-1 and u.col=d.col left join two b on b.tile=d.tile and b.row=d.row+1 and b.col=d.col""",
}


@check("dem_agreement", I.dense_oracle("""
select tile, case when n >= 200 then round(r, 3) end as slope_corr, case when n >= 200 then round(m, 3) end as median_offset_m, nan_frac,
  case when n < 200 then 'too few cells in common' when r < 0.7 then 'slopes do not agree' end as error
from (select tile, count(*) filter (inner_ and z is not null and zp is not null) as n, round(avg(case when zp is null then 1.0 else 0.0 end), 4) as nan_frac,
  corr(so, sp) filter (inner_ and z is not null and zp is not null and so is not null and sp is not null) as r,
  median(zp - z) filter (inner_ and z is not null and zp is not null and so is not null and sp is not null) as m
  from (select *, row between 1 and 6 and col between 1 and 78 as inner_ from sl) group by tile)""", **AGREE_SQL))
def dem_agreement(spark, sf):
    meta = I.view(spark, sf, "fx_meta")
    d = G.densify(I.view(spark, sf, "fx_cells").select("tile", "row", "col", (F.col("z") / 200).alias("z")), meta)
    body = G.block_reduce(d, meta, 2, {"z": ("z", "nanmean")})
    pub = body.withColumn("z", F.when((F.col("row") * 7 + F.col("col") * 3) % 41 != 0, F.coalesce("z", F.lit(0.0)) + (
        (F.col("row") * 13 + F.col("col") * 7 + F.col("tile")) % 11) / 16.0))
    return A.dem_agreement(d, pub, meta, 2, margin=1, min_cells=200)
