"""Checks for raster neighbourhood operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import check
from ridgeline import constants as K
from ridgeline.functions import rasters as R
from ridgeline.operators import features as FT
from ridgeline.operators import grid as G


def _cells(spark, sf):
    return I.view(spark, sf, "fx_cells")


def _meta(spark, sf):
    return I.view(spark, sf, "fx_meta")


def _filled(spark, sf):
    dense = G.densify(_cells(spark, sf).select("tile", "row", "col", "z"), _meta(spark, sf))
    return G.fill_median(dense).select("tile", "row", "col", "z", "valid")


def _round(df, places, *cols):
    return df.select("tile", "row", "col", *[(F.round(c, places) + 0.0).alias(c) for c in cols])


def _window_sql(src: str, agg: str, k: int, border: str, extra: str = "") -> str:
    """Brute-force k x k neighbourhood: offsets joined by clamped coordinates."""
    def idx(c: str, n: int) -> str:
        p = f"(d.{c} + o{c[0]}.v)"
        if border == "replicate":
            return f"least(greatest({p}, 0), {n - 1})"
        if border == "reflect":
            return f"(case when {p} < 0 then -1-{p} when {p} >= {n} then {2 * n - 1}-{p} else {p} end)"
        return p
    b, a = k // 2, k - 1 - k // 2
    return (f"select d.tile, d.row, d.col{extra}, {agg} as v from {src} d, range({-b}, {a + 1}) orr(v), range({-b}, {a + 1}) oc(v) "
            f"join {src} s on s.tile = d.tile and s.row = {idx('row', 16).replace('or.v', 'orr.v')} and s.col = {idx('col', 160)} "
            f"group by d.tile, d.row, d.col{extra}")


def _upper(k: int) -> str:
    return f"list_sort(list(s.z))[{k * k // 2 + 1}]"


@check("densify", I.dense_oracle("select tile, row, col, z, y from dense"))
def densify(spark, sf):
    return G.densify(_cells(spark, sf).select("tile", "row", "col", "z", "y"), _meta(spark, sf))


@check("fill_median", I.filled_oracle(
    "select f.tile, f.row, f.col, round(f.z, 6) as z, d.z is not null as valid from filled f join dense d using (tile, row, col)"))
def fill_median(spark, sf):
    return _filled(spark, sf).withColumn("z", F.round("z", 6))


@check("median_filter_3", I.filled_oracle(f"select tile, row, col, v as median from m",
                                          m=_window_sql("filled", _upper(3), 3, "replicate")))
def median_filter_3(spark, sf):
    return G.median_filter(_filled(spark, sf), _meta(spark, sf), 3)


@check("median_filter_4_reflect", I.filled_oracle("select tile, row, col, v as median from m",
                                                  m=_window_sql("filled", _upper(4), 4, "reflect")))
def median_filter_4_reflect(spark, sf):
    return G.median_filter(_filled(spark, sf), _meta(spark, sf), 4, "reflect")


@check("median_filter_10", I.filled_oracle("select tile, row, col, v as median from m",
                                           m=_window_sql("filled", _upper(10), 10, "replicate")))
def median_filter_10(spark, sf):
    """Wide median: NumPy partition inside halo blocks."""
    return G.median_filter(_filled(spark, sf), _meta(spark, sf), 10)


@check("box_mean_4", I.filled_oracle("select tile, row, col, round(v, 6) as mean from m",
                                     m=_window_sql("filled", "avg(s.z)", 4, "replicate")))
def box_mean_4(spark, sf):
    return _round(G.box_mean(_filled(spark, sf), _meta(spark, sf), {"mean": "z"}, 4), 6, "mean")


@check("box_mean_15_reflect", I.filled_oracle("select tile, row, col, round(v, 6) as mean from m",
                                              m=_window_sql("filled", "avg(s.z)", 15, "reflect")))
def box_mean_15_reflect(spark, sf):
    return _round(G.box_mean(_filled(spark, sf), _meta(spark, sf), {"mean": "z"}, 15, "reflect"), 6, "mean")


@check("dilate_5", I.dense_oracle("select tile, row, col, cast(v as bigint) as near from m",
                                  m=_window_sql("dense", "max(s.y)", 11, "truncate")))
def dilate_5(spark, sf):
    return G.dilate(_cells(spark, sf), _meta(spark, sf), {"near": "y"}, 5)


GRAD_SQL = """
select d.tile, d.row, d.col,
  case when l.col is not null and r.col is not null then (r.z - l.z)/2 when r.col is not null then r.z - d.z else d.z - l.z end as gx,
  case when u.row is not null and b.row is not null then (b.z - u.z)/2 when b.row is not null then b.z - d.z else d.z - u.z end as gy,
  (coalesce(r.z, case when r.col is null then d.z end) - coalesce(l.z, case when l.col is null then d.z end))/2 as hx,
  (coalesce(b.z, case when b.row is null then d.z end) - coalesce(u.z, case when u.row is null then d.z end))/2 as hy
from {src} d left join {src} l on l.tile=d.tile and l.row=d.row and l.col=d.col-1
 left join {src} r on r.tile=d.tile and r.row=d.row and r.col=d.col+1
 left join {src} u on u.tile=d.tile and u.row=d.row-1 and u.col=d.col
 left join {src} b on b.tile=d.tile and b.row=d.row+1 and b.col=d.col"""


@check("slope_one_sided", I.dense_oracle(
    "select tile, row, col, round(degrees(atan(sqrt(gx*gx+gy*gy))), 6) as slope from g", g=GRAD_SQL.format(src="dense")))
def slope_one_sided(spark, sf):
    """Holes are left NULL, so cells beside one have no slope."""
    d = G.densify(_cells(spark, sf).select("tile", "row", "col", "z"), _meta(spark, sf))
    return _round(G.slope(d, _meta(spark, sf), 1.0), 6, "slope")


@check("slope_replicate", I.filled_oracle(
    "select tile, row, col, round(degrees(atan(sqrt(hx*hx+hy*hy))), 6) as slope from g", g=GRAD_SQL.format(src="filled")))
def slope_replicate(spark, sf):
    return _round(G.slope(_filled(spark, sf), _meta(spark, sf), 1.0, "replicate"), 6, "slope")


@check("roughness_raw", I.filled_oracle(
    "select tile, row, col, round(sqrt(greatest(v, 0)), 5) as rough from m",
    m=_window_sql("filled", "avg(s.z*s.z) - avg(s.z)*avg(s.z)", 3, "reflect")))
def roughness_raw(spark, sf):
    return _round(G.roughness(_filled(spark, sf), _meta(spark, sf), 3, None, "reflect"), 5, "rough")


@check("roughness_detrended", I.filled_oracle(
    "select tile, row, col, round(sqrt(greatest(v, 0)), 5) as rough from m",
    trend=_window_sql("filled", "avg(s.z)", 6, "replicate"),
    u="select f.tile, f.row, f.col, f.z - t.v as z from filled f join trend t using (tile, row, col)",
    m=_window_sql("u", "avg(s.z*s.z) - avg(s.z)*avg(s.z)", 3, "replicate")))
def roughness_detrended(spark, sf):
    return _round(G.roughness(_filled(spark, sf), _meta(spark, sf), 3, 6), 5, "rough")


@check("micro_relief_2m", I.filled_oracle(
    "select m.tile, m.row, m.col, round(least(greatest(f.z - m.v, -20), 20)/20, 6) + 0.0 as relief from m join filled f using (tile, row, col)",
    m=_window_sql("filled", _upper(3), 3, "reflect")))
def micro_relief_2m(spark, sf):
    return _round(G.micro_relief(_filled(spark, sf), _meta(spark, sf), 3, 20.0), 6, "relief")


@check("centre", I.dense_oracle("""
select d.tile, d.row, d.col, round(coalesce(d.z - a.m, 0), 6) + 0.0 as z, d.z is not null as valid
from dense d join (select tile, avg(z) as m from fx_cells group by tile) a using (tile)"""))
def centre(spark, sf):
    d = G.densify(_cells(spark, sf).select("tile", "row", "col", "z"), _meta(spark, sf))
    return G.centre(d).select("tile", "row", "col", (F.round("z", 6) + 0.0).alias("z"), "valid")


TERRAIN_SQL = {
    "m3": _window_sql("filled", _upper(3), 3, "reflect"),
    "m10": _window_sql("filled", _upper(10), 10, "reflect"),
    "g": GRAD_SQL.format(src="filled"),
    "rr": _window_sql("filled", "avg(s.z*s.z) - avg(s.z)*avg(s.z)", 3, "reflect"),
    "terrain": """
select f.tile, f.row, f.col,
  round(least(greatest(f.z - m3.v, -0.5), 0.5)/0.5, 5) + 0.0 as mrm_2m,
  round(least(greatest(f.z - m10.v, -1.0), 1.0)/1.0, 5) + 0.0 as mrm_10m,
  round(least(greatest(degrees(atan(sqrt(gx*gx+gy*gy)))/60.0, 0), 1), 5) as slope,
  round(least(greatest(sqrt(greatest(rr.v, 0))/0.5, 0), 1), 4) as roughness
from filled f join m3 using (tile, row, col) join m10 using (tile, row, col)
join g using (tile, row, col) join rr using (tile, row, col)""",
}


@check("terrain_bands", I.filled_oracle("select * from terrain", **TERRAIN_SQL))
def terrain_bands(spark, sf):
    t = FT.terrain_bands(_filled(spark, sf), _meta(spark, sf), 1.0)
    return t.select("tile", "row", "col", (F.round("mrm_2m", 5) + 0.0).alias("mrm_2m"),
                    (F.round("mrm_10m", 5) + 0.0).alias("mrm_10m"), F.round("slope", 5).alias("slope"),
                    F.round("roughness", 4).alias("roughness"))


TERRAIN_CENTRED_SQL = {
    "zc": "select f.tile, f.row, f.col, f.z - a.m as z from filled f join (select tile, avg(z) as m from filled group by tile) a using (tile)",
    "m3": _window_sql("zc", _upper(3), 3, "replicate"),
    "m10": _window_sql("zc", _upper(10), 10, "replicate"),
    "g": GRAD_SQL.format(src="zc"),
    "trend": _window_sql("zc", "avg(s.z)", 6, "replicate"),
    "u": "select f.tile, f.row, f.col, f.z - t.v as z from zc f join trend t using (tile, row, col)",
    "rr": _window_sql("u", "avg(s.z*s.z) - avg(s.z)*avg(s.z)", 3, "replicate"),
}


@check("model_bands", I.filled_oracle("""
select f.tile, f.row, f.col,
  round(least(greatest(f.z - m3.v, -0.75), 0.75)/0.75, 5) + 0.0 as mrm_2m,
  round(least(greatest(degrees(atan(sqrt(hx*hx+hy*hy)))/60.0, 0), 1), 5) as slope,
  round(least(greatest(sqrt(greatest(rr.v, 0))/1.0, 0), 1), 4) as roughness,
  round(least(greatest(f.z - m10.v, -1.0), 1.0)/1.0, 5) + 0.0 as mrm_10m
from zc f join m3 using (tile, row, col) join m10 using (tile, row, col)
join g using (tile, row, col) join rr using (tile, row, col)""", **TERRAIN_CENTRED_SQL))
def model_bands(spark, sf):
    """The scorer's own derivation: centred, replicate borders, scaled clips."""
    z = G.centre(_filled(spark, sf).select("tile", "row", "col", "z"))
    t = FT.model_bands(z, _meta(spark, sf), 1.0)
    return t.select("tile", "row", "col", (F.round("mrm_2m", 5) + 0.0).alias("mrm_2m"), F.round("slope", 5).alias("slope"),
                    F.round("roughness", 4).alias("roughness"), (F.round("mrm_10m", 5) + 0.0).alias("mrm_10m"))


CANOPY_SQL = ("select tile, row, col, round(least(greatest(n*3/40.0, 0), 1), 6) as chm, "
              "round(case when y = 0 then 0 else least(greatest(n/10.0/y, 0), 1) end, 6) as vdi from fx_cells")


@check("canopy_bands", I.oracle(CANOPY_SQL, "fx_cells"))
def canopy_bands(spark, sf):
    c = _cells(spark, sf).select("tile", "row", "col", (F.col("n") * 3.0).alias("chm"),
                                 (F.col("n") / 10.0).alias("low"), F.col("y").cast("double").alias("high"))
    return _round(FT.canopy_bands(c), 6, "chm", "vdi")


@check("feature_stack", I.filled_oracle("""
select t.tile, t.row, t.col,
  case when d.z is null then 0 else t.mrm_2m end as mrm_2m, case when d.z is null then 0 else t.mrm_10m end as mrm_10m,
  case when d.z is null then 0 else t.slope end as slope, case when d.z is null then 0 else t.roughness end as roughness,
  case when d.z is null then 0 else c.chm end as chm, case when d.z is null then 0 else c.vdi end as vdi
from terrain t join dense d using (tile, row, col) left join canopy c using (tile, row, col)""",
    canopy=CANOPY_SQL, **TERRAIN_SQL))
def feature_stack(spark, sf):
    c = _cells(spark, sf).select("tile", "row", "col", (F.col("n") * 3.0).alias("chm"),
                                 (F.col("n") / 10.0).alias("low"), F.col("y").cast("double").alias("high"))
    f = FT.feature_stack(_filled(spark, sf), c, _meta(spark, sf), 1.0)
    return f.select("tile", "row", "col", *[(F.round(b, 4 if b == "roughness" else 6 if b in ("chm", "vdi") else 5) + 0.0).alias(b)
                                            for b in ("mrm_2m", "mrm_10m", "slope", "roughness", "chm", "vdi")])


@check("block_reduce", I.dense_oracle("""
select tile, floor(row/3)::bigint as row, floor(col/3)::bigint as col,
  case when count(z) = 9 then round(avg(z), 6) end as z_mean, round(avg(z), 6) as z_nanmean,
  max(y) as y_max, coalesce(min(case when code > 0 then code end), 0) as code_min
from dense where row < 15 and col < 159 group by 1, 2, 3"""))
def block_reduce(spark, sf):
    d = G.densify(_cells(spark, sf), _meta(spark, sf))
    r = G.block_reduce(d, _meta(spark, sf), 3, {
        "z_mean": ("z", "mean"), "z_nanmean": ("z", "nanmean"), "y_max": ("y", "max"), "code_min": ("code", "min_nonzero")})
    return r.withColumns({"z_mean": F.round("z_mean", 6), "z_nanmean": F.round("z_nanmean", 6)})


@check("shift", I.dense_oracle("""
select a.tile, a.row, a.col, coalesce(b.y, 0) as y, coalesce(b.code, 0) as code
from dense a left join dense b on b.tile=a.tile and b.row = a.row - 2 and b.col = a.col + 1"""))
def shift(spark, sf):
    return G.shift(_cells(spark, sf), _meta(spark, sf), 2, -1, ["y", "code"])


@check("d4_quarter_turn_flipped", I.oracle(
    "select tile, col as row, row as col, z from fx_cells", "fx_cells"))
def d4_quarter_turn_flipped(spark, sf):
    """Mirror then one quarter turn counter-clockwise equals a transpose."""
    return G.d4(_cells(spark, sf).select("tile", "row", "col", "z"), 1, True, F.lit(16), F.lit(160))


@check("d4_round_trip", I.oracle("""
select t.k, t.flip, tile, row, col, z from fx_cells, (select unnest(range(4)) as k) t1(k),
 (select k.k as k, f.f = 1 as flip from range(4) k(k), range(2) f(f)) t where t1.k = t.k""", "fx_cells"))
def d4_round_trip(spark, sf):
    cells = _cells(spark, sf).select("tile", "row", "col", "z")
    out = None
    for k in range(4):
        for flip in (False, True):
            there = G.d4(cells, k, flip, F.lit(16), F.lit(160))
            back = G.d4_inverse(there, k, flip, F.lit(16), F.lit(160)).select(
                F.lit(k).cast("bigint").alias("k"), F.lit(flip).alias("flip"), "tile", "row", "col", "z")
            out = back if out is None else out.unionByName(back)
    return out


@check("reflect_pad", I.oracle("""
select c.tile, r.r as row, k.k as col, c.z from range(19) r(r), range(167) k(k), fx_cells c
where c.row = case when r.r >= 16 then 30 - r.r else r.r end and c.col = case when k.k >= 160 then 318 - k.k else k.k end""",
                              "fx_cells"))
def reflect_pad(spark, sf):
    return G.reflect_pad(_cells(spark, sf).select("tile", "row", "col", "z"), _meta(spark, sf), 3, 7)


@check("common_extent", I.oracle("""
select 'fine' as side, tile, count(*) as n from fx_cells where row < 14 and col < 156 group by tile
union all select 'body', tile, count(*) from fx_cells where row < 7 and col < 78 group by tile""", "fx_cells"))
def common_extent(spark, sf):
    """A half-resolution raster one body row and two columns short of the fine one."""
    meta = _meta(spark, sf)
    body_meta = meta.select("tile", F.lit(7).cast("bigint").alias("height"), F.lit(78).cast("bigint").alias("width"))
    fine, body = G.common_extent(_cells(spark, sf), _cells(spark, sf), meta, body_meta, 2, 1)
    return (fine.groupBy(F.lit("fine").alias("side"), "tile").agg(F.count("*").alias("n"))
            .unionByName(body.groupBy(F.lit("body").alias("side"), "tile").agg(F.count("*").alias("n"))))


def conv_sql(src: str = "dense") -> str:
    k = K.STUB_KERNEL
    terms = " + ".join(f"case when o.a = {i - 1} and o.b = {j - 1} then {k[i][j]}::double * coalesce(s.z, 0)/50 else 0 end"
                       for i in range(3) for j in range(3))
    return (f"select d.tile, d.row, d.col, sum({terms}) + ({K.STUB_BIAS})::double as v from {src} d, "
            f"(select a.a, b.b from range(-1,2) a(a), range(-1,2) b(b)) o join {src} s "
            f"on s.tile=d.tile and s.row=d.row+o.a and s.col=d.col+o.b group by 1,2,3")


@check("conv3x3", I.dense_oracle("select tile, row, col, round(1/(1+exp(-v)), 6) as prob from m", m=conv_sql()))
def conv3x3(spark, sf):
    c = _cells(spark, sf).select("tile", "row", "col", (F.col("z") / 50).alias("z"))
    d = G.conv3x3(c, _meta(spark, sf), K.STUB_KERNEL, K.STUB_BIAS)
    return _round(d.withColumn("prob", G.sigmoid(F.col("logit"))), 6, "prob")


@check("conv3x3_stride2", I.dense_oracle(
    "select tile, (row/2)::bigint as row, (col/2)::bigint as col, round(v, 6) as logit from m where row % 2 = 0 and col % 2 = 0", m=conv_sql()))
def conv3x3_stride2(spark, sf):
    c = _cells(spark, sf).select("tile", "row", "col", (F.col("z") / 50).alias("z"))
    return _round(G.conv3x3(c, _meta(spark, sf), K.STUB_KERNEL, K.STUB_BIAS, stride=2), 6, "logit")


SHADE_SQL = {
    "g": GRAD_SQL.format(src="filled"),
    "lit": """
select tile, row, col, (-ex*cos(radians(-225))*cos(radians(38)) - ny*sin(radians(-225))*cos(radians(38)) + sin(radians(38)))/sqrt(ex*ex+ny*ny+1) as s0,
  (-ex*cos(radians(45))*cos(radians(38)) - ny*sin(radians(45))*cos(radians(38)) + sin(radians(38)))/sqrt(ex*ex+ny*ny+1) as s1
from (select *, gx*2.4::double as ex, -gy*2.4::double as ny from g)""",
    "shaded": """
select l.tile, row, col, round(((s0-a0)/(b0-a0) + (s1-a1)/(b1-a1))/2, 6) as shade from lit l
join (select tile, min(s0) a0, max(s0) b0, min(s1) a1, max(s1) b1 from lit group by tile) e on e.tile = l.tile""",
}


@check("hillshade", I.filled_oracle("select * from shaded", **SHADE_SQL))
def hillshade(spark, sf):
    return G.hillshade(_filled(spark, sf), _meta(spark, sf), 1.0).select("tile", "row", "col", F.round("shade", 6).alias("shade"))


@check("bilinear_sample", I.filled_oracle("""
select pid, s.tile, round(sum(wt*f.z), 6) as sampled from (
  select pid, tile, rf, cf, least(floor(rf) + a.a, 15) as rr, least(floor(cf) + b.b, 159) as cc,
    (case when a.a=1 then rf-floor(rf) else 1-(rf-floor(rf)) end)*(case when b.b=1 then cf-floor(cf) else 1-(cf-floor(cf)) end) as wt
  from (select o_orderkey as pid, cast(t.tile as bigint) as tile,
          least(greatest((o_orderkey % 190)/1E1 - 1, 0), 15) as rf, least(greatest((o_custkey % 1640)/1E1 - 1, 0), 159) as cf
        from orders join fx_meta t on t.tile = o_custkey % (select count(*) from fx_meta)), range(2) a(a), range(2) b(b)) s
join filled f on f.tile = s.tile and f.row = s.rr and f.col = s.cc group by pid, s.tile"""))
def bilinear_sample(spark, sf):
    pts = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pid"), (F.col("o_custkey") % _meta(spark, sf).count()).cast("bigint").alias("tile"),
        ((F.col("o_orderkey") % 190) / 10.0 - 1).alias("row_f"), ((F.col("o_custkey") % 1640) / 10.0 - 1).alias("col_f"))
    got = G.bilinear_sample(_filled(spark, sf), _meta(spark, sf), pts)
    return got.select("pid", "tile", F.round("sampled", 6).alias("sampled"))


@check("raster_summary", I.dense_oracle("""
select d.tile, max(row)+1 as height, max(col)+1 as width, round(avg(case when z is null then 0 else 1 end), 6) as valid_frac,
  min(z) as elev_min, max(z) as elev_max, round(quantile_cont(z, 0.98) - quantile_cont(z, 0.02), 6) as relief from dense d group by d.tile"""))
def raster_summary(spark, sf):
    d = G.densify(_cells(spark, sf).select("tile", "row", "col", "z"), _meta(spark, sf))
    return FT.raster_summary(d).withColumns({"valid_frac": F.round("valid_frac", 6), "relief": F.round("relief", 6)})


@check("water_mask", I.filled_oracle("""
select d.tile, d.row, d.col, d.y as target, case when d.z is not null and sqrt(greatest(m.v, 0)) < 25 then 1 else coalesce(1 - d.w, 0) end as ignore_,
  case when (d.z is not null and sqrt(greatest(m.v, 0)) < 25) or coalesce(1 - d.w, 0) > 0 then 0 else 1 end::double as weight
from dense d join m using (tile, row, col)""",
    zero="select tile, row, col, coalesce(z, 0) as z from dense",
    m=_window_sql("zero", "avg(s.z*s.z) - avg(s.z)*avg(s.z)", 15, "reflect")))
def water_mask(spark, sf):
    """Flat surfaces become ignore; target and class are left alone."""
    d = G.densify(_cells(spark, sf), _meta(spark, sf))
    lab = d.select("tile", "row", "col", F.col("y").alias("target"), F.coalesce(1 - F.col("w"), F.lit(0)).alias("ignore_"),
                   F.lit(1.0).alias("weight"))
    lab = lab.withColumn("weight", F.when(F.col("ignore_") > 0, 0.0).otherwise(F.col("weight")))
    out = FT.water_mask(d.select("tile", "row", "col", "z"), lab, _meta(spark, sf), 15, 25.0, ignore="ignore_")
    return out.select("tile", "row", "col", "target", F.col("ignore_").cast("bigint").alias("ignore_"), "weight")


@check("water_mask_fraction", I.filled_oracle("""
select d.tile, round(avg(case when d.z is not null and sqrt(greatest(m.v, 0)) < 25 then 1.0 else 0.0 end), 6) as flat_frac
from dense d join m using (tile, row, col) group by d.tile""",
    zero="select tile, row, col, coalesce(z, 0) as z from dense",
    m=_window_sql("zero", "avg(s.z*s.z) - avg(s.z)*avg(s.z)", 15, "reflect")))
def water_mask_fraction(spark, sf):
    d = G.densify(_cells(spark, sf).select("tile", "row", "col", "z"), _meta(spark, sf))
    return FT.flat_fraction(FT.flat_cells(d, _meta(spark, sf), 15, 25.0)).withColumn("flat_frac", F.round("flat_frac", 6))


@check("sanitize_nodata", """
select event_id, case when v < -1E5 then null else v end as kept, case when v < -1E5 or v = 0 then null else v end as kept_nonzero
from (select event_id, case event_type when 'view' then -2E5::double when 'click' then 0::double when 'signup' then -86::double else value end as v from events)""")
def sanitize_nodata(spark, sf):
    e = I.table(spark, sf, "events")
    v = (F.when(F.col("event_type") == "view", -2e5).when(F.col("event_type") == "click", 0.0)
         .when(F.col("event_type") == "signup", -86.0).otherwise(F.col("value")))
    d = e.select("event_id", v.alias("v"))
    return d.select("event_id", R.sanitize_nodata(F.col("v")).alias("kept"),
                    R.sanitize_nodata(F.col("v"), True).alias("kept_nonzero"))


@check("cell_ground_round_trip", I.oracle("""
select tile, row, col, 1000 + col*0.5::double as x, 5000 - row*0.5::double as y, row as row2, col as col2,
  cast(floor((5000 - (5000.3 - row*0.7))/0.5) as bigint) as off_row from fx_cells""", "fx_cells"))
def cell_ground_round_trip(spark, sf):
    x0, y1, res = F.lit(1000.0), F.lit(5000.0), F.lit(0.5)
    d = _cells(spark, sf).select("tile", "row", "col", R.cell_to_ground(F.col("row"), F.col("col"), x0, y1, res).alias("g"))
    back = R.ground_to_cell(F.col("g.x") + 0.25, F.col("g.y") - 0.25, x0, y1, res)
    off = R.ground_to_cell(F.lit(0.0), F.lit(5000.3) - F.col("row") * 0.7, x0, y1, res)
    return d.select("tile", "row", "col", "g.x", "g.y", back["row"].alias("row2"), back["col"].alias("col2"), off["row"].alias("off_row"))


@check("band_join", I.oracle("select tile, row, col, a.z, b.y, b.code from fx_cells a join fx_cells b using (tile, row, col)", "fx_cells"))
def band_join(spark, sf):
    c = _cells(spark, sf)
    return FT.band_join(c.select("tile", "row", "col", "z"), c.select("tile", "row", "col", "y"), c.select("tile", "row", "col", "code"))


@check("blocks_round_trip", I.oracle("select tile, row, col, z, cast(y as double) as y from fx_cells", "fx_cells"))
def blocks_round_trip(spark, sf):
    from ridgeline.sources.rasters import blocks_to_cells, cells_to_blocks

    blocks = cells_to_blocks(_cells(spark, sf), ["z", "y"], 64)
    return blocks_to_cells(blocks, ["z", "y"], 64)


@check("cells_to_blocks", I.oracle("""
select tile, 'z' as band, floor(row/64)::bigint as brow, floor(col/64)::bigint as bcol, count(*) as n, round(sum(z), 3) as total
from fx_cells group by 1, 2, 3, 4""", "fx_cells"))
def cells_to_blocks(spark, sf):
    from ridgeline.sources.rasters import cells_to_blocks

    b = cells_to_blocks(_cells(spark, sf), ["z"], 64)
    kept = F.filter("data", lambda v: v.isNotNull())
    return b.select("tile", "band", "brow", "bcol", F.size(kept).cast("bigint").alias("n"),
                    F.round(F.aggregate(kept, F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


SKEL_BASE = "select tile, row, col, coalesce(prob_pct, 0)/1E2 as z from dense"


def skeleton_sql(iters: int, src: str, prefix: str = "") -> dict[str, str]:
    """CTE chain for the soft skeleton: explicit 3-neighbour minima and maxima."""
    def cross_min(s: str) -> str:
        return (f"select d.tile, d.row, d.col, min(s.z) as z from {s} d join {s} s on s.tile=d.tile and "
                f"((s.row = d.row and abs(s.col-d.col) <= 1) or (s.col = d.col and abs(s.row-d.row) <= 1)) group by 1,2,3")

    def square_max(s: str) -> str:
        return (f"select d.tile, d.row, d.col, max(s.z) as z from {s} d, range(-1,2) a(a), range(-1,2) b(b) join {s} s on s.tile=d.tile "
                f"and s.row = d.row + a.a and s.col = d.col + b.b group by 1,2,3")
    p = prefix
    out = {f"{p}e0": cross_min(src), f"{p}o0": square_max(f"{p}e0"),
           f"{p}sk0": f"select x.tile, x.row, x.col, greatest(x.z - o.z, 0) as z from {src} x join {p}o0 o using (tile, row, col)"}
    cur = f"{p}e0"
    for i in range(1, iters + 1):
        out[f"{p}e{i}"] = cross_min(cur)
        out[f"{p}o{i}"] = square_max(f"{p}e{i}")
        out[f"{p}sk{i}"] = (f"select x.tile, x.row, x.col, s.z + greatest(greatest(x.z - o.z, 0) - s.z*greatest(x.z - o.z, 0), 0) as z "
                            f"from {cur} x join {p}o{i} o using (tile, row, col) join {p}sk{i - 1} s using (tile, row, col)")
        cur = f"{p}e{i}"
    return out


@check("soft_skeleton_2", I.dense_oracle("select tile, row, col, round(z, 6) as skel from sk2", base=SKEL_BASE, **skeleton_sql(2, "base")))
def soft_skeleton_2(spark, sf):
    from ridgeline.operators.skeleton import soft_skeleton

    c = _cells(spark, sf).select("tile", "row", "col", (F.col("prob_pct") / 100.0).alias("p"))
    return _round(soft_skeleton(c, _meta(spark, sf), {"skel": "p"}, 2), 6, "skel")


@check("soft_skeleton_8", I.dense_oracle("select tile, row, col, round(z, 6) as skel from sk8", base=SKEL_BASE, **skeleton_sql(8, "base")))
def soft_skeleton_8(spark, sf):
    from ridgeline.operators.skeleton import soft_skeleton

    c = _cells(spark, sf).select("tile", "row", "col", (F.col("prob_pct") / 100.0).alias("p"))
    return _round(soft_skeleton(c, _meta(spark, sf), {"skel": "p"}, 8), 6, "skel")


@check("erode_cross", I.dense_oracle("select tile, row, col, z as eroded from e0", base=SKEL_BASE, e0=skeleton_sql(0, "base")["e0"]))
def erode_cross(spark, sf):
    from ridgeline.operators.skeleton import erode_cross as op

    d = G.densify(_cells(spark, sf).select("tile", "row", "col", "prob_pct"), _meta(spark, sf))
    d = d.select("tile", "row", "col", (F.coalesce("prob_pct", F.lit(0)) / 100.0).alias("p"))
    return op(d, _meta(spark, sf), "p", "eroded")


def _u_sql(*parts: str) -> str:
    text = " || '|' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"(('0x' || substr(md5({text}), 1, 13))::ubigint::double / 4503599627370496.0)"


def _normal_sql(*parts: str) -> str:
    seed, *key = parts
    return f"(sqrt(ln(1.0 - {_u_sql(seed, chr(39) + 'a' + chr(39), *key)}) * -2.0) * cos({_u_sql(seed, chr(39) + 'b' + chr(39), *key)} * 6.283185307179586))"


BAND_SQL = " + ".join(
    f"{_normal_sql('7', 'tile', f'r0 + {i}', f'c0 + {j}')} * {'(1 - fr)' if i == 0 else 'fr'} * {'(1 - fc)' if j == 0 else 'fc'}" for i in (0, 1) for j in (0, 1))


@check("band_noise", I.filled_oracle(f"""
select tile, row, col, round(z + up * (0.05::double / greatest(sd, 1e-9)), 6) as z from (
  select *, stddev_pop(up) over (partition by tile) as sd from (
    select tile, row, col, z, {BAND_SQL} as up from (
      select *, row/6.0::double - r0 as fr, col/6.0::double - c0 as fc from (
        select *, cast(floor(row/6.0::double) as bigint) as r0, cast(floor(col/6.0::double) as bigint) as c0 from filled))))"""))
def band_noise(spark, sf):
    from ridgeline.operators.sampling import add_band_noise

    d = add_band_noise(_filled(spark, sf).select("tile", "row", "col", "z"), _meta(spark, sf), 0.05, 6.0, seed=7)
    return d.select("tile", "row", "col", F.round("z", 6).alias("z"))


@check("white_noise", I.filled_oracle(f"""
select tile, row, col, round(z + {_normal_sql('7', 'tile', 'row', 'col')} * 0.05::double, 6) as z from filled"""))
def white_noise(spark, sf):
    from ridgeline.operators.sampling import add_noise

    d = add_noise(_filled(spark, sf).select("tile", "row", "col", "z"), 0.05, seed=7)
    return d.select("tile", "row", "col", F.round("z", 6).alias("z"))
