"""Checks for the area registry, builds, vetting and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.points import E_SQL, HAR_LAT_SQL, HAR_LON_SQL, N_SQL
from checks.registry import check
from checks.scoring import CORPUS_SQL, scored
from checks.vector import ranked_oracle
from ridgeline import constants as K
from ridgeline.functions import geodesy as GD
from ridgeline.functions import rasters as R
from ridgeline.operators import polygons as PG
from ridgeline.operators import registry as RG


def _aois(spark, sf):
    return I.view(spark, sf, "fx_aois")


def _harvested(spark, sf):
    """Machine-picked areas, one per customer; the low keys are curated too."""
    return I.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("bigint").alias("key"), F.col("c_name").alias("name"),
        (F.lit(36.0) + (F.col("c_custkey") % 200) / 100.0).alias("lat"), (F.lit(-119.0) + (F.col("c_custkey") % 150) / 100.0).alias("lon"),
        F.lit("harvest").alias("role"), F.lit(1000).cast("bigint").alias("size_m"))


HARVESTED_SQL = """
select c_custkey as key, c_name as name, 36 + (c_custkey % 200)/1E2 as lat, -119 + (c_custkey % 150)/1E2 as lon, 'harvest' as role,
  cast(1000 as bigint) as size_m from customer"""


@check("merge_registry", I.oracle(
    "select * from fx_aois union all select * from harv where key not in (select key from fx_aois)", "fx_aois", harv=HARVESTED_SQL))
def merge_registry(spark, sf):
    return RG.merge_registry(_aois(spark, sf), _harvested(spark, sf))


#: manifests: every third customer was never built, every eleventh failed
MANIFEST_SQL = """
select c_custkey as key, c_custkey % 3 <> 0 as built, case when c_custkey % 11 = 0 then 'only 7 ground points' end as error,
  case when c_custkey % 13 <> 0 then (c_custkey % 60)/1E1 end as ground_density, case when c_custkey % 17 <> 0 then (c_custkey % 100)/1E2 end as valid_frac,
  case when c_custkey % 7 <> 0 then (c_custkey % 90)/1E2 end as trail_km, (c_custkey % 37)/1E2 as active_km, (c_custkey % 41)/1E2 as faint_km,
  (c_custkey % 43)/1E2 as lifecycle_km, case when c_custkey % 5 <> 0 then 0.5::double + (c_custkey % 47)/1E2 end as slope_corr from customer"""


def _manifests(spark, sf):
    k = F.col("c_custkey")
    return I.table(spark, sf, "customer").select(
        k.cast("bigint").alias("key"), (k % 3 != 0).alias("built"), F.when(k % 11 == 0, "only 7 ground points").alias("error"),
        F.when(k % 13 != 0, (k % 60) / 10.0).alias("ground_density"), F.when(k % 17 != 0, (k % 100) / 100.0).alias("valid_frac"),
        F.when(k % 7 != 0, (k % 90) / 100.0).alias("trail_km"), ((k % 37) / 100.0).alias("active_km"), ((k % 41) / 100.0).alias("faint_km"),
        ((k % 43) / 100.0).alias("lifecycle_km"), F.when(k % 5 != 0, F.lit(0.5) + (k % 47) / 100.0).alias("slope_corr"))


@check("pending_tiles", f"select key from ({HARVESTED_SQL}) where key not in (select key from ({MANIFEST_SQL}) where built)")
def pending_tiles(spark, sf):
    return RG.pending_tiles(_harvested(spark, sf), _manifests(spark, sf).where("built")).select("key")


@check("built_tiles", f"select key from ({HARVESTED_SQL}) where key in (select key from ({MANIFEST_SQL}) where built and error is null)")
def built_tiles(spark, sf):
    return RG.built_tiles(_harvested(spark, sf), _manifests(spark, sf).where("built"), ["harvest", "train"]).select("key")


VET_SQL = f"""
select *, len(reasons) = 0 as accepted from (select key, case when not built then ['not built'] when error is not null then ['build error: ' || error]
 else list_filter([case when ground_density < 2 then 'ground density ' || printf('%.1f', ground_density) || '/m2 < 2.0' end,
   case when valid_frac < 0.85 then 'valid fraction ' || printf('%.2f', valid_frac) || ' < 0.85' end,
   case when coalesce(trail_km, 0) < 0.3 then 'only ' || printf('%.2f', coalesce(trail_km, 0)) || ' km of trail in tile' end], lambda r: r is not null) end as reasons
 from ({MANIFEST_SQL}))"""


@check("vet", f"select key, array_to_string(reasons, '; ') as reasons, accepted from ({VET_SQL})")
def vet(spark, sf):
    return RG.vet(_manifests(spark, sf)).select("key", F.concat_ws("; ", "reasons").alias("reasons"), "accepted")


@check("apply_vet", f"select key, name from ({HARVESTED_SQL}) where key in (select key from ({VET_SQL}) where accepted)")
def apply_vet(spark, sf):
    return RG.apply_vet(_harvested(spark, sf), RG.vet(_manifests(spark, sf))).select("key", "name")


CENTRE_SQL = """
select distinct case o_orderkey % 2 when 0 then 'dem1' else 'lidar05' end as variant, case when o_custkey % 5 = 0 then 'val' else 'train' end as split,
  case when o_custkey % 5 = 0 and o_orderkey % 2 = 0 then 'active' else case substr(o_orderpriority, 1, 1) when '1' then 'lifecycle' when '2' then 'faint' else 'active' end end as class from orders"""


@check("corpus_check", f"""
select 'rejected tile in training' as problem, cast(key as varchar) as subject from ({HARVESTED_SQL}) where key in (select key from ({VET_SQL}) where not accepted)
union all select 'class has no centres', v || '/' || s || '/' || c from (select unnest(['dem1','lidar05']) as v), (select unnest(['train','val']) as s),
 (select unnest(['active','faint','lifecycle']) as c) where not exists (select 1 from ({CENTRE_SQL}) x where x.variant = v and x.split = s and x.class = c)""")
def corpus_check(spark, sf):
    o = I.table(spark, sf, "orders")
    pr = F.substring("o_orderpriority", 1, 1)
    val = F.col("o_custkey") % 5 == 0
    centres = o.select(
        F.when(F.col("o_orderkey") % 2 == 0, "dem1").otherwise("lidar05").alias("variant"), F.when(val, "val").otherwise("train").alias("split"),
        F.when(val & (F.col("o_orderkey") % 2 == 0), "active").otherwise(
            F.when(pr == "1", "lifecycle").when(pr == "2", "faint").otherwise("active")).alias("class"))
    return RG.corpus_check(_harvested(spark, sf), RG.vet(_manifests(spark, sf)), centres, ["dem1", "lidar05"])


@check("training_source", """
select c_custkey as key, v as variant, case when v in ('dem1', 'lidar1') then case when c_custkey % 4 <> 0 then 'published' end else 'own grid' end as source,
  case when v in ('dem1', 'lidar1') and c_custkey % 4 = 0 then 'skipped: no published elevation' end as reason
from customer, (select unnest(['lidar05', 'dem1', 'lidar1']) as v)""")
def training_source(spark, sf):
    tiles = I.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_custkey") % 4 != 0).alias("has_dem"))
    return RG.training_source(tiles, [(v[0], v[1]) for v in K.VARIANTS])


@check("corpus_totals", f"""
select count(*) filter (error is null) as built, count(*) filter (error is not null) as failed, round(sum(active_km) filter (error is null), 4) as active_km,
  round(sum(faint_km) filter (error is null), 4) as faint_km, round(sum(lifecycle_km) filter (error is null), 4) as lifecycle_km,
  round(min(slope_corr), 4) as r_min, round(max(slope_corr), 4) as r_max, round(median(slope_corr), 4) as r_median from ({MANIFEST_SQL})""")
def corpus_totals(spark, sf):
    d = RG.corpus_totals(_manifests(spark, sf))
    return d.withColumns({c: F.round(c, 4) for c in ("active_km", "faint_km", "lifecycle_km", "r_min", "r_max", "r_median")})


@check("select_aois", I.oracle(
    "select pos, a.* from fx_aois a join (select unnest([7, 3, 5, 1]) as key, unnest([0, 1, 2, 3]) as pos) using (key) where role in ('train', 'eval') and role = 'train'", "fx_aois"))
def select_aois(spark, sf):
    return RG.select_aois(_aois(spark, sf), [7, 3, 5, 1], "train")


GAP_SQL = """
select h.key as held, t.key as training, round(greatest(abs(h.x - t.x), abs(h.y - t.y)) - (h.size_m + t.size_m)/2.0, 3) as gap_m
from xy h, xy t where h.role in ('eval', 'control') and t.role in ('train', 'harvest') and greatest(abs(h.x - t.x), abs(h.y - t.y)) - (h.size_m + t.size_m)/2.0 < 600"""


@check("split_clearance", I.oracle(GAP_SQL, "fx_aois", harv=HARVESTED_SQL,
    xy=f"select *, {E_SQL} as x, {N_SQL} as y from (select * from fx_aois union all select * from harv where key not in (select key from fx_aois))"))
def split_clearance(spark, sf):
    """Curated held-out areas against the machine-picked training areas."""
    d = GD.with_utm(RG.merge_registry(_aois(spark, sf), _harvested(spark, sf)), "lon", "lat", F.lit(11))
    return RG.split_clearance(d).withColumn("gap_m", F.round("gap_m", 3))


XY_SQL = f"select *, {E_SQL} as x, {N_SQL} as y from (select * from fx_aois union all select * from harv where key not in (select key from fx_aois))"
MIXED_SQL = f"select * exclude (size_m), size_m + (key % 4) * 1500 as size_m from ({XY_SQL})"


@check("split_clearance_mixed", I.oracle(GAP_SQL, "fx_aois", harv=HARVESTED_SQL, xy=MIXED_SQL))
def split_clearance_mixed(spark, sf):
    """Areas of one to several kilometres."""
    d = GD.with_utm(RG.merge_registry(_aois(spark, sf), _harvested(spark, sf)), "lon", "lat", F.lit(11))
    d = d.withColumn("size_m", F.col("size_m") + (F.col("key") % 4) * 1500)
    return RG.split_clearance(d).withColumn("gap_m", F.round("gap_m", 3))


@check("harvest_key", I.oracle("""
select key, 'h_' || digits_lat || '_s' || digits_lon as hkey from (
 select key, cast((cast(round(abs(lat)*1E5) as bigint) + 5)//10//10000 as varchar) || lpad(cast((cast(round(abs(lat)*1E5) as bigint) + 5)//10 % 10000 as varchar), 4, '0') as digits_lat,
  cast((cast(round(abs(lon)*1E5) as bigint) + 5)//10//10000 as varchar) || lpad(cast((cast(round(abs(lon)*1E5) as bigint) + 5)//10 % 10000 as varchar), 4, '0') as digits_lon
 from (select key, lat + key/1E5 as lat, lon - key*3/1E5 as lon from fx_aois))""", "fx_aois"))
def harvest_key(spark, sf):
    d = _aois(spark, sf).select("key", (F.col("lat") + F.col("key") / 1e5).alias("lat"), (F.col("lon") - F.col("key") * 3 / 1e5).alias("lon"))
    return d.select("key", R.harvest_key(F.col("lat"), F.col("lon")).alias("hkey"))


@check("harvest_note", """
select o_orderkey as k, 'auto-selected: ' || o_custkey || ' m faint, ' || o_custkey*2 || ' m lifecycle, ' || o_custkey % 9 || ' ways, 3DEP ' || o_orderpriority as note from orders""")
def harvest_note(spark, sf):
    o = I.table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("k"), R.harvest_note(
        F.col("o_custkey"), F.col("o_custkey") * 2, F.col("o_custkey") % 9, F.col("o_orderpriority")).alias("note"))


@check("provenance", "select s_suppkey as k, s_name || ' · model m' || s_nationkey || ' · EPSG:32611' as text from supplier")
def provenance(spark, sf):
    s = I.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), R.provenance(
        F.col("s_name"), F.concat(F.lit("m"), F.col("s_nationkey").cast("string")), F.lit("EPSG:32611")).alias("text"))


@check("note_evidence", """
select c_custkey as key, case when c_custkey % 3 <> 0 then c_custkey % 3000 + 1000 end as elevation_m,
  (c_custkey % 500)/1E2 as active_km, case when c_custkey % 2 = 0 then (c_custkey % 300)/1E2 end as faint_km, cast(null as double) as lifecycle_km from customer""")
def note_evidence(spark, sf):
    k = F.col("c_custkey")
    hundredths = lambda n: F.concat(F.floor((k % n) / 100).cast("string"), F.lit("."), F.lpad(((k % n) % 100).cast("string"), 2, "0"))
    notes = F.concat(
        F.when(k % 3 != 0, F.concat((k % 3000 + 1000).cast("string"), F.lit(" m, 8% canopy. "))).otherwise(F.lit("the faint end of the range. ")),
        F.lit("active "), hundredths(500), F.lit(" km, 88 mm tread; "),
        F.when(k % 2 == 0, F.concat(F.lit("faint "), hundredths(300), F.lit(" km."))).otherwise(F.lit("lifecycle none")))
    return RG.note_evidence(I.table(spark, sf, "customer").select(k.alias("key"), notes.alias("notes")))


def _key_sql(v: str) -> str:
    q = f"(cast(round(abs({v})*1E5) as bigint) + 5)//10"
    return f"cast({q}//10000 as varchar) || lpad(cast({q} % 10000 as varchar), 4, '0')"


@check("select_cells_covered", ranked_oracle(f"""
select 'h_' || {_key_sql('lat')} || '_s' || {_key_sql('lon')} as key, lat, lon, 'harvest' as role, 1000 as size_m, total_m,
  'auto-selected: ' || faint_m || ' m faint, ' || lifecycle_m || ' m lifecycle, ' || n_ways || ' ways, 3DEP ' || project as notes
from (select *, round({HAR_LON_SQL}, 5) as lon, round({HAR_LAT_SQL}, 5) as lat from (
  select any_value(z.gx) as gx, any_value(z.gy) as gy, any_value(total_m) as total_m, any_value(faint_m) as faint_m, any_value(lifecycle_m) as lifecycle_m,
    any_value(n_ways) as n_ways, arg_max(c.name, {{c: c.cnt, n: c.name}}) as project, (any_value(z.gx)+0.5::double)*1000 as cx, (any_value(z.gy)+0.5::double)*1000 as cy
  from zoned z join fx_coverage c on (z.gx+0.5::double)*1000 >= (c.x0+119.4::double)*10000 and (z.gx+0.5::double)*1000 < (c.x1+119.4::double)*10000
    and (z.gy+0.5::double)*1000 >= (c.y0-36.2::double)*5000 and (z.gy+0.5::double)*1000 < (c.y1-36.2::double)*5000
  where total_m >= 400 group by z.gx, z.gy)) order by total_m desc, gx, gy limit 20""", views=("fx_coverage",)))
def select_cells_covered(spark, sf):
    """Richest cells that a survey covers, with their registry key and note."""
    from ridgeline.plans.harvest import harvest_registry

    cov = I.view(spark, sf, "fx_coverage")
    # the mapped area is shifted onto the zone's own ground, cell for cell
    polys = cov.select("name", F.col("cnt").alias("count"), F.array(PG.rect_ring(
        (F.col("x0") + 119.4) * 10000, (F.col("y0") - 36.2) * 5000, (F.col("x1") + 119.4) * 10000, (F.col("y1") - 36.2) * 5000)).alias("rings"))
    return harvest_registry(I.ways(spark, sf), I.view(spark, sf, "fx_zones"), polys, limit=20, buffer_m=200.0, ground_coverage=True)


@check("stream_scores", scored(CORPUS_SQL))
def stream_scores(spark, sf):
    from checks.scoring import _cells
    from ridgeline.operators.scoring import near_planes
    from checks.streams import run_scores

    near = near_planes(_cells(spark, sf), I.view(spark, sf, "fx_meta"), 5, ["code"])
    return run_scores(spark, near).withColumn("code", F.col("code").cast("bigint"))


@check("stream_evidence", ranked_oracle("select * from scored"))
def stream_evidence(spark, sf):
    from checks.streams import run_evidence

    return run_evidence(spark, I.ways(spark, sf))
