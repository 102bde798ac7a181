"""Checks for crop sampling, inference windows, blending and preview."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.grid import SHADE_SQL, _upper, _window_sql
from checks.registry import check
from ridgeline import constants as K
from ridgeline.operators import grid as G
from ridgeline.operators import inference as N
from ridgeline.operators import sampling as S

CROP = 8


def _meta(spark, sf):
    return I.view(spark, sf, "fx_meta")


def _labels(spark, sf):
    """Target 1 on about a twentieth of the cells, with its class."""
    c = I.view(spark, sf, "fx_cells")
    return c.select("tile", "row", "col", (F.col("prob_pct") > 80).cast("bigint").alias("target"), F.col("code").alias("class"))


LAB_SQL = "select tile, row, col, case when prob_pct > 80 then 1 else 0 end as target, code as class from fx_cells"

BOUNDARY_SQL = """
select m.tile, m.height, m.width, case when c.cut is null then 128 else least(greatest(c.cut, 88), 136) end::bigint as boundary
from fx_meta m left join (select tile, min(col) as cut from (
  select tile, col, sum(n) over (partition by tile order by col) as cum, sum(n) over (partition by tile) as total
  from (select tile, col, count(*) as n from lab where target > 0 group by 1, 2)) where cum >= total*0.8::double group by tile) c using (tile)"""

BANDS_SQL = """
select tile, height, 'train' as split, 0 as col0, boundary as col1 from bnd union all select tile, height, 'val', boundary, width from bnd"""

CENTRES_SQL = """
select l.tile, l.row, l.col, l.class, b.split from lab l join bands b using (tile)
where target > 0 and row >= 4 and row < height-4 and col >= col0+4 and col < col1-4"""

SBASE = {"lab": LAB_SQL, "bnd": BOUNDARY_SQL, "bands": BANDS_SQL, "centres": CENTRES_SQL}


def sampled(body: str, **extra: str) -> str:
    return I.oracle(body, "fx_cells", "fx_meta", **SBASE, **extra)


def _boundary(spark, sf):
    return S.split_boundary(_labels(spark, sf), _meta(spark, sf), CROP)


def _bands(spark, sf, split):
    return S.split_bands(_boundary(spark, sf), CROP, split)


def _centres(spark, sf, split):
    return S.legal_centres(_labels(spark, sf), _bands(spark, sf, split), CROP)


@check("split_boundary", sampled("select * from bnd"))
def split_boundary(spark, sf):
    return _boundary(spark, sf)


@check("legal_centres", sampled("select * from centres"))
def legal_centres(spark, sf):
    parts = [_centres(spark, sf, s).withColumn("split", F.lit(s)) for s in ("train", "val")]
    return parts[0].unionByName(parts[1])


@check("cap_centres", sampled("""
select tile, row, col, class, split from (select *, row_number() over (partition by split, tile, class order by row, col) as rk,
  count(*) over (partition by split, tile, class) as n from centres) where (rk-1) % case when n > 10 then n//10 + 1 else 1 end = 0"""))
def cap_centres(spark, sf):
    parts = [S.cap_centres(_centres(spark, sf, s), 10).withColumn("split", F.lit(s)) for s in ("train", "val")]
    return parts[0].unionByName(parts[1])


@check("class_mix", sampled("""
select split, class, count(*) as centres, round(1.0::double/count(*) over (partition by split), 6) as share from centres group by split, class"""))
def class_mix(spark, sf):
    parts = [S.class_mix(_centres(spark, sf, s)).withColumn("split", F.lit(s)) for s in ("train", "val")]
    return parts[0].unionByName(parts[1]).withColumn("share", F.round("share", 6))


def _plan(spark, sf):
    """As many crops as there are validation centres."""
    centres = _centres(spark, sf, "val")
    return S.draw_crops(centres, _bands(spark, sf, "val"), centres.count(), CROP, 2)


@check("draw_crops")
def draw_crops(spark, sf):
    """A fixed seed gives this fixed plan of validation crops."""
    return _plan(spark, sf)


def _native(spark, sf):
    d = G.densify(I.view(spark, sf, "fx_cells"), _meta(spark, sf))
    return d.select("tile", "row", "col", "z", F.coalesce("y", F.lit(0)).cast("bigint").alias("target"),
                    F.coalesce("w", F.lit(0)).cast("double").alias("weight"), F.coalesce("code", F.lit(0)).cast("bigint").alias("class"))


@check("extract_crops", I.dense_oracle("""
select c.tile*1000000 + c.row*1000 + c.col as crop_id, (d.row - c.row)//2 as row, (d.col - c.col)//2 as col, round(avg(d.z), 5) as z,
  max(coalesce(d.y, 0)) as y, case when count(d.z) = 4 then avg(coalesce(d.w, 0)) else 0 end::double as w,
  coalesce(min(case when d.code > 0 then d.code end), 0) as class
from fx_cells c join dense d on d.tile = c.tile and d.row >= c.row and d.row < c.row + 8 and d.col >= c.col and d.col < c.col + 8
where c.y = 1 and c.row <= 8 and c.col <= 152 group by 1, 2, 3"""))
def extract_crops(spark, sf):
    """One crop whose corner is each positive cell that leaves room for it."""
    c = I.view(spark, sf, "fx_cells").where((F.col("y") == 1) & (F.col("row") <= 8) & (F.col("col") <= 152))
    plan = c.select((F.col("tile") * 1000000 + F.col("row") * 1000 + F.col("col")).alias("crop_id"), "tile",
                    F.col("row").alias("row0"), F.col("col").alias("col0"))
    return S.body_crops(plan, _native(spark, sf), 8, 2).withColumn("z", F.round("z", 5))


@check("extract_fine_crops", I.dense_oracle("""
select c.tile*1000000 + c.row*1000 + c.col as crop_id, count(*) as cells, count(d.z) as filled, round(sum(d.z), 4) as total,
  max(coalesce(d.y, 0)) as positive
from fx_cells c join dense d on d.tile = c.tile and d.row >= c.row and d.row < c.row + 8 and d.col >= c.col and d.col < c.col + 8
where c.y = 1 and c.row <= 8 and c.col <= 152 group by 1"""))
def extract_fine_crops(spark, sf):
    """Elevation stays at the native grid while labels go to the body grid."""
    c = I.view(spark, sf, "fx_cells").where((F.col("y") == 1) & (F.col("row") <= 8) & (F.col("col") <= 152))
    plan = c.select((F.col("tile") * 1000000 + F.col("row") * 1000 + F.col("col")).alias("crop_id"), "tile",
                    F.col("row").alias("row0"), F.col("col").alias("col0"))
    z, lab = S.extract_crops(plan, _native(spark, sf), 8, 1, 2)
    a = z.groupBy("crop_id").agg(F.count("*").alias("cells"), F.count("z").alias("filled"), F.round(F.sum("z"), 4).alias("total"))
    return a.join(lab.groupBy("crop_id").agg(F.max("y").alias("positive")), "crop_id")


@check("crop_arrays")
def crop_arrays(spark, sf):
    crops = S.body_crops(_plan(spark, sf), _native(spark, sf), CROP, 2)
    d = S.crop_arrays(crops, ["y", "w"])
    return d.select("crop_id", F.size("y").alias("cells"), F.aggregate("y", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("positive"))


@check("augment_crops")
def augment_crops(spark, sf):
    crops = S.body_crops(_plan(spark, sf), _native(spark, sf), CROP, 2, noise_seed=11)
    d = S.augment(crops, CROP // 2, seed=11)
    return d.select("crop_id", "row", "col", F.round("z", 5).alias("z"), "y", "w", "class")


@check("full_tile", I.dense_oracle("""
select tile, row//2 as row, col//2 as col, round(avg(z), 5) as z, max(coalesce(y, 0)) as y,
  case when count(z) = 4 then avg(coalesce(w, 0)) else 0 end::double as w, coalesce(min(case when code > 0 then code end), 0) as class
from dense group by 1, 2, 3"""))
def full_tile(spark, sf):
    z, lab = S.full_tile(_native(spark, sf), _meta(spark, sf), 2, 2)
    return z.join(lab, ["tile", "row", "col"]).withColumn("z", F.round("z", 5))


@check("full_tile_published", I.dense_oracle("""
select l.tile, l.row, l.col, p.zp as z, l.y, case when p.zp is null then 0 else l.w end::double as w, l.class
from (select tile, row//2 as row, col//2 as col, max(coalesce(y, 0)) as y, avg(coalesce(w, 0)) as w, coalesce(min(case when code > 0 then code end), 0) as class from dense group by 1, 2, 3) l
join (select tile, row, col, case when prob_pct is null then null else prob_pct/1E1 end as zp from dense where row < 7 and col < 78) p using (tile, row, col)"""))
def full_tile_published(spark, sf):
    """Elevation from a published raster one row and two columns short."""
    meta = _meta(spark, sf)
    pub = G.densify(I.view(spark, sf, "fx_cells").select("tile", "row", "col", "prob_pct"), meta).where(
        (F.col("row") < 7) & (F.col("col") < 78)).select("tile", "row", "col", (F.col("prob_pct") / 10.0).alias("z"))
    pub_meta = meta.select("tile", F.lit(7).cast("bigint").alias("height"), F.lit(78).cast("bigint").alias("width"))
    z, lab = S.full_tile(_native(spark, sf), meta, 2, 2, (), pub, pub_meta)
    return z.join(lab, ["tile", "row", "col"])


#: a published body raster two columns short, which every third tile lacks
PUBLISHED_SQL = "select tile, row, col, case when prob_pct is not null then prob_pct/1E1 end as z from dense where row < 8 and col < 78 and tile % 3 <> 0"


def _published(spark, sf):
    meta = _meta(spark, sf)
    d = G.densify(I.view(spark, sf, "fx_cells").select("tile", "row", "col", "prob_pct"), meta)
    d = d.where((F.col("row") < 8) & (F.col("col") < 78) & (F.col("tile") % 3 != 0))
    size = meta.where("tile % 3 <> 0").select("tile", F.lit(8).cast("bigint").alias("height"), F.lit(78).cast("bigint").alias("width"))
    return d.select("tile", "row", "col", (F.col("prob_pct") / 10.0).alias("z")), size


def _canopied(spark, sf):
    """Native cells with two canopy bands, 0 where empty."""
    more = I.view(spark, sf, "fx_cells").select("tile", "row", "col", F.col("n").cast("double").alias("low"), F.col("code").cast("double").alias("high"))
    return _native(spark, sf).join(more, ["tile", "row", "col"], "left").na.fill(0.0, ["low", "high"])


BODY_SQL = """
select d.tile, d.row//2 as row, d.col//2 as col, max(coalesce(d.y, 0)) as y, avg(coalesce(d.w, 0)) as w, count(d.z) as nz, avg(d.z) as own,
  coalesce(min(case when d.code > 0 then d.code end), 0) as class, avg(coalesce(k.n, 0)) as low, avg(coalesce(d.code, 0)) as high
from dense d left join fx_cells k on k.tile = d.tile and k.row = d.row and k.col = d.col group by 1, 2, 3"""


@check("extract_crops_published", I.dense_oracle("""
select c.tile*1000000 + c.row*1000 + c.col as crop_id, b.row - c.row//2 as row, b.col - c.col//2 as col, p.z, round(b.low, 5) as low, round(b.high, 5) as high,
  b.y, case when p.z is null then 0 else b.w end::double as w, b.class
from fx_cells c join bodies b on b.tile = c.tile and b.row >= c.row//2 and b.row < c.row//2 + 4 and b.col >= c.col//2 and b.col < c.col//2 + 4
left join pub p on p.tile = b.tile and p.row = b.row and p.col = b.col
where c.y = 1 and c.row <= 8 and c.col <= 152 and c.row % 2 = 0 and c.col % 2 = 0 and c.tile % 3 <> 0""", bodies=BODY_SQL, pub=PUBLISHED_SQL))
def extract_crops_published(spark, sf):
    """Elevation of the published raster beside our own canopy and labels; tiles without it have no crops."""
    c = I.view(spark, sf, "fx_cells").where("y = 1 and row <= 8 and col <= 152 and row % 2 = 0 and col % 2 = 0")
    plan = c.select((F.col("tile") * 1000000 + F.col("row") * 1000 + F.col("col")).alias("crop_id"), "tile", F.col("row").alias("row0"), F.col("col").alias("col0"))
    z, lab = S.extract_crops(plan, _canopied(spark, sf), 8, 2, 2, ("low", "high"), _published(spark, sf)[0])
    return z.join(lab, ["crop_id", "row", "col"]).withColumns({b: F.round(b, 5) for b in ("low", "high")})


@check("full_tile_published_canopy", I.dense_oracle("""
select b.tile, b.row, b.col, p.z, round(b.low, 5) as low, round(b.high, 5) as high, b.y, case when p.z is null then 0 else b.w end::double as w, b.class
from bodies b join pub p on p.tile = b.tile and p.row = b.row and p.col = b.col""", bodies=BODY_SQL, pub=PUBLISHED_SQL))
def full_tile_published_canopy(spark, sf):
    """Elevation, canopy and labels trimmed to the ground that all cover."""
    pub, size = _published(spark, sf)
    z, lab = S.full_tile(_canopied(spark, sf), _meta(spark, sf), 2, 2, ("low", "high"), pub, size)
    return z.join(lab, ["tile", "row", "col"]).withColumns({b: F.round(b, 5) for b in ("low", "high")})


@check("full_tile_fine", I.dense_oracle("""
select * from (select tile, count(*) as cells, count(z) as filled from dense where row < 15 and col < 159 group by tile)
join (select tile, count(*) as body, count(*) filter (n < 9) as holed from (
  select tile, row//3, col//3, count(z) as n from dense where row < 15 and col < 159 group by 1, 2, 3) group by tile) using (tile)"""))
def full_tile_fine(spark, sf):
    """Three native pixels per body pixel: the fine raster keeps all its ground."""
    z, lab = S.full_tile(_native(spark, sf).withColumn("weight", F.lit(1.0)), _meta(spark, sf), 1, 3)
    a = z.groupBy("tile").agg(F.count("*").alias("cells"), F.count("z").alias("filled"))
    return a.join(lab.groupBy("tile").agg(F.count("*").alias("body"), F.count_if(F.col("w") == 0).alias("holed")), "tile")


# --- inference -------------------------------------------------------------------

@check("windows", I.oracle("""
select distinct m.tile, r.r as row0, c.c as col0 from fx_meta m, (select unnest([0, 4, 6])::bigint as r) r,
 (select unnest(list_distinct(list_concat(range(0, 151, 7), [150])))::bigint as c) c""", "fx_meta"))
def windows(spark, sf):
    """Ten-pixel windows, steps of 4 and 7: the last one is flush with the edge."""
    meta = _meta(spark, sf)
    rows = meta.select("tile", "width", F.explode(N.window_origins(F.col("height"), 10, 4, 2)).alias("row0"))
    return rows.select("tile", "row0", F.explode(N.window_origins(F.col("width"), 10, 7, 2)).alias("col0"))


@check("window_origins_by_height", """
select p, list_aggregate(list_sort(list_distinct(list_concat(range(0, last + 1, 128), [last]))), 'string_agg', ',') as origins
from (select p_partkey as p, greatest(((p_size*40 + 200 - 256)//2)*2, 0) as last from part)""")
def window_origins_by_height(spark, sf):
    """Origins for one raster height per part size."""
    p = I.table(spark, sf, "part")
    n = (F.col("p_size") * 40 + 200).cast("bigint")
    return p.select(F.col("p_partkey").alias("p"), F.concat_ws(",", N.window_origins(n, 256, 128, 2).cast("array<string>")).alias("origins"))


@check("crop_windows", I.oracle("""
select c.tile, w.o as row0, v.o as col0, count(*) as n, round(sum(c.z*(c.row-w.o+1)*(c.col-v.o+2)), 3) as moment
from fx_cells c join (select unnest([0, 4, 6])::bigint as o) w on c.row >= w.o and c.row < w.o + 10
join (select unnest(list_distinct(list_concat(range(0, 151, 4), [150])))::bigint as o) v on c.col >= v.o and c.col < v.o + 10 group by 1, 2, 3""", "fx_cells"))
def crop_windows(spark, sf):
    d = N.crop_windows(I.view(spark, sf, "fx_cells"), _meta(spark, sf), 10, 4, 2, ["z"])
    return d.groupBy("tile", "row0", "col0").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("z") * (F.col("r") + 1) * (F.col("c") + 2)), 3).alias("moment"))


HANN = "greatest((0.5-0.5*cos(2*pi()*(({r})+1)/17))*(0.5-0.5*cos(2*pi()*(({c})+1)/17)), 1e-3)"


WIN16 = "(select unnest(range(0, 145, 8)) as o)"

@check("hann_taper", I.oracle(f"""
select c.tile, v.o as col0, round(sum(c.z*{HANN.format(r='c.row', c='c.col - v.o')}), 4) as tapered
from fx_cells c join {WIN16} v on c.col >= v.o and c.col < v.o + 16 group by 1, 2""", "fx_cells"))
def hann_taper(spark, sf):
    """Elevation under the taper, summed over every window."""
    d = N.crop_windows(I.view(spark, sf, "fx_cells"), _meta(spark, sf), 16, 8, 1, ["z"])
    taper = N.hann_taper(spark, 16).select(F.col("row").alias("r"), F.col("col").alias("c"), "taper")
    return d.join(taper, ["r", "c"]).groupBy("tile", "col0").agg(F.round(F.sum(F.col("z") * F.col("taper")), 4).alias("tapered"))


BLEND_SQL = f"""
select tile, row, col, round(sum(p*t)/greatest(sum(t), 1e-6), 6) as prob from (
 select c.tile, c.row, c.col, (c.prob_pct + v.o % 7)/2E2 as p, {HANN.format(r='c.row', c='c.col - v.o')} as t
 from fx_cells c join {WIN16} v on c.col >= v.o and c.col < v.o + 16) group by 1, 2, 3"""


@check("blend", I.oracle(BLEND_SQL, "fx_cells"))
def blend(spark, sf):
    d = N.crop_windows(I.view(spark, sf, "fx_cells"), _meta(spark, sf), 16, 8, 1, ["prob_pct"])
    d = d.withColumn("prob", (F.col("prob_pct") + F.col("col0") % 7) / 200.0)
    return N.blend(d, 16).withColumn("prob", F.round("prob", 6))


WCONV_SQL = "select d.tile, v.o as o, d.row, d.col, sum({terms}) + ({bias})::double as v from dense d join " + WIN16 + """ v on d.col >= v.o and d.col < v.o + 16,
 (select a.a, b.b from range(-1,2) a(a), range(-1,2) b(b)) o join dense s on s.tile=d.tile and s.row=d.row+o.a and s.col=d.col+o.b and s.col >= v.o and s.col < v.o + 16 group by 1,2,3,4"""
WCONV_SQL = WCONV_SQL.format(bias=K.STUB_BIAS, terms=" + ".join(
    f"case when o.a = {i - 1} and o.b = {j - 1} then {K.STUB_KERNEL[i][j]}::double * coalesce(s.z, 0)/50 else 0 end" for i in range(3) for j in range(3)))


@check("predict", I.dense_oracle(f"""
select tile, row, col, round(sum(t/(1+exp(-v)))/greatest(sum(t), 1e-6), 6) as prob
from (select *, {HANN.format(r='row', c='col - o')} as t from wconv) group by 1, 2, 3""", wconv=WCONV_SQL))
def predict(spark, sf):
    """Sixteen-pixel windows, half overlapping, scored by the stand-in convolution."""
    scorer = N.stub_scorer(K.STUB_KERNEL, K.STUB_BIAS, 1, 1 / 50)
    d = N.predict(I.view(spark, sf, "fx_cells"), _meta(spark, sf), scorer, 16, 8)
    return d.withColumn("prob", F.round("prob", 6))


@check("predict_stride2", I.dense_oracle(f"""
select tile, row//2 as row, col//2 as col, round(sum(t/(1+exp(-v)))/greatest(sum(t), 1e-6), 6) as prob
from (select *, greatest((0.5-0.5*cos(2*pi()*(row//2+1)/9))*(0.5-0.5*cos(2*pi()*((col-o)//2+1)/9)), 1e-3) as t from wconv where row % 2 = 0 and col % 2 = 0) group by 1, 2, 3""",
    wconv=WCONV_SQL))
def predict_stride2(spark, sf):
    scorer = N.stub_scorer(K.STUB_KERNEL, K.STUB_BIAS, 2, 1 / 50)
    d = N.predict(I.view(spark, sf, "fx_cells"), _meta(spark, sf), scorer, 16, 8, stride=2)
    return d.withColumn("prob", F.round("prob", 6))


def _tta_sql(more: str = "0", join: str = "") -> str:
    """Turning the view and turning the answer back is turning the kernel."""
    cols = []
    for flip in (False, True):
        for k in range(4):
            m = [list(r) for r in K.STUB_KERNEL]
            for _ in range(-k % 4):  # quarter turns counter-clockwise
                m = [[m[j][2 - i] for j in range(3)] for i in range(3)]
            if flip:
                m = [r[::-1] for r in m]
            terms = " + ".join(f"case when o.a = {i - 1} and o.b = {j - 1} then {m[i][j]}::double * coalesce(s.z, 0)/50 else 0 end"
                               for i in range(3) for j in range(3))
            cols.append(f"1/(1+exp(-(sum({terms}) + ({K.STUB_BIAS})::double + {more})))")
    return (f"select d.tile, v.o as o, d.row, d.col, ({' + '.join(cols)})/8 as p from dense d join {WIN16} v on d.col >= v.o and d.col < v.o + 16, "
            "(select a.a, b.b from range(-1,2) a(a), range(-1,2) b(b)) o join dense s on s.tile=d.tile and s.row=d.row+o.a and s.col=d.col+o.b "
            "and s.col >= v.o and s.col < v.o + 16" + join + " group by 1,2,3,4")


@check("predict_tta", I.dense_oracle(f"""
select tile, row, col, round(sum(t*p)/greatest(sum(t), 1e-6), 6) as prob
from (select *, {HANN.format(r='row', c='col - o')} as t from wtta) group by 1, 2, 3""", wtta=_tta_sql()))
def predict_tta(spark, sf):
    """The same windows averaged over the eight dihedral views."""
    scorer = N.stub_scorer(K.STUB_KERNEL, K.STUB_BIAS, 1, 1 / 50)
    d = N.predict(I.view(spark, sf, "fx_cells"), _meta(spark, sf), scorer, 16, 8, tta=True)
    return d.withColumn("prob", F.round("prob", 6))


@check("predict_canopy", I.dense_oracle(f"""
select tile, row, col, round(sum(t/(1+exp(-v)))/greatest(sum(t), 1e-6), 6) as prob from (
 select k.tile, k.row, k.col, k.v + 0.125::double*(coalesce(f.n, 0) + coalesce(f.code, 0)) as v, {HANN.format(r='k.row', c='k.col - k.o')} as t
 from wconv k left join fx_cells f on f.tile = k.tile and f.row = k.row and f.col = k.col) group by 1, 2, 3""", wconv=WCONV_SQL))
def predict_canopy(spark, sf):
    """Two canopy bands go to the scorer with the elevation."""
    scorer = N.stub_scorer(K.STUB_KERNEL, K.STUB_BIAS, 1, 1 / 50, 0.125)
    d = N.predict(I.view(spark, sf, "fx_cells"), _meta(spark, sf), scorer, 16, 8, canopy=("n", "code"))
    return d.withColumn("prob", F.round("prob", 6))


@check("predict_canopy_tta", I.dense_oracle(f"""
select tile, row, col, round(sum(t*p)/greatest(sum(t), 1e-6), 6) as prob
from (select *, {HANN.format(r='row', c='col - o')} as t from wtta) group by 1, 2, 3""",
    wtta=_tta_sql("0.125::double*max(coalesce(f.n, 0) + coalesce(f.code, 0))", " left join fx_cells f on f.tile = d.tile and f.row = d.row and f.col = d.col")))
def predict_canopy_tta(spark, sf):
    """The same with all bands turned together."""
    scorer = N.stub_scorer(K.STUB_KERNEL, K.STUB_BIAS, 1, 1 / 50, 0.125)
    d = N.predict(I.view(spark, sf, "fx_cells"), _meta(spark, sf), scorer, 16, 8, tta=True, canopy=("n", "code"))
    return d.withColumn("prob", F.round("prob", 6))


@check("preview_layers", I.filled_oracle("""
select h.tile, h.row, h.col, h.shade, round(least(greatest(least(greatest(f.z - m3.v, -0.5), 0.5)/0.5, -0.6), 0.6), 6) + 0.0 as relief,
  case when d.y > 0 then 0.75 else 0 end::double as positive_alpha, case when coalesce(d.w, 0) = 0 then 0.3 else 0 end::double as ignore_alpha
from shaded h join filled f using (tile, row, col) join m3 using (tile, row, col) join dense d using (tile, row, col)""", **SHADE_SQL,
    m3=_window_sql("filled", _upper(3), 3, "reflect")))
def preview_layers(spark, sf):
    from ridgeline.plans.preview import preview_layers as op

    d = G.densify(I.view(spark, sf, "fx_cells"), _meta(spark, sf))
    filled = G.fill_median(d.select("tile", "row", "col", "z")).select("tile", "row", "col", "z")
    lab = d.select("tile", "row", "col", F.coalesce("y", F.lit(0)).alias("target"), (1 - F.coalesce("w", F.lit(0))).alias("ignore"))
    out = op(filled, lab, _meta(spark, sf), 1.0)
    return out.withColumns({"shade": F.round("shade", 6), "relief": F.round("relief", 6)})
