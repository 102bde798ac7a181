"""Checks for scoring, losses and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import check
from checks.grid import skeleton_sql
from ridgeline import constants as K
from ridgeline.operators import scoring as S


def _cells(spark, sf):
    c = I.view(spark, sf, "fx_cells")
    return c.select("tile", "row", "col", (F.col("prob_pct") / 100.0).alias("prob"), "y", "w", "code",
                    ((F.col("prob_pct") - 50) / 10.0).alias("logit"))


def _meta(spark, sf):
    return I.view(spark, sf, "fx_meta")


#: label dilated unmasked; prediction masked, then dilated; radius 5
NEAR_SQL = """
select d.tile, d.row, d.col, d.prob_pct, d.y, d.w, d.code, max(s.y) as y_near,
       max(case when s.w > 0 then s.prob_pct end) as p_near
from fx_cells d join fx_cells s on s.tile = d.tile and s.row between d.row-5 and d.row+5 and s.col between d.col-5 and d.col+5
where d.w > 0 group by all"""

T7 = "(select unnest([20,30,40,50,60,70,80]) as tp)"

COUNTS_SQL = f"""
select n.tile, t.tp, n.code,
  sum(n.y) as y_sum, sum(case when n.p_near >= t.tp then n.y else 0 end) as tp_r
from near n, {T7} t where n.y > 0 group by 1, 2, 3"""

POOLED_SQL = f"""
select tile, t.tp, sum(case when prob_pct >= t.tp then 1 else 0 end) as pred,
  sum(case when prob_pct >= t.tp then y_near else 0 end) as tp_p, sum(y) as y_all,
  sum(case when p_near >= t.tp then y else 0 end) as tp_all
from near, {T7} t group by 1, 2"""

RESULT_SQL = """
select *, 2*p*r/(p+r+1e-6) as f1 from (
 select tile, tp, code, y_sum, tp_p/(pred+1e-6) as p, tp_r/(y_sum+1e-6) as r from counts join pooled using (tile, tp))"""

BEST_SQL = "select * from (select *, row_number() over (partition by tile, code order by f1 desc, tp) as rk from result) where rk = 1"

AP_SQL = """
select tile, sum(pos*cp/cn)/sum(pos) as ap from (
  select tile, prob_pct, n, pos, sum(n) over (partition by tile order by prob_pct desc) as cn,
         sum(pos) over (partition by tile order by prob_pct desc) as cp
  from (select tile, prob_pct, count(*) as n, sum(y) as pos from fx_cells where w > 0 group by 1, 2))
group by tile having sum(pos) > 0 and sum(pos) < sum(n)"""


def scored(body: str, **extra: str) -> str:
    return I.oracle(body, "fx_cells", "fx_meta", near=NEAR_SQL, counts=COUNTS_SQL, pooled=POOLED_SQL,
                    result=RESULT_SQL, best=BEST_SQL, ap=AP_SQL, **extra)


@check("relaxed_precision_recall", scored(
    "select tile, round(tp_p/(pred+1e-6), 6) as precision, round(tp_all/(y_all+1e-6), 6) as recall from pooled where tp = 50"))
def relaxed_precision_recall(spark, sf):
    d = S.relaxed_pr(_cells(spark, sf), _meta(spark, sf), 0.5, 5)
    return d.select("tile", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@check("threshold_sweep", scored("""
select tile, tp/1E2 as t, round(p, 4) as p, round(r, 4) as r, round(2*p*r/(p+r+1e-6), 4) as f1
from (select *, tp_p/(pred+1e-6) as p, tp_all/(y_all+1e-6) as r from pooled where tp in (30, 50, 70))"""))
def threshold_sweep(spark, sf):
    return S.threshold_sweep(_cells(spark, sf), _meta(spark, sf), 1.0)


@check("stratified_counts", scored("""
select tile, tp/1E2 as t, code, cast(y_sum as bigint) as y_sum, cast(pred as bigint) as pred, cast(tp_p as bigint) as tp_p,
  cast(tp_r as bigint) as tp_r from (select * from counts union all
    select distinct tile, tp, 0, 0, 0 from near, (select unnest([20,30,40,50,60,70,80]) as tp) where y = 0) join pooled using (tile, tp)"""))
def stratified_counts(spark, sf):
    return S.stratified_counts(_cells(spark, sf), _meta(spark, sf), 1.0).withColumn("code", F.col("code").cast("bigint"))


@check("stratified_result", scored("""
select tile, code, round(f1, 4) as f1, round(p, 4) as p, round(r, 4) as r, tp/1E2 as t, cast(y_sum as bigint) as px from best"""))
def stratified_result(spark, sf):
    return S.stratified_result(S.stratified_counts(_cells(spark, sf), _meta(spark, sf), 1.0), ["tile"]).withColumn(
        "code", F.col("code").cast("bigint"))


CORPUS_SQL = """
select code, round(f1, 4) as f1, round(p, 4) as p, round(r, 4) as r, tp/1E2 as t, cast(y_sum as bigint) as px from (
 select *, row_number() over (partition by code order by f1 desc, tp) as rk from (
  select *, 2*p*r/(p+r+1e-6) as f1 from (
   select code, tp, y_sum, tp_p/(pred+1e-6) as p, tp_r/(y_sum+1e-6) as r
   from (select tp, code, sum(y_sum) as y_sum, sum(tp_r) as tp_r from counts group by 1, 2)
   join (select tp, sum(pred) as pred, sum(tp_p) as tp_p from pooled group by tp) using (tp))))
where rk = 1"""


@check("stratified_corpus", scored(CORPUS_SQL))
def stratified_corpus(spark, sf):
    """Counts summed over all tiles before dividing."""
    counts = S.stratified_counts(_cells(spark, sf), _meta(spark, sf), 1.0)
    return S.stratified_result(S.sum_counts(counts, [])).withColumn("code", F.col("code").cast("bigint"))


@check("average_precision", I.oracle("select tile, round(ap, 6) as ap from ap", "fx_cells", ap=AP_SQL))
def average_precision(spark, sf):
    return S.average_precision(_cells(spark, sf)).select("tile", F.round("ap", 6).alias("ap"))


@check("average_precision_corpus", I.oracle("""
select round(sum(pos*cp/cn)/sum(pos), 6) as ap from (
  select prob_pct, n, pos, sum(n) over (order by prob_pct desc) as cn, sum(pos) over (order by prob_pct desc) as cp
  from (select prob_pct, count(*) as n, sum(y) as pos from fx_cells where w > 0 group by 1))""", "fx_cells"))
def average_precision_corpus(spark, sf):
    d = S.average_precision(_cells(spark, sf).withColumn("g", F.lit(0)), ["g"])
    return d.select(F.round("ap", 6).alias("ap"))


@check("false_positive_rate", I.oracle(
    "select tile, round(avg(case when prob_pct >= 50 then 1.0 else 0.0 end), 6) as fp_rate from fx_cells where w > 0 group by tile", "fx_cells"))
def false_positive_rate(spark, sf):
    return S.false_positive_rate(_cells(spark, sf)).withColumn("fp_rate", F.round("fp_rate", 6))


@check("evaluate_tiles", scored("""
select p.tile, s.f1_30, s.f1_50, s.f1_70, b.score, b.classes, round(ap.ap, 4) as ap, f.fp_rate, f.positive_frac
from (select distinct tile from fx_cells) p
left join (select tile, max(case when tp=30 then f end) f1_30, max(case when tp=50 then f end) f1_50, max(case when tp=70 then f end) f1_70
  from (select tile, tp, round(2*p*r/(p+r+1e-6), 4) as f from (select *, tp_p/(pred+1e-6) as p, tp_all/(y_all+1e-6) as r from pooled)) group by tile) s using (tile)
left join (select tile, round(avg(round(f1, 4)), 4) as score, count(*) as classes from best group by tile) b using (tile)
left join ap using (tile)
left join (select tile, round(avg(case when w > 0 then case when prob_pct >= 50 then 1.0 else 0.0 end end), 5) as fp_rate,
   round(avg(case when y > 0 then 1.0 else 0.0 end), 5) as positive_frac from fx_cells group by tile) f using (tile)"""))
def evaluate_tiles(spark, sf):
    return S.evaluate_tiles(_cells(spark, sf), _meta(spark, sf), 1.0)


def _scores(spark, sf):
    """Per-tile class scores, doubled into two variants, with some advisories."""
    res = S.stratified_result(S.stratified_counts(_cells(spark, sf), _meta(spark, sf), 1.0), ["tile"])
    names = F.create_map(*[F.lit(v) for kv in ((c, n) for n, c in K.CLASS_CODE.items()) for v in kv])
    base = res.select("tile", F.element_at(names, F.col("code").cast("int")).alias("class"), "f1",
                      F.when(F.col("tile") % 5 != 2, F.col("px")).alias("px"),
                      F.when(F.col("tile") % 7 == 3, "not evidence").otherwise("").alias("advisory"))
    return base.withColumn("variant", F.explode(F.array(F.lit("dem1"), F.lit("lidar05"))))


SCORES_SQL = """
select tile, case code when 1 then 'active' when 2 then 'faint' else 'lifecycle' end as class, round(f1, 4) as f1,
  case when tile % 5 <> 2 then y_sum end as px, case when tile % 7 = 3 then 'not evidence' else '' end as advisory, v as variant
from best, (select unnest(['dem1','lidar05']) as v)"""


@check("held_out_spread", scored("""
select * from (select variant, class, count(*) filter (not thin) as n, round(median(f1) filter (not thin), 4) as median,
  min(f1) filter (not thin) as min, max(f1) filter (not thin) as max, count(*) filter (thin) as too_thin
  from (select *, coalesce(px, 10) < 10 as thin from scores where advisory = '') group by 1, 2) where n > 0""", scores=SCORES_SQL))
def held_out_spread(spark, sf):
    return S.held_out_spread(_scores(spark, sf), min_px=10)


@check("held_out_tiles", scored(
    "select variant, class, tile, f1, coalesce(px, 10) < 10 as thin from scores where advisory = ''", scores=SCORES_SQL))
def held_out_tiles(spark, sf):
    return S.held_out_tiles(_scores(spark, sf), min_px=10)


@check("run_report", scored("""
select (select max(tile % 2) from scores) as epoch, h.variant, h.class, h.val_f1, s.n, s.median, s.min, s.max, s.too_thin
from (select variant, class, round(avg(f1), 4) as val_f1 from scores where tile % 2 = (select max(tile % 2) from scores) group by 1, 2) h
left join (select * from (select variant, class, count(*) filter (not thin) as n, round(median(f1) filter (not thin), 4) as median,
  min(f1) filter (not thin) as min, max(f1) filter (not thin) as max, count(*) filter (thin) as too_thin
  from (select *, coalesce(px, 10) < 10 as thin from scores where advisory = '') group by 1, 2) where n > 0) s using (variant, class)""",
    scores=SCORES_SQL))
def run_report(spark, sf):
    scores = _scores(spark, sf)
    history = scores.groupBy((F.col("tile") % 2).alias("epoch"), "variant", "class").agg(F.round(F.avg("f1"), 4).alias("f1"))
    return S.run_report(history, S.held_out_spread(scores, min_px=10))


@check("validation_means", """
select o_orderpriority as variant, round(avg(case when o_custkey % 9 <> 0 then o_totalprice/1E5 end), 4) as loss,
  round(avg(o_custkey/1E3), 4) as bce from orders group by 1""")
def validation_means(spark, sf):
    o = I.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("variant"),
        F.when(F.col("o_custkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 1e5).alias("loss"),
        (F.col("o_custkey") / 1e3).alias("bce"))
    return S.validation_means(o, ["variant"], ["loss", "bce"])


VAL_SQL = """
select cast(o_custkey % 40 as bigint) as epoch, substr(o_orderpriority, 1, 1) as variant,
  substr(o_orderpriority, 1, 1) <> '3' or o_custkey % 40 < 10 as canopy, avg(o_totalprice)/5E5 as score from orders group by 1, 2, 3"""


def _val(spark, sf):
    pr = F.substring("o_orderpriority", 1, 1)
    return I.table(spark, sf, "orders").groupBy(
        (F.col("o_custkey") % 40).cast("bigint").alias("epoch"), pr.alias("variant"),
        ((pr != "3") | (F.col("o_custkey") % 40 < 10)).alias("canopy")).agg((F.avg("o_totalprice") / 5e5).alias("score"))


@check("selection_score", f"""
select epoch, round(coalesce(avg(score) filter (not canopy), avg(score)), 6) as score, round(avg(score), 6) as score_all,
  avg(score) filter (not canopy) is not null as deployable from ({VAL_SQL}) group by epoch""")
def selection_score(spark, sf):
    d = S.selection_score(_val(spark, sf))
    return d.withColumns({"score": F.round("score", 6), "score_all": F.round("score_all", 6)})


@check("best_epoch", f"""
select epoch, score from (select epoch, round(coalesce(avg(score) filter (not canopy), avg(score)), 2) as score
  from ({VAL_SQL}) group by epoch) order by score desc, epoch limit 1""")
def best_epoch(spark, sf):
    """Scores rounded to two places, so that ties occur."""
    return S.best_epoch(S.selection_score(_val(spark, sf)).withColumn("score", F.round("score", 2)))


@check("label_prior", I.oracle("""
select tile, cast(pos as bigint) as positive, n as total, round(pos/n, 6) as prior,
  round(ln((8*pi/(8*pi+1-pi))/(1 - 8*pi/(8*pi+1-pi))), 5) as bias, round((1-pi)/(pi*8), 4) as neg_pos_ratio
from (select *, least(greatest(pos/n, 1e-6), 1-1e-6) as pi from
  (select tile, sum(y) as pos, count(*) as n from fx_cells where w > 0 group by tile))""", "fx_cells"))
def label_prior(spark, sf):
    d = S.label_prior(_cells(spark, sf), ["tile"])
    return d.select("tile", F.col("positive").cast("bigint").alias("positive"), "total", F.round("prior", 6).alias("prior"),
                    F.round("bias", 5).alias("bias"), F.round("neg_pos_ratio", 4).alias("neg_pos_ratio"))


@check("weighted_bce_strict", I.oracle("""
select tile, round(sum((8*y*ln(1+exp(-x)) + (1-y)*ln(1+exp(x)))*w)/(sum(w)+1e-6), 6) as bce
from (select *, (prob_pct-50)/1E1 as x from fx_cells) group by tile""", "fx_cells"))
def weighted_bce_strict(spark, sf):
    return S.weighted_bce(_cells(spark, sf), None).withColumn("bce", F.round("bce", 6))


LOSS_NEAR_SQL = """
select d.tile, d.row, d.col, 1/(1+exp(-(d.prob_pct-50)/1E1)) as sp, d.prob_pct/1E2 as p, d.y, d.w, max(s.y) as yn,
  max(1/(1+exp(-(s.prob_pct-50)/1E1))) as spn, max(s.prob_pct)/1E2 as pn
from fx_cells d join fx_cells s on s.tile = d.tile and s.row between d.row-5 and d.row+5 and s.col between d.col-5 and d.col+5
group by all"""


@check("weighted_bce_relaxed", I.oracle("""
select tile, round(sum((-8*y*ln(greatest(spn, 1e-6)) - (1-yn)*ln(greatest(1-sp, 1e-6)))*w)/(sum(w)+1e-6), 6) as bce
from ln group by tile""", "fx_cells", ln=LOSS_NEAR_SQL))
def weighted_bce_relaxed(spark, sf):
    return S.weighted_bce(_cells(spark, sf), _meta(spark, sf), radius=5).withColumn("bce", F.round("bce", 6))


@check("tversky_strict", I.oracle("""
select tile, round(1 - (tp+1e-6)/(tp+0.3*fp+0.7*fn+1e-6), 6) as tversky from (
 select tile, sum(w*p*y) as tp, sum(w*p*(1-y)) as fp, sum(w*(1-p)*y) as fn
 from (select *, prob_pct/1E2 as p from fx_cells) group by tile)""", "fx_cells"))
def tversky_strict(spark, sf):
    return S.tversky(_cells(spark, sf), None).withColumn("tversky", F.round("tversky", 6))


@check("tversky_relaxed", I.oracle("""
select tile, round(1 - (tp+1e-6)/(tp+0.3*fp+0.7*fn+1e-6), 6) as tversky from (
 select tile, sum(w*pn*y) as tp, sum(w*p*(1-yn)) as fp, sum(w*(1-pn)*y) as fn from ln group by tile)""", "fx_cells", ln=LOSS_NEAR_SQL))
def tversky_relaxed(spark, sf):
    return S.tversky(_cells(spark, sf), _meta(spark, sf), radius=5).withColumn("tversky", F.round("tversky", 6))


CLDICE_SQL = {
    "pb": "select tile, row, col, case when w > 0 then prob_pct/1E2 else coalesce(y, 0) end as z from dense",
    "yb": "select tile, row, col, cast(coalesce(y, 0) as double) as z from dense",
    **skeleton_sql(1, "pb", "p_"), **skeleton_sql(1, "yb", "y_"),
    "cl": """
select tile, 1 - 2*tp*ts/(tp+ts+1e-6) as cldice from (
 select tile, (sum(sp.z*yb.z)+1e-6)/(sum(sp.z)+1e-6) as tp, (sum(sy.z*pb.z)+1e-6)/(sum(sy.z)+1e-6) as ts
 from p_sk1 sp join y_sk1 sy using (tile, row, col) join pb using (tile, row, col) join yb using (tile, row, col) group by tile)""",
}


@check("cldice_1", I.dense_oracle("select tile, round(cldice, 6) as cldice from cl", **CLDICE_SQL))
def cldice_1(spark, sf):
    return S.cldice(_cells(spark, sf), _meta(spark, sf), 1).withColumn("cldice", F.round("cldice", 6))


@check("combined_score", I.dense_oracle("""
select tile, epoch, round(case when rp > 0 then cldice end, 6) as cldice,
  round(bce + tversky + case when rp > 0 then 0.5*rp*cldice else 0 end, 6) as total
from (select tile, sum((8*y*ln(1+exp(-x)) + (1-y)*ln(1+exp(x)))*w)/(sum(w)+1e-6) as bce
      from (select *, (prob_pct-50)/1E1 as x from fx_cells) group by tile) b
join (select tile, 1 - (tp+1e-6)/(tp+0.3*fp+0.7*fn+1e-6) as tversky from (
 select tile, sum(w*p*y) as tp, sum(w*p*(1-y)) as fp, sum(w*(1-p)*y) as fn
 from (select *, prob_pct/1E2 as p from fx_cells) group by tile)) t using (tile)
join cl using (tile), (select epoch, case when epoch < 2 then 0 else least((epoch-1)/3.0, 1) end as rp from range(6) e(epoch))""", **CLDICE_SQL))
def combined_score(spark, sf):
    """Loss total per tile over the first six epochs, warm-up of two."""
    c, m = _cells(spark, sf), _meta(spark, sf)
    parts = S.weighted_bce(c, None).join(S.tversky(c, None), "tile").join(S.cldice(c, m, 1), "tile")
    parts = parts.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")))
    d = S.combined_score(parts, S.ramp(F.col("epoch"), 2))
    return d.select("tile", "epoch", F.round("cldice", 6).alias("cldice"), F.round("total", 6).alias("total"))


@check("overlay_summary", I.oracle("""
select tile, round(avg(prob_pct/1E2), 6) as mean, round(avg(case when prob_pct > 50 then 1.0 else 0.0 end), 6) as above_half
from fx_cells group by tile""", "fx_cells"))
def overlay_summary(spark, sf):
    d = S.overlay_summary(_cells(spark, sf))
    return d.select("tile", F.round("mean", 6).alias("mean"), F.round("above_half", 6).alias("above_half"))


@check("parity", I.oracle("""
select tile, round(max(abs(a - b)), 6) as max_abs_diff,
  count(*) filter ((a is null) <> (b is null)) as nodata_mismatches, max(b) - min(b) > 0.05 as has_range
from (select tile, prob_pct/1E2 as a, case when code = 2 then null else prob_pct/1E2 + row/1E5 end as b from fx_cells) group by tile""", "fx_cells"))
def parity(spark, sf):
    c = _cells(spark, sf)
    other = c.withColumn("prob", F.when(F.col("code") != 2, F.col("prob") + F.col("row") / 1e5))
    return S.parity(c, other).withColumn("max_abs_diff", F.round("max_abs_diff", 6))


@check("prob_at_ground", I.oracle("""
select o.o_orderkey as pid, cast(o.o_custkey % (select count(*) from fx_meta) as bigint) as tile, c.prob_pct/1E2 as prob from orders o
left join fx_cells c on c.tile = o.o_custkey % (select count(*) from fx_meta) and c.row = floor((5000 - (4980 + o.o_orderkey % 300/1E1))/1.0)
  and c.col = floor((1000 + o.o_custkey % 2000/1E1 - 10 - 1000)/1.0)""", "fx_cells", "fx_meta"))
def prob_at_ground(spark, sf):
    """Nearest cell under each ground point; outside the raster is NULL."""
    from ridgeline.operators.overlay import prob_at_ground as op

    pts = I.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pid"), (F.col("o_custkey") % _meta(spark, sf).count()).cast("bigint").alias("tile"),
        (F.lit(1000.0) + (F.col("o_custkey") % 2000) / 10.0 - 10).alias("x"),
        (F.lit(4980.0) + (F.col("o_orderkey") % 300) / 10.0).alias("y"))
    meta = _meta(spark, sf).select("tile", F.lit(1000.0).alias("x0"), F.lit(5000.0).alias("y1"), F.lit(1.0).alias("res"))
    return op(pts, _cells(spark, sf), meta).select("pid", "tile", "prob")


@check("paint_overlay", I.oracle("""
with recursive x as (select 1) select tile, row, col, lv as level, case when lv/255.0::double < 0.3::double then 0 else
  cast(floor((0.55::double + lv/255.0::double*(0.92::double-0.55::double))*0.8::double*255.0 + 0.5) as bigint)*16777216 + cr*65536 + cg*256 + cb end as argb
from (select *, cast(floor(((a//65536)%256) + (((b//65536)%256) - ((a//65536)%256))*f + 0.5) as bigint) as cr,
   cast(floor(((a//256)%256) + (((b//256)%256) - ((a//256)%256))*f + 0.5) as bigint) as cg,
   cast(floor((a%256) + ((b%256) - (a%256))*f + 0.5) as bigint) as cb
 from (select *, u - i as f, ramp[i+1] as a, ramp[i+2] as b
  from (select *, least(cast(floor(u) as bigint), 7) as i
   from (select tile, row, col, cast(floor(prob_pct/1E2*255 + 0.5) as bigint) as lv,
     (0.25::double + cast(floor(prob_pct/1E2*255 + 0.5) as bigint)/255.0::double*(1-0.25::double))*8 as u,
     [854151, 4981409, 8258472, 11150229, 13387640, 15101020, 16291136, 16631079, 15792417]::bigint[] as ramp from fx_cells))))""".replace("with recursive x as (select 1) ", ""), "fx_cells"))
def paint_overlay(spark, sf):
    from ridgeline.functions.rasters import paint

    return paint(_cells(spark, sf), spark, 0.3, 0.8).select("tile", "row", "col", "level", "argb")


@check("lookup_join", I.oracle("""
select tile, row, col, c.class, c.code from fx_cells join (select unnest(['active', 'faint', 'lifecycle']) as class, unnest([1, 2, 3])::bigint as code) c using (code)""", "fx_cells"))
def lookup_join(spark, sf):
    """Class names by code."""
    from ridgeline.operators.lookups import class_codes, lookup_join as op

    cells = I.view(spark, sf, "fx_cells").select("tile", "row", "col", "code")
    return op(cells, class_codes(spark), ["code"])
