"""Checks for way, tag and grid-cell operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import check
from ridgeline.functions import tags as T
from ridgeline.operators import ways as W

MIDS_SQL = """
select c.id, c.total / c.n as share_m, k.k,
       s.x0 + (s.x1-s.x0)*((k.k+0.5)*c.total/c.n - s.s0)/s.len as x,
       s.y0 + (s.y1-s.y0)*((k.k+0.5)*c.total/c.n - s.s0)/s.len as y
from (select id, max(total) as total, greatest(cast(floor(max(total)/least(20.0::double, max(total))) as bigint), 1) as n
      from cums group by id having max(total) >= 1) c
join (select unnest(range(100000)) as k) k on k.k < c.n
join cums s on s.id = c.id and (k.k+0.5)*c.total/c.n >= s.s0 and (k.k+0.5)*c.total/c.n < s.s0 + s.len"""

EVIDENCE_SQL = "select id, vclass as evidence from kinds where kind = 'trail' and vclass in ('faint','lifecycle')"

CELLS_SQL = """
select cast(floor(m.x/1000) as bigint) as gx, cast(floor(m.y/1000) as bigint) as gy,
       cast(round_even(coalesce(sum(case when evidence='faint' then share_m end),0),0) as bigint) as faint_m,
       cast(round_even(coalesce(sum(case when evidence='lifecycle' then share_m end),0),0) as bigint) as lifecycle_m,
       cast(round_even(sum(share_m),0) as bigint) as total_m,
       count(distinct m.id) as n_ways
from mids m join evid using (id) group by 1, 2"""

ZONED_SQL = """
select s.* from scored s where not exists (select 1 from fx_zones z
  where (s.gx+1)*1000 >= z.x - z.size_m/2.0 - 200 and s.gx*1000 <= z.x + z.size_m/2.0 + 200
    and (s.gy+1)*1000 >= z.y - z.size_m/2.0 - 200 and s.gy*1000 <= z.y + z.size_m/2.0 + 200)"""


def ranked_oracle(body: str, views: tuple[str, ...] = (), **extra: str) -> str:
    return I.oracle(body, "fx_vertices", "fx_tags", "fx_zones", *views, segs=I.SEGMENTS_SQL, cums=I.SEGMENTS_CUM_SQL,
                    kinds=I.KINDS_SQL, mids=MIDS_SQL, evid=EVIDENCE_SQL, scored=CELLS_SQL, zoned=ZONED_SQL, **extra)


def _evidence_cells(spark, sf):
    return W.score_cells(I.ways(spark, sf))


@check("rank_evidence_cells", ranked_oracle(
    "select * from zoned where total_m >= 400 order by total_m desc, gx, gy limit 60"))
def rank_evidence_cells(spark, sf):
    """Harvest: the 60 richest grid cells of rare evidence outside curated zones."""
    from ridgeline.plans.harvest import rank_evidence

    return rank_evidence(I.ways(spark, sf), I.view(spark, sf, "fx_zones"), limit=60, buffer_m=200.0)


@check("score_evidence_cells", ranked_oracle("select * from scored"))
def score_evidence_cells(spark, sf):
    return _evidence_cells(spark, sf)


TWICE_SQL = f"select * from ({EVIDENCE_SQL}) union all select * from ({EVIDENCE_SQL}) where id % 5 = 0"


@check("score_evidence_cells_repeated", I.oracle(
    "select * from scored", "fx_vertices", "fx_tags", "fx_zones", segs=I.SEGMENTS_SQL, cums=I.SEGMENTS_CUM_SQL, kinds=I.KINDS_SQL,
    mids=MIDS_SQL, evid=TWICE_SQL, scored=CELLS_SQL))
def score_evidence_cells_repeated(spark, sf):
    """Every fifth way comes twice: its metres add up, but it is one way."""
    w = I.ways(spark, sf)
    return W.score_cells(w.unionByName(w.where(F.col("id") % 5 == 0)))


@check("exclude_zones", ranked_oracle("select * from zoned"))
def exclude_zones(spark, sf):
    return W.exclude_zones(_evidence_cells(spark, sf), I.view(spark, sf, "fx_zones"), buffer_m=200.0)


@check("walk_to_cells", ranked_oracle("""
select id, cast(floor(x/1000) as bigint) as gx, cast(floor(y/1000) as bigint) as gy,
       count(*) as points, round(sum(share_m), 4) as metres from mids group by 1, 2, 3"""))
def walk_to_cells(spark, sf):
    mids = W.walk_to_cells(W.way_segments(I.ways(spark, sf)))
    return mids.groupBy("id", F.col("gx").cast("bigint").alias("gx"), F.col("gy").cast("bigint").alias("gy")).agg(
        F.count("*").alias("points"), F.round(F.sum("share_m"), 4).alias("metres"))


@check("way_segments", I.ways_oracle("""
select id, seg, round(len, 6) as len, round(s0, 6) as s0, round(total, 6) as total
from cums where total >= 1"""))
def way_segments(spark, sf):
    return W.way_segments(I.ways(spark, sf)).select(
        "id", "seg", *[F.round(c, 6).alias(c) for c in ("len", "s0", "total")])


@check("way_length", I.ways_oracle("select id, round(max(total), 6) as length from cums group by id"))
def way_length(spark, sf):
    return W.way_length(I.ways(spark, sf)).select("id", F.round("length", 6).alias("length"))


@check("classify_way", I.oracle("""
select id, kind, case when kind = 'trail' then trail_weight when kind is not null then 0.0::double end as weight,
       vclass, case when kind='trail' and vclass <> 'active' then vclass end as evidence from kinds""",
       "fx_tags", kinds=I.KINDS_SQL))
def classify_way(spark, sf):
    tags = F.col("tags")
    return I.tag_map(I.view(spark, sf, "fx_tags")).select(
        "id", T.classify_way(tags).alias("c"), T.visibility_class(tags).alias("vclass"),
        T.evidence_kind(tags).alias("evidence")).select("id", "c.kind", "c.weight", "vclass", "evidence")


@check("visibility_weight", """
select o_orderpriority as grade, cast(case substr(o_orderpriority, 1, 1) when '1' then 1.0 when '2' then 0.7
  when '3' then 0.5 when '4' then 0.35 else 1.0 end as double) as weight, count(*) as n
from orders group by 1, 2""")
def visibility_weight(spark, sf):
    o = I.table(spark, sf, "orders")
    code = F.substring("o_orderpriority", 1, 1)
    vis = (F.when(code == "1", "excellent").when(code == "2", "bad").when(code == "3", "horrible")
           .when(code == "4", "no"))
    return o.groupBy(F.col("o_orderpriority").alias("grade"), T.visibility_weight(vis).alias("weight")).agg(
        F.count("*").alias("n"))


@check("filter_ways_all", I.ways_oracle("""
select v.id from (select id, min(x) ax, max(x) bx, min(y) ay, max(y) by_ from fx_vertices group by id) v
join fx_tags using (id) where ax <= 6000 and bx >= 1000 and ay <= 7000 and by_ >= 2000"""))
def filter_ways_all(spark, sf):
    return W.filter_ways(I.ways(spark, sf), (1000.0, 2000.0, 6000.0, 7000.0), "all").select("id")


@check("filter_ways_evidence", I.ways_oracle("""
select v.id from (select distinct id from fx_vertices) v join fx_tags using (id)
where hw_key <> 'highway' or vis is not null"""))
def filter_ways_evidence(spark, sf):
    return W.filter_ways(I.ways(spark, sf), None, "evidence").select("id")


#: a clip rectangle that cuts through the middle of the mapped area
CLIP = (1040.0, 1025.0, 8060.0, 7075.0)

CLIPPED_SQL = f"""
select * from (select *,
   greatest(0, case when x1>x0 then ({CLIP[0]}-x0)/(x1-x0) when x1<x0 then ({CLIP[2]}-x0)/(x1-x0) else 0 end,
               case when y1>y0 then ({CLIP[1]}-y0)/(y1-y0) when y1<y0 then ({CLIP[3]}-y0)/(y1-y0) else 0 end) as t0,
   least(1, case when x1>x0 then ({CLIP[2]}-x0)/(x1-x0) when x1<x0 then ({CLIP[0]}-x0)/(x1-x0) else 1 end,
            case when y1>y0 then ({CLIP[3]}-y0)/(y1-y0) when y1<y0 then ({CLIP[1]}-y0)/(y1-y0) else 1 end) as t1
   from cums where total >= 1)
where t0 < t1 and (x0 <> x1 or (x0 >= {CLIP[0]} and x0 <= {CLIP[2]})) and (y0 <> y1 or (y0 >= {CLIP[1]} and y0 <= {CLIP[3]}))"""


@check("clip_segments", I.ways_oracle(
    "select id, round(sum(len*(t1-t0)), 5) as in_tile_m, count(*) as pieces from clipped group by id", clipped=CLIPPED_SQL))
def clip_segments(spark, sf):
    c = W.clip_segments(W.way_segments(I.ways(spark, sf)), *CLIP)
    return c.groupBy("id").agg(F.round(F.sum("clen"), 5).alias("in_tile_m"), F.count("*").alias("pieces"))


@check("clipped_parts", I.ways_oracle("""
select id, part, round(sum(len*(t1-t0)), 5) as part_m from (
  select *, cast(sum(fresh) over (partition by id order by seg) as bigint) as part from (
    select *, case when lag(seg) over (partition by id order by seg) = seg-1
       and lag(t1) over (partition by id order by seg) = 1 and t0 = 0 then 0 else 1 end as fresh from clipped))
group by id, part""", clipped=CLIPPED_SQL))
def clipped_parts(spark, sf):
    c = W.clip_segments(W.way_segments(I.ways(spark, sf)), *CLIP)
    return W.clipped_parts(c, ["id"]).groupBy("id", "part").agg(F.round(F.sum("clen"), 5).alias("part_m"))
