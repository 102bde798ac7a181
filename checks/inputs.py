"""Input views derived from the test tables, identical in Spark SQL and DuckDB.

The tables hold no rasters, points or ways, so each view derives one from whole
tables: every source row takes part, and the views grow with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS: dict[str, str] = {
    # one raster tile per ten suppliers, 16 x 160 cells, about 90 % filled
    "fx_cells": """
select cast(floor(l_suppkey/10) as bigint) as tile,
       cast(l_partkey % 16 as bigint) as row,
       cast((l_suppkey % 10)*16 + l_orderkey % 16 as bigint) as col,
       cast(sum(l_quantity) as double) as z,
       cast(count(*) as bigint) as n,
       cast(floor(((sum(cast(round(l_discount*100) as bigint))*37) % 101)
                * ((sum(cast(round(l_discount*100) as bigint))*37) % 101) / 1E2) as bigint) as prob_pct,
       cast(max(case when l_returnflag='R' and l_linestatus='O' and l_quantity>48 then 1 else 0 end) as bigint) as y,
       cast(min(case when l_returnflag='N' and l_quantity>49 then 0 else 1 end) as bigint) as w,
       cast(min(1 + l_linenumber % 3) as bigint) as code
from {lineitem} group by 1, 2, 3""",
    "fx_meta": """
select tile, cast(16 as bigint) as height, cast(160 as bigint) as width
from (select distinct cast(floor(l_suppkey/10) as bigint) as tile from {lineitem})""",
    # way vertices: one per (order, line number), so at most seven per way
    "fx_vertices": """
select cast(l_orderkey as bigint) as id, cast(l_linenumber as bigint) as pos,
       cast((l_orderkey % 100)*100 + min(l_partkey % 150) as double) as x,
       cast((floor(l_orderkey/100) % 100)*100 + min(l_suppkey*7 % 150) as double) as y
from {lineitem} group by l_orderkey, l_linenumber""",
    "fx_tags": """
select cast(o_orderkey as bigint) as id,
       case when substr(o_orderpriority,1,1)='1' then 'abandoned:highway' else 'highway' end as hw_key,
       case when o_custkey % 10 = 0 then 'primary'
            when o_custkey % 10 = 3 then 'service'
            when o_custkey % 2 = 0 then 'path' else 'track' end as hw_val,
       case substr(o_orderpriority,1,1) when '2' then 'bad' when '3' then 'horrible'
            when '4' then 'good' else null end as vis,
       case when o_orderstatus='P' and o_custkey % 7 = 0 then 'asphalt' end as surface,
       case when o_custkey % 11 = 0 then 'stream' when o_custkey % 13 = 0 then 'canal' end as waterway
from {orders}""",
    # 20 tiles of 100 m x 100 m; class 2 ground, 1 vegetation, 7 and 18 noise
    "fx_points": """
select cast(event_id as bigint) as event_id, cast(user_id % 20 as bigint) as tile,
       cast(event_id*37 % 1000 as double)/1E1 as x,
       cast(cast(floor(event_id/7) as bigint)*91 % 1000 as double)/1E1 as y,
       value as z,
       cast(case event_type when 'view' then 2 when 'click' then 2 when 'signup' then 1
            when 'purchase' then 7 else 18 end as bigint) as cls
from {events}""",
    # a survey: every line of an order is a point, 100 m x 100 m a tile, a third of them ground
    "fx_survey": """
select cast(l_orderkey*10 + l_linenumber as bigint) as event_id, cast(floor(min(l_suppkey)/10) as bigint) as tile,
       cast(l_orderkey*37 % 10000 as double)/1E2 as x, cast(min(l_partkey)*91 % 10000 as double)/1E2 as y,
       cast(min(l_quantity) as double) as z, cast(case when l_linenumber % 3 = 0 then 2 else 1 end as bigint) as cls
from {lineitem} group by l_orderkey, l_linenumber""",
    "fx_zones": """
select cast(n_nationkey as bigint) as key,
       cast((n_nationkey*97 % 100)*100 + 50 as double) as x,
       cast((n_nationkey*53 % 100)*100 + 50 as double) as y,
       cast(300 as bigint) as size_m
from {nation}""",
    "fx_aois": """
select cast(s_suppkey as bigint) as key, s_name as name,
       cast(3620 + s_suppkey*37 % 200 as double)/1E2 as lat,
       cast(-11940 + s_suppkey*53 % 150 as double)/1E2 as lon,
       case s_suppkey % 4 when 0 then 'eval' when 1 then 'train' when 2 then 'harvest' else 'control' end as role,
       cast(1000 as bigint) as size_m
from {supplier}""",
    "fx_coverage": """
select n_name as name, cast(n_nationkey*1000 + n_regionkey as bigint) as cnt,
       cast(362 + (n_nationkey % 5)*4 as double)/1E1 as y0,
       cast(367 + (n_nationkey % 5)*4 as double)/1E1 as y1,
       cast(-1194 + floor(n_nationkey/5)*3 as double)/1E1 as x0,
       cast(-1192 + floor(n_nationkey/5)*3 as double)/1E1 as x1
from {nation}""",
    # map views to plan a fetch for, one per customer
    "fx_views": """
select cast(c_custkey as bigint) as view_id,
       cast((c_custkey*31 % 4000)*10 as double) as x0, cast((c_custkey*17 % 4000)*10 as double) as y0,
       cast((c_custkey*31 % 4000)*10 as double) + 1 + abs(cast(c_acctbal as double)) as x1,
       cast((c_custkey*17 % 4000)*10 as double) + 1 + c_custkey % 3000 as y1
from {customer}""",
    # elevation catalog: one square footprint per supplier, some coarse, some undated
    "fx_catalog": """
select cast(s_suppkey as bigint) as object_id,
       case s_suppkey % 4 when 0 then 103E-1 when 1 then 1E0 when 2 then 15E-1 else 5E-1 end as low_ps,
       s_name as title,
       case when s_suppkey % 5 = 0 then null
            else cast(1599436800000 + s_suppkey*86400000 as bigint) end as acquired_ms,
       cast((s_suppkey*41 % 40)*1000 as double) as fx0,
       cast((s_suppkey*29 % 40)*1000 as double) as fy0,
       cast((s_suppkey*41 % 40)*1000 + 9000 as double) as fx1,
       cast((s_suppkey*29 % 40)*1000 + 9000 as double) as fy1
from {supplier}""",
}

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Spark form of one input view."""
    text = VIEWS[name]
    used = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def oracle(body: str, *names: str, **extra: str) -> str:
    """DuckDB text: the named views as CTEs, then extra CTEs, then the body."""
    parts = []
    for n in names:
        text = re.sub(r"\{(\w+)\}", r"\1", VIEWS[n])
        parts.append(f"{n} as ({text})")
    parts += [f"{n} as ({text})" for n, text in extra.items()]
    return f"with {', '.join(parts)} {body}" if parts else body


def tag_map(tags: DataFrame) -> DataFrame:
    """One ``map<string,string>`` of the non-NULL tags per way."""
    pairs = F.array(
        F.struct(F.col("hw_key").alias("k"), F.col("hw_val").alias("v")),
        F.struct(F.lit("trail_visibility").alias("k"), F.col("vis").alias("v")),
        F.struct(F.lit("surface").alias("k"), F.col("surface").alias("v")),
        F.struct(F.lit("waterway").alias("k"), F.col("waterway").alias("v")),
    )
    return tags.select("id", F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("tags"))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with tags and a vertex array.

    The vertex array is bounded: a way has one vertex per line number. The number
    of partitions is stated: a way takes few bytes, and what is made of it many.
    """
    verts = view(spark, sf_dir, "fx_vertices").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    lines = verts.groupBy("id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "x", "y"))),
            lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")),
        ).alias("geometry")
    )
    return lines.join(tag_map(view(spark, sf_dir, "fx_tags")), "id")


# --- shared oracle fragments --------------------------------------------------

#: way segments with length and running start, as the oracle computes them
SEGMENTS_SQL = """
select id, row_number() over (partition by id order by pos) - 1 as seg,
       x as x0, y as y0, x1, y1, sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y)) as len
from (select *, lead(x) over (partition by id order by pos) as x1,
                lead(y) over (partition by id order by pos) as y1 from fx_vertices)
where x1 is not null"""

SEGMENTS_CUM_SQL = """
select *, coalesce(sum(len) over (partition by id order by seg rows between unbounded preceding and 1 preceding), 0) as s0,
       sum(len) over (partition by id) as total from segs"""

#: kind and visibility class per way
KINDS_SQL = """
select *, case when waterway is not null then case when waterway in ('river','stream','riverbank') then 'water' end
     when hw_key <> 'highway' then case when hw_val in ('path','footway','track','bridleway','cycleway','steps',
          'unclassified','service','trunk','tertiary') then 'trail' end
     when hw_val in ('path','footway','track','bridleway','cycleway','steps')
       then case when surface in ('wood','asphalt','concrete','paved','metal') then 'excluded' else 'trail' end end as kind,
   case when hw_key <> 'highway' then 'lifecycle' when vis in ('bad','horrible','no') then 'faint' else 'active' end as vclass,
   case when hw_key <> 'highway' then 0.6::double when vis = 'bad' then 0.7::double
        when vis = 'horrible' then 0.5::double when vis='no' then 0.35::double
        when vis = 'intermediate' then 0.9::double else 1.0::double end as trail_weight
from fx_tags"""

#: dense cells, NULL where the raster has no data
DENSE_SQL = """
select m.tile, r.row, c.col, k.z, k.prob_pct, k.y, k.w, k.code
from fx_meta m, range(16) r(row), range(160) c(col)
left join fx_cells k on k.tile = m.tile and k.row = r.row and k.col = c.col"""

def dense_oracle(body: str, **extra: str) -> str:
    return oracle(body, "fx_cells", "fx_meta", dense=DENSE_SQL, **extra)


def filled_oracle(body: str, **extra: str) -> str:
    return oracle(
        body, "fx_cells", "fx_meta", dense=DENSE_SQL,
        med="select tile, median(z) as m from fx_cells group by tile",
        filled="select d.tile, d.row, d.col, coalesce(d.z, med.m) as z from dense d join med using (tile)",
        **extra,
    )


def ways_oracle(body: str, **extra: str) -> str:
    return oracle(body, "fx_vertices", "fx_tags", segs=SEGMENTS_SQL, cums=SEGMENTS_CUM_SQL,
                  kinds=KINDS_SQL, **extra)
