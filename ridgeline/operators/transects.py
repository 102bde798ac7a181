"""Cross-profiles along ways and the signal they carry."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline import constants as K
from ridgeline.operators import grid as G
from ridgeline.operators import ways as W
from ridgeline.operators.labels import assign_tiles
from ridgeline.operators.lineage import cut
from ridgeline.operators.plans import pin
from ridgeline.operators.ranks import measured


def tile_parts(segments: DataFrame, meta: DataFrame, min_part: float = K.MIN_PART_M,
               keep: Sequence[str] = ("vclass",)) -> DataFrame:
    """Connected pieces of each way inside each tile, as segment arrays.

    A piece never has more segments than its way has vertices.
    """
    s = assign_tiles(segments, meta, 0.0)
    c = W.clip_to(s, F.col("tx0"), F.col("ty0"), F.col("tx1"), F.col("ty1"))
    c = W.clipped_parts(c, ["tile", "id"])
    piece = F.struct("seg", F.col("cx0").alias("x0"), F.col("cy0").alias("y0"), F.col("cx1").alias("x1"),
                     F.col("cy1").alias("y1"), F.col("clen").alias("len"))
    g = c.groupBy("tile", "id", "part", *keep, "tx0", "ty1", "res").agg(F.array_sort(F.collect_list(piece)).alias("segs"))
    starts = W._running_starts(F.transform("segs", lambda x: x["len"]))
    g = pin(g.withColumn("starts", starts), ["starts"]).withColumn("total", F.element_at("starts", -1))
    return g.where(F.col("total") >= min_part)


def _point_at(s: Column) -> Column:
    """Position at distance ``s`` along the part's segments."""
    # the last segment whose start does not lie beyond s
    i = F.least(F.size(F.filter("starts", lambda v: v <= s)), F.size("segs")) - 1
    seg, start = F.get("segs", i), F.get("starts", i)
    f = F.least(F.coalesce(F.try_divide(s - start, seg["len"]), F.lit(0.0)), F.lit(1.0))
    return F.struct((seg["x0"] + (seg["x1"] - seg["x0"]) * f).alias("x"), (seg["y0"] + (seg["y1"] - seg["y0"]) * f).alias("y"))


def stations(parts: DataFrame, step: float = K.STEP_M, margin: float = 2.0, ahead: float = 1.0) -> DataFrame:
    """Points along each part with the unit normal of the way there."""
    keep = [c for c in parts.columns if c not in ("segs", "starts")]
    n = F.ceil((F.greatest(F.col("total") - margin, F.lit(margin + 1.0)) - margin) / step)
    d = parts.withColumn("station", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    d = d.withColumn("s", F.col("station") * step + margin)
    d = d.withColumns({"_p": _point_at(F.col("s")), "_q": _point_at(F.least(F.col("s") + ahead, F.col("total")))})
    d = pin(d, ["_p", "_q"])
    d = d.withColumns({"_dx": F.col("_q.x") - F.col("_p.x"), "_dy": F.col("_q.y") - F.col("_p.y")})
    d = d.withColumn("_norm", F.hypot("_dx", "_dy")).where(F.col("_norm") >= 1e-6)
    return d.select(*keep, "station", "s", F.col("_p.x").alias("x"), F.col("_p.y").alias("y"),
                    (-F.col("_dy") / F.col("_norm")).alias("nx"), (F.col("_dx") / F.col("_norm")).alias("ny"))


def offset_count(half: float, res: float) -> int:
    return math.ceil((2 * half + res) / res - 1e-9)


def transect(half: float, res: float) -> tuple[int, Callable[[Column], tuple[Column, Column]]]:
    """Sample positions across the way at a station: how many, and where the one numbered ``off`` is on the raster."""
    def position(off: Column) -> tuple[Column, Column]:
        o = off * res - half
        return ((F.col("ty1") - (F.col("y") + F.col("ny") * o)) / F.col("res"), (F.col("x") + F.col("nx") * o - F.col("tx0")) / F.col("res"))

    return offset_count(half, res), position


def profile_stats(profiles: DataFrame, keys: Sequence[str], transect: Sequence[str], half: float, res: float,
                  berm: float = K.BERM_M, min_transects: int = K.MIN_TRANSECTS) -> DataFrame:
    """Incision, noise and their ratio per group of transects.

    Incision compares the mean profile's crest with its centre; noise is the
    population deviation of the same difference taken transect by transect. A
    transect becomes one row with a column for each offset, from which both
    follow in one further aggregation, so profiles are only computed once.
    """
    keys, n = list(keys), offset_count(half, res)
    centre, span = n // 2, int(berm / res)
    inside = range(max(centre - span, 0), min(centre + span, n - 1) + 1)
    wanted = sorted({centre, *inside})
    each = profiles.groupBy(*keys, *transect).agg(*[F.max(F.when(F.col("off") == o, F.col("v"))).alias(f"_v{o}") for o in wanted])

    def crest(prefix: str) -> Column:
        own = [F.col(f"{prefix}{o}") for o in inside]
        return F.greatest(*own) if len(own) > 1 else own[0]

    each = each.withColumn("_d", F.col(f"_v{centre}") - crest("_v"))
    d = each.groupBy(*keys).agg(F.count("*").alias("n_transects"), (F.stddev_pop("_d") * 1000).alias("noise_mm"),
                                *[F.avg(f"_v{o}").alias(f"_m{o}") for o in wanted])
    d = d.withColumn("incision_mm", (crest("_m") - F.col(f"_m{centre}")) * 1000)
    few = F.col("n_transects") < min_transects
    snr = F.when(F.col("noise_mm") > 0, F.col("incision_mm") / F.col("noise_mm") * F.sqrt("n_transects")).otherwise(F.lit(0.0))
    return d.select(
        *keys, "n_transects", F.when(~few, F.col("incision_mm")).alias("incision_mm"),
        F.when(~few, F.col("noise_mm")).alias("noise_mm"), F.when(~few, snr).alias("snr"),
        F.when(few, F.lit("too few transects")).alias("note"))


def mean_profile(profiles: DataFrame, keys: Sequence[str], half: float, res: float) -> DataFrame:
    """Mean height by offset, in millimetres."""
    return profiles.groupBy(*keys, "off").agg((F.avg("v") * 1000).alias("mean_mm")).withColumn(
        "offset_m", F.col("off") * res - half)


def sample_profiles(segments: DataFrame, relief: DataFrame, meta: DataFrame, half: float, res: float, step: float,
                    min_part: float, margin: float = 2.0, ahead: float = 1.0) -> DataFrame:
    """Relief sampled along every transect of every trail in every tile.

    Stations are many times the ways' own data, and samples many times the stations. Neither is shuffled where
    the tiles and their relief are few: they are made and looked up where the ways are. Else stations are, once.
    """
    meta = measured(meta)
    at = stations(tile_parts(segments, meta, min_part), step, margin, ahead)
    line, finest = transect(half, res), meta.agg(F.min("res")).first()[0] or res
    reach = math.ceil((line[0] - 1) * res / 2 / finest + 1e-6)
    p = G.bilinear_sample(relief, meta, at.drop("total", "s"), "relief", "v", line, reach)
    return p.select("tile", "id", "part", "vclass", "station", "off", "v")


def signal_by_class(segments: DataFrame, dtm: DataFrame, meta: DataFrame, res: float, half: float = K.HALF_WIDTH_M,
                    step: float = K.STEP_M, berm: float = K.BERM_M, min_part: float = K.MIN_PART_M,
                    relief_px: int | None = None, min_transects: int = K.MIN_TRANSECTS,
                    margin: float = 2.0, ahead: float = 1.0, min_valid: int = 100) -> DataFrame:
    """Signal per tile and class on elevation minus its 10 m median.

    A tile with fewer than ``min_valid`` real cells is not analysed: it is one
    row without a class that says so.
    """
    k = relief_px or K.window_px(10.0, res, 5)
    # small and read by many steps; found once, so that none repeats the work that led to them
    meta = cut(meta)
    empty = cut(dtm.groupBy("tile").agg(F.count("z").alias("_n")).where(F.col("_n") < min_valid).select("tile"))
    filled = G.fill_median(dtm.join(empty, "tile", "left_anti"))
    med = G.median_filter(filled, meta, k, "reflect", "z", "_m", keep=("z",))
    relief = med.select("tile", "row", "col", (F.col("z") - F.col("_m")).alias("relief"))
    p = sample_profiles(segments.where(F.col("kind") == "trail"), relief, meta, half, res, step, min_part, margin, ahead)
    d = profile_stats(p, ["tile", "vclass"], ["id", "part", "station"], half, res, berm, min_transects)
    return d.unionByName(empty.withColumn("note", F.lit("no valid DTM")), allowMissingColumns=True)
