"""Operators over ways: ``(id, tags, geometry array<struct<x,y>>)``.

A way is one row, so its segments, lengths and stations come from array
functions in that row and need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline import constants as K
from ridgeline.functions import tags as T
from ridgeline.operators.plans import pin


def filter_ways(ways: DataFrame, bbox: tuple[float, float, float, float] | None, mode: str) -> DataFrame:
    """Keep the ways a region request would return.

    ``bbox`` is (min x, min y, max x, max y) in the geometry's own units; a way
    is in it if its bounding box overlaps.
    """
    tags = F.col("tags")
    has_highway = F.map_contains_key(tags, F.lit("highway"))
    if mode == "all":
        keep = has_highway | T.has_lifecycle(tags) | F.map_contains_key(tags, F.lit("waterway"))
    elif mode == "evidence":
        graded = F.coalesce(
            F.try_element_at(tags, F.lit("trail_visibility")).isin(*K.VISIBILITY_WEIGHT), F.lit(False))
        keep = (has_highway & graded) | T.has_lifecycle(tags)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    out = ways.where(keep)
    if bbox is not None:
        xs = F.transform("geometry", lambda p: p["x"])
        ys = F.transform("geometry", lambda p: p["y"])
        out = out.where(
            (F.array_min(xs) <= bbox[2]) & (F.array_max(xs) >= bbox[0])
            & (F.array_min(ys) <= bbox[3]) & (F.array_max(ys) >= bbox[1]))
    return out


def _segment_array(geometry: Column) -> Column:
    """Array of segments with length ``len`` and running start ``s0``."""
    n = F.size(geometry)
    pairs = F.zip_with(
        F.slice(geometry, F.lit(1), n - 1), F.slice(geometry, F.lit(2), n - 1),
        lambda a, b: F.struct(
            a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"),
            F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"])).alias("len")))
    return pairs


def _running_starts(lengths: Column) -> Column:
    """Prefix sums starting at 0, one longer than the input."""
    return F.aggregate(
        lengths, F.array(F.lit(0.0)),
        lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def way_segments(ways: DataFrame, min_length: float = 1.0) -> DataFrame:
    """One row per segment with length, running start and the way's total.

    Ways with fewer than two vertices or shorter than ``min_length`` are dropped.
    """
    keep = [c for c in ways.columns if c != "geometry"]
    d = ways.where(F.size("geometry") >= 2).withColumn("_segs", _segment_array(F.col("geometry")))
    d = pin(d.withColumn("_starts", _running_starts(F.transform("_segs", lambda s: s["len"]))), ["_segs", "_starts"])
    d = d.withColumn("total", F.element_at("_starts", -1)).where(F.col("total") >= min_length)
    d = d.select(*keep, "total", "_starts", F.posexplode("_segs").alias("seg", "_s"))
    return d.select(
        *keep, F.col("seg").cast("bigint").alias("seg"), "_s.x0", "_s.y0", "_s.x1", "_s.y1", "_s.len",
        F.get("_starts", F.col("seg")).alias("s0"), F.get("_starts", F.col("seg") + 1).alias("s1"), "total")


def way_length(ways: DataFrame) -> DataFrame:
    lens = F.transform(_segment_array(F.col("geometry")), lambda s: s["len"])
    return ways.where(F.size("geometry") >= 2).withColumn(
        "length", F.aggregate(lens, F.lit(0.0), lambda a, v: a + v))


def walk(segments: DataFrame, step: float = 20.0) -> DataFrame:
    """Evenly spaced midpoints along each way, each carrying its share of length.

    Midpoint k sits at ``(k + 1/2) * total / n``. Each segment works out which
    midpoints fall on it from its own running start, so no range join is needed
    and consecutive segments never claim the same one.
    """
    n = F.greatest(F.floor(F.col("total") / F.least(F.lit(step), F.col("total"))), F.lit(1))
    keep = [c for c in segments.columns if c not in ("x0", "y0", "x1", "y1", "len", "s0", "s1")]
    d = segments.withColumn("_n", n)

    def first(at: str) -> Column:
        return F.ceil(F.col(at) * F.col("_n") / F.col("total") - 0.5)

    d = d.withColumns({
        "_k0": F.greatest(first("s0"), F.lit(0)),
        "_k1": F.when(F.col("s1") >= F.col("total"), F.col("_n")).otherwise(first("s1")),
    })
    d = pin(d, ["_k0", "_k1"])
    d = d.where(F.col("_k1") > F.col("_k0")).withColumn("k", F.explode(F.sequence(F.col("_k0"), F.col("_k1") - 1)))
    at = (F.col("k") + 0.5) * F.col("total") / F.col("_n")
    f = (at - F.col("s0")) / F.col("len")
    return d.select(
        *keep, F.col("k").cast("bigint").alias("k"), (F.col("total") / F.col("_n")).alias("share_m"),
        (F.col("x0") + (F.col("x1") - F.col("x0")) * f).alias("x"),
        (F.col("y0") + (F.col("y1") - F.col("y0")) * f).alias("y"))


def walk_to_cells(segments: DataFrame, size_m: float = 1000.0, step: float = 20.0) -> DataFrame:
    return walk(segments, step).withColumns({
        "gx": F.floor(F.col("x") / size_m), "gy": F.floor(F.col("y") / size_m)})


def way_cells(ways: DataFrame, size_m: float = 1000.0, step: float = 20.0, min_length: float = 1.0) -> DataFrame:
    """One row per (way, grid cell) with the way's metres in that cell.

    The midpoints of :func:`walk` are formed and counted inside the way's own
    row, so distinct ways per cell are later a plain count and no shuffle by
    way is needed. Works on streams too.
    """
    keep = [c for c in ways.columns if c != "geometry"]
    d = ways.where(F.size("geometry") >= 2).withColumn("_segs", _segment_array(F.col("geometry")))
    d = pin(d.withColumn("_starts", _running_starts(F.transform("_segs", lambda s: s["len"]))), ["_segs", "_starts"])
    d = d.withColumn("total", F.element_at("_starts", -1)).where(F.col("total") >= min_length)
    d = d.withColumn("_n", F.greatest(F.floor(F.col("total") / F.least(F.lit(step), F.col("total"))), F.lit(1)))

    def on_segment(seg: Column, i: Column) -> Column:
        s0, s1 = F.get("_starts", i), F.get("_starts", i + 1)
        k0 = F.greatest(F.ceil(s0 * F.col("_n") / F.col("total") - 0.5), F.lit(0))
        k1 = F.when(s1 >= F.col("total"), F.col("_n")).otherwise(F.ceil(s1 * F.col("_n") / F.col("total") - 0.5))
        ks = F.when(k1 > k0, F.sequence(k0, F.greatest(k1 - 1, k0))).otherwise(F.array().cast("array<bigint>"))

        def cell(k: Column) -> Column:
            f = ((k + 0.5) * F.col("total") / F.col("_n") - s0) / seg["len"]
            return F.struct(
                F.floor((seg["x0"] + (seg["x1"] - seg["x0"]) * f) / size_m).alias("gx"),
                F.floor((seg["y0"] + (seg["y1"] - seg["y0"]) * f) / size_m).alias("gy"))

        return F.transform(ks, cell)

    d = pin(d.withColumn("_cells", F.flatten(F.transform("_segs", on_segment))), ["_cells"])
    d = d.withColumn("_c", F.explode(F.array_distinct("_cells")))
    hits = F.size(F.filter("_cells", lambda c: c == F.col("_c")))
    return d.select(*keep, "_c.gx", "_c.gy", (hits * F.col("total") / F.col("_n")).alias("m"))


def score_cells(ways: DataFrame, size_m: float = 1000.0, step: float = 20.0) -> DataFrame:
    """Metres of faint and lifecycle evidence and distinct ways per grid cell.

    Ways are reduced to one row per cell they cross before any shuffle. Rows of
    one id in a cell are then joined: an id that comes twice is one way, though
    its metres add up. Partial sums are combined on the map side, so a cell
    that many ways cross is no hot spot.
    """
    tagged = pin(ways.select("id", "geometry", T.evidence_kind(F.col("tags")).alias("evidence")), ["evidence"])
    tagged = tagged.where(F.col("evidence").isNotNull())
    per_way = way_cells(tagged.select("id", "evidence", "geometry"), size_m, step)
    per_way = per_way.groupBy("gx", "gy", "id").agg(
        *[F.sum(F.when(F.col("evidence") == e, F.col("m"))).alias(e) for e in ("faint", "lifecycle")])
    cells = per_way.groupBy("gx", "gy").agg(
        F.coalesce(F.sum("faint"), F.lit(0.0)).alias("_f"), F.coalesce(F.sum("lifecycle"), F.lit(0.0)).alias("_l"),
        F.count("*").alias("n_ways"))
    return cells.select(
        F.col("gx").cast("bigint").alias("gx"), F.col("gy").cast("bigint").alias("gy"),
        F.rint("_f").cast("bigint").alias("faint_m"), F.rint("_l").cast("bigint").alias("lifecycle_m"),
        F.rint(F.col("_f") + F.col("_l")).cast("bigint").alias("total_m"), "n_ways")


def exclude_zones(cells: DataFrame, zones: DataFrame, size_m: float = 1000.0,
                  buffer_m: float = K.EXCLUSION_BUFFER_M) -> DataFrame:
    """Drop grid cells that touch a buffered square around a zone centre.

    Every zone lists the cells it touches by arithmetic, so the overlap test is
    an anti equi-join on the cell key and never compares all pairs.
    """
    half = F.col("size_m") / 2.0 + buffer_m
    ring = zones.select((F.col("x") - half).alias("ax"), (F.col("x") + half).alias("bx"),
                        (F.col("y") - half).alias("ay"), (F.col("y") + half).alias("by"))

    def touched(lo: str, hi: str) -> Column:
        return F.sequence(F.ceil(F.col(lo) / size_m) - 1, F.floor(F.col(hi) / size_m))

    hit = ring.select(F.explode(touched("ax", "bx")).alias("gx"), "ay", "by")
    hit = hit.select("gx", F.explode(touched("ay", "by")).alias("gy")).distinct()
    return cells.join(hit, ["gx", "gy"], "left_anti")


def cell_centres(cells: DataFrame, size_m: float, zone: int) -> DataFrame:
    """Adds the cell centre's longitude and latitude at five decimals."""
    from ridgeline.functions.geodesy import with_lonlat

    d = cells.withColumns({"_x": (F.col("gx") + 0.5) * size_m, "_y": (F.col("gy") + 0.5) * size_m})
    d = with_lonlat(d, "_x", "_y", F.lit(zone)).drop("_x", "_y")
    return d.withColumns({"lon": F.round("lon", 5), "lat": F.round("lat", 5)})


def select_cells(cells: DataFrame, covered: DataFrame | None, limit: int,
                 min_m: float = K.MIN_EVIDENCE_M) -> DataFrame:
    """The ``limit`` richest covered cells holding at least ``min_m``.

    ``covered`` maps cells to a survey ``project``; cells without one are
    skipped before the limit is taken. Ties are ordered by cell.
    """
    d = cells.where(F.col("total_m") >= min_m)
    if covered is not None:
        d = d.join(covered.where(F.col("project").isNotNull()), ["gx", "gy"])
    return d.orderBy(F.desc("total_m"), "gx", "gy").limit(limit)


def clip_segments(segments: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Liang-Barsky clip to one rectangle, with the kept parameter range."""
    return clip_to(segments, F.lit(x0), F.lit(y0), F.lit(x1), F.lit(y1))


def clip_to(segments: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """Clip every segment to its own rectangle; outside segments are dropped."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    lo, hi = F.lit(0.0), F.lit(1.0)
    ok = F.lit(True)
    for d, a, b in ((dx, x0 - F.col("x0"), x1 - F.col("x0")), (dy, y0 - F.col("y0"), y1 - F.col("y0"))):
        ta, tb = F.try_divide(a, d), F.try_divide(b, d)
        lo = F.greatest(lo, F.when(d > 0, ta).when(d < 0, tb).otherwise(F.lit(0.0)))
        hi = F.least(hi, F.when(d > 0, tb).when(d < 0, ta).otherwise(F.lit(1.0)))
        ok = ok & ((d != 0) | ((a <= 0) & (b >= 0)))
    d = pin(segments.withColumns({"_t0": lo, "_t1": hi, "_ok": ok}), ["_t0", "_t1", "_ok"])
    d = d.where(F.col("_ok") & (F.col("_t0") < F.col("_t1"))).drop("_ok")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return d.withColumns({
        "cx0": F.col("x0") + dx * F.col("_t0"), "cy0": F.col("y0") + dy * F.col("_t0"),
        "cx1": F.col("x0") + dx * F.col("_t1"), "cy1": F.col("y0") + dy * F.col("_t1"),
        "clen": F.col("len") * (F.col("_t1") - F.col("_t0")),
    })


def clipped_parts(clipped: DataFrame, keys: list[str]) -> DataFrame:
    """Number the clipped segments of a way into connected ``part``s.

    A new part starts whenever the previous segment did not run up to this
    one's start. ``keys`` must identify one way in one extent; its segments are bounded by
    the way's own vertex array.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("seg")
    joins_prev = (F.lag("seg").over(w) == F.col("seg") - 1) & (F.lag("_t1").over(w) == 1.0) & (F.col("_t0") == 0.0)
    d = clipped.withColumn("_new", F.when(F.coalesce(joins_prev, F.lit(False)), 0).otherwise(1))
    d = d.withColumn("part", F.sum("_new").over(w).cast("bigint"))
    return d.drop("_new")
