"""Point-cloud operators: gridding, neighbour search, height above ground.

Points are ``(tile, x, y, z, cls)``. Row 0 of a grid is its north edge.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgeline import constants as K
from ridgeline.operators import grid as G
from ridgeline.operators.lineage import cut
from ridgeline.operators.ranks import exact_quantiles, keyed_join, measured


def drop_noise(points: DataFrame) -> DataFrame:
    return points.where(~F.col("cls").isin(*K.NOISE_CLASSES))


def ground(points: DataFrame) -> DataFrame:
    return points.where(F.col("cls") == K.GROUND_CLASS)


def grid_bounds(points: DataFrame, res: float) -> DataFrame:
    """One resolution-aligned extent per tile, with the grid's height and width."""
    b = points.groupBy("tile").agg(
        (F.floor(F.min("x") / res) * res).alias("x0"), (F.floor(F.min("y") / res) * res).alias("y0"),
        (F.ceil(F.max("x") / res) * res).alias("x1"), (F.ceil(F.max("y") / res) * res).alias("y1"))
    return b.withColumns({
        "height": F.greatest(F.rint((F.col("y1") - F.col("y0")) / res), F.lit(1.0)).cast("bigint"),
        "width": F.greatest(F.rint((F.col("x1") - F.col("x0")) / res), F.lit(1.0)).cast("bigint"),
    })


def cells_in_reach(points: DataFrame, meta: DataFrame, res: float, radius: float) -> DataFrame:
    """Each point once per cell whose centre lies within ``radius``, with ``dist``.

    ``radius`` bounds the copies per point, and what follows is always an
    aggregation by cell, so the copies are combined before they are shuffled.
    """
    d = keyed_join(points, meta.select("tile", "x0", "y1", "height", "width"), ["tile"])
    u, v = (F.col("x") - F.col("x0")) / res, (F.col("y1") - F.col("y")) / res
    r = radius / res

    def span(at: Column, n: str) -> Column:
        lo = F.greatest(F.ceil(at - r - 0.5), F.lit(0))
        hi = F.least(F.floor(at + r - 0.5), F.col(n) - 1)
        return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi)))

    d = d.withColumn("col", F.explode(span(u, "width")))
    d = d.withColumn("row", F.explode(span(v, "height")))
    dx = F.col("x") - (F.col("x0") + (F.col("col") + 0.5) * res)
    dy = F.col("y") - (F.col("y1") - (F.col("row") + 0.5) * res)
    d = d.withColumn("dist", F.sqrt(dx * dx + dy * dy)).where(F.col("dist") <= radius)
    return d.drop("x0", "y1", "height", "width")


def _radius(res: float, radius: float | None) -> float:
    return res * math.sqrt(2.0) if radius is None else radius


def grid_idw(points: DataFrame, meta: DataFrame, res: float, power: float = 6.0,
             radius: float | None = None, value: str = "z") -> DataFrame:
    """Inverse-distance weighted grid; a point on the centre decides the cell."""
    d = cells_in_reach(points, meta, res, _radius(res, radius))
    hit = F.col("dist") == 0
    wt = F.when(~hit, F.pow(F.col("dist"), F.lit(-power)))
    return d.groupBy("tile", "row", "col").agg(
        F.coalesce(F.avg(F.when(hit, F.col(value))), F.sum(F.col(value) * wt) / F.sum(wt)).alias("z"))


def grid_max(points: DataFrame, meta: DataFrame, res: float, value: str, radius: float | None = None) -> DataFrame:
    d = cells_in_reach(points, meta, res, _radius(res, radius))
    return d.groupBy("tile", "row", "col").agg(F.max(value).alias("max"))


def grid_count(points: DataFrame, meta: DataFrame, res: float, predicates: dict[str, Column],
               radius: float | None = None) -> DataFrame:
    """Several conditional counts in one aggregation."""
    d = cells_in_reach(points, meta, res, _radius(res, radius))
    return d.groupBy("tile", "row", "col").agg(*[F.count_if(p).alias(n) for n, p in predicates.items()])


def canopy_grids(points: DataFrame, meta: DataFrame, res: float, radius: float | None = None) -> DataFrame:
    """Canopy height and low/high vegetation counts from ``hag``, in one pass.

    A cell where no point counts is empty, not 0, so that it may be filled.
    """
    d = cells_in_reach(points, meta, res, _radius(res, radius))

    def count(p: Column) -> Column:
        return F.nullif(F.count_if(p), F.lit(0).cast("bigint")).cast("double")

    return d.groupBy("tile", "row", "col").agg(
        F.max("hag").alias("chm"), count(F.col("hag") < 0.8).alias("low"), count(F.col("hag") <= 12).alias("high"))


def fill_window(dense: DataFrame, meta: DataFrame, windows: dict[str, int], block: int = G.BLOCK) -> DataFrame:
    """Fill empty cells from filled ones within ``n`` cells, weighted by 1/distance.

    ``windows`` gives ``n`` per band. A window of 12 has 440 neighbours, so
    looking them up by key would multiply the empty cells; each halo block is
    worked as one small array instead, all bands in the same shuffle.
    """
    import numpy as np
    import pandas as pd

    reach = max(windows.values())
    keep = [c for c in dense.columns if c not in ("tile", "row", "col")]
    d = G.haloed(dense, meta, keep, reach, reach, "truncate", block, fill=False)
    schema = T.StructType([dense.schema[c] for c in ("tile", "row", "col", *keep)])
    offsets = {band: [(i, j, 1.0 / math.hypot(i, j)) for i in range(-n, n + 1) for j in range(-n, n + 1)
                      if 0 < math.hypot(i, j) <= n] for band, n in windows.items()}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["row"].min(), pdf["col"].min()
        h, w = pdf["row"].max() - r0 + 1, pdf["col"].max() - c0 + 1
        at = (pdf["row"] - r0 + reach, pdf["col"] - c0 + reach)
        home = pdf["home"].to_numpy()
        res = pdf.loc[home, ["tile", "row", "col", *keep]].copy()
        for band, around in offsets.items():
            gaps = pdf[band].isna().to_numpy() & home
            if not gaps.any():
                continue
            value, real = np.zeros((h + 2 * reach, w + 2 * reach)), np.zeros((h + 2 * reach, w + 2 * reach))
            value[at] = pdf[band].fillna(0.0)
            real[at] = pdf[band].notna()
            rr, cc = at[0].to_numpy()[gaps], at[1].to_numpy()[gaps]
            total, weight = np.zeros(len(rr)), np.zeros(len(rr))
            for i, j, wt in around:
                total += wt * value[rr + i, cc + j]
                weight += wt * real[rr + i, cc + j]
            fill = np.full(len(rr), np.nan)
            np.divide(total, weight, out=fill, where=weight > 0)
            res.loc[pdf.index[gaps], band] = fill
        return res

    return d.groupBy(*G.KEY).applyInPandas(one, schema)


def _buckets(df: DataFrame, s: float, around: bool, axes: str = "xy") -> DataFrame:
    """Cubic buckets of side ``s``; with ``around``, once per adjoining bucket."""
    for c in axes:
        at = F.floor(F.col(c) / s)
        df = df.withColumn(f"b{c}", F.explode(F.sequence(at - 1, at + 1)) if around else at)
    return df


def height_above_ground(points: DataFrame, cell: float) -> DataFrame:
    """Adds ``hag``: z minus the z of the nearest ground point in plan.

    Blocks with a halo of ``cell`` answer all points that have ground within
    it. The few that have none look again in buckets of twice the size, until
    none is left. Ground points at one position are collapsed first, so a pile
    of copies is one candidate. Only a tile without any ground point leaves
    ``hag`` empty.
    """
    import numpy as np
    import pandas as pd

    from ridgeline.operators import neighbours as NB

    cand = ground(points).where("z is not null").groupBy("tile", "x", "y").agg(F.min("z").alias("_gz"))
    spots = points.select("tile", "x", "y").distinct().join(cand.select("tile").distinct(), "tile", "left_semi")
    both = NB.into_blocks(cand, cell).drop("home").unionByName(
        NB.into_blocks(spots, cell).where("home").drop("home").withColumn("_gz", F.lit(None).cast("double")))
    tile = points.schema["tile"]

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        g = pdf["_gz"].notna().to_numpy()
        own, low = pdf[~g], pdf[g]
        d, z, sure = NB.nearest_below(*(low[c].to_numpy() for c in ("x", "y", "_gz")), own["x"].to_numpy(), own["y"].to_numpy(), cell)
        return pd.DataFrame({"tile": own["tile"], "x": own["x"], "y": own["y"], "_d": d, "_gz": np.where(np.isinf(d), np.nan, z), "sure": sure})

    best = cut(both.groupBy("tile", "bx", "by").applyInPandas(nearest, T.StructType([tile, *_doubles("x", "y", "_d", "_gz"), T.StructField("sure", T.BooleanType())])))
    found, todo, s = best.where("sure").select("tile", "x", "y", "_gz"), best.where("not sure").select("tile", "x", "y"), cell
    while not todo.isEmpty():
        s *= 2
        near = _buckets(cand, s, False).withColumnsRenamed({"x": "_gx", "y": "_gy"})
        j = _buckets(todo, s, True).join(near, ["tile", "bx", "by"], "left")
        dx, dy = F.col("x") - F.col("_gx"), F.col("y") - F.col("_gy")
        j = j.withColumn("_d", dx * dx + dy * dy)
        best = j.groupBy("tile", "x", "y").agg(F.min(F.when(F.col("_d").isNotNull(), F.struct("_d", "_gz"))).alias("_b"))
        best = cut(best.select("tile", "x", "y", F.col("_b._d").alias("_d"), F.col("_b._gz").alias("_gz")))
        sure = F.col("_d").isNotNull() & (F.col("_d") <= s * s)
        found = found.unionByName(best.where(sure).select("tile", "x", "y", "_gz"))
        todo = best.where(~sure).select("tile", "x", "y")
    return points.join(found, ["tile", "x", "y"], "left").withColumn("hag", F.col("z") - F.col("_gz")).drop("_gz")


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


#: Boxes of points along one side of a bucket, and growth of buckets from round to round.
BOXES, WIDER = 8, 4


def _boxes(spots: DataFrame, side: float) -> DataFrame:
    """Occupied cubes (``cx``, ``cy``, ``cz``) of ``side``: how many points stand in each, and how far they reach."""
    d = spots.withColumns({f"c{c}": F.floor(F.col(c) / side) for c in "xyz"})
    return d.groupBy("tile", "cx", "cy", "cz").agg(
        F.sum("m").alias("_n"), *[f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])


def _wider(boxes: DataFrame) -> DataFrame:
    """The boxes of ``WIDER`` times the side."""
    d = boxes.withColumns({f"c{c}": F.floor(F.col(f"c{c}") / WIDER) for c in "xyz"})
    return d.groupBy("tile", "cx", "cy", "cz").agg(
        F.sum("_n").alias("_n"), *[f(f"_{n}{c}").alias(f"_{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])


def _boxes_in_reach(todo: DataFrame, boxes: DataFrame, s: float, k: int) -> DataFrame:
    """Each point of ``todo`` with the boxes in which its ``k`` nearest may be, as far as they stand within ``s``.

    The buckets of side ``s`` around a point hold at most ``27 * BOXES ** 3`` boxes, however many points
    those hold. A box is left out where others that lie wholly nearer have ``k`` points already.
    """
    one, side = ["tile", "x", "y", "z"], s / BOXES
    near = boxes.withColumns({f"b{c}": F.floor(F.col(f"c{c}") / BOXES) for c in "xyz"})
    d = _buckets(todo, s, True, "xyz").join(near, ["tile", "bx", "by", "bz"])
    least, most, home = F.lit(0.0), F.lit(0.0), F.lit(True)
    for c in "xyz":
        low, high = F.col(f"_lo{c}") - F.col(c), F.col(c) - F.col(f"_hi{c}")
        gap = F.greatest(low, high, F.lit(0.0))
        wide = F.greatest(F.abs(low), F.abs(high))
        least, most = least + gap * gap, most + wide * wide
        home = home & (F.floor(F.col(c) / side) == F.col(f"c{c}"))
    d = d.withColumns({"_least": least, "_most": most, "_n": F.col("_n") - F.when(home, F.col("m")).otherwise(0)})
    upto = Window.partitionBy(*one).orderBy("_most").rowsBetween(Window.unboundedPreceding, 0)
    # the copies of the point itself are its neighbours too, but for one
    d = d.withColumn("_held", F.sum("_n").over(upto) + F.col("m") - 1)
    bound = F.min(F.when(F.col("_held") >= k, F.col("_most"))).over(Window.partitionBy(*one))
    d = d.withColumn("_bound", bound * (1 + 1e-9))  # sums of squares may differ in their last digits
    return d.where(F.col("_bound").isNull() | (F.col("_least") <= F.col("_bound"))).select(*one, "m", "_others", "cx", "cy", "cz")


def neighbour_distance(points: DataFrame, cell: float, k: int = 8) -> DataFrame:
    """Mean distance in space to the ``k`` nearest other points, per position.

    Points at one position are one row with a multiplicity ``m``, so copies
    never multiply into pairs. Blocks with a halo of ``cell`` answer the points
    that have enough neighbours within it; the rest look in cubes of ``WIDER`` times
    the size, and so on: first at the boxes of points there, then at the points of
    those boxes that may hold a nearest one. A tile of ``k`` points or fewer
    averages all others; a point alone in its tile has none.
    """
    import pandas as pd

    from ridgeline.operators import neighbours as NB

    # a point without height is at no distance from any
    points = points.where(F.col("z").isNotNull() & ~F.isnan("z"))
    spots = points.groupBy("tile", "x", "y", "z").agg(F.count("*").alias("m"))
    others = points.groupBy("tile").agg((F.count("*") - 1).alias("_others"))
    spots = cut(keyed_join(spots, measured(others), ["tile"]))
    tile = points.schema["tile"]

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        home = pdf["home"].to_numpy()
        mean, sure = NB.mean_of_nearest(*(pdf[c].to_numpy() for c in ("x", "y", "z", "m", "home", "_others")), k, cell)
        return pdf.loc[home, ["tile", "x", "y", "z", "m", "_others"]].assign(mean_dist=mean, sure=sure)

    counts = [T.StructField(n, T.LongType()) for n in ("m", "_others")]
    schema = T.StructType([tile, *_doubles("x", "y", "z"), *counts, *_doubles("mean_dist"), T.StructField("sure", T.BooleanType())])
    key = ("tile", "bx", "by", "bz")
    blocks = NB.into_blocks(spots, cell, "xyz").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    best = cut(blocks.groupBy(*key).applyInPandas(nearest, schema))
    answer = ["tile", "x", "y", "z", "m", "mean_dist"]
    found, todo, s, boxes = best.where("sure").select(*answer), best.where("not sure").drop("sure", "mean_dist"), cell, None
    while not todo.isEmpty():
        s *= WIDER
        boxes = cut(_boxes(spots, s / BOXES) if boxes is None else _wider(boxes))
        near = spots.select("tile", *[F.floor(F.col(c) / (s / BOXES)).alias(f"c{c}") for c in "xyz"],
                            *[F.col(c).alias(f"_{c}") for c in "xyzm"])
        j = measured(_boxes_in_reach(todo, boxes, s, k)).join(near, ["tile", "cx", "cy", "cz"])
        dx, dy, dz = (F.col(c) - F.col(f"_{c}") for c in ("x", "y", "z"))
        j = j.withColumn("_d", F.sqrt(dx * dx + dy * dy + dz * dz))
        j = j.withColumn("_m", F.when(F.col("_d") == 0, F.col("m") - 1).otherwise(F.col("_m")))
        one = Window.partitionBy("tile", "x", "y", "z").orderBy("_d", "_x", "_y", "_z")
        j = j.withColumn("_rn", F.row_number().over(one)).where(F.col("_rn") <= k + 1)
        j = j.withColumn("_before", F.coalesce(F.sum("_m").over(one.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        take = F.least(F.col("_m"), F.greatest(F.lit(k) - F.col("_before"), F.lit(0)))
        best = cut(j.groupBy("tile", "x", "y", "z", "m", "_others").agg(
            F.try_divide(F.sum(F.col("_d") * take), F.sum(take)).alias("mean_dist"), F.sum(take).alias("_got"),
            F.max(F.when(take > 0, F.col("_d"))).alias("_far")))
        sure = F.coalesce((F.col("_got") == F.col("_others")) | ((F.col("_got") == k) & (F.col("_far") <= s)), F.lit(False))
        found = found.unionByName(best.where(sure).select(*answer))
        todo = best.where(~sure).select("tile", "x", "y", "z", "m", "_others")
    return found


def drop_outliers(points: DataFrame, cell: float, k: int = 8, multiplier: float = 3.0) -> DataFrame:
    """Drop points whose mean neighbour distance is far above the tile's own.

    The spread is summed around the mean in a second pass, so that large counts
    do not cancel.
    """
    dist = neighbour_distance(points, cell, k)
    m, v = F.col("m"), F.col("mean_dist")
    means = dist.where(v.isNotNull()).groupBy("tile").agg(F.sum(m).alias("_n"), (F.sum(m * v) / F.sum(m)).alias("_mean"))
    dist = keyed_join(dist, measured(means), ["tile"])
    off = v - F.col("_mean")
    spread = dist.groupBy("tile").agg(F.sqrt(F.try_divide(F.sum(m * off * off), F.max("_n") - 1)).alias("_sd"))
    far = keyed_join(dist, measured(spread), ["tile"]).where(off > F.coalesce("_sd", F.lit(0.0)) * multiplier)
    return points.join(far.select("tile", "x", "y", "z"), ["tile", "x", "y", "z"], "left_anti")


def point_stats(points: DataFrame, size_m: float, min_ground: int = K.MIN_GROUND_POINTS) -> DataFrame:
    """Counts, densities and median ground elevation per tile; a data hole is an error row."""
    is_ground = F.col("cls") == K.GROUND_CLASS
    base = points.groupBy("tile").agg(F.count("*").alias("points"), F.count_if(is_ground).alias("ground_points"))
    med = exact_quantiles(ground(points), ["tile"], "z", {"_med": 0.5})
    area = float(size_m) ** 2
    d = base.join(med, "tile", "left")
    few = F.col("ground_points") < min_ground
    return d.select(
        "tile", "points", F.round(F.col("points") / area, 1).alias("density"),
        F.round(F.col("ground_points") / area, 1).alias("ground_density"),
        F.round(F.col("ground_points") * 100 / F.col("points"), 1).alias("ground_frac"),
        F.when(~few, F.round("_med", 1)).alias("elev_median"),
        F.when(few, F.concat(F.lit("only "), F.col("ground_points").cast("string"),
                             F.lit(" ground points"))).alias("error"))


def check_complete(declared: DataFrame, points: DataFrame) -> DataFrame:
    """Tiles whose declared point count is not what was decoded."""
    got = points.groupBy("tile").agg(F.count("*").alias("decoded"))
    d = declared.select("tile", "declared").join(got, "tile", "left").withColumn(
        "decoded", F.coalesce("decoded", F.lit(0).cast("bigint")))
    return d.withColumn("truncated", F.col("declared") != F.col("decoded"))
