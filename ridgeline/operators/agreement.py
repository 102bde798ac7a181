"""Checking a published elevation raster against our own grid."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline import constants as K
from ridgeline.operators import grid as G
from ridgeline.operators.lineage import cut
from ridgeline.operators.ranks import exact_quantiles

CLIP = math.tan(math.radians(K.SLOPE_CLIP_DEG))


def slope_clip(cells: DataFrame, meta: DataFrame, res: float, values: dict[str, str]) -> DataFrame:
    """Gradient magnitudes clipped at tan 60 degrees, of several rasters at once; NULL beside a hole."""
    names = {v: (f"_gx_{v}", f"_gy_{v}") for v in values}
    g = G.gradients_of(cells, meta, res, names)
    return g.withColumns({out: G._clamp(F.hypot(*names[v]), 0.0, CLIP) for v, out in values.items()}).drop(*[n for pair in names.values() for n in pair])


def dem_agreement(ours: DataFrame, published: DataFrame, meta: DataFrame, k: int, res: float = K.BODY_RES,
                  margin: int = K.AGREEMENT_MARGIN_PX, min_cells: int = K.MIN_OVERLAP_CELLS,
                  min_corr: float = K.MIN_SLOPE_CORR) -> DataFrame:
    """Correlation of clipped slopes and median offset per tile, with a verdict.

    ``ours`` is dense at ``1/k`` of the published pixel; ``published`` is dense
    on the body grid.
    """
    body = G.block_reduce(ours, meta, k, {"z": ("z", "nanmean")})
    size = meta.select("tile", F.floor(F.col("height") / k).alias("height"), F.floor(F.col("width") / k).alias("width"))
    # Margins and shares are those of the ground that both rasters cover.
    theirs = published.groupBy("tile").agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    size = size.join(theirs, "tile").select("tile", F.least("height", "_h").alias("height"), F.least("width", "_w").alias("width"))
    both = published.select("tile", "row", "col", F.col("z").alias("zp")).join(body, ["tile", "row", "col"])
    # One exchange of halo blocks for both rasters; what follows reads its result four times.
    s = cut(G.with_size(slope_clip(both, size, res, {"z": "_so", "zp": "_sp"}), size))
    inner = (F.col("row").between(F.lit(margin), F.col("height") - 1 - margin)
             & F.col("col").between(F.lit(margin), F.col("width") - 1 - margin))
    real = inner & F.col("z").isNotNull() & F.col("zp").isNotNull()
    s = s.withColumns({"_real": real, "_use": real & F.col("_so").isNotNull() & F.col("_sp").isNotNull()})
    used = s.where("_use")
    # a constant slope has no correlation: NULL, not an arithmetic error
    r = F.try_divide(F.covar_pop("_so", "_sp"), F.stddev_pop("_so") * F.stddev_pop("_sp"))
    stats = used.groupBy("tile").agg(r.alias("_r"))
    off = exact_quantiles(used.withColumn("_o", F.col("zp") - F.col("z")), ["tile"], "_o", {"_med": 0.5})
    base = s.groupBy("tile").agg(F.count_if("_real").alias("_n"), F.avg(F.col("zp").isNull().cast("double")).alias("_nan"))
    d = base.join(stats, "tile", "left").join(off, "tile", "left")
    few = F.col("_n") < min_cells
    return d.select(
        "tile", F.when(~few, F.round("_r", 3)).alias("slope_corr"), F.when(~few, F.round("_med", 3)).alias("median_offset_m"),
        F.round("_nan", 4).alias("nan_frac"),
        F.when(few, "too few cells in common").when(
            F.coalesce(F.col("_r") < min_corr, F.lit(True)), "slopes do not agree").alias("error"))
