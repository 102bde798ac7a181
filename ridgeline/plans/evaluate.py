"""Evaluate: whole tiles through a scorer to one record per variant and tile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline import constants as K
from ridgeline.operators import inference as N
from ridgeline.operators import sampling as SM
from ridgeline.operators import scoring as S
from ridgeline.operators.lineage import cut


@dataclass(frozen=True)
class Variant:
    """What a variant reads: elevation reduced by ``z_scale``, ``stride`` pixels a body pixel, canopy bands, and whose elevation."""

    scorer: Callable
    z_scale: int
    stride: int
    canopy: tuple[str, ...] = ()
    published: bool = False


def evaluate(native: DataFrame, meta: DataFrame, variants: dict[str, Variant], label_scale: int, body_tile: int, overlap: float,
             advisories: DataFrame | None = None, tta: bool = False, published: DataFrame | None = None,
             published_meta: DataFrame | None = None) -> DataFrame:
    """Every variant's record of every tile; ``skipped`` says why a tile has none.

    A variant of published elevation reads ``published`` and never the native
    grid in its place. Rasters too small for a window are skipped as well.
    """
    out = []
    for name, v in variants.items():
        if v.published and (published is None or published_meta is None):
            raise ValueError(f"{name} reads published elevation, and none is given")
        own = published_meta.select("tile", "height", "width") if v.published else None
        z, lab = SM.full_tile(native, meta, v.z_scale, label_scale, v.canopy, published if v.published else None, own)
        size = meta.select("tile", F.floor(F.col("height") / label_scale).alias("height"), F.floor(F.col("width") / label_scale).alias("width"))
        skipped = []
        if v.published:
            skipped = [SM.tiles_without(size, published_meta)]
            size = size.alias("a").join(own.alias("b"), "tile").select("tile", F.least("a.height", "b.height").alias("height"), F.least("a.width", "b.width").alias("width"))
        fine = size.withColumns({c: F.col(c) * v.stride for c in ("height", "width")})
        tile = body_tile * v.stride
        small = N.too_small(fine, tile)
        skipped.append(small.withColumnRenamed("error", "reason"))
        fine = fine.join(small, "tile", "left_anti")
        prob = N.predict(z, fine, v.scorer, tile, N.window_step(tile, overlap, v.stride), v.stride, tta, canopy=v.canopy)
        # the scorer is by far the dearest step: run it once, then score what it wrote
        cells = cut(prob.join(lab, ["tile", "row", "col"]).withColumnRenamed("class", "code"))
        scored = S.evaluate_tiles(cells, size, K.BODY_RES, advisories).withColumn("skipped", F.lit(None).cast("string"))
        none = reduce(DataFrame.unionByName, skipped).withColumnRenamed("reason", "skipped")
        out.append(scored.unionByName(none, allowMissingColumns=True).withColumn("variant", F.lit(name)))
    return reduce(DataFrame.unionByName, out)
