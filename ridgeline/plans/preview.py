"""Preview layers of a tile as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.operators import grid as G


def preview_layers(filled: DataFrame, labels: DataFrame, meta: DataFrame, res: float, relief_px: int = 3) -> DataFrame:
    """Hillshade, fine relief in +-0.6 and the label overlays, one row per cell."""
    shade = G.hillshade(filled, meta, res)
    relief = G.micro_relief(filled, meta, relief_px, 0.5, "reflect", out="mrm_2m")
    d = shade.join(relief.select("tile", "row", "col", "mrm_2m"), ["tile", "row", "col"]).join(
        labels.select("tile", "row", "col", "target", "ignore"), ["tile", "row", "col"], "left")
    return d.select(
        "tile", "row", "col", "shade", F.least(F.greatest("mrm_2m", F.lit(-0.6)), F.lit(0.6)).alias("relief"),
        F.when(F.col("target") > 0, 0.75).otherwise(0.0).alias("positive_alpha"),
        F.when(F.col("ignore") > 0, 0.30).otherwise(0.0).alias("ignore_alpha"))
