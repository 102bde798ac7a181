"""Probability overlays: point lookup on the ground."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.rasters import ground_to_cell
from ridgeline.operators.ranks import keyed_join


def prob_at_ground(points: DataFrame, cells: DataFrame, meta: DataFrame, value: str = "prob") -> DataFrame:
    """Value of the cell under each ``(tile, x, y)``; outside the raster is NULL, never 0."""
    d = keyed_join(points, meta.select("tile", "x0", "y1", "res"), ["tile"], "left")
    at = ground_to_cell(F.col("x"), F.col("y"), F.col("x0"), F.col("y1"), F.col("res"))
    d = d.withColumns({"row": at["row"], "col": at["col"]}).drop("x0", "y1", "res")
    return d.join(cells.select("tile", "row", "col", value), ["tile", "row", "col"], "left")
