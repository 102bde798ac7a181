"""Harvest: from tagged ways to ranked grid cells worth surveying."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline import constants as K
from ridgeline.functions import rasters as R
from ridgeline.operators import polygons as PG
from ridgeline.operators import ways as W


def rank_evidence(ways: DataFrame, zones: DataFrame, limit: int, size_m: float = 1000.0,
                  buffer_m: float = K.EXCLUSION_BUFFER_M, min_m: float = K.MIN_EVIDENCE_M,
                  covered: DataFrame | None = None) -> DataFrame:
    """Score, drop cells near curated zones, keep the richest covered ones."""
    cells = W.exclude_zones(W.score_cells(ways, size_m), zones, size_m, buffer_m)
    return W.select_cells(cells, covered, limit, min_m)


def harvest_registry(ways: DataFrame, zones: DataFrame, coverage: DataFrame, limit: int, zone: int = 11,
                     size_m: float = 1000.0, buffer_m: float = K.EXCLUSION_BUFFER_M,
                     min_m: float = K.MIN_EVIDENCE_M, ground_coverage: bool = False) -> DataFrame:
    """The chosen cells as registry rows.

    ``coverage`` is geographic, or in grid metres with ``ground_coverage``.
    """
    cells = W.exclude_zones(W.score_cells(ways, size_m), zones, size_m, buffer_m)
    cells = W.cell_centres(cells.where(F.col("total_m") >= min_m), size_m, zone)
    if ground_coverage:
        at = cells.select("gx", "gy", ((F.col("gx") + 0.5) * size_m).alias("lon"), ((F.col("gy") + 0.5) * size_m).alias("lat"))
        bucket = size_m * 4
    else:
        at, bucket = cells.select("gx", "gy", "lon", "lat"), 1.0
    at = at.withColumn("key", F.struct("gx", "gy"))
    covered = PG.find_project(at, coverage, cell=bucket).select("gx", "gy", "project")
    top = W.select_cells(cells, covered, limit, min_m)
    return top.select(
        R.harvest_key(F.col("lat"), F.col("lon")).alias("key"), "lat", "lon", F.lit("harvest").alias("role"),
        F.lit(int(size_m)).alias("size_m"), "total_m",
        R.harvest_note(F.col("faint_m"), F.col("lifecycle_m"), F.col("n_ways"), F.col("project")).alias("notes"))


def harvest_totals(ways: DataFrame, zones: DataFrame, size_m: float = 1000.0,
                   buffer_m: float = K.EXCLUSION_BUFFER_M, min_m: float = K.MIN_EVIDENCE_M) -> DataFrame:
    """Candidate cells outside the zones, their kilometres, and how many are rich enough."""
    cells = W.exclude_zones(W.score_cells(ways, size_m), zones, size_m, buffer_m)
    return cells.agg(F.count("*").alias("cells"), (F.sum("total_m") / 1000.0).alias("km"),
                     F.count_if(F.col("total_m") >= min_m).alias("eligible"))
