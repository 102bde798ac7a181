"""Build: from points and ways to elevation, features, labels and manifests.

Every step is a DataFrame over all tiles at once; a tile is a key, never a job.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import constants as K
from ridgeline import schemas as S
from ridgeline.functions.geodesy import utm_epsg
from ridgeline.operators import features as FT
from ridgeline.operators import grid as G
from ridgeline.operators import inference as N
from ridgeline.operators import labels as L
from ridgeline.operators import points as P
from ridgeline.operators import polygons as PG
from ridgeline.operators import registry as RG
from ridgeline.operators.lineage import cut
from ridgeline.sources.rasters import write_tiles
from ridgeline.sources.readers import write_documents

DTM_FILL_PX = 12
CANOPY_FILL_PX = 3
COUNT_FILL_PX = 5


def build_dtm(points: DataFrame, meta: DataFrame, res: float, knn_cell: float,
              fill_px: int = DTM_FILL_PX) -> DataFrame:
    """Dense bare-earth elevation: ground returns, outliers out, gridded, small gaps filled."""
    ground = P.drop_outliers(P.ground(points), knn_cell)
    dtm = G.densify(P.grid_idw(ground, meta, res), meta)
    return P.fill_window(dtm, meta, {"z": fill_px})


def build_canopy(points: DataFrame, meta: DataFrame, res: float, hag_cell: float) -> DataFrame:
    """Canopy height and vegetation counts, empty cells filled from close ones."""
    hag = P.height_above_ground(points, hag_cell)
    d = G.densify(P.canopy_grids(hag, meta, res), meta)
    d = P.fill_window(d, meta, {"chm": CANOPY_FILL_PX, "low": COUNT_FILL_PX, "high": COUNT_FILL_PX})
    return d.withColumns({b: F.coalesce(b, F.lit(0.0)) for b in ("chm", "low", "high")})


def build_features(points: DataFrame, res: float, knn_cell: float, hag_cell: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Grid metadata, elevation with nodata, and the six-band feature stack."""
    clean = P.drop_noise(points)
    meta = P.grid_bounds(clean, res)
    dtm = build_dtm(clean, meta, res, knn_cell)
    canopy = build_canopy(clean, meta, res, hag_cell)
    filled = G.fill_median(dtm).where(F.col("error").isNull()).drop("error")
    return meta, dtm, FT.feature_stack(filled, canopy, meta, res)


def build_labels(segments: DataFrame, dtm: DataFrame, meta: DataFrame, water_tiles: DataFrame | None = None) -> DataFrame:
    """Label planes, with flat water ignored on the tiles that are flagged for it."""
    planes = L.label_planes(segments, meta)
    if water_tiles is None:
        return planes
    wet = dtm.join(water_tiles.select("tile"), "tile", "left_semi")
    wet_meta = meta.join(water_tiles.select("tile"), "tile", "left_semi")
    return FT.water_mask(wet, planes, wet_meta)


def manifests(aois: DataFrame, points: DataFrame, rasters: DataFrame, labels: DataFrame, res: float,
              projects: DataFrame | None = None, faults: DataFrame | None = None, agreement: DataFrame | None = None) -> DataFrame:
    """One nested row per area; whatever is missing or failed shows as ``error``.

    ``points``, ``rasters`` and ``labels`` are the per-tile summaries, keyed by
    the area's ``key`` in column ``tile``; so are ``faults`` (tile, error), found
    by other steps, and ``agreement`` with published elevation. ``projects`` is
    (key, project). See :func:`ridgeline.operators.registry.manifest_rows`.
    """
    p = points.select(F.col("tile").alias("key"), F.col("error").alias("_perr"), F.struct(
        "points", "density", "ground_density", "ground_frac", "elev_median").alias("points"))
    r = rasters.select(F.col("tile").alias("key"), F.struct(
        "height", "width", "valid_frac", "elev_min", "elev_max", "relief").alias("raster"))
    by_class = F.create_map(*[x for c in K.CLASS_CODE for x in (F.lit(c), F.col(f"km_{c}") if f"km_{c}" in labels.columns else F.lit(None).cast("double"))])
    lab = labels.select(F.col("tile").alias("key"), F.struct(
        F.col("km").alias("trail_km"), by_class.alias("trail_km_by_class"), "positive_frac", "ignore_frac").alias("labels"))
    d = aois.join(p, "key", "left").join(r, "key", "left").join(lab, "key", "left")
    extra = {"project": projects, "_fault": faults and faults.select(F.col("tile").alias("key"), F.col("error").alias("_fault")),
             "dem": agreement and agreement.select(F.col("tile").alias("key"), F.struct("slope_corr", "median_offset_m").alias("dem"))}
    kinds = {"project": "string", "_fault": "string", "dem": "struct<slope_corr: double, median_offset_m: double>"}
    for name, found in extra.items():
        d = d.withColumn(name, F.lit(None).cast(kinds[name])) if found is None else d.join(found.select("key", name), "key", "left")
    error = F.coalesce("_perr", "_fault", F.when(F.col("points").isNull(), "no points").when(F.col("raster").isNull(), "no raster"))
    whole = error.isNull()
    return d.select(F.struct(*aois.columns).alias("aoi"), F.lit(res).alias("res"), "project", utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"), "points",
                    F.when(whole, F.col("raster")).alias("raster"), F.when(whole, F.col("labels")).alias("labels"), "dem", error.alias("error"))


#: Rasters that a build writes, beside the manifests.
RASTERS = ("dtm", "features", "labels")


def built_manifests(spark: SparkSession, root: str) -> DataFrame:
    """All manifests of a build folder; none where nothing was built yet."""
    try:
        return spark.read.schema(S.MANIFEST).option("basePath", f"{root}/manifests").json(f"{root}/manifests/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], S.MANIFEST)


def build_tiles(aois: DataFrame, points: DataFrame, ways: DataFrame, root: str, res: float, knn_cell: float, hag_cell: float, window_px: int,
                coverage: DataFrame | None = None, force: bool = False, min_ground: int = K.MIN_GROUND_POINTS,
                project_cell: float = 1.0) -> DataFrame:
    """Build the areas that have no good manifest yet below ``root``; returns the manifests of this batch.

    ``points.tile`` and ``aois.key`` are the same text, and ``ways`` are in the
    tiles' metres. Whatever is wrong with one tile - no points, a data hole, no
    ground in its raster, too small for a window of ``window_px`` - becomes the
    ``error`` of its manifest and takes the tile out of the later steps, so it
    stops no other. Tiles are committed in two steps that may both be repeated:
    rasters replace those of the same tiles, and manifests are written after
    them, one folder a tile. A run that ends in between leaves tiles without a
    manifest, and the next run builds them again; so are tiles with an error.
    """
    spark = aois.sparkSession
    good = built_manifests(spark, root).where("error is null").select("aoi.key")
    todo = cut(RG.pending_tiles(aois, good, force))
    one = todo.first()
    if one is None:
        return spark.createDataFrame([], S.MANIFEST)
    own = points.join(todo.select(F.col("key").alias("tile")), "tile", "left_semi")
    stats = cut(P.point_stats(own, one.size_m, min_ground))
    # read by every step below: found once, so that no step joins and filters all points again
    clean = cut(P.drop_noise(own.join(stats.where("error is null").select("tile"), "tile", "left_semi")))
    extents = cut(P.grid_bounds(clean, res))
    faults = N.too_small(extents, window_px)
    clean = clean.join(faults.select("tile"), "tile", "left_anti")
    extents = extents.join(faults.select("tile"), "tile", "left_anti")
    dtm = cut(build_dtm(clean, extents, res, knn_cell))
    filled = cut(G.fill_median(dtm))
    empty = filled.where(F.col("error").isNotNull()).select("tile", "error").distinct()
    faults = cut(faults.unionByName(empty))
    extents = extents.join(empty.select("tile"), "tile", "left_anti")
    canopy = build_canopy(clean.join(empty.select("tile"), "tile", "left_anti"), extents, res, hag_cell)
    features = FT.feature_stack(filled.where(F.col("error").isNull()).drop("error"), canopy, extents, res)
    grid = extents.withColumn("res", F.lit(float(res)))
    # all ways are classified once a batch; what is near no tile plays no part in labels or their summary
    segments = cut(L.segments_near(L.classified_segments(ways), grid))
    wet = todo.where(F.array_contains("flags", "water")).select(F.col("key").alias("tile"))
    planes = build_labels(segments, dtm, grid, None if wet.isEmpty() else wet)
    ok = extents.select("tile")
    for name, cells in zip(RASTERS, (dtm.join(ok, "tile", "left_semi"), features, planes), strict=True):
        write_tiles(cells, f"{root}/{name}")
    read = {n: spark.read.schema(d.schema).parquet(f"{root}/{n}").join(ok, "tile", "left_semi") for n, d in zip(RASTERS, (dtm, features, planes), strict=True)}
    projects = None if coverage is None else PG.find_project(todo.select("key", "lon", "lat"), coverage, cell=project_cell).select("key", "project")
    batch = manifests(todo, stats, FT.raster_summary(read["dtm"]), L.label_stats(read["labels"], segments, grid), res, projects, faults)
    write_documents(batch.withColumn("key", F.col("aoi.key")), f"{root}/manifests", by="key")
    return built_manifests(spark, root).join(todo.select(F.col("key").alias("_key")), F.col("aoi.key") == F.col("_key"), "left_semi")
