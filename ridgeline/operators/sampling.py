"""Noise, sampling bands, crop plans and crop extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline import constants as K
from ridgeline.functions.noise import below, normal, uniform
from ridgeline.operators import grid as G
from ridgeline.operators.ranks import bucket_rank, hashed_rank, keyed_join


def add_noise(cells: DataFrame, sigma: float, seed: int, value: str = "z") -> DataFrame:
    """White noise per cell."""
    return cells.withColumn(value, F.col(value) + normal(seed, "tile", "row", "col") * sigma)


def add_band_noise(cells: DataFrame, meta: DataFrame | None, sigma: float | Column, scale_px: float | Column, seed: int,
                   value: str = "z", key: tuple[str, ...] = ("tile",)) -> DataFrame:
    """Spatially correlated noise: hashed normals on a coarse grid, bilinear between.

    A coarse node is a pure function of its key, so every cell computes its own
    four corners and nothing is joined. The field is then rescaled to ``sigma``
    over each raster. ``sigma`` and ``scale_px`` may differ from key to key.
    """
    k = F.greatest(scale_px if isinstance(scale_px, Column) else F.lit(float(scale_px)), F.lit(2.0))
    d = cells.withColumn("_k", k).withColumns({"_fr": F.col("row") / F.col("_k"), "_fc": F.col("col") / F.col("_k")})
    r0, c0 = F.floor("_fr"), F.floor("_fc")
    fr, fc = F.col("_fr") - r0, F.col("_fc") - c0

    def node(i: int, j: int):
        return normal(seed, *key, r0 + i, c0 + j)

    up = (node(0, 0) * (1 - fr) * (1 - fc) + node(0, 1) * (1 - fr) * fc
          + node(1, 0) * fr * (1 - fc) + node(1, 1) * fr * fc)
    d = d.withColumn("_up", up).drop("_fr", "_fc", "_k")
    sd = d.groupBy(*key).agg(F.stddev_pop("_up").alias("_sd"))
    d = keyed_join(d, sd, list(key))
    return d.withColumn(value, F.col(value) + F.col("_up") * (sigma / F.greatest(F.col("_sd"), F.lit(1e-9)))).drop(
        "_up", "_sd")


def crop_noise(raw: DataFrame, seed: int, native_res: float, noise_m: float = 0.05, band_noise_m: float = 0.05) -> DataFrame:
    """Noise on the native elevation of each crop, before anything is reduced.

    White noise and band-limited noise, each of a strength drawn for the crop;
    the band's scale is drawn between the published bounds, in metres.
    """
    i, (lo, hi) = F.col("crop_id"), K.BAND_NOISE_SCALE_M
    u = {k: uniform(seed, i, F.lit(k)) for k in ("white", "band", "scale")}
    d = raw
    if noise_m:
        d = d.withColumn("z", F.col("z") + normal(seed, i, "row", "col") * (u["white"] * noise_m))
    if band_noise_m:
        d = add_band_noise(d, None, u["band"] * band_noise_m, (u["scale"] * (hi - lo) + lo) / native_res, seed + 1, key=("crop_id",))
    return d


def split_boundary(labels: DataFrame, meta: DataFrame, crop: int) -> DataFrame:
    """Column of each tile that parts the training band from the validation band.

    About a fifth of the labelled cells fall to its right; the clamp leaves
    both bands more than one crop wide where the tile allows it.
    """
    per_col = labels.where(F.col("target") > 0).groupBy("tile", "col").agg(F.count("*").alias("_n"))
    run = Window.partitionBy("tile").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("tile")
    cum = per_col.withColumns({"_cum": F.sum("_n").over(run), "_total": F.sum("_n").over(every)})
    cut = cum.where(F.col("_cum") >= F.col("_total") * (1 - K.VAL_COL_FRAC)).groupBy("tile").agg(F.min("col").alias("_cut"))
    d = meta.select("tile", "height", "width").join(cut, "tile", "left")
    w = F.col("width")
    lo = F.greatest(F.floor(w * K.BOUNDARY_RANGE[0]), F.lit(crop))
    hi = F.least(F.floor(w * K.BOUNDARY_RANGE[1]), w - (3 * crop) // 2)
    d = d.withColumns({"_lo": lo, "_hi": hi})
    half = F.floor(w / 2)
    d = d.withColumns({
        "_lo2": F.when(F.col("_lo") > F.col("_hi"), half).otherwise(F.col("_lo")),
        "_hi2": F.when(F.col("_lo") > F.col("_hi"), half).otherwise(F.col("_hi"))})
    return d.select("tile", "height", "width", F.when(
        F.col("_cut").isNull(), F.floor(w * (1 - K.VAL_COL_FRAC))).otherwise(
        F.least(F.greatest(F.col("_cut"), F.col("_lo2")), F.col("_hi2"))).cast("bigint").alias("boundary"))


def split_bands(boundary: DataFrame, crop: int, split: str) -> DataFrame:
    """Column band of a split per tile; tiles that cannot hold one crop are dropped."""
    c0 = F.lit(0).cast("bigint") if split == "train" else F.col("boundary")
    c1 = F.col("boundary") if split == "train" else F.col("width")
    d = boundary.select("tile", "height", c0.alias("col0"), c1.alias("col1"))
    return d.where((F.col("col1") - F.col("col0") >= crop) & (F.col("height") >= crop))


def legal_centres(labels: DataFrame, bands: DataFrame, crop: int) -> DataFrame:
    """Labelled cells around which a whole crop stays inside the split band."""
    half = crop // 2
    d = keyed_join(labels.where(F.col("target") > 0).select("tile", "row", "col", "class"), bands, ["tile"])
    return d.where(
        (F.col("row") >= half) & (F.col("row") < F.col("height") - half)
        & (F.col("col") >= F.col("col0") + half) & (F.col("col") < F.col("col1") - half)
    ).select("tile", "row", "col", "class")


def cap_centres(centres: DataFrame, cap: int = K.MAX_CENTRES) -> DataFrame:
    """Every n-th centre in reading order where a (tile, class) has more than ``cap``."""
    n = centres.groupBy("tile", "class").agg(F.count("*").alias("_n"))
    d = bucket_rank(centres, ["tile", "class"], "row", ["col"], "_rank")
    d = keyed_join(d, n, ["tile", "class"])
    step = F.when(F.col("_n") > cap, F.floor(F.col("_n") / cap) + 1).otherwise(F.lit(1))
    return d.where((F.col("_rank") - 1) % step == 0).drop("_rank", "_n")


def class_mix(centres: DataFrame) -> DataFrame:
    """Wanted share of each class that has centres, renormalised, with its centre count."""
    d = centres.groupBy("class").agg(F.count("*").alias("centres"))
    share = F.lit(None).cast("double")
    for name, code in K.CLASS_CODE.items():
        share = F.when(F.col("class") == code, F.lit(K.CLASS_MIX[name])).otherwise(share)
    d = d.withColumn("_w", share)
    # at most one row per class code, so this window is three rows
    return d.withColumn("share", F.col("_w") / F.sum("_w").over(Window.partitionBy(F.lit(1)))).drop("_w")


def draw_crops(centres: DataFrame, bands: DataFrame, n: int, crop: int, label_scale: int = 1,
               positive_frac: float = 0.5, seed: int = 1234) -> DataFrame:
    """A repeatable plan of ``n`` crops: class, then tile, then centre.

    Every choice is a hash of the seed and the crop number, so the plan does
    not depend on how the data is partitioned. The other share is uniform over
    the split bands, and so is every crop where no class has a centre.
    """
    spark = centres.sparkSession
    half = crop // 2
    i = F.col("crop_id")
    d = spark.range(n).select(F.col("id").alias("crop_id"))
    d = d.withColumns({f"_u{k}": uniform(seed, i, F.lit(k)) for k in range(6)})
    mix = class_mix(centres)
    run = Window.partitionBy(F.lit(1)).orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    mix = mix.withColumn("_hi", F.sum("share").over(run))

    pools = centres.groupBy("tile", "class").agg(F.count("*").alias("_nc"))
    pools = hashed_rank(pools, ["class"], ["tile"], "_ti")
    tiles = pools.groupBy("class").agg(F.count("*").alias("_nt"))
    ranked = bucket_rank(centres, ["tile", "class"], "row", ["col"], "_ci")

    # one row holding at most one entry per class code
    pick = mix.join(tiles, "class").groupBy(F.lit(0).alias("_g")).agg(
        F.array_sort(F.collect_list(F.struct("class", "_hi", "_nt"))).alias("_mix"))
    d = d.withColumn("_g", F.lit(0)).join(F.broadcast(pick), "_g", "left")
    by_class = (F.col("_u0") < positive_frac) & F.col("_mix").isNotNull()
    pos = d.where(by_class)
    chosen = F.coalesce(F.get(F.filter("_mix", lambda m: F.col("_u1") < m["_hi"]), F.lit(0)), F.element_at("_mix", -1))
    pos = pos.withColumn("_m", chosen).withColumns({"class": F.col("_m.class"), "_nt": F.col("_m._nt")}).drop("_mix", "_m", "_g")
    pos = pos.withColumn("_ti", below(F.col("_u2"), F.col("_nt")) + 1)
    pos = pos.join(pools, ["class", "_ti"]).withColumn("_ci", below(F.col("_u3"), F.col("_nc")) + 1)
    pos = pos.join(ranked, ["tile", "class", "_ci"]).join(bands, "tile")
    jitter = 2 * (half // 2) + 1
    r = F.col("row") + below(F.col("_u4"), jitter) - half // 2 - half
    c = F.col("col") + below(F.col("_u5"), jitter) - half // 2 - half
    pos = pos.select(
        "crop_id", "tile", F.col("class").cast("bigint").alias("class"),
        F.least(F.greatest(r, F.lit(0)), F.col("height") - crop).alias("row0"),
        F.least(F.greatest(c, F.col("col0")), F.col("col1") - crop).alias("col0"))

    numbered = hashed_rank(bands.withColumn("_g", F.lit(0)), ["_g"], ["tile"], "_ti")
    total = numbered.groupBy("_g").agg(F.count("*").alias("_nt"))
    rest = d.where(~by_class).drop("_mix").join(F.broadcast(total), "_g")
    rest = rest.withColumn("_ti", below(F.col("_u2"), F.col("_nt")) + 1).join(numbered, ["_g", "_ti"])
    rest = rest.select(
        "crop_id", "tile", F.lit(0).cast("bigint").alias("class"),
        below(F.col("_u4"), F.col("height") - crop + 1).alias("row0"),
        (F.col("col0") + below(F.col("_u5"), F.col("col1") - F.col("col0") - crop + 1)).alias("col0"))
    snap = {c: (F.floor(F.col(c) / label_scale) * label_scale).cast("bigint") for c in ("row0", "col0")}
    return pos.unionByName(rest).withColumns(snap)


def crop_cells(plan: DataFrame, cells: DataFrame, crop: int, bands: list[str]) -> DataFrame:
    """Cells of every planned crop, with crop-local ``row`` and ``col``.

    Crops and cells meet on blocks one crop wide, so a crop looks at no more
    than four blocks and a large tile is many keys.
    """
    p = plan.select("crop_id", "tile", "row0", "col0")
    p = p.withColumn("_br", F.explode(F.sequence(F.floor(F.col("row0") / crop), F.floor((F.col("row0") + crop - 1) / crop))))
    p = p.withColumn("_bc", F.explode(F.sequence(F.floor(F.col("col0") / crop), F.floor((F.col("col0") + crop - 1) / crop))))
    c = cells.select("tile", "row", "col", *bands, F.floor(F.col("row") / crop).alias("_br"), F.floor(F.col("col") / crop).alias("_bc"))
    j = p.join(c, ["tile", "_br", "_bc"])
    r, k = F.col("row") - F.col("row0"), F.col("col") - F.col("col0")
    j = j.where((r >= 0) & (r < crop) & (k >= 0) & (k < crop))
    return j.select("crop_id", "tile", r.alias("row"), k.alias("col"), *bands)


LABEL_RULES = {"y": ("target", "max"), "w": ("weight", "mean"), "class": ("class", "min_nonzero"), "cover": ("_valid", "mean")}
#: The same where elevation is read from elsewhere, so that its own grid says where there is ground.
READ_RULES = {k: v for k, v in LABEL_RULES.items() if k != "cover"}


def _trainable(lab: DataFrame) -> DataFrame:
    """Weight 0 unless real ground covers the whole body cell."""
    return lab.withColumn("w", F.when(F.col("cover") > 0.999, F.col("w")).otherwise(F.lit(0.0))).drop("cover")


def _reduce_both(d: DataFrame, meta: DataFrame | None, z_scale: int, label_scale: int, key: str,
                 canopy: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Elevation (and canopy) at its own scale, labels at the body's."""
    d = d.withColumn("_valid", F.col("z").isNotNull().cast("double"))
    z_rules = {"z": ("z", "nanmean"), **{c: (c, "mean") for c in canopy}}
    if z_scale == label_scale:
        both = _trainable(G.block_reduce(d, meta, z_scale, {**z_rules, **LABEL_RULES}, key))
        return both.select(key, "row", "col", *z_rules), both.select(key, "row", "col", "y", "w", "class")
    return (G.block_reduce(d, meta, z_scale, z_rules, key),
            _trainable(G.block_reduce(d, meta, label_scale, LABEL_RULES, key)))


def extract_crops(plan: DataFrame, cells: DataFrame, crop: int, z_scale: int = 1, label_scale: int = 1,
                  canopy: tuple[str, ...] = (), published: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Elevation (with canopy) and label tables per crop, each at its own resolution.

    ``cells`` carries ``z`` (NULL nodata), ``target``, ``weight`` and ``class``
    on the native grid; ``crop`` is a multiple of both scales. With a
    ``published`` raster ``(tile, row, col, z)`` on the body grid, elevation is
    read from it, and a body cell counts where that raster has ground; crops of
    tiles it lacks are left out. See :func:`tiles_without`.
    """
    if published is None:
        raw = crop_cells(plan, cells, crop, ["z", "target", "weight", "class", *canopy]).drop("tile")
        return _reduce_both(raw, None, z_scale, label_scale, "crop_id", canopy)
    have = plan.join(published.select("tile").distinct(), "tile", "left_semi")
    body = have.select("crop_id", "tile", F.floor(F.col("row0") / label_scale).alias("row0"), F.floor(F.col("col0") / label_scale).alias("col0"))
    read = crop_cells(body, published, crop // label_scale, ["z"]).drop("tile")
    raw = crop_cells(have, cells, crop, ["target", "weight", "class", *canopy]).drop("tile")
    rest = G.block_reduce(raw, None, label_scale, {**{c: (c, "mean") for c in canopy}, **READ_RULES}, "crop_id")
    return _read_beside(read, rest, "crop_id", canopy)


def _read_beside(read: DataFrame, rest: DataFrame, key: str, canopy: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Elevation as it was read, with canopy, and labels that count only where it has ground."""
    both = rest.join(read.select(key, "row", "col", "z"), [key, "row", "col"], "left")
    both = both.withColumn("w", F.when(F.col("z").isNotNull(), F.col("w")).otherwise(F.lit(0.0)))
    return both.select(key, "row", "col", "z", *canopy), both.select(key, "row", "col", "y", "w", "class")


def tiles_without(tiles: DataFrame, published: DataFrame) -> DataFrame:
    """Tiles that a variant of published elevation cannot use, with the reason."""
    lack = tiles.select("tile").join(published.select("tile").distinct(), "tile", "left_anti")
    return lack.withColumn("reason", F.lit("skipped: no published elevation"))


def body_crops(plan: DataFrame, cells: DataFrame, crop: int, scale: int = 1, canopy: tuple[str, ...] = (),
               noise_seed: int | None = None, native_res: float = K.BODY_RES) -> DataFrame:
    """Crops whose elevation and labels share the body grid, in one aggregation.

    With ``noise_seed`` the native elevation gets :func:`crop_noise` first.
    """
    raw = crop_cells(plan, cells, crop, ["z", "target", "weight", "class", *canopy]).drop("tile")
    if noise_seed is not None:
        raw = crop_noise(raw, noise_seed, native_res)
    raw = raw.withColumn("_valid", F.col("z").isNotNull().cast("double"))
    rules = {"z": ("z", "nanmean"), **{c: (c, "mean") for c in canopy}, **LABEL_RULES}
    return _trainable(G.block_reduce(raw, None, scale, rules, "crop_id"))


def crop_arrays(crops: DataFrame, bands: list[str]) -> DataFrame:
    """One row-major array per crop and band, for a trainer; a crop is a bounded window."""
    packed = F.array_sort(F.collect_list(F.struct("row", "col", *bands)))
    d = crops.groupBy("crop_id").agg(packed.alias("_p"))
    return d.select("crop_id", *[F.col("_p")[b].alias(b) for b in bands])


def augment(crops: DataFrame, body: int, seed: int, canopy_dropout: float = 0.15, jitter_m: float = 2.0, res: float = K.BODY_RES,
            canopy: tuple[str, ...] = ()) -> DataFrame:
    """Random view of each crop, every choice a hash of the seed and the crop.

    A dihedral transform, canopy withheld now and then, and one rigid shift of
    the labels. Cells the shift exposes have no known label, so their weight is
    0. Noise belongs on the native elevation: see :func:`crop_noise`.
    """
    i = F.col("crop_id")
    u = {k: uniform(seed, i, F.lit(k)) for k in ("turn", "flip", "drop", "dr", "dc")}
    d = crops.withColumns({"_k": below(u["turn"], 4), "_f": u["flip"] < 0.5})
    n = body - 1
    c1 = F.when(F.col("_f"), F.lit(n) - F.col("col")).otherwise(F.col("col"))
    r1 = F.col("row")
    d = d.withColumns({"_r1": r1, "_c1": c1})
    turned_r = (F.when(F.col("_k") == 1, F.lit(n) - F.col("_c1")).when(F.col("_k") == 2, F.lit(n) - F.col("_r1"))
                .when(F.col("_k") == 3, F.col("_c1")).otherwise(F.col("_r1")))
    turned_c = (F.when(F.col("_k") == 1, F.col("_r1")).when(F.col("_k") == 2, F.lit(n) - F.col("_c1"))
                .when(F.col("_k") == 3, F.lit(n) - F.col("_r1")).otherwise(F.col("_c1")))
    d = d.withColumns({"row": turned_r.cast("bigint"), "col": turned_c.cast("bigint")}).drop("_r1", "_c1", "_k", "_f")

    if canopy:
        keep = u["drop"] >= canopy_dropout
        d = d.withColumns({c: F.when(keep, F.col(c)).otherwise(F.lit(0.0)) for c in canopy})
    if jitter_m:
        reach = jitter_m / res
        dr = F.rint((u["dr"] * 2 - 1) * reach).cast("bigint")
        dc = F.rint((u["dc"] * 2 - 1) * reach).cast("bigint")
        moved = d.select("crop_id", (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), "y", "w", "class")
        d = d.drop("y", "w", "class").join(moved, ["crop_id", "row", "col"], "left")
        d = d.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast(moved.schema[c].dataType) for c in ("y", "w", "class")})
    return d


def full_tile(cells: DataFrame, meta: DataFrame, z_scale: int, label_scale: int, canopy: tuple[str, ...] = (),
              published: DataFrame | None = None, published_meta: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Elevation and labels of whole tiles for evaluation.

    Elevation is the published raster where one is given (already on the body
    grid; tiles it lacks are left out), else our own grid reduced. Elevation,
    canopy and labels come back trimmed to the ground they share, counted in
    body pixels.
    """
    body = meta.select("tile", F.floor(F.col("height") / label_scale).alias("height"), F.floor(F.col("width") / label_scale).alias("width"))
    if published is None:
        z, lab = _reduce_both(cells, meta, z_scale, label_scale, "tile", canopy)
        if z_scale == label_scale:
            return z, lab
        fine = meta.select("tile", F.floor(F.col("height") / z_scale).alias("height"), F.floor(F.col("width") / z_scale).alias("width"))
        return G.common_extent(z, lab, fine, body, label_scale // z_scale, 1)
    rest = G.block_reduce(cells, meta, label_scale, {**{c: (c, "mean") for c in canopy}, **READ_RULES})
    z, rest = G.common_extent(published.select("tile", "row", "col", "z"), rest, published_meta, body, 1, 1)
    return _read_beside(z, rest, "tile", canopy)
