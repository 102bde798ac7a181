"""Raster neighbourhood operators over long-form cells.

``cells`` is ``(tile, row, col, <bands>)`` and ``meta`` is ``(tile, height,
width)``. Neighbourhoods are taken on square blocks, not on tiles: each cell is
copied into the blocks whose halo it touches, the copies are hash-partitioned
once by ``(tile, brow, bcol)``, and both one-dimensional window passes then run
inside that partitioning. A tile that holds most of the data is therefore many
independent tasks, and no task holds more than one block plus its halo at once.

Separable windows are only right when every cell of the block is present, so
the blocks are filled from a generated skeleton in the same shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.ranks import exact_quantiles, keyed_join

BLOCK = 64
KEY = ["tile", "brow", "bcol"]


def densify(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Every (row, col) of each tile, bands NULL where there was no cell."""
    bands = [c for c in cells.columns if c not in ("tile", "row", "col")]
    skeleton = _skeleton(meta).select(
        "tile", "row", "col", *[F.lit(None).cast(cells.schema[b].dataType).alias(b) for b in bands])
    both = cells.select("tile", "row", "col", *bands).unionByName(skeleton)
    return both.groupBy("tile", "row", "col").agg(*[F.max(b).alias(b) for b in bands])


def _skeleton(meta: DataFrame) -> DataFrame:
    # Two steps, so the rows of all tiles spread before columns are generated. The number of partitions is
    # stated: sizes take few bytes, and adaptive execution would merge them into one task that makes every cell.
    rows = meta.select("tile", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    rows = rows.repartition(4 * meta.sparkSession.sparkContext.defaultParallelism, "tile", "row")
    return rows.select(
        "tile", F.col("row").cast("bigint").alias("row"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("width") - 1)).alias("col"))


def _border_positions(i: Column, n: Column, before: int, after: int, border: str) -> Column:
    """All positions in [-before, n+after) that read cell ``i`` under a border rule."""
    if border in ("truncate", "none"):
        return F.array(i)
    if border == "replicate":
        lo = F.when(i == 0, F.lit(-before).cast("bigint")).otherwise(i)
        hi = F.when(i == n - 1, n - 1 + after).otherwise(i)
        return F.sequence(lo, hi)
    if border == "reflect":  # half-sample: d c b a | a b c d | d c b a
        turns = F.ceil(F.lit(float(max(before, after))) / (n * 2)).cast("bigint")
        every = F.flatten(F.transform(
            F.sequence(-turns, turns),
            lambda m: F.array(i + m * n * 2, -1 - i + m * n * 2)))
        return F.filter(every, lambda p: (p >= -before) & (p < n + after))
    raise ValueError(f"unknown border {border!r}")


def haloed(cells: DataFrame, meta: DataFrame, bands: Sequence[str], before: int, after: int,
           border: str = "truncate", block: int = BLOCK, fill: bool = True, size: bool = False) -> DataFrame:
    """Block copies of ``cells`` with halo and border cells, partitioned by block.

    Adds ``brow``, ``bcol`` and ``home``: home rows are the block's own cells.
    With ``fill`` the block is made complete; leave it off only when cells are
    already dense. With ``size`` the raster's height and width stay on.
    """
    d = cells.select("tile", "row", "col", *bands)
    if fill:
        empty = _skeleton(meta).select(
            "tile", "row", "col", *[F.lit(None).cast(cells.schema[b].dataType).alias(b) for b in bands])
        d = d.unionByName(empty)
    d = with_size(d, meta)
    if border in ("replicate", "reflect"):
        d = d.withColumn("row", F.explode(
            _border_positions(F.col("row"), F.col("height"), before, after, border)))
        d = d.withColumn("col", F.explode(
            _border_positions(F.col("col"), F.col("width"), before, after, border)))

    def reach(i: str, n: str) -> Column:
        # a block [b*B, b*B+B) reads rows b*B-before .. b*B+B-1+after
        first = F.floor((F.col(i) - after) / block)
        last = F.floor((F.col(i) + before) / block)
        top = F.floor((F.col(n) - 1) / block)
        lo = F.greatest(first, F.lit(0).cast("bigint"))
        hi = F.least(last, top)
        return F.sequence(F.least(lo, top), F.greatest(hi, F.lit(0).cast("bigint")))

    d = d.withColumn("brow", F.explode(reach("row", "height")))
    d = d.withColumn("bcol", F.explode(reach("col", "width")))
    home = (
        (F.floor(F.col("row") / block) == F.col("brow"))
        & (F.floor(F.col("col") / block) == F.col("bcol"))
        & F.col("row").between(F.lit(0), F.col("height") - 1)
        & F.col("col").between(F.lit(0), F.col("width") - 1)
    )
    more = [*bands, *(("height", "width") if size else ())]
    d = by_block(d.select(*KEY, "row", "col", home.alias("home"), *more))
    if fill:
        d = d.groupBy(*KEY, "row", "col").agg(
            F.max("home").alias("home"), *[F.max(b).alias(b) for b in more])
    return d


def by_block(d: DataFrame) -> DataFrame:
    """Partitioned by block into ``spark.sql.shuffle.partitions`` parts.

    The number is stated: rows of blocks compress well, and what adaptive
    execution would merge up to 64 MB takes many times that to sort.
    """
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), *KEY)


def with_size(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Adds the tile's ``height`` and ``width`` to every cell."""
    return keyed_join(cells, meta.select("tile", "height", "width"), ["tile"])


def _core(block: int) -> Column:
    """Columns the second pass needs: the block's own, without its side halo."""
    return F.floor(F.col("col") / block) == F.col("bcol")


def across(before: int, after: int) -> Window:
    """Frame over columns of one block row."""
    return Window.partitionBy(*KEY, "row").orderBy("col").rangeBetween(-before, after)


def down(before: int, after: int) -> Window:
    """Frame over rows of one block column."""
    return Window.partitionBy(*KEY, "col").orderBy("row").rangeBetween(-before, after)


def span(k: int) -> tuple[int, int]:
    """Cells before and after the centre of a k-wide window; even k leans back."""
    return k // 2, k - 1 - k // 2


def dilate(cells: DataFrame, meta: DataFrame, bands: dict[str, str], radius: int,
           keep: Sequence[str] = (), block: int = BLOCK, dense: bool = False) -> DataFrame:
    """Square maximum of each band, border truncated. ``bands`` maps output to input."""
    src = sorted(set(bands.values()) | set(keep))
    d = haloed(cells, meta, src, radius, radius, "truncate", block, fill=not dense)
    d = d.withColumns({f"_r_{o}": F.max(i).over(across(radius, radius)) for o, i in bands.items()})
    d = d.where(_core(block)).withColumns({f"_d_{o}": F.max(f"_r_{o}").over(down(radius, radius)) for o in bands})
    return d.where("home").select(
        "tile", "row", "col", *keep, *[F.col(f"_d_{o}").alias(o) for o in bands])


def box_mean(cells: DataFrame, meta: DataFrame, bands: dict[str, str], k: int,
             border: str = "replicate", keep: Sequence[str] = (), block: int = BLOCK,
             dense: bool = True) -> DataFrame:
    """k x k mean of NULL-free bands."""
    b, a = span(k)
    src = sorted(set(bands.values()) | set(keep))
    d = haloed(cells, meta, src, b, a, border, block, fill=not dense)
    d = d.withColumns({f"_r_{o}": F.sum(i).over(across(b, a)) for o, i in bands.items()})
    d = d.where(_core(block)).withColumns({f"_d_{o}": F.sum(f"_r_{o}").over(down(b, a)) / float(k * k) for o in bands})
    return d.where("home").select(
        "tile", "row", "col", *keep, *[F.col(f"_d_{o}").alias(o) for o in bands])


#: widest median done with window frames; wider ones go to block arrays
FRAME_MEDIAN_MAX = 5


def median_filter(cells: DataFrame, meta: DataFrame, k: int, border: str = "replicate",
                  value: str = "z", out: str = "median", keep: Sequence[str] = (),
                  block: int = BLOCK, dense: bool = True) -> DataFrame:
    """Exact k x k median of a NULL-free band; even k takes the upper middle."""
    b, a = span(k)
    src = sorted({value, *keep})
    d = haloed(cells, meta, src, b, a, border, block, fill=not dense)
    if k <= FRAME_MEDIAN_MAX:
        d = d.withColumn("_line", F.collect_list(value).over(across(b, a)))
        d = d.where(_core(block)).withColumn("_box", F.flatten(F.collect_list("_line").over(down(b, a))))
        mid = F.get(F.array_sort("_box"), F.lit(k * k // 2))
        return d.where("home").select("tile", "row", "col", *keep, mid.alias(out))
    return block_median(d, k, value, out, list(keep))


def block_median(d: DataFrame, k: int, value: str, out: str, keep: list[str]) -> DataFrame:
    """k x k median of haloed blocks, one small array at a time; home cells only."""
    from pyspark.sql import types as T

    import numpy as np
    import pandas as pd

    b, _ = span(k)
    schema = T.StructType([d.schema[c] for c in ("tile", "row", "col", *keep)]
                          + [T.StructField(out, T.DoubleType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = pdf["row"].min(), pdf["col"].min()
        h, w = pdf["row"].max() - r0 + 1, pdf["col"].max() - c0 + 1
        plane = np.full((h, w), np.nan)
        plane[pdf["row"] - r0, pdf["col"] - c0] = pdf[value]
        boxes = np.lib.stride_tricks.sliding_window_view(plane, (k, k))
        mine = pdf[pdf["home"]]
        picked = boxes[mine["row"] - r0 - b, mine["col"] - c0 - b].reshape(len(mine), k * k)
        res = mine[["tile", "row", "col", *keep]].copy()
        res[out] = np.partition(picked, k * k // 2, axis=1)[:, k * k // 2]
        return res

    return d.groupBy(*KEY).applyInPandas(one, schema)


def gradients(cells: DataFrame, meta: DataFrame, res: float, edge: str = "one_sided",
              value: str = "z", keep: Sequence[str] = (), block: int = BLOCK,
              dense: bool = True) -> DataFrame:
    """Adds ``gx`` and ``gy`` per metre. A NULL neighbour makes the gradient NULL.

    ``one_sided`` switches to a one-sided difference on the outermost row and
    column; ``replicate`` repeats the border cell and so halves it there.
    """
    return gradients_of(cells, meta, res, {value: ("gx", "gy")}, edge, keep, block, dense)


def gradients_of(cells: DataFrame, meta: DataFrame, res: float, values: dict[str, tuple[str, str]], edge: str = "one_sided",
                 keep: Sequence[str] = (), block: int = BLOCK, dense: bool = True) -> DataFrame:
    """Gradients of several rasters of a tile, from one exchange of halo blocks."""
    src = sorted({*values, *keep})
    border = "replicate" if edge == "replicate" else "truncate"
    d = haloed(cells, meta, src, 1, 1, border, block, fill=not dense)
    for which, axis, w in ((0, "col", Window.partitionBy(*KEY, "row").orderBy("col")), (1, "row", Window.partitionBy(*KEY, "col").orderBy("row"))):
        has_prev, has_next = F.lag(axis).over(w).isNotNull(), F.lead(axis).over(w).isNotNull()

        def along(value: str) -> Column:
            prev, nxt, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)  # noqa: B023
            return (F.when(has_prev & has_next, (nxt - prev) / (2.0 * res))  # noqa: B023
                    .when(has_next, (nxt - own) / res).when(has_prev, (own - prev) / res))  # noqa: B023

        d = d.withColumns({names[which]: along(value) for value, names in values.items()})
    return d.where("home").select("tile", "row", "col", *src, *[n for names in values.values() for n in names])


def slope(cells: DataFrame, meta: DataFrame, res: float, edge: str = "one_sided",
          value: str = "z", out: str = "slope", keep: Sequence[str] = (), **kw) -> DataFrame:
    """Slope in degrees."""
    g = gradients(cells, meta, res, edge, value, keep, **kw)
    return g.withColumn(out, F.degrees(F.atan(F.hypot("gx", "gy")))).drop("gx", "gy")


def fill_median(cells: DataFrame, value: str = "z") -> DataFrame:
    """NULLs take the tile's exact median; adds ``valid`` and ``error``.

    A tile with no value at all keeps NULL and says so in ``error``.
    """
    med = exact_quantiles(cells, ["tile"], value, {"_median": 0.5})
    return keyed_join(cells, med, ["tile"], "left").withColumns({
        "valid": F.col(value).isNotNull(),
        value: F.coalesce(F.col(value), F.col("_median")),
        "error": F.when(F.col("_median").isNull(), F.lit("no cell has a value")),
    }).drop("_median")


def centre(cells: DataFrame, value: str = "z") -> DataFrame:
    """Subtract the tile mean of valid cells; nodata becomes 0 with ``valid`` false."""
    mean = cells.groupBy("tile").agg(F.avg(value).alias("_mean"))
    return keyed_join(cells, mean, ["tile"]).withColumns({
        "valid": F.col(value).isNotNull(),
        value: F.coalesce(F.col(value) - F.col("_mean"), F.lit(0.0)),
    }).drop("_mean")


def _clamp(c: Column, lo: float, hi: float) -> Column:
    # least and greatest skip NULL; an unknown value stays unknown
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def micro_relief(cells: DataFrame, meta: DataFrame, k: int, clip: float, border: str = "reflect",
                 value: str = "z", out: str = "relief", keep: Sequence[str] = (), **kw) -> DataFrame:
    """Elevation minus its k x k median, clipped and scaled to [-1, 1]."""
    d = median_filter(cells, meta, k, border, value, "_med", keep=sorted({value, *keep}), **kw)
    return d.withColumn(out, _clamp(F.col(value) - F.col("_med"), -clip, clip) / clip).drop("_med")


def roughness(cells: DataFrame, meta: DataFrame, k: int, detrend: int | None,
              border: str = "replicate", value: str = "z", out: str = "rough",
              keep: Sequence[str] = (), **kw) -> DataFrame:
    """Local standard deviation, after removing a wider box mean when ``detrend`` is set."""
    base = sorted({value, *keep})
    d, u = cells, value
    if detrend:
        d = box_mean(cells, meta, {"_trend": value}, detrend, border, keep=base, **kw)
        d = d.withColumn("_u", F.col(value) - F.col("_trend")).drop("_trend")
        u = "_u"
    d = d.withColumn("_u2", F.col(u) * F.col(u))
    held = base + (["_u"] if u == "_u" else [])
    d = box_mean(d, meta, {"_m": u, "_m2": "_u2"}, k, border, keep=held, **kw)
    var = F.greatest(F.col("_m2") - F.col("_m") * F.col("_m"), F.lit(0.0))
    return d.withColumn(out, F.sqrt(var)).drop("_m", "_m2", "_u")


def block_reduce(cells: DataFrame, meta: DataFrame | None, k: int, how: dict[str, tuple[str, str]],
                 key: str = "tile") -> DataFrame:
    """Reduce k x k cells to one. ``how`` maps output to (band, rule).

    Rules are mean, max, min_nonzero and nanmean. Trailing partial blocks are
    dropped; without ``meta`` the raster is taken to hold whole blocks only. A
    plain mean of a block with a missing cell is NULL.
    """
    d = cells
    if meta is not None:
        d = with_size(cells, meta).where(
            (F.col("row") < F.floor(F.col("height") / k) * k) & (F.col("col") < F.floor(F.col("width") / k) * k))
    aggs = []
    for out, (band, rule) in how.items():
        c = F.col(band)
        if rule == "mean":
            agg = F.when(F.count(c) == k * k, F.avg(c))
        elif rule == "nanmean":
            agg = F.avg(c)
        elif rule == "max":
            agg = F.max(c)
        elif rule == "min_nonzero":
            agg = F.coalesce(F.min(F.when(c > 0, c)), F.lit(0).cast(cells.schema[band].dataType))
        else:
            raise ValueError(f"unknown rule {rule!r}")
        aggs.append(agg.alias(out))
    return d.groupBy(key, F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col")).agg(*aggs)


def shift(cells: DataFrame, meta: DataFrame, dr: int, dc: int, bands: Sequence[str]) -> DataFrame:
    """Translate dense cells; what slides in from outside is 0."""
    moved = cells.select("tile", (F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), *bands)
    moved = with_size(moved, meta).where(
        F.col("row").between(F.lit(0), F.col("height") - 1) & F.col("col").between(F.lit(0), F.col("width") - 1)
    ).select("tile", "row", "col", *bands)
    zeros = {b: F.coalesce(F.col(b), F.lit(0).cast(cells.schema[b].dataType)) for b in bands}
    return densify(moved, meta).withColumns(zeros)


def d4(cells: DataFrame, k: int, flip: bool, height: Column, width: Column) -> DataFrame:
    """One of the eight dihedral transforms: mirror columns first, then k quarter turns."""
    r, c, h, w = F.col("row"), F.col("col"), height, width
    if flip:
        c = w - 1 - c
    for _ in range(k % 4):
        r, c, h, w = w - 1 - c, r, w, h
    return cells.withColumns({"row": r.cast("bigint"), "col": c.cast("bigint")})


def d4_inverse(cells: DataFrame, k: int, flip: bool, height: Column, width: Column) -> DataFrame:
    """Undo :func:`d4`; height and width are those of the untransformed raster."""
    h, w = (width, height) if k % 2 else (height, width)
    r, c = F.col("row"), F.col("col")
    for _ in range(-k % 4):
        r, c, h, w = w - 1 - c, r, w, h
    if flip:
        c = width - 1 - c
    return cells.withColumns({"row": r.cast("bigint"), "col": c.cast("bigint")})


def reflect_pad(cells: DataFrame, meta: DataFrame, pad_h: int, pad_w: int) -> DataFrame:
    """Mirror the bottom and right edges without repeating the edge cell.

    A pad that is not smaller than the raster fails the job.
    """
    d = with_size(cells, meta)
    ok = (F.lit(pad_h) < F.col("height")) & (F.lit(pad_w) < F.col("width"))
    d = d.withColumn("height", F.when(ok, F.col("height")).otherwise(
        F.raise_error("reflect padding must be smaller than the raster").cast("bigint")))

    def spots(i: str, n: str, pad: int) -> Column:
        mirror = (F.col(n) - 1) * 2 - F.col(i)
        inside = (mirror >= F.col(n)) & (mirror < F.col(n) + pad)
        return F.when(inside, F.array(F.col(i), mirror)).otherwise(F.array(F.col(i)))

    d = d.withColumn("row", F.explode(spots("row", "height", pad_h)))
    return d.withColumn("col", F.explode(spots("col", "width", pad_w))).drop("height", "width")


def common_extent(a: DataFrame, b: DataFrame, meta_a: DataFrame, meta_b: DataFrame,
                  ka: int, kb: int) -> tuple[DataFrame, DataFrame]:
    """Trim two rasters to the ground they share, counted in body pixels."""
    ma = meta_a.select("tile", F.floor(F.col("height") / ka).alias("ha"), F.floor(F.col("width") / ka).alias("wa"))
    mb = meta_b.select("tile", F.floor(F.col("height") / kb).alias("hb"), F.floor(F.col("width") / kb).alias("wb"))
    both = ma.join(mb, "tile").select(
        "tile", F.least("ha", "hb").alias("_h"), F.least("wa", "wb").alias("_w"))

    def trim(df: DataFrame, k: int) -> DataFrame:
        return keyed_join(df, both, ["tile"]).where(
            (F.col("row") < F.col("_h") * k) & (F.col("col") < F.col("_w") * k)).drop("_h", "_w")

    return trim(a, ka), trim(b, kb)


def conv3x3(cells: DataFrame, meta: DataFrame, kernel: Sequence[Sequence[float]], bias: float,
            stride: int = 1, value: str = "z", out: str = "logit", block: int = BLOCK) -> DataFrame:
    """3x3 convolution with zero padding; missing cells read as 0.

    A row pass forms one partial sum per kernel row, a column pass adds them.
    """
    d = haloed(cells, meta, [value], 1, 1, "truncate", block, fill=True)
    z = F.coalesce(F.col(value), F.lit(0.0))
    d = d.withColumn("_z", z)
    wx = Window.partitionBy(*KEY, "row").orderBy("col")
    left, right = F.coalesce(F.lag("_z").over(wx), F.lit(0.0)), F.coalesce(F.lead("_z").over(wx), F.lit(0.0))
    d = d.withColumns({"_l": left, "_g": right})
    d = d.withColumns({
        f"_k{i}": F.col("_l") * row[0] + F.col("_z") * row[1] + F.col("_g") * row[2]
        for i, row in enumerate(kernel)})
    wy = Window.partitionBy(*KEY, "col").orderBy("row")
    total = (F.coalesce(F.lag("_k0").over(wy), F.lit(0.0)) + F.col("_k1")
             + F.coalesce(F.lead("_k2").over(wy), F.lit(0.0)) + bias)
    d = d.withColumn(out, total).where("home")
    if stride > 1:
        d = d.where((F.col("row") % stride == 0) & (F.col("col") % stride == 0))
    return d.select("tile", F.floor(F.col("row") / stride).alias("row"),
                    F.floor(F.col("col") / stride).alias("col"), out)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.exp(-x) + 1.0)


def hillshade(cells: DataFrame, meta: DataFrame, res: float, azimuths: Sequence[float] = (315.0, 45.0),
              altitude: float = 38.0, vert_exag: float = 2.4, value: str = "z",
              keep: Sequence[str] = (), **kw) -> DataFrame:
    """Mean illumination over several light directions, scaled per tile to [0, 1]."""
    import math

    g = gradients(cells, meta, res, "one_sided", value, keep, **kw)
    # row grows southward, so northward slope is -gy
    ex, ny = F.col("gx") * vert_exag, -F.col("gy") * vert_exag
    norm = F.sqrt(ex * ex + ny * ny + 1.0)
    alt = math.radians(altitude)
    shades = []
    for i, az in enumerate(azimuths):
        a = math.radians(90.0 - az)
        lx, ly, lz = math.cos(a) * math.cos(alt), math.sin(a) * math.cos(alt), math.sin(alt)
        shades.append(((-ex * lx - ny * ly + lz) / norm).alias(f"_s{i}"))
    d = g.select("*", *shades)
    ext = d.groupBy("tile").agg(
        *[F.min(f"_s{i}").alias(f"_lo{i}") for i in range(len(azimuths))],
        *[F.max(f"_s{i}").alias(f"_hi{i}") for i in range(len(azimuths))])
    d = keyed_join(d, ext, ["tile"])
    total = F.lit(0.0)
    for i in range(len(azimuths)):
        span = F.col(f"_hi{i}") - F.col(f"_lo{i}")
        total = total + F.when(span > 1e-6, (F.col(f"_s{i}") - F.col(f"_lo{i}")) / span).otherwise(
            F.col(f"_s{i}"))
    return d.select("tile", "row", "col", value, *keep, (total / float(len(azimuths))).alias("shade"))


def quads(cells: DataFrame, meta: DataFrame, value: str, block: int = BLOCK) -> DataFrame:
    """Each cell with its right, lower and lower-right neighbours ``q00..q11``.

    On the last row and column the edge repeats.
    """
    d = haloed(cells, meta, [value], 0, 1, "replicate", block, fill=False)
    wx = Window.partitionBy(*KEY, "row").orderBy("col")
    wy = Window.partitionBy(*KEY, "col").orderBy("row")
    d = d.withColumn("_e", F.lead(value).over(wx))
    d = d.withColumns({"_s": F.lead(value).over(wy), "_se": F.lead("_e").over(wy)})
    return d.where("home").select("tile", "row", "col", F.col(value).alias("q00"), F.col("_e").alias("q01"),
                                  F.col("_s").alias("q10"), F.col("_se").alias("q11"))


def _on_raster(v: Column, n: str) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), (F.col(n) - 1).cast("double"))


#: Bytes of raster blocks that are broadcast.
BROADCAST_BYTES = 32 << 20


def haloed_planes(cells: DataFrame, meta: DataFrame, value: str, reach: int, block: int = BLOCK) -> DataFrame:
    """One array ``plane`` a block, row by row, of ``block + 2 * reach + 1`` cells a side; NULL where no cell.

    It starts ``reach`` cells before the block. They are broadcast where the sizes of all tiles say that they are few.
    """
    side = block + 2 * reach + 1
    d = haloed(cells, meta, [value], reach, reach + 1, "truncate", block, fill=False)
    d = d.withColumns({"_i": (F.col("row") - F.col("brow") * block + reach).cast("int"), "_j": (F.col("col") - F.col("bcol") * block + reach).cast("int")})
    places = F.sequence(F.lit(0), F.lit(side - 1))
    d = d.groupBy(*KEY, "_i", "_j").agg(F.max(value).alias("_v"))
    lines = d.groupBy(*KEY, "_i").agg(F.map_from_entries(F.collect_list(F.struct("_j", "_v"))).alias("_m"))
    lines = lines.select(*KEY, "_i", F.transform(places, lambda i: F.try_element_at("_m", i)).alias("_line"))
    planes = lines.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("_i", "_line"))).alias("_m"))
    blank = F.array_repeat(F.lit(None).cast(cells.schema[value].dataType), side)
    planes = planes.select(*KEY, F.flatten(F.transform(places, lambda i: F.coalesce(F.try_element_at("_m", i), blank))).alias("plane"))
    n = meta.agg(F.sum(F.ceil(F.col("height") / block) * F.ceil(F.col("width") / block))).first()[0] or 0
    return F.broadcast(planes) if n * side * side * 8 <= BROADCAST_BYTES else planes


def bilinear_sample(cells: DataFrame, meta: DataFrame, points: DataFrame, value: str = "z", out: str = "sampled",
                    line: tuple[int, Callable[[Column], tuple[Column, Column]]] | None = None, reach: int = 0) -> DataFrame:
    """Value of dense cells at fractional ``(row_f, col_f)``; the edge repeats beyond it.

    The raster side carries 2x2 neighbourhoods, so a point is one lookup by
    cell key and nothing has to be gathered back together.

    With ``line``, a row stands for several positions: their number, and a function from the number ``off``
    of one to its row and column. None is more than ``reach`` cells from the middle of the line, so a row meets
    the block of its middle, with all cells in reach, and becomes a row for each position only there.
    """
    p = keyed_join(points, meta.select("tile", "height", "width"), ["tile"])
    if line is not None:
        n, position = line
        side = BLOCK + 2 * reach + 1
        r, c = position(F.lit((n - 1) / 2))
        p = p.withColumns({"brow": F.floor(_on_raster(r, "height") / BLOCK), "bcol": F.floor(_on_raster(c, "width") / BLOCK)})
        p = p.join(haloed_planes(cells, meta, value, reach), KEY, "left")
        p = p.withColumn("off", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        r, c = position(F.col("off"))
        p = p.withColumns({"_r": _on_raster(r, "height"), "_c": _on_raster(c, "width")})
        p = p.withColumns({"row": F.floor("_r"), "col": F.floor("_c")})
        p = p.withColumn("_at", ((F.col("row") - F.col("brow") * BLOCK + reach) * side + F.col("col") - F.col("bcol") * BLOCK + reach).cast("int"))
        got = p.withColumns({f"q{i}{j}": F.get("plane", F.col("_at") + (i * side + j)) for i in (0, 1) for j in (0, 1)})
        keep = [*points.columns, F.col("off").cast("bigint").alias("off")]
    else:
        p = p.withColumns({"_r": _on_raster(F.col("row_f"), "height"), "_c": _on_raster(F.col("col_f"), "width")})
        p = p.withColumns({"row": F.floor("_r"), "col": F.floor("_c")})
        got, keep = p.join(quads(cells, meta, value), ["tile", "row", "col"], "left"), points.columns

    def mix(a: Column, b: Column, f: Column) -> Column:
        # a corner without weight must not matter, even if it is unknown
        return F.when(f == 0, a).otherwise(a * (1 - f) + b * f)

    fr, fc = F.col("_r") - F.col("row"), F.col("_c") - F.col("col")
    v = mix(mix(F.col("q00"), F.col("q01"), fc), mix(F.col("q10"), F.col("q11"), fc), fr)
    return got.select(*keep, v.alias(out))
