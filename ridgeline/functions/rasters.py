"""Column expressions for cell/ground arithmetic, nodata, colour and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import constants as K


def sanitize_nodata(z: Column, zero_is_nodata: bool = False) -> Column:
    """NaN, absurd magnitudes and (optionally) zero become NULL."""
    bad = F.isnan(z) | (z < K.ABSURD_M)
    if zero_is_nodata:
        bad = bad | (z == 0.0)
    return F.when(~bad, z)


def cell_to_ground(row: Column, col: Column, x0: Column, y1: Column, res: Column) -> Column:
    """Ground position of a cell's north-west corner; northing falls with row."""
    return F.struct((x0 + col * res).alias("x"), (y1 - row * res).alias("y"))


def ground_to_cell(x: Column, y: Column, x0: Column, y1: Column, res: Column) -> Column:
    return F.struct(
        F.floor((y1 - y) / res).alias("row"), F.floor((x - x0) / res).alias("col")
    )


def rescale_transform(meta: DataFrame, k: int) -> DataFrame:
    """Raster metadata after reducing by ``k`` whole cells per axis."""
    return meta.withColumns({
        "res": F.col("res") * k,
        "height": F.floor(F.col("height") / k).cast("bigint"),
        "width": F.floor(F.col("width") / k).cast("bigint"),
    })


def snr_verdict(snr: Column) -> Column:
    return F.when(snr > 8, "STRONG").when(snr > 3, "usable").otherwise("weak")


def quantise_prob(p: Column, levels: int = K.PALETTE_LEVELS) -> Column:
    """Palette index of a probability; NULL stays NULL and is never painted."""
    clamped = F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    # least and greatest skip NULL, which would paint nodata as level 0
    return F.when(p.isNotNull(), F.floor(clamped * (levels - 1) + 0.5)).cast("bigint")


def palette(spark: SparkSession, threshold: float, opacity: float) -> DataFrame:
    """256 packed ARGB colours by level, as a small lookup DataFrame.

    The colour follows the raw probability; the threshold only hides levels.
    """
    threshold = min(max(threshold, 0.0), 1.0)
    opacity = min(max(opacity, 0.0), 1.0)
    stops = len(K.PLASMA) - 1
    p = F.col("level") / float(K.PALETTE_LEVELS - 1)
    u = (F.lit(K.PALETTE_FLOOR) + p * (1 - K.PALETTE_FLOOR)) * stops
    d = spark.range(K.PALETTE_LEVELS).select(F.col("id").alias("level"))
    d = d.withColumns({"p": p, "u": u})
    d = d.withColumn("i", F.least(F.floor("u"), F.lit(stops - 1)).cast("int"))
    ramp = F.array(*[F.lit(c) for c in K.PLASMA])
    d = d.withColumns({
        "f": F.col("u") - F.col("i"),
        "a": F.get(ramp, F.col("i")),
        "b": F.get(ramp, F.col("i") + 1),
    })

    def channel(shift: int) -> Column:
        lo = F.shiftright("a", shift).bitwiseAND(F.lit(255))
        hi = F.shiftright("b", shift).bitwiseAND(F.lit(255))
        mixed = F.floor(lo + (hi - lo) * F.col("f") + 0.5)
        return F.least(F.greatest(mixed, F.lit(0)), F.lit(255)).cast("bigint")

    alpha = (F.lit(K.PALETTE_ALPHA[0]) + F.col("p") * (K.PALETTE_ALPHA[1] - K.PALETTE_ALPHA[0]))
    alpha8 = F.floor(alpha * opacity * 255.0 + 0.5).cast("bigint")
    argb = alpha8 * (1 << 24) + channel(16) * 65536 + channel(8) * 256 + channel(0)
    return d.select(
        "level", F.when(F.col("p") >= threshold, argb).otherwise(F.lit(0)).cast("bigint").alias("argb")
    )


def paint(cells: DataFrame, spark: SparkSession, threshold: float, opacity: float,
          prob: str = "prob") -> DataFrame:
    """Packed colour per cell. The lookup side is 256 rows by construction."""
    lut = F.broadcast(palette(spark, threshold, opacity))
    return (
        cells.withColumn("level", quantise_prob(F.col(prob)))
        .join(lut, "level", "left")
        .withColumn("argb", F.coalesce("argb", F.lit(0).cast("bigint")))
    )


def _digits(v: Column, places: int) -> Column:
    """Magnitude of a 5-decimal coordinate at ``places`` decimals, digits only.

    Rounded half away from zero on integers, so no decimal tie depends on how
    an engine formats doubles.
    """
    units = F.round(F.abs(v) * 1e5).cast("bigint")
    cut = 10 ** (5 - places)
    q = F.floor((units + cut // 2) / cut).cast("bigint")
    return F.concat(
        F.floor(q / 10**places).cast("bigint").cast("string"),
        F.lpad((q % 10**places).cast("string"), places, "0"),
    )


def harvest_key(lat: Column, lon: Column) -> Column:
    """``h_`` plus both coordinates at four decimals, sign spelled ``s``."""
    def part(v: Column) -> Column:
        return F.concat(F.when(v < 0, "s").otherwise(""), _digits(v, 4))
    return F.concat(F.lit("h_"), part(lat), F.lit("_"), part(lon))


def harvest_note(faint_m: Column, lifecycle_m: Column, n_ways: Column, project: Column) -> Column:
    return F.concat(
        F.lit("auto-selected: "), faint_m.cast("string"), F.lit(" m faint, "),
        lifecycle_m.cast("string"), F.lit(" m lifecycle, "), n_ways.cast("string"),
        F.lit(" ways, 3DEP "), project,
    )


def describe_source(title: Column, pixel_m: Column, first: Column, last: Column) -> Column:
    """Title, pixel size to two significant digits, and the flight date or date range."""
    size = F.when(pixel_m.isNotNull(), F.format_string("%.2g m", pixel_m))
    flown = F.when(
        first.isNotNull(),
        F.concat(F.lit("flown "), first.cast("string"),
                 F.when(first == last, F.lit("")).otherwise(
                     F.concat(F.lit(" to "), last.cast("string")))),
    )
    return F.concat_ws(" · ", F.coalesce(title, F.lit("unknown source")), size, flown)


def provenance(source: Column, model: Column, projection: Column) -> Column:
    return F.concat_ws(" · ", source, F.concat(F.lit("model "), model), projection)


def note_km(notes: Column, cls: str) -> Column:
    """First ``<class> N.NN km`` figure in free text, NULL when absent."""
    return F.try_to_number(
        F.nullif(F.regexp_extract(notes, rf"\b{cls} (\d+\.\d+) km", 1), F.lit("")), F.lit("999999.999999")
    ).cast("double")


def note_elevation(notes: Column) -> Column:
    return F.nullif(F.regexp_extract(notes, r"\b(\d{3,4}) m\b", 1), F.lit("")).cast("bigint")
