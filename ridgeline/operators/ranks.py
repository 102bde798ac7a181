"""Ranks, prefix sums and exact quantiles that never gather one key in one task.

Each works in two levels. Rows are first counted per (key, bucket); the bucket
table is small, so its running totals are cheap; rows then only need an order
inside their own bucket. A key that holds a third of the data is spread over
its buckets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators.lineage import cut

#: Rows of a span that one task orders, and spans at most.
SPAN_ROWS, SPANS = 65_536, 1024
#: Rows that are broadcast once they are counted.
BROADCAST_ROWS = 100_000
#: Rows of a histogram bin that are ordered as they are.
SELECT_ROWS = 262_144


def bucket_rank(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str],
                out: str = "rank") -> DataFrame:
    """1-based rank of rows by ``(bucket, *order)`` inside ``keys``."""
    keys = list(keys)
    counts = df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        df.withColumn("_in", F.row_number().over(inside))
        .join(offsets, [*keys, bucket])
        .withColumn(out, (F.col("_before") + F.col("_in")).cast("bigint"))
        .drop("_in", "_before")
    )


def hashed_rank(df: DataFrame, keys: Sequence[str], id_cols: Sequence[str],
                out: str = "rank", buckets: int = 4096) -> DataFrame:
    """A repeatable dense 1-based numbering inside ``keys``, in hash order."""
    d = df.withColumn("_hb", F.pmod(F.xxhash64(*id_cols), F.lit(buckets)))
    return bucket_rank(d, keys, "_hb", id_cols, out).drop("_hb")


def keyed_join(big: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join of a big side with one row per key on the small side.

    The small side is joined as it is: its size is what the optimizer measures
    when it considers a broadcast, and beyond that adaptive execution splits the
    big side's hot keys, so neither side is ever multiplied.
    """
    return big.join(small, list(keys), how)


def measured(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, worked out once, to be broadcast if it has counted at most ``most`` rows.

    The optimizer's guess of what an aggregation leaves is the size of its input, so a join with it
    would shuffle the big side before adaptive execution learns better.
    """
    done = cut(small)
    return F.broadcast(done) if done.count() <= most else done


def measured_edges(df: DataFrame, value: str, rows_each: int = SPAN_ROWS, most: int = SPANS) -> list[float]:
    """Values that part ``df`` into spans of about as many rows each, at most ``most`` of them."""
    spans = min(most, -(-df.count() // rows_each))
    if spans <= 1:
        return []
    found = df.agg(F.percentile_approx(value, [i / spans for i in range(1, spans)], 10 * most).alias("q")).first().q
    return sorted(set(found or []))


def span_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of ``edges`` up to ``value``, looked up in two steps of about the root of their number."""
    if not edges:
        return F.lit(0)
    step = math.isqrt(len(edges)) + 1
    lits = lambda v: F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<double>")
    coarse = F.size(F.filter(lits(edges[step - 1::step]), lambda e: e <= value)) * step
    return coarse + F.size(F.filter(F.slice(lits(edges), coarse + 1, step), lambda e: e <= value))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: dict[str, float], buckets: int = 4096, most: int = SELECT_ROWS) -> DataFrame:
    """Exact linear-interpolated quantiles per key, NULL values ignored.

    ``probs`` maps an output column to a probability. Values are collapsed to
    (value, count) first, then located through an equal-width histogram, so
    only the bins that hold a wanted rank are ever ordered. While such a bin
    holds more than ``most`` rows, it gets a histogram of its own: one far
    outlier costs a round, not an order of everything else.
    """
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs, buckets, most).drop("_all")
    keys = list(keys)
    vals = cut(df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c")))

    def ranks(p: float) -> tuple[Column, Column]:
        at = (F.col("_total") - 1) * F.lit(float(p))
        return F.floor(at), F.ceil(at)

    wanted = F.lit(False)
    for p in probs.values():
        for r in ranks(p):
            wanted = wanted | ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_bc")))
    # Bins of a key part its values, so the least value of a bin names it.
    bins = vals.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.sum("_c").alias("_total"), F.lit(0).cast("bigint").alias("_before"))
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    upto = Window.partitionBy(*keys, "_in").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        width = F.col("_hi") - F.col("_lo")
        at = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * buckets), F.lit(buckets - 1))).otherwise(F.lit(0)).cast("bigint")
        binned = keyed_join(vals, bins, keys).where(inside).withColumns({"_bin": at, "_in": F.col("_lo")})
        hist = binned.groupBy(*keys, "_in", "_bin").agg(
            F.sum("_c").alias("_bc"), F.count("*").alias("_rows"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.max("_total").alias("_total"), F.max("_before").alias("_base"))
        hist = hist.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_bc").over(upto), F.lit(0)))
        bins = cut(hist.where(wanted).select(*keys, "_lo", "_hi", "_total", "_before", "_rows"))
        settled = bins.where((F.col("_rows") > most) & (F.col("_lo") < F.col("_hi"))).isEmpty()
        bins = bins.drop("_rows")
        if settled:
            break
    rows = keyed_join(vals, bins, keys).where(inside)
    one = Window.partitionBy(*keys, "_lo").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_end", F.col("_before") + F.sum("_c").over(one))
    rows = rows.withColumn("_start", F.col("_end") - F.col("_c"))
    aggs = []
    for name, p in probs.items():
        lo, hi = ranks(p)
        frac = (F.max("_total") - 1) * F.lit(float(p))

        def at(r: Column) -> Column:
            return F.max(F.when((r >= F.col("_start")) & (r < F.col("_end")), F.col("_v")))

        low, high = at(lo), at(hi)
        aggs.append((low + (high - low) * (frac - F.floor(frac))).alias(name))
    return rows.groupBy(*keys).agg(*aggs)


def running_totals(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str],
                   sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums ordered by ``(bucket, *order)`` inside ``keys``.

    ``sums`` maps an output column to the summed column. ``bucket`` must sort
    the same way as ``order``.
    """
    keys = list(keys)
    totals = df.groupBy(*keys, bucket).agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, bucket,
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_b_{o}") for o in sums])
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({f"_i_{o}": F.sum(c).over(inside) for o, c in sums.items()})
    d = d.join(totals, [*keys, bucket])
    d = d.withColumns({o: F.col(f"_b_{o}") + F.col(f"_i_{o}") for o in sums})
    return d.drop(*[f"_b_{o}" for o in sums], *[f"_i_{o}" for o in sums])
