"""Shards by jump consistent hashing, in column expressions alone.

A key walks from shard to shard by the published recurrence: a 64-bit linear
congruential step, then ``j = floor((b + 1) * 2^31 / (top 31 bits + 1))``; the
last place before the walk leaves the range is the shard. No ring table exists,
and with one more shard a key either stays or moves into the new shard.

Cases: a null key counts as -1; null text has no bytes and checksum 0; repeated
rows share a shard and take neighbouring slots; very long texts only cost their
length; an empty table gives no rows; further columns are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import ceil_div, documents, only
from ridgeline.llm.registry import query
from ridgeline.operators.ranks import bucket_rank

#: Fixed values of the published recurrence.
MULTIPLIER = 2862933555777941757
WORD = 1 << 64
TOP_BITS = 1 << 33
RANGE = 1 << 31

#: Bytes that a row takes beside its text.
ROW_BYTES = 16
#: Rows that one task ranks, on average, and spans of keys at most.
SPAN_ROWS, SPANS = 65536, 1024
STATE = "struct<shard: bigint, grown: bigint, j: bigint, k: decimal(20,0)>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def jump(key: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard among ``shards``, and among one more.

    The walk over one more shard visits the same places first, so one walk
    gives both. Products of 64-bit numbers are exact in 38-digit decimals.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    dec = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    unsigned = key.cast("decimal(20,0)") + F.when(key < 0, dec(WORD)).otherwise(dec(0))

    def step(s: Column, _: Column) -> Column:
        following = ((s["k"] * dec(MULTIPLIER) + dec(1)) % dec(WORD)).cast("decimal(20,0)")

        def moved(k: Column) -> Column:
            top = F.floor(k / dec(TOP_BITS)).cast("double") + 1.0
            return F.struct(
                F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"), s["j"].alias("grown"),
                F.floor((s["j"].cast("double") + 1.0) * (F.lit(float(RANGE)) / top)).cast("bigint").alias("j"),
                k.alias("k")).cast(STATE)

        return F.when(s["j"] <= shards, _let(following, moved)).otherwise(s)

    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("shard"), zero.alias("grown"), zero.alias("j"), unsigned.cast("decimal(20,0)").alias("k")).cast(STATE)
    return F.aggregate(F.sequence(F.lit(0), F.lit(shards)), start, step,
                       lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def assign_shards(rows: DataFrame, key: str, text: str, shards: int) -> DataFrame:
    """Rows with ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard``.

    ``key`` is an integer column. Slots count from 0 inside a shard in the order
    of the key, the checksum and the size; ranks are taken over spans of keys,
    measured to hold about as many rows each, and then shifted, so no task orders
    a whole shard. Input columns of those names are replaced, all others kept.
    """
    made = ("size", "text_crc32", "shard", "slot", "grown_shard")
    kept = [c for c in rows.columns if c not in made]
    at, body = F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(-1).cast("bigint")), F.col(f"`{text}`")
    span = key_span(F.col("key"), F.col("text_crc32"), *span_edges(rows.select(at.alias("key"))))
    d = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), at.alias("key"), (text_bytes(body) + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32(body.cast("binary")), F.lit(0).cast("bigint")).alias("text_crc32"), jump(at, shards).alias("jump"))
    d = d.withColumns({"shard": F.col("jump.shard"), "grown_shard": F.col("jump.grown"), "span": span}).drop("jump")
    d = bucket_rank(d, ["shard"], "span", ["key", "text_crc32", "size"], "rank")
    return d.select(*[F.col("row")[c].alias(c) for c in kept], "size", "text_crc32", "shard", (F.col("rank") - 1).alias("slot"), "grown_shard")


def span_edges(keys: DataFrame) -> tuple[list[int], set[int]]:
    """Quantiles of the keys, at most ``SPANS`` of them, and the keys that fill spans alone."""
    count = min(SPANS, ceil_div(keys.count(), SPAN_ROWS))
    if count == 1:
        return [], set()
    edges = keys.agg(F.percentile_approx("key", [i / count for i in range(1, count)], 10 * SPANS).alias("q")).first().q or []
    return sorted(set(edges)), {e for e in edges if edges.count(e) > 1}


def key_span(key: Column, crc: Column, edges: list[int], heavy: set[int]) -> Column:
    """A number that sorts as (key, crc) does: the key's span, cut by checksums where one key fills spans.

    Edges are looked up in two steps of about the root of their number.
    """
    if not edges:
        return F.lit(0).cast("bigint")
    # A heavy key is a span of its own: it begins at the key and ends with it.
    cuts = sorted(set(edges) | {h + 1 for h in heavy})
    step = math.isqrt(len(cuts)) + 1
    long = lambda v: F.array(*[F.lit(x).cast("bigint") for x in v])
    coarse = F.size(F.filter(long(cuts[step - 1::step]), lambda c: c <= key)) * step
    at = coarse + F.size(F.filter(F.slice(long(cuts), coarse + 1, step), lambda c: c <= key))
    inner = F.when(key.isin(*heavy), F.shiftright(crc, 20)).otherwise(0) if heavy else F.lit(0)
    return (at * 4096 + inner).cast("bigint")


SHARDS = 40

# The checksum is the reflected CRC-32 with its usual polynomial, 3988292384.
OP4_SQL = f"""
with recursive crc_table as (
  select list(c order by n) as t from (
    select n, list_reduce(list_concat([n], range(8)), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as c from range(256) r(n))),
raw as (select doc_id, row_number() over () as rid, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
sums as (
  select rid, doc_id, cast(length(h) // 2 + {ROW_BYTES} as bigint) as size, xor(4294967295, list_reduce(
    list_concat([4294967295::bigint], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) as text_crc32
  from raw, crc_table),
walk(rid, k, b, j, grown) as (
  select rid, case when coalesce(doc_id, -1) < 0 then coalesce(doc_id, -1)::hugeint + {WORD} else doc_id::hugeint end, 0::bigint, 0::bigint, 0::bigint from raw
  union all
  select rid, nk, case when j < {SHARDS} then j else b end, cast(floor((j + 1.0::double) * ({RANGE}.0::double / (cast(nk // {TOP_BITS} as double) + 1.0::double))) as bigint), j
  from (select *, (k * {MULTIPLIER} + 1) % {WORD} as nk from walk where j <= {SHARDS})),
placed as (select rid, max(b) as shard, max(grown) as grown_shard from walk group by rid)
select doc_id, size, text_crc32, 'key' as law, cast(shard as int) as shard,
  row_number() over (partition by shard order by coalesce(doc_id, -1), text_crc32, size) - 1 as slot, cast(grown_shard as int) as grown_shard
from sums join placed using (rid)"""


@query("op4_sharding", OP4_SQL)
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of forty shards, by its id and the shard count alone."""
    d = assign_shards(only(documents(spark, sf_dir), doc_id="doc_id", text="text"), "doc_id", "text", SHARDS)
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
