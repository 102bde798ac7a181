"""Mixing sources to target weights, in column expressions alone.

Each source's documents are laid end to end as one stream of tokens, cut into
blocks of fixed length, of which the last may be shorter. A source gets as many
slots as its target has of its own mean block. Output shards hold equally many
slots; a shard's slots
are drawn over the sources multinomially in residual form: every source gets
the whole part of its expectation, and what is left is drawn by the fractions,
which keeps a source near its target. The i-th slot of a source takes block
``perm(i mod N)`` of its N blocks, where ``perm`` is a pseudorandom permutation
of indices, another one for each pass over the source; slots and packed blocks
then meet in a join on the block index.

Cases: null and empty texts have no tokens and take nothing; a null source is a
source of its own and comes last; equal rows are laid out one after the other;
a very long text spans many blocks; an empty table gives no rows; a table
without tokens gets targets of 0; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import documents, only, shared_folder, stored, uniform
from ridgeline.llm.registry import query
from ridgeline.operators.ranks import hashed_rank, running_totals

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_TOKENS = 64
SHARD_SLOTS = 1024
CAP = 3
ROUNDS = 12
SEED = 7
#: Documents of one source are laid out in so many independent runs.
RUNS = 4096
#: Shards are numbered in spans, so that running totals never gather a source.
SHARD_SPAN = 64


def source_key(source: Column) -> Column:
    """A text that sorts as the source does by code point, null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, text, source) to (doc_id, source, src, size, crc)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", "source", source_key(F.col("source")).alias("src"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"))


def source_targets(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """One row per source: its size, weight and target.

    Weights 1, 2, 3 repeat in the order of sources. Targets are
    ``min(weight * level, cap * size)``, with the one level at which they add up
    to all tokens: what resharing an excess by weight, again and again, ends in.
    Sources in the order of ``cap * size / weight`` are capped from the front.
    """
    s = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", (F.row_number().over(Window.orderBy("src")) - 1) % 3 + 1)
    s = s.withColumns({"cap": (cap * F.col("source_size")).cast("double"), "w": F.col("weight").cast("double")})
    order = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(whole),
        "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "rest": F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))})
    level = (F.col("total") - F.col("capped")) / F.col("rest")
    fits = level <= F.col("cap") / F.col("w")
    s = s.withColumn("level", F.min(F.when(fits, F.struct(F.col("capped").alias("at"), level.alias("level")))).over(whole)["level"])
    target = F.least(F.col("w") * F.coalesce("level", F.lit(float("inf"))), F.col("cap"))
    return s.select("src", "source_size", "weight", target.alias("target"), "total")


def permuted(index: Column, size: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. size-1, by swap-or-not rounds.

    Each round pairs an index with ``k - index`` modulo the size and swaps the
    two if a bit hashed from the larger says so: a bijection for every size.
    """
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), size) - x, size)
        return F.when(F.xxhash64(key, r, F.greatest(x, other)).bitwiseAND(1) == 1, other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index, swap)


def draw_slots(targets: DataFrame, block: int = BLOCK_TOKENS, slots: int = SHARD_SLOTS, cap: int = CAP,
               seed: int = SEED) -> DataFrame:
    """The mixture: (src, shard, block), one row for each output slot.

    Slots that draws gave a source beyond its own, in shards in hashed order, are
    drawn again for the sources that got fewer, by what each still lacks. So a
    source ends within two blocks of its target, and none gives a block more than
    ``cap`` times.
    """
    t = targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
    t = t.withColumn("own_slots", F.col("target") / (F.col("source_size") / F.col("blocks")))
    # In order, so that the sum of doubles does not hang on the plan.
    every = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("wanted", F.sum("own_slots").over(every)).withColumn("all_slots", F.round("wanted").cast("bigint"))
    t = t.withColumn("shards", F.greatest(F.ceil(F.col("all_slots") / slots), F.lit(1)))
    # Each source meets each shard by unrolling its own shard numbers, span by span.
    span = t.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("shards") - 1) / SHARD_SPAN))).alias("span"))
    span = span.repartition("src", "span")
    first = F.col("span") * SHARD_SPAN
    each = span.select("*", F.explode(F.sequence(first, F.least(first + SHARD_SPAN, F.col("shards")) - 1)).alias("shard"))
    held = F.least(F.lit(slots).cast("bigint"), F.col("all_slots") - F.col("shard") * slots)
    expected = held * (F.col("own_slots") / F.col("wanted"))
    each = each.withColumns({"whole": F.floor(expected), "held": held})
    each = each.withColumn("part", expected - F.col("whole"))
    by_shard = Window.partitionBy("shard").orderBy("src")
    everyone = Window.partitionBy("shard")
    each = each.withColumns({
        "left": F.col("held") - F.sum("whole").over(everyone),
        "high": F.sum("part").over(by_shard.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "last": F.row_number().over(by_shard) == F.count("*").over(everyone)})
    each = each.withColumn("low", F.col("high") - F.col("part"))
    each = each.withColumn("high", F.when(F.col("last"), F.greatest(F.col("left").cast("double"), F.col("high"))).otherwise(F.col("high")))
    # What is left: draws u in [0, left), each for the source whose interval holds it.
    draws = each.where("last and left > 0").select("shard", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("left"))).alias("n"), "left")
    draws = draws.withColumn("u", uniform(F.lit(seed), F.lit("draw"), F.col("shard"), F.col("n")) * F.col("left"))
    draws = draws.withColumn("cell", F.floor("u"))
    ranges = each.where("high > low").select("src", "shard", "low", "high", F.explode(
        F.sequence(F.floor("low"), F.greatest(F.ceil("high") - 1, F.floor("low")))).alias("cell"))
    drawn = draws.join(ranges, ["shard", "cell"]).where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    counts = each.select("src", "shard", "span", F.col("whole").alias("n")).unionByName(
        drawn.select("src", "shard", F.floor(F.col("shard") / SHARD_SPAN).alias("span"), F.lit(1).cast("bigint").alias("n")))
    counts = counts.groupBy("src", "span", "shard").agg(F.sum("n").alias("n")).join(t.select("src", "blocks", "own_slots", "shards"), "src")
    counts = counts.withColumn("order", uniform(F.lit(seed), F.lit("order"), F.col("shard")))
    counts = counts.withColumn("span", F.floor(F.col("order") * F.ceil(F.col("shards") / SHARD_SPAN)))
    at = shared_folder(targets.sparkSession)
    counts = stored(running_totals(counts, ["src"], "span", ["order", "shard"], {"upto": "n"}).where("n > 0"), at, "counts")
    # A row here becomes many slots, so rows are spread by number before: their own few bytes would be left in one task.
    spread = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = F.least(F.ceil("own_slots"), cap * F.col("blocks"))
    counts = counts.withColumn("over", F.greatest(F.lit(0).cast("bigint"), F.least("n", F.col("upto") - most)))
    again = redrawn(counts, t, at, seed)
    counts = counts.select("src", "shard", "blocks", (F.col("upto") - F.col("n")).alias("first"), (F.col("upto") - F.col("over")).alias("end")).where("first < end")
    counts = counts.unionByName(again).repartition(spread, "src", "shard")
    rows = counts.select("src", "shard", "blocks", F.explode(F.sequence(F.col("first"), F.col("end") - 1)).alias("i"))
    turn = F.xxhash64(F.lit(seed), F.col("src"), F.floor(F.col("i") / F.col("blocks")))
    return rows.select("src", "shard", permuted(F.col("i") % F.col("blocks"), F.col("blocks"), turn).alias("block"))


def redrawn(counts: DataFrame, t: DataFrame, at: str, seed: int) -> DataFrame:
    """Slots (src, shard, blocks, first, end) in place of those that ``counts`` marks ``over``.

    What a source lacks, its own slots less what it kept, never takes it past its
    cap. The shares of what is free are rounded by one systematic draw, so each
    is taken whole, up or down, and they add up. Free slots and takers are
    numbered alike and meet by number.
    """
    got = counts.groupBy("src").agg(F.sum(F.col("n") - F.col("over")).alias("kept"), F.sum("over").alias("over"))
    s = t.select("src", "blocks", "own_slots").join(got, "src", "left").na.fill(0, ["kept", "over"])
    s = s.withColumn("lack", F.greatest(F.col("own_slots") - F.col("kept"), F.lit(0.0)))
    order = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.col("lack") * F.least(F.lit(1.0), F.try_divide(F.sum("over").over(every), F.sum("lack").over(every)))
    s = s.withColumn("share", F.coalesce(share, F.lit(0.0)))
    draw = uniform(F.lit(seed), F.lit("again"))
    s = s.withColumn("upto", F.floor(F.sum("share").over(order) + draw)).withColumn("gain", F.col("upto") - F.coalesce(F.lag("upto").over(Window.orderBy("src")), F.lit(0).cast("bigint")))
    s = stored(s.where("gain > 0").select("src", "blocks", "kept", "gain", "upto"), at, "redrawn")
    free = stored(counts.where("over > 0").select("src", "shard", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("over"))).alias("k")), at, "free")
    free = hashed_rank(free.withColumn("all", F.lit(1)), ["all"], ["shard", "src", "k"], "number").select("number", "shard")
    takers = s.select("src", "blocks", F.explode(F.sequence(F.col("upto") - F.col("gain") + 1, F.col("upto"))).alias("number"), (F.col("kept") - F.col("upto") + F.col("gain") - 1).alias("base"))
    first = F.col("base") + F.col("number")
    return takers.join(free, "number").select("src", "shard", "blocks", first.alias("first"), (first + 1).alias("end"))


def packed(rows: DataFrame) -> DataFrame:
    """Rows with ``start``: their first token's place in the stream of their source."""
    d = rows.withColumn("run", F.pmod(F.xxhash64("doc_id", "crc"), F.lit(RUNS)))
    d = running_totals(d, ["src"], "run", ["doc_id", "crc", "size"], {"upto": "size"})
    return d.withColumn("start", F.col("upto") - F.col("size")).drop("upto", "run")


def mix(docs: DataFrame, block: int = BLOCK_TOKENS, slots: int = SHARD_SLOTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """(doc_id, text, source) to (doc_id, source, size, crc, source_size, target, taken).

    ``taken`` counts the tokens of a document that the mixture holds, repeats
    included; it is at most ``cap`` times the size.
    """
    rows = stored(sized(docs), shared_folder(docs.sparkSession), "sized")
    targets = source_targets(rows, cap)
    uses = draw_slots(targets, block, slots, cap, seed).groupBy("src", "block").agg(F.count("*").alias("uses"))
    placed = packed(rows.where("size > 0"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.withColumn("block", F.explode(F.sequence(first, last)))
    inside = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    full = pieces.join(uses, ["src", "block"], "left").groupBy("src", "start", "doc_id", "source", "size", "crc").agg(
        F.coalesce(F.sum(F.col("uses") * inside), F.lit(0)).cast("bigint").alias("taken")).drop("start")
    none = rows.where("size = 0").select("src", "doc_id", "source", "size", "crc", F.lit(0).cast("bigint").alias("taken"))
    return full.unionByName(none).join(targets.select("src", "source_size", "target"), "src").drop("src")


@query("op7_source_mix")
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights of their sources."""
    d = mix(only(documents(spark, sf_dir), doc_id="doc_id", text="text", source="source"))
    return d.select("doc_id", "size", "source_size", "target", "taken", "source")
