"""How far the sources of a language differ in their words.

Arrow does the counting where the texts are read: ``ascii_lower``,
``split_pattern_regex``, ``dictionary_encode`` and a hash ``group_by`` inside
``mapInArrow`` turn batches into partial counts, which a task merges before it
sends them on. The counts of kept terms are then dealt into columnar shards of
(lang, terms, two blocks of sources); a shard adds up the divergences of its
terms for every pair of its sources, and the shards' sums are added.

Numbers are exact: p is a whole number of billionths, and divergences are whole.

Cases: null text, lang and source are ''; an empty text has no terms but its
group counts; a lang without a kept term has pairs of value 0 and no terms;
repeated rows count as documents of their own; very long texts are read whole;
ties go to the smaller item in UTF-8 order; an empty table gives no rows;
further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import documents, only, shared_folder, stored
from ridgeline.llm.registry import query

#: What stands between terms.
GAP = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCUMENTS = 10
SCALE = 1_000_000_000
PRIOR = 2
TOP_TERMS = 10
#: Distinct (lang, source, term) rows that a task holds before it sends them on.
HELD_ROWS = 500_000
#: Bytes of text that Arrow splits at a time.
SLICE_BYTES = 16 << 20
#: Counts in one shard, and sources in one of its two blocks.
SHARD_ROWS, SOURCE_BLOCK = 262_144, 256

PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                     ("n", pa.int64()), ("docs", pa.int64())])


def _merged(parts: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table([t["lang"], t["source"], t["term"], t["n_sum"], t["docs_sum"]], schema=PARTIAL)


def batch_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, text) rows to their groups' terms with occurrences and documents."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), GAP)
    rows, terms = pc.list_parent_indices(words), pc.list_flatten(words)
    filled = pc.greater(pc.binary_length(terms), 0)
    codes = pc.filter(terms, filled).dictionary_encode()
    per_row = pa.table([pc.filter(rows, filled), codes.indices], names=["row", "code"]).group_by(["row", "code"]).aggregate([([], "count_all")])
    keys = [pc.take(batch.column(i), per_row["row"]) for i in range(2)]
    t = pa.table([*keys, per_row["code"], per_row["count_all"]], names=["lang", "source", "code", "n"])
    t = t.group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    return pa.table([t["lang"], t["source"], pc.take(codes.dictionary, t["code"]), t["n_sum"], t["n_count"]], schema=PARTIAL)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``SLICE_BYTES`` of text; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(ends // SLICE_BYTES, return_index=True)[1].tolist() + [batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        for part in _slices(batch):
            held.append(batch_counts(part))
            if sum(t.num_rows for t in held) > HELD_ROWS:
                held = [_merged(held)]
                if held[0].num_rows > HELD_ROWS // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from _merged(held).to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, text) to (lang, source, term, n, docs), terms of every group with its documents that hold them."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(
        count_batches, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a term: one more than its smoothed share in whole billionths."""
    top = (n + PRIOR).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", top, (total + 2 * terms).cast("decimal(28,0)"))


def shard_divergences(shard: pa.Table) -> pa.Table:
    """Divergences of one shard's terms, for the pairs of its two blocks of sources.

    Rows are (side, source, zero, term, p): ``side`` 0 and 1 are the blocks, ``zero``
    is a source's p where it has no count, and a null term only brings a source.
    """
    sides = []
    terms = shard["term"].combine_chunks().dictionary_encode()
    code = pc.fill_null(terms.indices, -1).to_numpy(zero_copy_only=False)
    side, p = shard["side"].to_numpy(), pc.fill_null(shard["p"], 0).to_numpy()
    for i in (0, 1):
        mine = pa.table({"source": shard["source"], "zero": shard["zero"]}).filter(pa.array(side == i))
        names = mine["source"].combine_chunks().dictionary_encode()
        rows = names.indices.to_numpy()
        zero = np.zeros(len(names.dictionary), np.int64)
        zero[rows] = mine["zero"].to_numpy()
        matrix = np.repeat(zero[:, None], len(terms.dictionary), axis=1)
        known = code[side == i] >= 0
        matrix[rows[known], code[side == i][known]] = p[side == i][known]
        sides.append((names.dictionary, matrix))
    (a, pa_), (b, pb) = sides
    out = np.empty((len(a), len(b)), np.int64)
    for i in range(len(a)):
        gap = pa_[i] - pb
        out[i] = (gap * gap // (pa_[i] + pb)).sum(axis=1)
    left, right = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a))
    return pa.table([pc.take(a, pa.array(left)), pc.take(b, pa.array(right)), pa.array(out.ravel())], names=["source", "item", "value"])


def pair_values(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, item, value): summed divergence of every two sources of a lang.

    ``groups`` is (lang, source, terms, zero) and ``kept`` (lang, source, term, p).
    Sources are numbered into blocks, terms into parts by their hash; a shard is a
    part with two blocks. A part that no source of a block has a count in still
    differs by the zeros, so every part gets every source once.
    """
    numbered = groups.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1) / SOURCE_BLOCK).cast("int"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("rows")).join(
        numbered.groupBy("lang").agg((F.max("block") + 1).alias("blocks"), F.max("terms").alias("terms")), "lang")
    # Counts of a part fill at most SHARD_ROWS / SOURCE_BLOCK terms of two blocks' matrices.
    parts = sizes.select("lang", "blocks", F.greatest(F.ceil(F.col("rows") / SHARD_ROWS), F.ceil(F.col("terms") * SOURCE_BLOCK / (8 * SHARD_ROWS))).cast("int").alias("parts"))
    sources = numbered.select("lang", "source", "block", "zero").join(parts, "lang")
    known = kept.join(sources, ["lang", "source"]).withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")).cast("int"))
    alone = sources.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns(
        {"term": F.lit(None).cast("string"), "p": F.lit(None).cast("bigint")})
    # One row a term of a part, so that terms which only the other blocks hold are there too.
    listed = known.select("lang", "part", "blocks", "term").distinct().withColumns(
        {"source": F.lit(None).cast("string"), "block": F.lit(None).cast("int"), "zero": F.lit(None).cast("bigint"), "p": F.lit(None).cast("bigint")})
    cols = ["lang", "part", "blocks", "source", "block", "zero", "term", "p"]
    rows = known.select(*cols).unionByName(alone.select(*cols)).unionByName(listed.select(*cols))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    mine = F.flatten(F.transform(others, lambda o: F.when(F.col("block").isNull(), F.transform(others, lambda i: F.struct(o.alias("i"), i.alias("j"), F.lit(-1).alias("side"))))
                                 .otherwise(F.array(F.struct(F.col("block").alias("i"), o.alias("j"), F.lit(0).alias("side")),
                                                    F.struct(o.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))))))
    dealt = rows.withColumn("at", F.explode(mine)).select("lang", "part", "at.*", "source", "zero", "term", "p")

    def divergences(key: tuple, shard: pa.Table) -> pa.Table:
        t = shard_divergences(shard)
        return t.append_column("lang", pa.array([key[0].as_py()] * t.num_rows, pa.string()))

    sums = dealt.groupBy("lang", "part", "i", "j").applyInArrow(divergences, "source string, item string, value bigint, lang string")
    return sums.where("source <> item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence_audit(docs: DataFrame, at: str, min_documents: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, text) to (lang, source, part, item, value, rank).

    ``at`` is a folder that all executors share; the counts are kept there.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counts = stored(term_counts(docs), at, "term_counts")
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents)
    by_term = stored(by_term, at, "kept_terms").drop("docs")
    kept = counts.select("lang", "source", "term", "n").join(by_term, ["lang", "term"])
    langs = by_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select(empty("lang"), empty("source")).distinct().join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.na.fill(0, ["terms", "all_total", "total"]).withColumn("zero", F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))))
    groups = stored(groups, at, "groups")
    kept = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("all_n"), F.col("all_total"), F.col("terms")).alias("q"))
    kept = stored(kept, at, "shares")
    values = pair_values(groups.where("terms > 0").select("lang", "source", "terms", "zero"), kept.select("lang", "source", "term", "p"))
    bare = groups.where("terms = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").withColumn("value", F.lit(0).cast("bigint"))
    first = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = values.select("lang", "source", "item", "value").unionByName(bare.select("lang", "source", "item", "value"))
    pairs = pairs.withColumn("rank", F.row_number().over(first)).withColumn("part", F.lit("pair"))
    gap = F.col("p") - F.col("q")
    words = kept.where("p > q").select("lang", "source", F.col("term").alias("item"), F.call_function("div", gap * gap, F.col("p") + F.col("q")).alias("value"))
    words = words.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    cols = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*cols).unionByName(words.select(*cols))


OP12_SQL = rf"""
with docs as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as rid,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents),
per_doc as (select lang, source, rid, term, count(*) as n from (select lang, source, rid, unnest(words) as term from docs) group by all),
kept as (select lang, term, sum(n)::hugeint as n from per_doc group by all having count(*) >= {MIN_DOCUMENTS}),
langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang),
grp as (select distinct lang, source from docs),
counts as (select lang, source, term, sum(n)::hugeint as n from per_doc semi join kept using (lang, term) group by all),
totals as (select lang, source, sum(n)::hugeint as total from counts group by all),
shares as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
    1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + {PRIOR})) // (coalesce(t.total, 0) + 2 * l.v) as p,
    1 + ({SCALE}::hugeint * (k.n + {PRIOR})) // (l.total + 2 * l.v) as q
  from grp g join langs l using (lang) join kept k using (lang)
    left join counts c on c.lang = g.lang and c.source = g.source and c.term = k.term
    left join totals t on t.lang = g.lang and t.source = g.source),
sums as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
  from grp a join grp b on a.lang = b.lang and a.source <> b.source
    left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
words as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q)) // (p + q) as value from shares where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank
  from (select * from pairs union all select * from words))
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {TOP_TERMS}"""


@query("op12_source_divergence", OP12_SQL)
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against each other of its lang, and the terms it uses more than its lang."""
    docs = only(documents(spark, sf_dir), lang="lang", source="source", text="text")
    return divergence_audit(docs, shared_folder(spark))
