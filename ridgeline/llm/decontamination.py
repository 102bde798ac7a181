"""Benchmark decontamination by a positional inverted index, in DataFrame operations alone.

A window is a run of consecutive words of a benchmark item. All words of the
corpus that occur in the benchmark are counted; each window then starts from
its rarest terms. Postings (term, document, position) of those terms over the
whole corpus are stored as the index. A window's lists are intersected from the
rarest on, each shifted by the term's place in the item, so that what is left
is (document, item, shift). A shift that survives is looked at in the
document's own words: windows found there word by word are exact phrase
matches; shifts whose rarest terms only lie within ``slop`` places of where
they belong are proximity matches.

Documents take part under a hash of id and text. Two that shared one would only
be looked at for each other's shifts, so results are exact.

Cases: null and empty texts have no words and are clean; an item without words
has no windows, one with fewer words than a window is one window; null item ids
count as the empty text; repeated documents each get their row, repeated items
count once; a very long document is one row, its postings are many; ties in
rarity go to the term that sorts first; with an empty benchmark all documents are
clean; an empty corpus gives no rows; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import documents, only, shared_folder, stored
from ridgeline.llm.registry import query
from ridgeline.operators.plans import pin

WINDOW = 10
SLOP = 2
RAREST = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of benchmark terms or windows sent to every task; beyond it, joins shuffle.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def sized_broadcast(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it is counted to be small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def benchmark_items(items: DataFrame) -> DataFrame:
    """(item, words) of the items that have words, each once."""
    d = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words"))
    return d.where(F.size("words") > 0).distinct()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, key, pos) of the given (term, t) in (key, text)."""
    d = docs.select("key", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return d.join(sized_broadcast(terms), "term").select("t", "key", "pos")


def rarest_terms(items: DataFrame, counts: DataFrame, window: int, rarest: int = RAREST) -> DataFrame:
    """(row, terms): the searches that the windows of the items come down to.

    ``terms`` holds a window's rarest terms with their place in the item, the
    rarest first. A window with a term that the corpus lacks is dropped.
    """
    length = F.least(F.lit(window), F.size("words"))
    each = items.select("row", "words", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("words") - length)).alias("first"))
    each = each.withColumn("i", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("length") - 1)))
    each = each.withColumn("term", F.element_at("words", F.col("i") + 1)).join(counts, "term", "left")
    ordered = F.array_sort(F.collect_list(F.struct("n", "term", "t", "i")))
    d = each.groupBy("row", "first").agg(ordered.alias("terms"), F.count_if(F.col("n").isNull()).alias("lacking"))
    few = F.transform(F.slice("terms", 1, rarest), lambda x: F.struct(x["t"].alias("t"), x["i"].alias("i")))
    return d.where("lacking = 0").select("row", few.alias("terms")).distinct()


def intersect(found: DataFrame, index: DataFrame, searches: DataFrame, nth: int, slop: int) -> DataFrame:
    """Keep the shifts at which the ``nth`` term has a posting, at most ``slop`` off its place.

    Positions meet by stretches of ``2 * slop + 1``, of which a range touches two at most.
    """
    width = 2 * slop + 1
    further = searches.select("search", F.get("terms", F.lit(nth)).alias("x")).select("search", "x.t", "x.i")
    asked = found.join(sized_broadcast(further), "search")
    done = asked.where("t is null").select("key", "search", "shift")
    asked = asked.where("t is not null").withColumn("place", F.col("shift") + F.col("i"))
    asked = asked.withColumn("stretch", F.explode(F.array_distinct(F.array(
        F.floor((F.col("place") - slop) / width), F.floor((F.col("place") + slop) / width)))))
    lists = index.withColumn("stretch", F.floor(F.col("pos") / width))
    kept = asked.join(lists, ["key", "t", "stretch"]).where(F.abs(F.col("pos") - F.col("place")) <= slop)
    return done.unionByName(kept.select("key", "search", "shift")).distinct()


def candidate_shifts(docs: DataFrame, items: DataFrame, at: str, window: int, slop: int) -> DataFrame:
    """(key, row, shift) where the rarest terms of some window of the item agree."""
    number = F.monotonically_increasing_id()
    vocabulary = stored(items.select(F.explode("words").alias("term")).distinct().withColumn("t", number), at, "vocabulary")
    counts = postings(docs, vocabulary).groupBy("t").agg(F.count("*").alias("n"))
    counts = stored(counts.join(vocabulary, "t"), at, "counts")
    searches = stored(rarest_terms(items, counts, window).withColumn("search", number), at, "searches")
    needed = vocabulary.join(searches.select(F.explode("terms.t").alias("t")).distinct(), "t", "left_semi")
    index = stored(postings(docs, needed), at, "index")
    starts = searches.select("search", F.col("terms")[0]["t"].alias("t"), F.col("terms")[0]["i"].alias("i"))
    found = index.join(sized_broadcast(starts), "t").select("key", "search", (F.col("pos") - F.col("i")).alias("shift"))
    for nth in range(1, RAREST):
        found = intersect(found, index, searches, nth, slop)
    return found.join(sized_broadcast(searches.select("search", "row")), "search").select("key", "row", "shift").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """All columns of ``docs`` (``text`` among them) with what was found in each.

    Adds ``found``: a struct of ``n_words``, ``n_hit`` (words inside any
    occurrence), ``spans`` (the occurrences as start and end), ``items`` (ids
    with an occurring window, sorted as text) and ``near`` (ids with a proximity
    match alone).
    """
    at = shared_folder(docs.sparkSession)
    keyed = docs.select("*", F.xxhash64("doc_id", "text").alias("_key"))
    rows = stored(benchmark_items(items).withColumn("row", F.monotonically_increasing_id()), at, "items")
    shifts = candidate_shifts(keyed.select(F.col("_key").alias("key"), "text"), rows, at, window, slop)
    shifts = shifts.join(sized_broadcast(rows.withColumn("length", F.least(F.lit(window), F.size("words")))), "row")
    shifts = shifts.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("item", "words", "length", "shift")).alias("_shifts"))
    shifts = stored(shifts, at, "shifts")
    d = keyed.join(shifts.hint("shuffle_hash"), "_key", "left").withColumn("_words", words_of(F.col("text")))
    d = pin(d, ["_words"])

    def occurrences(c: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(c["words"]) - c["length"]),
            lambda i: F.when(c["shift"] + i >= 0, F.slice("_words", c["shift"] + i + 1, c["length"]) == F.slice(c["words"], i + 1, c["length"])).otherwise(False))
        return F.transform(starts, lambda i: F.struct(
            (c["shift"] + i).alias("start"), (c["shift"] + i + c["length"]).alias("end"), c["item"].alias("item")))

    d = pin(d.withColumn("_seen", F.array_sort(F.flatten(F.transform("_shifts", occurrences)))), ["_seen"])
    union = F.aggregate(
        "_seen", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"),
                              F.greatest(a["upto"], s["end"]).alias("upto")), lambda a: a["n"])
    ids = F.array_sort(F.array_distinct(F.coalesce(F.col("_seen.item"), F.array().cast("array<string>"))))
    near = F.array_sort(F.array_except(F.coalesce(F.col("_shifts.item"), F.array().cast("array<string>")), ids))
    spans = F.array_distinct(F.transform("_seen", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return d.withColumn("found", F.struct(
        F.size("_words").cast("bigint").alias("n_words"), F.coalesce(union, F.lit(0)).cast("bigint").alias("n_hit"),
        spans.alias("spans"), ids.alias("items"), near.alias("near"))).drop("_key", "_shifts", "_words", "_seen")


OP6_SQL = rf"""
with d as (
  select doc_id, row_number() over () as rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'),
    lambda x: x <> '') as words from documents),
b as (
  select cast(item_id as varchar) as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'),
    lambda x: x <> '') as words from benchmark),
bw as (
  select item, least({WINDOW}, len(words)) as n, unnest(range(1, len(words) - least({WINDOW}, len(words)) + 2)) as i, words from b where len(words) > 0),
windows as (select distinct item, n, array_to_string(words[i:i + n - 1], ' ') as w from bw),
sizes as (select distinct n from windows),
dw as (
  select rid, n, unnest(range(1, len(words) - n + 2)) as i, words from d, sizes where len(words) >= n),
hits as (
  select rid, i, dw.n, item from (select rid, n, i, array_to_string(words[i:i + n - 1], ' ') as w from dw) dw join windows on windows.n = dw.n and windows.w = dw.w),
hit_words as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from hits) group by rid),
hit_items as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from hits group by rid)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit_words using (rid) left join hit_items using (rid)"""


@query("op6_decontamination", OP6_SQL)
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    d = decontaminate(only(documents(spark, sf_dir), doc_id="doc_id", text="text"),
                      only(documents(spark, sf_dir, "benchmark"), item_id="item_id", text="text"))
    return d.select("doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("found.items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))
