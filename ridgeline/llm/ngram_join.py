"""N-gram Jaccard join by prefix trees.

A document is the set of its word n-grams, held as 64-bit hashes. Two sets link
when ``100 * intersection >= percent * union``. The join is exact:

1. Equal sets are one class, found by a 128-bit digest of the set.
2. A class goes on only if enough of its first hashes (in hash order) occur in
   another class. Two linked sets share at least ``l`` of the first
   ``n - need + l`` hashes of each, so a class with fewer such hits has no link.
3. Over the classes left, n-grams are ordered globally by how many sets hold
   them. The rarest ``n - need + 1`` n-grams of a set are its keys; linked sets
   share a key. Sets tied through keys form neighbourhoods.
4. A neighbourhood, in blocks of bounded size, is joined by a prefix tree: its
   sets, most frequent n-gram first, are stored in a trie whose nodes hold runs
   of n-grams. Queries walk down it together; sets with a common beginning
   share the overlap counted so far, and a query leaves a subtree when overlap
   plus the shorter of the remaining lengths cannot reach what the sizes demand.
5. Links give components.

Blocks of one neighbourhood meet where they share a key; every pair of sets
meets in exactly one block pair. N-grams travel packed by ranges of hash, once
for a batch of documents, so neither a common n-gram nor a group of copies
gathers in one task.

Cases: null and empty texts and texts of white space have an empty set and
link with nothing; a text with fewer words than an n-gram is one n-gram; very
long texts are read whole; repeated rows are copies; an id on several texts has the
links of all of them; a row without an id has a
set but no links and a null component; an empty table gives no rows; further
columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import documents, only, shared_folder, stored
from ridgeline.llm.components import components
from ridgeline.llm.registry import query

MIX = np.uint64(0x9E3779B97F4A7C15)
#: One in so many n-grams is asked for in step 2.
SPARE = 16
#: N-grams of one range of hashes, on average.
RANGE_NGRAMS = 1 << 19
#: Sets whose n-grams travel together.
BATCH_SETS = 1024
#: Sets of one trie, on average.
BLOCK_SETS = 512
#: Bytes of the table of queries against n-grams that one walk may hold.
WALK_BYTES = 1 << 25


def ngrams(text: str | None, n: int) -> np.ndarray:
    """Distinct hashed n-grams of the words of a text, in ascending order."""
    h = xxhash.xxh3_64_intdigest
    words = np.array([h(w) for w in (text or "").encode().lower().split()], dtype=np.uint64)
    if not len(words):
        return words
    width = min(n, len(words))
    count = len(words) - width + 1
    out = words[:count] ^ np.uint64(width)
    for k in range(1, width):
        out = ((out ^ (out >> np.uint64(29))) * MIX) + words[k:k + count]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def needed(size: int, percent: int) -> int:
    """The least overlap of a set with any set it links to."""
    return -(-percent * size // 100)


def pair_needed(sizes: np.ndarray | int, percent: int) -> np.ndarray:
    """The least overlap that links two sets whose sizes add up to ``sizes``."""
    return -(-percent * np.asarray(sizes) // (100 + percent))


def digest(ngram_set: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(ngram_set.tobytes())


def _blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, text) to (id, n_shingles, digest, sid, first): ``first`` once for each class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for b in batches:
            sizes, digests, sids, first = [], [], [], []
            for t in b.column(1).to_pylist():
                s = ngrams(t, n)
                d = digest(s) if len(s) else None
                sizes.append(len(s))
                digests.append(d)
                sids.append(int.from_bytes(d[:8], "little", signed=True) if d else None)
                if d is None or d in known:
                    first.append(None)
                    continue
                known.add(d)
                first.append(s[:len(s) - needed(len(s), percent) + max(1, len(s) // SPARE)].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sids, pa.int64()), pa.array(first, pa.binary())],
                ["id", "n_shingles", "digest", "sid", "first"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, n_shingles bigint, digest binary, sid bigint, first binary")


def _ranges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted ``keys`` fall in, and where each begins."""
    return np.unique(keys >> np.uint64(64 - bits), return_index=True)


def shared_firsts(rows: DataFrame, bits: int) -> DataFrame:
    """(sid, first) to (sid, hits): how many of a class's first hashes another class has, or more.

    A batch sends a hash once, marked if several of its classes have it; those
    classes then already know. So a hash that all documents share costs each
    batch one entry.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(1)]
            keys, sids = np.concatenate(parts), np.repeat(b.column(0).to_numpy(), [len(p) for p in parts])
            order = np.lexsort((sids, keys))
            keys, sids = keys[order], sids[order]
            fresh = np.append(True, (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1]))
            keys, sids = keys[fresh], sids[fresh]
            lead = np.append(True, keys[1:] != keys[:-1])
            run = np.cumsum(lead) - 1
            several = np.bincount(run)[run] > 1
            keys, owners, marks, told = keys[lead], sids[lead], several[lead], np.sort(sids[several].view(np.uint64))
            names, at = _ranges(keys, bits)
            ends = np.append(at[1:], len(keys))
            spans = list(zip(at, ends, strict=True))
            none = b""
            yield pa.RecordBatch.from_arrays(
                [pa.array(names.astype(np.int64)), _blobs([keys[i:j] for i, j in spans]), _blobs([owners[i:j] for i, j in spans]),
                 _blobs([marks[i:j] for i, j in spans]), pa.array([none] * len(spans), pa.binary())], ["range", "keys", "sids", "marks", "told"])
            if len(told):
                names, at = _ranges(told, bits)
                spans = list(zip(at, np.append(at[1:], len(told)), strict=True))
                empty = pa.array([none] * len(spans), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), empty, empty, empty, _blobs([told[i:j] for i, j in spans])],
                                                 ["range", "keys", "sids", "marks", "told"])

    def meet(t: pa.Table) -> pa.Table:
        joined = lambda c, kind: np.frombuffer(b"".join(t[c].to_pylist()), kind)
        keys, sids, marks, told = joined("keys", np.uint64), joined("sids", np.int64), joined("marks", bool), joined("told", np.int64)
        order = np.lexsort((sids, keys))
        keys, sids, marks = keys[order], sids[order], marks[order]
        lead = np.append(True, keys[1:] != keys[:-1])[:len(keys)]
        fresh = lead | np.append(True, sids[1:] != sids[:-1])[:len(keys)]
        run = np.cumsum(lead) - 1
        shared = (np.bincount(run, fresh) > 1) | (np.bincount(run, marks) > 0) if len(keys) else np.zeros(0, bool)
        names, hits = np.unique(np.concatenate([sids[fresh & ~marks & shared[run]] if len(keys) else sids, told]), return_counts=True)
        return pa.table({"sid": pa.array(names), "hits": pa.array(hits.astype(np.int64))})

    sent = rows.select("sid", "first").mapInArrow(send, "range bigint, keys binary, sids binary, marks binary, told binary")
    return sent.groupBy("range").applyInArrow(meet, "sid bigint, hits bigint").groupBy("sid").agg(F.sum("hits").alias("hits"))


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """(class, text, digest) to (batch, id, n, ngrams): the sets that have the given digest, once a task; ``id`` is the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, done = TaskContext.get().partitionId() << 32, set()
        for b in batches:
            for at in range(0, b.num_rows, BATCH_SETS):
                ids, sizes, blobs = [], [], []
                for i, t, d in zip(*[c.to_pylist() for c in b.slice(at, BATCH_SETS).columns], strict=True):
                    s = ngrams(t, n)
                    if i not in done and len(s) and digest(s) == d:
                        done.add(i)
                        ids.append(i)
                        sizes.append(len(s))
                        blobs.append(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([made] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _blobs(blobs)],
                    ["batch", "id", "n", "ngrams"])
                made += 1

    return docs.select("class", "text", "digest").mapInArrow(run, "batch bigint, id bigint, n bigint, ngrams binary")


def ordered_sets(sets: DataFrame, bits: int, percent: int) -> DataFrame:
    """(id, n, ngrams, counts, keys) of the sets that have a key.

    ``ngrams`` are those of more than one set, the most frequent first, with
    ``counts`` beside them; ``keys`` are the rarest that a link must touch.
    """

    def ask(t: pa.Table) -> pa.Table:
        keys, counts = np.unique(np.frombuffer(b"".join(t["ngrams"].to_pylist()), np.uint64), return_counts=True)
        names, at = _ranges(keys, bits)
        spans = list(zip(at, np.append(at[1:], len(keys)), strict=True))
        return pa.table({"range": pa.array(names.astype(np.int64)), "batch": pa.array([t["batch"][0].as_py()] * len(spans), pa.int64()),
                         "keys": _blobs([keys[i:j] for i, j in spans]), "counts": _blobs([counts[i:j].astype(np.int64) for i, j in spans])})

    def answer(t: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in t["keys"].to_pylist()]
        every, where = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(where, np.frombuffer(b"".join(t["counts"].to_pylist()), np.int64)).astype(np.int64)
        keep = total[where] > 1
        ends = np.cumsum([len(p) for p in parts])
        out = [(t["batch"][i].as_py(), p[keep[e - len(p):e]], total[where[e - len(p):e]][keep[e - len(p):e]]) for i, (p, e) in enumerate(zip(parts, ends, strict=True))]
        return pa.table({"batch": pa.array([b for b, _, _ in out], pa.int64()), "keys": _blobs([k for _, k, _ in out]), "counts": _blobs([c for _, _, c in out])})

    def order(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, counts = np.frombuffer(b"".join(right["keys"].to_pylist()), np.uint64), np.frombuffer(b"".join(right["counts"].to_pylist()), np.int64)
        by = np.argsort(keys)
        keys, counts = keys[by], counts[by]
        ids, sizes, sets_, held, firsts = [], [], [], [], []
        for i, n, blob in zip(left["id"].to_pylist(), left["n"].to_pylist(), left["ngrams"].to_pylist(), strict=True):
            s = np.frombuffer(blob, np.uint64)
            at = np.minimum(np.searchsorted(keys, s), max(0, len(keys) - 1))
            common = keys[at] == s if len(keys) else np.zeros(len(s), bool)
            width = n - needed(n, percent) + 1 - int((~common).sum())
            if width <= 0 or not common.any():
                continue
            own, c = s[common], counts[at[common]]
            rank = np.lexsort((own, -c))
            ids.append(i)
            sizes.append(n)
            sets_.append(own[rank])
            held.append(c[rank])
            firsts.append(own[rank][::-1][:width].view(np.int64))
        return pa.table({"id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "ngrams": _blobs(sets_), "counts": _blobs(held),
                         "keys": pa.array([f.tolist() for f in firsts], pa.list_(pa.int64()))})

    asked = sets.groupBy("batch").applyInArrow(ask, "range bigint, batch bigint, keys binary, counts binary")
    told = asked.groupBy("range").applyInArrow(answer, "batch bigint, keys binary, counts binary")
    return sets.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(
        order, "id bigint, n bigint, ngrams binary, counts binary, keys array<bigint>")


class Trie:
    """Sets as ascending ranks, stored by their common beginnings in nodes that hold runs of ranks."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.nodes: list[tuple[np.ndarray, list[int], list[int], int, int, int]] = []   # run, sets ending here, children, least size, largest size, longest rest
        self.roots: list[int] = []
        work = [(order, 0, self.roots)]
        while work:
            own, depth, into = work.pop()
            for group in self._by_rank(sets, own, depth):
                one, last = sets[group[0]], sets[group[-1]]
                same = min(len(one), len(last))
                differ = np.flatnonzero(one[depth:same] != last[depth:same])
                end = depth + int(differ[0]) if len(differ) else same
                ending = [i for i in group if len(sets[i]) == end]
                children: list[int] = []
                into.append(len(self.nodes))
                s = sizes[group]
                self.nodes.append((one[depth:end], ending, children, int(s.min()), int(s.max()), max(len(sets[i]) for i in group) - end))
                rest = [i for i in group if len(sets[i]) > end]
                if rest:
                    work.append((rest, end, children))

    @staticmethod
    def _by_rank(sets: list[np.ndarray], own: list[int], depth: int) -> Iterator[list[int]]:
        begin = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or sets[own[i]][depth] != sets[own[begin]][depth]:
                yield own[begin:i]
                begin = i

    def join(self, queries: list[np.ndarray], query_sizes: np.ndarray, n_ranks: int, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each stored set: queries that may link to it, with exact overlaps."""
        stretch = 64
        at_once = max(1, WALK_BYTES // max(1, n_ranks))
        for begin in range(0, len(queries), at_once):
            own = queries[begin:begin + at_once]
            sizes = query_sizes[begin:begin + at_once]
            has = np.zeros((-(-max(1, n_ranks) // stretch) * stretch, len(own)), np.uint8)
            for j, q in enumerate(own):
                has[q, j] = 1
            # How many of a query's ranks lie before each stretch.
            before = np.cumsum(has.reshape(-1, stretch, len(own)).sum(axis=1, dtype=np.int32), axis=0)
            before = np.concatenate([np.zeros((1, len(own)), np.int32), before[:-1]])
            lengths = np.array([len(q) for q in own], np.int64)
            work = [(k, np.arange(len(own)), np.zeros(len(own), np.int64)) for k in self.roots]
            while work:
                k, alive, overlap = work.pop()
                run, ending, children, least, _, rest = self.nodes[k]
                overlap = overlap + has[run][:, alive].sum(axis=0, dtype=np.int64)
                left = lengths[alive] - np.maximum(before[run[-1] // stretch][alive], overlap)
                reach = overlap + np.minimum(left, rest) >= pair_needed(sizes[alive] + least, percent)
                alive, overlap = alive[reach], overlap[reach]
                if len(alive):
                    for s in ending:
                        yield s, alive + begin, overlap
                    work += [(c, alive, overlap) for c in children]


def block_links(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between the sets of one block, or of two: (a, b) as row numbers, and ids."""
    t = t.take(np.unique(t["id"].to_numpy(), return_index=True)[1])
    ids, sizes = t["id"].to_numpy(), t["n"].to_numpy()
    parts = [np.frombuffer(x, np.uint64) for x in t["ngrams"].to_pylist()]
    every, first, where = np.unique(np.concatenate(parts), return_index=True, return_inverse=True)
    counts = np.frombuffer(b"".join(t["counts"].to_pylist()), np.int64)[first]
    rank = np.empty(len(every), np.int64)
    rank[np.lexsort((every, -counts))] = np.arange(len(every))
    ranks = np.split(rank[where], np.cumsum([len(p) for p in parts])[:-1])
    block, b1, b2 = t["block"].to_numpy(), t["b1"][0].as_py(), t["b2"][0].as_py()
    stored_, asked = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
    trie = Trie([ranks[i] for i in stored_], sizes[stored_])
    a, b = [], []
    for s, queries, overlap in trie.join([ranks[i] for i in asked], sizes[asked], len(every), percent):
        q = asked[queries]
        linked = 100 * overlap >= percent * (sizes[q] + sizes[stored_[s]] - overlap)
        linked &= q > stored_[s] if b1 == b2 else ids[q] != ids[stored_[s]]
        a.append(np.full(int(linked.sum()), stored_[s]))
        b.append(q[linked])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), ids


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """Numbers of links that connect all that the links connect."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x] = y
            kept.append(k)
    return kept


def neighbourhood_links(sets: DataFrame, at: str, percent: int, block_sets: int) -> DataFrame:
    """(a, b, n): links that connect every component (n null), and each set's number of links (b null)."""
    keys = sets.select("id", F.explode("keys").alias("key"))
    leaders = keys.groupBy("key").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    near = keys.join(leaders, "key").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    near = components(near, at, "near").withColumnRenamed("node", "id")
    blocks = near.groupBy("component").agg(F.ceil(F.count("*") / block_sets).alias("blocks"))
    placed = near.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = stored(placed, at, "placed")
    alone = placed.where("blocks = 1").select("component", F.lit(0).cast("bigint").alias("b1"), F.lit(0).cast("bigint").alias("b2")).distinct()
    split = placed.where("blocks > 1").join(keys, "id").select("component", "block", "key").distinct()
    pairs = split.withColumnRenamed("block", "b1").join(split.withColumnRenamed("block", "b2"), ["component", "key"]).where("b1 <= b2")
    pairs = alone.unionByName(pairs.select("component", "b1", "b2").distinct())
    homes = pairs.withColumn("block", F.explode(F.array_distinct(F.array("b1", "b2"))))
    rows = placed.join(homes, ["component", "block"]).join(sets.drop("keys"), "id")

    def links(t: pa.Table) -> pa.Table:
        a, b, ids = block_links(t, percent)
        kept = spanning(a, b, len(ids))
        degree = np.bincount(np.concatenate([a, b]), minlength=len(ids))
        some = np.flatnonzero(degree)
        nulls = lambda n: pa.nulls(n, pa.int64())
        return pa.table({
            "a": pa.chunked_array([pa.array(ids[a[kept]]), pa.array(ids[some])]), "b": pa.chunked_array([pa.array(ids[b[kept]]), nulls(len(some))]),
            "n": pa.chunked_array([nulls(len(kept)), pa.array(degree[some].astype(np.int64))])})

    return rows.select("component", "b1", "b2", "block", "id", "n", "ngrams", "counts").groupBy("component", "b1", "b2").applyInArrow(
        links, "a bigint, b bigint, n bigint")


def _ties(marks: DataFrame, classes: DataFrame, at: str) -> DataFrame | None:
    """(a, b): every class of an id that stands on several texts, with the first of them; None where no id does."""
    held = marks.where("id is not null and n_shingles > 0").select("id", "digest")
    several = held.groupBy("id").agg(F.min("digest").alias("home"), F.max("digest").alias("far")).where("home <> far")
    several = stored(several, at, "several")
    if several.isEmpty():
        return None
    pairs = held.join(several.select("id", "home"), "id").where(F.col("digest") != F.col("home")).select("digest", "home").distinct()
    number = classes.select("digest", "class")
    return pairs.join(number.withColumnRenamed("class", "a"), "digest").join(
        number.select(F.col("digest").alias("home"), F.col("class").alias("b")), "home").select("a", "b")


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(id, text) to (id, n_shingles, component_id, n_links).

    ``component_id`` is the smallest id reachable by links; ``n_links`` counts
    the other distinct sets that a document links to. Classes have numbers of
    their own, so an id on several texts is in all their classes; the links of
    any of its texts are links of the id, which ties those classes together.
    """
    at = shared_folder(docs.sparkSession)
    marks = stored(signatures(docs.select(F.col("id").cast("bigint").alias("id"), "text"), n, percent), at, "marks")
    classes = marks.where("id is not null and n_shingles > 0").groupBy("digest").agg(
        F.min("id").alias("rep"), F.min("sid").alias("sid"), F.min("n_shingles").alias("n"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), at, "classes")

    def bits(total: int | None) -> int:
        return max(8, int(total or 0) // RANGE_NGRAMS).bit_length()

    firsts = marks.where("first is not null")
    size = firsts.agg(F.sum(F.octet_length("first") / 8)).first()[0]
    hits = shared_firsts(firsts, bits(size))
    least = F.ceil(F.col("n") * percent / 100)
    left = classes.join(hits, "sid").where(F.col("hits") >= F.greatest(F.lit(1), F.floor(least / SPARE)))
    left = left.select(F.col("rep").alias("id"), "class", "digest", "n")
    left = stored(left, at, "left")
    texts = docs.select(F.col("id").cast("bigint").alias("id"), "text").join(left.select("id", "class", "digest").hint("shuffle_hash"), "id")
    sets = stored(sets_of(texts, n), at, "sets")
    size = left.agg(F.sum("n")).first()[0]
    ordered = stored(ordered_sets(sets, bits(size), percent), at, "ordered")
    links = stored(neighbourhood_links(ordered, at, percent, block_sets), at, "links")
    edges, ties = links.where("b is not null").select("a", "b"), _ties(marks, classes, at)
    edges = edges if ties is None else edges.unionByName(ties)
    linked = components(edges, at, "linked").withColumnRenamed("node", "class")
    linked = classes.select("class", "rep").join(linked, "class")
    least_id = linked.groupBy("component").agg(F.min("rep").alias("least_id"))
    linked = linked.join(least_id, "component").select("class", "least_id")
    degree = links.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n_links"))
    known = classes.join(linked, "class", "left").join(degree, "class", "left").select(
        "digest", F.coalesce("least_id", "rep").alias("component"), F.coalesce("n_links", F.lit(0)).alias("links"))
    lonely = F.coalesce("component", "id")
    return marks.select("id", "n_shingles", "digest").join(known, "digest", "left").select(
        "id", "n_shingles", F.when(F.col("id").isNotNull(), lonely).alias("component_id"),
        F.when(F.col("id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("n_links"))


OP1_SQL = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
  from documents),
s as (select distinct doc_id, array_to_string(words[i:i + 3], ' ') as g
  from (select doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) as i from w where len(words) > 0)),
sets as (select doc_id, count(*) as n, md5(string_agg(g, chr(10) order by g)) as k from s group by doc_id),
shared as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
linked as (select x, y, p.k as kx, q.k as ky from shared join sets p on p.doc_id = x join sets q on q.doc_id = y where 100 * i >= 85 * (p.n + q.n - i)),
twoway as (select x, y, kx, ky from linked union all select y, x, ky, kx from linked),
reach as (select x, y from twoway union select r.x, b.y from reach r join twoway b on b.x = r.y),
least_ as (select x, min(y) as m from reach group by x),
degree as (select x, count(distinct ky) filter (ky <> kx) as n_links from twoway group by x)
select w.doc_id, coalesce(n, 0) as n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) as component_id, coalesce(n_links, 0) as n_links
from w left join sets using (doc_id) left join least_ on least_.x = w.doc_id left join degree on degree.x = w.doc_id"""


@query("op1_ngram_jaccard_join", OP1_SQL)
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its links: four words, 85 per cent."""
    d = jaccard_join(only(documents(spark, sf_dir), id="doc_id", text="text"), 4, 85)
    return d.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")
