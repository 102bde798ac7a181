"""Repeated byte strings, from merged Burrows-Wheeler transforms of corpus shards.

A byte is removed where some string of ``length`` bytes around it also starts
anywhere else in the corpus.

1. *Anchors.* Every window of ``length`` bytes picks the leftmost of its least
   hashed grams. Equal windows pick the same gram at the same place, so windows
   that pick a gram only ever repeat among the windows of equal grams. A run of
   windows with one pick is a unit: some bytes aligned on its anchor. Nothing is
   estimated here; units whose anchor occurs once just have no partner.
2. *Shards.* Equal units are one row with a count. Each task that reads texts
   turns the rows it meets into the transform of its shard: column by column
   from the right, the symbols that precede the suffixes in their sorted order.
3. *Merge.* The transforms of one bucket of anchors are interleaved. The
   interleave starts as one shard after the other; in each step the shards'
   next symbols are read in the order it gives and a stable partition by symbol
   is the interleave of suffixes one byte longer. No suffix is compared or
   sorted again. Where two neighbours first differ is carried along as the least
   such place between them, which gives common prefixes; neighbours that agree
   for ``length`` bytes form a repeated interval.
4. *Spans.* Repeated windows of a unit cover one run of bytes around its anchor.

A gram with more than ``CROWD`` different units would be one task, so its units
are cut by halves: windows in which the anchor stands at neighbouring places,
keyed by all the bytes these share, down to single windows, where a count decides.

Cases: null text counts as empty; texts shorter than ``length`` keep all bytes;
repeated rows repeat each other; overlapping repeats inside one text count; very
long texts are read in blocks of windows, whole; removed runs may end inside a
character, so what is kept is binary; ids may be null or repeat; an empty table
gives no rows; further columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import ceil_div, documents, only, shared_folder, stored
from ridgeline.llm.registry import query

LENGTH = 200
#: Bytes of a gram; at most half a window.
GRAM = 32
#: Windows of a text looked at together.
BLOCK_WINDOWS = 1 << 20
#: Units that a task sends on together.
OUT_ROWS = 1 << 16
#: Rows of a shard, rows of a bucket, and different units that one anchor may have in a bucket.
SHARD_ROWS, BUCKET_ROWS, CROWD = 32_768, 16_384, 65_536
#: A side of a join is broadcast up to this many measured bytes.
BROADCAST_BYTES = 32 << 20
#: What stands outside a unit; no byte of UTF-8.
PAD = 0xFF
UNIT = "anchor bigint, digest bigint, text_key bigint, size int, pos int, lead int, windows int"
HASH = [np.uint64(v) for v in (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9)]


def gram_size(length: int) -> int:
    return max(1, min(GRAM, length // 2))


def gram_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all grams, by joining hashes of halves."""
    unit = (b.astype(np.uint64) + np.uint64(1)) * HASH[0]
    unit ^= unit >> np.uint64(32)
    h, have, step = unit, 1, HASH[1]
    powers = {1: (unit, step)}
    with np.errstate(over="ignore"):
        while have * 2 <= gram:
            h = h[:-have] * step + h[have:]
            step, have = step * step, have * 2
            powers[have] = (h, step)
        left = gram - have
        for size in sorted(powers, reverse=True):
            if size <= left:
                more, by = powers[size]
                h = h[:len(b) - have - size + 1] * by + more[have:have + len(b) - have - size + 1]
                have, left = have + size, left - size
        h = (h ^ (h >> np.uint64(29))) * HASH[2]
    return h ^ (h >> np.uint64(32))


def picks(h: np.ndarray, grams: int) -> np.ndarray:
    """For each run of ``grams`` hashes the place of its leftmost least one."""
    at, have = np.arange(len(h), dtype=np.int32), 1
    while have < grams:
        step = min(have, grams - have)
        later = h[step:] < h[:-step]
        h = np.where(later, h[step:], h[:-step])
        at = np.where(later, at[step:], at[:-step])
        have += step
    return at


def units(text: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, digest, pos, lead, windows) of a text's units, block by block.

    ``pos`` is where the first window starts, ``lead`` the anchor's place in it.
    """
    from xxhash import xxh3_64_intdigest

    gram, view = gram_size(length), memoryview(text)
    for base in range(0, len(text) - length + 1, BLOCK_WINDOWS):
        b = np.frombuffer(view[base:base + BLOCK_WINDOWS + length - 1], np.uint8)
        h = gram_hashes(b, gram)
        at = picks(h, length - gram + 1)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1]).astype(np.int64)
        count = np.diff(np.concatenate([first, [len(at)]]))
        lead = at[first] - first
        digest = np.array([xxh3_64_intdigest(view[base + a:base + a + n + length - 1], d)
                           for a, n, d in zip(first.tolist(), count.tolist(), lead.tolist(), strict=True)], np.uint64)
        yield h[at[first]].view(np.int64), digest.view(np.int64), first + base, lead, count


def _unit_batch(parts: list[tuple], ids: list[tuple[int, int]]) -> pa.RecordBatch:
    sizes = [len(p[0]) for p in parts]
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    keys, lengths = np.repeat([i[0] for i in ids], sizes), np.repeat([i[1] for i in ids], sizes)
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0]), pa.array(cols[1]), pa.array(keys, pa.int64()), pa.array(lengths, pa.int32()),
         *[pa.array(c.astype(np.int32)) for c in cols[2:]]], ["anchor", "digest", "text_key", "size", "pos", "lead", "windows"])


def all_units(texts: DataFrame, length: int) -> DataFrame:
    """(text_key, size, text) to the units of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, ids, n = [], [], 0
            for key, size, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                for part in units(text.as_buffer().to_pybytes(), length):
                    parts.append(part)
                    ids.append((key, size))
                    n += len(part[0])
                if n > OUT_ROWS:
                    yield _unit_batch(parts, ids)
                    parts, ids, n = [], [], 0
            if parts:
                yield _unit_batch(parts, ids)

    return texts.where(F.col("size") >= length).select("text_key", "size", "text").mapInArrow(run, UNIT)


def cut_units(rows: DataFrame, length: int, width: int) -> DataFrame:
    """(text_key, size, text, wanted) to finer units: ``width`` places of the anchor in a window each.

    The new key hashes all the bytes that windows with those places share.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        grams, signed = length - gram_size(length), (lambda v: v - (1 << 64) if v >> 63 else v)
        for b in batches:
            out = []
            for key, size, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                view = memoryview(text.as_buffer())
                for u in wanted:
                    at = u["pos"] + u["lead"]
                    for piece in range((u["lead"] - u["windows"] + 1) // width, u["lead"] // width + 1):
                        near, far = piece * width, min(piece * width + width - 1, grams)
                        lead = min(u["lead"], far)
                        count = lead - max(u["lead"] - u["windows"] + 1, near) + 1
                        shared = xxh3_64_intdigest(view[at - near:at - far + length] if near <= far else b"", piece)
                        own = xxh3_64_intdigest(view[at - lead:at - lead + count + length - 1], lead)
                        out.append((signed(shared), signed(own), key, size, at - lead, lead, count))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.int32()] * 4, strict=True)],
                                                 ["anchor", "digest", "text_key", "size", "pos", "lead", "windows"])

    return rows.select("text_key", "size", "text", "wanted").mapInArrow(run, UNIT)


def transform(columns: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Burrows-Wheeler columns of aligned rows: ``columns[c, row]`` to the symbols before each sorted suffix.

    Rows of a part stand together, in the order of the whole.
    """
    out = np.empty_like(columns)
    order = np.argsort(part, kind="stable")
    for c in range(len(columns) - 1, -1, -1):
        symbols = columns[c][order]
        out[c] = symbols[np.argsort(part[order], kind="stable")]
        order = order[np.argsort(symbols, kind="stable")]
    return out


def _narrow(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint16 if ids.max(initial=0) < 1 << 16 else np.uint32)


def merge(shards: list[np.ndarray], length: int, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last column at which each row starts a repeated window; -1 where none does.

    Rows are numbered through the shards; a row's windows start from column
    ``begin`` up to ``stop``, and outside them it is padding.
    """
    symbols = np.concatenate(shards, axis=1)
    width, n = symbols.shape
    source = _narrow(np.repeat(np.arange(len(shards)), [s.shape[1] for s in shards]))
    rows = np.arange(n, dtype=np.int32)
    # Column where a suffix first differs from the one before it; nothing stands before the first.
    differ = np.full(n + 1, width, np.int16 if width < 1 << 15 else np.int32)
    differ[0] = differ[n] = -1
    first, last, starts = np.full(n, -1, np.int32), np.full(n, -1, np.int32), int(stop.max(initial=0))
    for c in range(width - 1, -1, -1):
        read = np.empty(n, np.uint8)
        read[np.argsort(source, kind="stable") if len(shards) > 1 else slice(None)] = symbols[c]
        perm = np.argsort(read, kind="stable")
        read, source, rows = read[perm], source[perm], rows[perm]
        fresh, alike = differ[perm], read[1:] == read[:-1]
        apart = np.flatnonzero(alike & (perm[1:] != perm[:-1] + 1)) + 1
        if len(apart):
            between = np.stack([perm[apart - 1] + 1, perm[apart] + 1], axis=1).ravel()
            fresh[apart] = np.minimum.reduceat(differ, between)[::2]
        differ[1:n] = np.where(alike, fresh[1:], c)
        if c < starts:
            agree = differ >= c + length
            hit = rows[agree[:n] | agree[1:]]
            hit = hit[(begin[hit] <= c) & (c < stop[hit])]
            first[hit] = c
            last[hit[last[hit] < 0]] = c
    return first, last


def shard_transforms(rows: DataFrame, length: int) -> DataFrame:
    """(text_key, size, text, wanted) to one compressed transform for each shard and bucket."""
    gram = gram_size(length)
    lanes, starts = 2 * length - gram, length - gram

    def built(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        import zstandard

        columns = np.full((lanes, len(held)), PAD, np.uint8)
        for i, (_, _, _, _, lead, _, body) in enumerate(held):
            columns[starts - lead:starts - lead + len(body), i] = np.frombuffer(body, np.uint8)
        buckets, part = np.unique(np.array([h[0] for h in held], np.int64), return_inverse=True)
        out = transform(columns, _narrow(part))
        order = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part)).tolist()
        numbers = np.array([h[1:6] for h in held], np.int64)[order]
        pack = zstandard.ZstdCompressor(level=1)
        spans = list(zip([0, *ends], ends, strict=False))
        for i in range(0, len(spans), 512):
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets[i:i + 512]), pa.array([b - a for a, b in spans[i:i + 512]], pa.int32()),
                 pa.array([pack.compress(np.ascontiguousarray(numbers[a:b].T).tobytes()) for a, b in spans[i:i + 512]], pa.binary()),
                 pa.array([pack.compress(np.ascontiguousarray(out[:, a:b]).tobytes()) for a, b in spans[i:i + 512]], pa.binary())],
                ["bucket", "n", "numbers", "transform"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[tuple] = []
        for b in batches:
            for key, size, text, wanted in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                if (key, size) in seen:  # a copy of a text brings nothing new
                    continue
                seen.add((key, size))
                view = memoryview(text.as_buffer())
                for u in wanted:
                    body = bytes(view[u["pos"]:u["pos"] + u["windows"] + length - 1])
                    held.append((u["bucket"], u["anchor"], u["digest"], u["n"], u["lead"], u["windows"], body))
                    if len(held) >= SHARD_ROWS:
                        yield from built(held)
                        held = []
        if held:
            yield from built(held)

    return rows.select("text_key", "size", "text", "wanted").mapInArrow(run, "bucket bigint, n int, numbers binary, transform binary")


def merged_buckets(transforms: DataFrame, length: int) -> DataFrame:
    """Shards' transforms to (anchor, digest, first, last): a unit's repeated windows."""
    gram = gram_size(length)
    lanes, starts = 2 * length - gram, length - gram

    def run(group: pa.Table) -> pa.Table:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        sizes = group["n"].to_pylist()
        shards = [np.frombuffer(unpack.decompress(t, max_output_size=lanes * n), np.uint8).reshape(lanes, n)
                  for t, n in zip(group["transform"].to_pylist(), sizes, strict=True)]
        numbers = [np.frombuffer(unpack.decompress(b, max_output_size=40 * n), np.int64).reshape(5, n)
                   for b, n in zip(group["numbers"].to_pylist(), sizes, strict=True)]
        anchor, digest, count, lead, windows = np.concatenate(numbers, axis=1)
        many, at = count > 1, starts - lead
        first, last = merge(shards, length, at, at + windows)
        first, last = np.where(many, at, first), np.where(many, at + windows - 1, last)
        hit = np.flatnonzero(first >= 0)
        return pa.table([pa.array(anchor[hit]), pa.array(digest[hit]), pa.array((first - at)[hit].astype(np.int32)), pa.array((last - at)[hit].astype(np.int32))],
                        names=["anchor", "digest", "first", "last"])

    # A text that several tasks met gives its units more than once.
    found = transforms.groupBy("bucket").applyInArrow(run, "anchor bigint, digest bigint, first int, last int")
    return found.groupBy("anchor", "digest").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def _with_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts that units are wanted of, with those units."""
    per_text = wanted.groupBy("text_key", "size").agg(F.collect_list(F.struct(*[c for c in wanted.columns if c not in ("text_key", "size")])).alias("wanted"))
    return texts.join(per_text.hint("shuffle_hash"), ["text_key", "size"])


def repeated_runs(texts: DataFrame, at: str, length: int = LENGTH) -> DataFrame:
    """(text_key, size, text) to (text_key, size, start, end), runs of bytes that repeat; they may overlap."""
    found, places, level = [], length - gram_size(length) + 1, 0
    occ = stored(all_units(texts, length), at, "units-0")
    while True:
        per_anchor = occ.groupBy("anchor").agg(F.count("*").alias("_n"), (F.min("digest") != F.max("digest")).alias("mixed")).where("_n > 1").drop("_n")
        cand = stored(occ.join(per_anchor, "anchor"), at, f"candidates-{level}")
        whole = cand.where("not mixed").select("text_key", "size", F.col("pos").alias("start"), (F.col("pos") + F.col("windows") + length - 1).alias("end"))
        found.append(whole)
        mixed = cand.where("mixed").drop("mixed")
        first = F.min(F.struct("text_key", "size", "pos", "lead", "windows")).alias("u")
        rows = stored(mixed.groupBy("anchor", "digest").agg(F.count("*").alias("n"), first).select("anchor", "digest", F.least("n", F.lit(2)).alias("n"), "u.*"), at, f"rows-{level}")
        crowded = rows.groupBy("anchor").count().where(F.col("count") > CROWD).select("anchor")
        crowded = stored(crowded, at, f"crowded-{level}")
        done = crowded.isEmpty()
        light = rows if done else stored(rows.join(crowded, "anchor", "left_anti"), at, f"light-{level}")
        buckets = ceil_div(light.count(), BUCKET_ROWS)
        wanted = light.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
        shards = stored(shard_transforms(_with_texts(texts, wanted), length), at, f"shards-{level}")
        runs = merged_buckets(shards, length)
        start = F.col("pos") + F.col("first")
        found.append(mixed.join(runs, ["anchor", "digest"]).select("text_key", "size", start.alias("start"), (F.col("pos") + F.col("last") + length).alias("end")))
        if done:
            break
        level, places = level + 1, ceil_div(places, 2)
        split = mixed.join(crowded, "anchor").select("text_key", "size", "pos", "lead", "windows").distinct()
        occ = stored(cut_units(_with_texts(texts, split), length, places), at, f"units-{level}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that overlap or touch become one."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        out = []
        for runs in b.column(2):
            flat = runs.values
            start, end = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            order = np.argsort(start, kind="stable")
            start, reach = start[order], np.maximum.accumulate(end[order])
            new = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
            ends = reach[np.r_[new[1:], len(reach)] - 1]
            out.append([{"start": x, "end": y} for x, y in zip(start[new].tolist(), ends.tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, span)], ["text_key", "size", "spans"])


def with_spans(docs: DataFrame, text: str, at: str, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``spans``: removed runs of bytes (start, end), apart and in order.

    Spans are worked out once for each different text.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), body.alias("text"))
    plain = plain.withColumns({"text_key": F.xxhash64("text"), "size": F.octet_length("text")})
    runs = repeated_runs(plain.select("text_key", "size", F.col("text").cast("binary").alias("text")), at, length)
    # Copies of a text give the same runs; they fall together before a text's runs are gathered.
    runs = runs.groupBy("text_key", "size", "start").agg(F.max("end").alias("end"))
    spans = runs.groupBy("text_key", "size").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    spans = stored(spans.mapInArrow(joined_runs, "text_key bigint, size int, spans array<struct<start: int, end: int>>"), at, "spans")
    measured = spans.agg(F.coalesce(F.sum(24 + 24 * F.size("spans")), F.lit(0)).alias("b")).first().b
    spans = F.broadcast(spans) if measured <= BROADCAST_BYTES else spans.hint("shuffle_hash")
    none = F.array().cast("array<struct<start: int, end: int>>")
    return plain.join(spans, ["text_key", "size"], "left").select("_row.*", F.coalesce("spans", none).alias("spans"))


def removal(docs: DataFrame, text: str, at: str, length: int = LENGTH) -> DataFrame:
    """``docs`` with ``spans``, ``n_bytes``, ``n_removed`` and ``kept``, the bytes that stay (binary)."""
    d = with_spans(docs, text, at, length)
    taken = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return d.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))).cast("bigint"), "n_removed": taken,
                          "kept": kept_bytes(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), F.col("spans"))})


def kept_bytes(body: Column, spans: Column) -> Column:
    """What is left of ``body`` without ``spans``."""
    gaps = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"])),
                      F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(body))),
                      lambda a, b: F.substring(body, a + 1, b - a))
    return F.when(F.size(spans) == 0, body).otherwise(F.unhex(F.array_join(F.transform(gaps, F.hex), "")))


# Two hexadecimal digits are a byte, so 400 of them are a string of 200.
OP13_SQL = """
with docs as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
starts as (select rid, unnest(range(len(h) // 2 - 199)) as i, h from docs where len(h) >= 400),
marked as (select rid, i, md5(substr(h, 2 * i + 1, 400)) as k from starts),
again as (select rid, i from marked where k in (select k from marked group by k having count(*) > 1)),
edges as (select rid, i, case when i - lag(i) over (partition by rid order by i) <= 200 then 0 else 1 end as fresh from again),
runs as (select rid, sum(fresh) over (partition by rid order by i) as run, i from edges),
spans as (select rid, min(i) as a, max(i) + 200 as b from runs group by rid, run),
cuts as (select rid, a, b, coalesce(lag(b) over (partition by rid order by a), 0) as before, lead(a) over (partition by rid order by a) as following from spans),
kept as (select rid, sum(b - a) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a)
    || max(case when following is null then substr(h, 2 * b + 1) else '' end) as h from cuts join docs using (rid) group by rid)
select doc_id, cast(len(d.h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(k.h, d.h))) as kept_sha256 from docs d left join kept k using (rid)"""


@query("op13_suffix_dedup", OP13_SQL)
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that do not lie in a 200-byte string which also starts elsewhere."""
    d = removal(only(documents(spark, sf_dir), doc_id="doc_id", text="text"), "text", shared_folder(spark))
    return d.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
