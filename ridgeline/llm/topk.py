"""Exact top-k by inner product over a bit-sliced index.

Every component of a vector is an integer attribute. Rows are packed into
blocks; a block keeps each attribute's values twice: exactly, and quantised to
``SLICE_BITS`` bits as slices, one bitmap over the block's rows for each bit. A
query's score is a weighted sum of attributes. Its quantised part is added with
bitmap arithmetic for all rows at once: slices are shifted by the set bits of
the weight (complemented first where the weight is negative) and summed by
carry-save adders into the slices of the score.

What quantising leaves out of a score lies between bounds that depend on the
query alone. Walking from the most significant slice down gives the k-th best
quantised score, and the same walk selects every row that the bounds do not
rule out; those boundary rows get their exact integer scores and are ordered by
score, then id. The result is exact whatever the data.

Blocks of queries meet blocks of rows, and a block pair returns k rows a query.

Rows with a component of ``WIDE`` or more, and queries whose scores could leave
64 bits, go by another way: floating-point scores with error bounds rule rows
out, and what is left is scored with Python integers, whatever their size. Only
a score among the k best that does not fit a long is an error.

Cases: vectors that are null, or have a null or non-finite component, take no
part; a shorter vector counts as ending in zeros; a query's own row is
every row of its id; rows without an id take no part; repeated rows are
separate candidates, while query rows that repeat id and vector are one query;
different vectors under one id are queries of their own, each with its k ranks,
and such a query's rows stand under the one id; fewer candidates than k are all returned; without queries
or candidates there are no rows; further columns play no part.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import ceil_div, documents, shared_folder, stored
from ridgeline.llm.registry import query

SLICE_BITS = 6
BLOCK_ROWS = 65536
QUERY_ROWS = 64
#: Blocks of queries that one copy of a block of rows serves.
ASKS_A_TASK = 64
#: Components from here on are kept as Python integers, apart from the others.
WIDE = 1 << 27
LONG = 1 << 63


def pack(rows: DataFrame, vector: str = "v") -> DataFrame:
    """(id, vector of longs[, raw]) to at most two rows a partition: n, dims, ids, wide, matrix (attributes by rows).

    The matrix has 32-bit integers; that of the wide rows is a pickled list of
    lists of Python integers. ``raw`` has, in place of the vector, the doubles
    whose 256-fold no long holds.
    """
    source = rows.select("id", vector, F.col("raw") if "raw" in rows.columns else F.lit(None).cast("array<double>").alias("raw"))

    def packed(ids: list, dims: int, wide: bool, matrix: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([len(ids)], pa.int64()), pa.array([dims], pa.int64()), pa.array([np.asarray(ids, np.int64).tobytes()], pa.binary()),
             pa.array([wide]), pa.array([matrix], pa.binary())], ["n", "dims", "ids", "wide", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, dims, wide = [], [], 0, []
        for b in batches:
            vectors, raw = b.column(1), b.column(2)
            large = raw.is_valid().to_numpy(zero_copy_only=False)
            flat, starts = vectors.flatten().to_numpy(), np.asarray(vectors.offsets)
            sizes = np.diff(starts)
            at, place = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(starts[:-1] - starts[0], sizes)
            large[at[(flat >= WIDE) | (flat <= -WIDE)]] = True
            for i in np.flatnonzero(large).tolist():
                wide.append((b.column(0)[i].as_py(), [whole(x) for x in raw[i].as_py()] if raw[i].is_valid else vectors[i].as_py()))
            keep = ~large
            if keep.any():
                ids.append(b.column(0).to_numpy()[keep])
                m = np.zeros((len(sizes), int(sizes[keep].max())), np.int64)
                own = keep[at]
                m[at[own], place[own]] = flat[own]
                parts.append(m[keep])
                dims = max(dims, m.shape[1])
        if ids:
            m = np.concatenate([np.pad(p, ((0, 0), (0, dims - p.shape[1]))) for p in parts])
            yield packed(np.concatenate(ids), dims, False, np.ascontiguousarray(m.T.astype(np.int32)).tobytes())
        if wide:
            dims = max(len(v) for _, v in wide)
            yield packed([i for i, _ in wide], dims, True, pickle.dumps([[v[d] if d < len(v) else 0 for _, v in wide] for d in range(dims)]))

    return source.mapInArrow(run, "n bigint, dims bigint, ids binary, wide boolean, matrix binary")


def whole(x: float) -> int:
    """floor(256 x), exactly."""
    return int(x) * 256 if abs(x) >= 1 << 53 else math.floor(x * 256)


def floats(values: np.ndarray) -> np.ndarray:
    """Integers of any size as doubles, all over one power of two that leaves room for sums of products."""
    top = max((abs(int(values.max(initial=0))), abs(int(values.min(initial=0))))).bit_length()
    if values.dtype != object:
        return np.ldexp(values.astype(np.float64), -top)
    return np.array([x / (1 << top) for x in values.ravel().tolist()], np.float64).reshape(values.shape)


class WideBlock:
    """Exact scores of integers of any size."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.floats = ids, values, floats(values)

    def search(self, own_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, list[int]]:
        """Ids and exact scores of the k best rows, ties to the smaller id."""
        d = min(len(weights), len(self.values))
        rows = np.flatnonzero(self.ids != own_id)
        if len(rows) > k:
            w, v = floats(weights[:d]), self.floats[:d, rows]
            # Twice the bound of rounding each factor, product and sum, and more than what underflow can take.
            about, error = w @ v, (np.abs(w) @ np.abs(v)) * ((2 * d + 8) * 2.0 ** -52) + 2.0 ** -900
            rows = rows[about + error >= np.partition(about - error, len(rows) - k)[len(rows) - k]]
        own = [int(w) for w in weights[:d]]
        scores = [sum(w * int(x) for w, x in zip(own, column, strict=True)) for column in self.values[:d, rows].T.tolist()]
        best = sorted(zip((-s for s in scores), self.ids[rows].tolist(), strict=True))[:k]
        return np.array([i for _, i in best], np.int64), [-s for s, _ in best]


class SlicedBlock:
    """The bit-sliced index of one block of rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values, self.n = ids, values, len(ids)
        self.whole: WideBlock | None = None
        words = -(-self.n // 64)
        self.low = values.min(axis=1, initial=0)
        span = int((values.max(axis=1, initial=0) - self.low).max(initial=0))
        self.shift = max(0, span.bit_length() - SLICE_BITS)
        q = (values - self.low[:, None]) >> self.shift
        self.bits = max(1, int(q.max(initial=0)).bit_length())
        padded = np.zeros((len(values), words * 64), np.int64)
        padded[:, :self.n] = q
        self.slices = np.stack([self._bitmaps((padded >> b) & 1) for b in range(self.bits)], axis=1)   # attribute x bit x words
        self.valid = self._bitmaps((np.arange(words * 64) < self.n)[None])[0]
        self.largest = max(int(values.max(initial=0)), -int(values.min(initial=0)))

    @staticmethod
    def _bitmaps(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits.astype(bool), axis=1, bitorder="little").view(np.uint64)

    def quantised(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of the sum of |weight| * (attribute, or its complement where the weight is negative)."""
        columns: dict[int, list[np.ndarray]] = {}
        for d in np.flatnonzero(weights):
            w = int(weights[d])
            own = self.slices[d] if w > 0 else ~self.slices[d]
            size = abs(w)
            while size:
                low = (size & -size).bit_length() - 1
                size &= size - 1
                for b in range(self.bits):
                    columns.setdefault(low + b, []).append(own[b])
        out, place = [], 0
        while any(k >= place for k in columns):
            here = columns.get(place, [])
            while len(here) > 2:
                a, b, c = here.pop(), here.pop(), here.pop(0)
                x = a ^ b
                columns.setdefault(place + 1, []).append((a & b) | (x & c))
                here.append(x ^ c)
            if len(here) == 2:
                a, b = here
                columns.setdefault(place + 1, []).append(a & b)
                here = [a ^ b]
            out.append(here[0] if here else np.zeros_like(self.valid))
            place += 1
        return out

    def boundary(self, slices: list[np.ndarray], allowed: np.ndarray, k: int, slack: int) -> np.ndarray:
        """Rows whose quantised score is at most ``slack`` below the k-th best of the allowed."""
        left, tied, value = k, allowed.copy(), 0
        for place in range(len(slices) - 1, -1, -1):
            high = tied & slices[place]
            n = int(np.bitwise_count(high).sum())
            if n >= left:
                tied, value = high, value | (1 << place)
            else:
                left, tied = left - n, tied & ~slices[place]
        least = value - slack
        if least <= 0:
            return allowed
        above, equal = np.zeros_like(allowed), allowed.copy()
        for place in range(len(slices) - 1, -1, -1):
            if least >> place & 1:
                equal = equal & slices[place]
            else:
                above |= equal & slices[place]
                equal = equal & ~slices[place]
        return above | equal

    def search(self, own_id: int, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows, ties to the smaller id."""
        d = min(len(weights), len(self.values))
        if weights.dtype == object or int(np.abs(weights[:d]).sum()) * self.largest >= LONG:
            self.whole = self.whole or WideBlock(self.ids, self.values)
            return self.whole.search(own_id, weights, k)
        w = np.zeros(len(self.values), np.int64)
        w[:d] = weights[:d]
        allowed = self.valid.copy()
        for i in np.flatnonzero(self.ids == own_id):
            allowed[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        if int(np.bitwise_count(allowed).sum()) > k and w.any():
            # A dropped remainder lies in 0 .. 2**shift - 1; its weighted sum spans this much, in quantised steps rounded up.
            spread = ((1 << self.shift) - 1) * int(np.abs(w).sum())
            allowed = self.boundary(self.quantised(w), allowed, k, -(-spread >> self.shift) if self.shift else 0)
        rows = np.flatnonzero(np.unpackbits(allowed.view(np.uint8), bitorder="little")[:self.n])
        scores = w @ self.values[:, rows]
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def top_k(rows: DataFrame, is_query: Column, k: int, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(id, v) with ``v`` an array of longs: (query_id, rank, id, score) for each query row."""
    spark = rows.sparkSession
    at = shared_folder(spark)
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, asks = ceil_div(sizes["n"], block_rows), ceil_div(sizes["q"], query_rows)
    index = stored(pack(rows.repartition(blocks)).withColumn("block", F.spark_partition_id()), at, "index")
    queries = rows.where(is_query).select("id", "v", *(["raw"] if "raw" in rows.columns else [])).dropDuplicates()
    asked = stored(pack(queries.repartition(asks)).withColumn("ask", F.spark_partition_id()), at, "queries")
    # Each block of rows is copied for every so many blocks of queries, and at least often enough to employ all cores.
    copies = max(ceil_div(asks, ASKS_A_TASK), min(asks, ceil_div(2 * spark.sparkContext.defaultParallelism, blocks)))
    index = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    asked = asked.withColumn("copy", F.col("ask") % copies).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, ...]] = []
        for b in range(left.num_rows if right.num_rows else 0):
            ids, values = unpacked(left.slice(b, 1))
            block = (WideBlock if values.dtype == object else SlicedBlock)(ids, values)
            for i in range(right.num_rows):
                ids, values = unpacked(right.slice(i, 1))
                ask, wide = right["ask"][i].as_py(), right["wide"][i].as_py()
                for at, (q, weights) in enumerate(zip(ids.tolist(), values.T, strict=True)):
                    found, scores = block.search(q, weights, k)
                    own = (q, ask, 2 * at + wide)   # a query's place, since ids may repeat
                    out += [(*own, i, 0, s) if -LONG <= s < LONG else (*own, i, 1 if s > 0 else -1, 0) for i, s in zip(found.tolist(), map(int, scores), strict=True)]
        columns = zip(*out, strict=True) if out else [[]] * 6
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "ask", "place", "id", "beyond", "score"])

    schema = "query_id bigint, ask bigint, place bigint, id bigint, beyond bigint, score bigint"
    found = index.groupBy("block", "copy").cogroup(asked.groupBy("block", "copy")).applyInArrow(search, schema)
    best = Window.partitionBy("query_id", "ask", "place").orderBy(F.desc("beyond"), F.desc("score"), "id")
    score = F.when(F.col("beyond") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score among the best does not fit a long")).cast("bigint"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", score.alias("score"))


def unpacked(row: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the matrix (attributes by rows) of one packed row."""
    n, dims = row["n"][0].as_py(), row["dims"][0].as_py()
    ids = np.frombuffer(row["ids"][0].as_buffer(), np.int64)
    if row["wide"][0].as_py():
        return ids, np.array(pickle.loads(row["matrix"][0].as_py()), object).reshape(dims, n)
    return ids, np.frombuffer(row["matrix"][0].as_buffer(), np.int32).reshape(dims, n).astype(np.int64)


def finite_vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v, raw): floor(256 x) of every component, of the vectors that take part.

    A vector with a component whose 256-fold no long holds has its doubles in ``raw``, and an empty ``v``.
    """
    raw = F.col(f"`{vector}`").cast("array<double>")
    fine = F.col(f"`{vec_id}`").isNotNull() & raw.isNotNull() & F.forall(raw, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = table.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{vec_id}`").cast("bigint").alias("id"), raw.alias("raw"))
    fits = F.forall("raw", lambda x: F.abs(x) < float(LONG // 256))
    v = F.when(fits, F.transform("raw", lambda x: F.floor(F.lit(256.0) * x))).otherwise(F.array().cast("array<bigint>"))
    return d.select("id", v.cast("array<bigint>").alias("v"), F.when(~fits, F.col("raw")).alias("raw"))


def quantised_vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v): those of the vectors whose every component fits a long."""
    return finite_vectors(table, vec_id, vector).where("raw is null").select("id", "v")


TOP, QUERY_STEP = 5, 50

OP8_SQL = f"""
with fine as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256.0::double * x::double) as hugeint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
queries as (select distinct vec_id, v from fine where vec_id % {QUERY_STEP} = 0)
select query_id, rank, vec_id, score::bigint as score from (
  select query_id, vec_id, score, row_number() over (partition by query_id, v order by score desc, vec_id) as rank from (
    select q.vec_id as query_id, q.v, c.vec_id, list_sum(list_concat([0::hugeint], list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0::hugeint)))) as score
    from queries q join fine c on q.vec_id <> c.vec_id))
where rank <= {TOP}"""


@query("op8_bit_sliced_top_k", OP8_SQL)
def op8_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every fiftieth vector, against all others."""
    rows = finite_vectors(documents(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, F.col("id") % QUERY_STEP == 0, TOP).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
