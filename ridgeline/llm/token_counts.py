"""Token counts through a cache of digests.

The cache is a parquet table (version, digest, n_bytes, n_tokens) that outlives
a run: ``version`` is the digest of the tokenizer's file and ``digest`` that of
a text. A run joins its texts to the cache, chooses one row for each digest
that is missing, encodes only those, appends their counts, and answers every
row from the cache.

Inside a task, texts are cut at single spaces, where this tokenizer's pieces
always end, and every distinct chunk is encoded once. Texts in which a space
has white space on both sides, or that hold one of the tokenizer's special
strings, are encoded whole.

Cases: null counts as empty, with no tokens; very long texts are encoded whole,
without truncation; repeated rows and equal texts are encoded once and answered
one by one; null ids are kept; an empty table gives no rows and appends none;
further columns play no part. Two runs that append the same digest at once only
leave equal rows, of which a reader takes one.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import documents, only, shared_folder, stored
from ridgeline.llm.registry import query

CACHE_SCHEMA = "version string, digest binary, n_bytes bigint, n_tokens bigint"
TOKEN_LIMIT = 1024
#: Chunks remembered by one task before it forgets them and starts anew.
MEMO_CHUNKS = 1_000_000
#: A space whose pieces depend on more than the chunk it begins.
UNSAFE = re.compile(r"[\s\x85᠎​] (?:[\s\x85᠎​]|\Z)")

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Counts tokens as the library does, remembering chunks already seen."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(text)
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre = spec.get("pre_tokenizer") or {}
        self.by_chunk = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                         and spec.get("normalizer") is None
                         and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]))
        self.memo: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if not self.by_chunk or UNSAFE.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        head, *rest = text.split(" ")
        chunks = [head, *[" " + c for c in rest]]
        memo = self.memo
        new = [c for c in set(chunks) if c not in memo]
        if new:
            if len(memo) > MEMO_CHUNKS:
                memo.clear()
                new = list(set(chunks))
            memo.update(zip(new, map(len, self.library.encode_batch(new, add_special_tokens=False)), strict=True))
        return sum(map(memo.__getitem__, chunks))


def encoder(version: str, text: str) -> Encoder:
    if version not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[version] = Encoder(text)
    return _ENCODERS[version]


def encode_texts(rows: DataFrame, version: str, tokenizer: str) -> DataFrame:
    """(digest, text) to (digest, n_bytes, n_tokens), once for each digest of a task.

    Rows of one digest come to one task, unless adaptive execution splits them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, seen = encoder(version, tokenizer), set()
        for b in batches:
            fresh = [i for i, d in enumerate(b.column(0).to_pylist()) if not (d in seen or seen.add(d))]
            b = b.take(pa.array(fresh, pa.int64()))
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array([enc.count(t) for t in texts], pa.int64())], ["digest", "n_bytes", "n_tokens"])

    return rows.select("digest", "text").mapInArrow(run, "digest binary, n_bytes bigint, n_tokens bigint")


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Counts stored for a tokenizer, one row a digest; none where no table is yet."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("version") == version).groupBy("digest").agg(
        F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_file: str, cache: str) -> DataFrame:
    """(doc_id, text) to (doc_id, digest, n_bytes, n_tokens), filling ``cache``."""
    spark = docs.sparkSession
    tokenizer = Path(tokenizer_file).read_text(encoding="utf-8")
    version = hashlib.sha256(tokenizer.encode()).hexdigest()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    rows = rows.withColumn("pick", F.xxhash64("doc_id", "digest"))
    picked = rows.groupBy("digest").agg(F.min("pick").alias("pick"))
    missing = picked.join(read_cache(spark, cache, version), "digest", "left_anti")
    texts = rows.join(missing.hint("shuffle_hash"), ["pick", "digest"], "left_semi")
    fresh = encode_texts(texts, version, tokenizer).select(F.lit(version).alias("version"), "digest", "n_bytes", "n_tokens")
    fresh.dropDuplicates(["digest"]).write.mode("append").parquet(cache)
    # Written out, the counts join as they are read, so that a digest with many rows can be split.
    counts = stored(read_cache(spark, cache, version), shared_folder(spark), "counts")
    return rows.select("doc_id", "digest").join(counts, "digest", "left").select(
        "doc_id", "digest", "n_bytes", "n_tokens")


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, from a cache that this run fills."""
    import public_tokenizers

    d = count_tokens(only(documents(spark, sf_dir), doc_id="doc_id", text="text"),
                     public_tokenizers.path("byte_bpe_50k.json"), f"{shared_folder(spark)}/token_cache")
    return d.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))
