"""From raw documents to shards: five stages, each written before the next begins.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``docs`` as they came. Further columns of any name are
carried along untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontamination, mixing, ngram_join, quality, sharding
from ridgeline.llm.common import documents, only, shared_folder, stored, uniform

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _tucked(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others in one struct where no name can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def _untucked(df: DataFrame, columns: list[str], *names: str) -> DataFrame:
    return df.select(*[F.col(c) if c in names else F.col("_rest")[c].alias(c) for c in columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. Null and empty texts are scored like any other."""
    labels = only(documents(spark, sf_dir, "labels"), doc_id="doc_id", quality="quality")
    model = quality.learn(docs.select("doc_id", "text"), labels, quality.in_training(F.col("doc_id")))
    scored = quality.score_rows(_tucked(docs, "doc_id", "text"), model)
    return _untucked(scored.where(F.col("score") >= quality.THRESHOLD), docs.columns, "doc_id", "text")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies: five words, similarity 0.8.

    Empty texts have no near copy. Of rows that repeat id and text one stays;
    rows without an id all stay.
    """
    groups = ngram_join.jaccard_join(only(docs, id="doc_id", text="text"), 5, 80)
    kept = groups.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("doc_id")).distinct()
    d = _tucked(docs.where("doc_id is not null"), "doc_id", "text").join(kept, "doc_id", "left_semi")
    d = d.withColumn("_text", F.xxhash64("text")).dropDuplicates(["doc_id", "_text"])
    return _untucked(d, docs.columns, "doc_id", "text").unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    items = only(documents(spark, sf_dir, "benchmark"), item_id="item_id", text="text")
    found = decontamination.decontaminate(_tucked(docs, "doc_id", "text"), items)
    return _untucked(found.where("found.n_hit = 0"), docs.columns, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.

    The mixture takes blocks of tokens; a document's taken tokens over its size
    is rounded up or down by a hash, so that sources keep their shares. That
    makes no, one, two or three copies. Documents without tokens take no part.
    """
    key = lambda crc: F.xxhash64("doc_id", crc)
    mixed = mixing.mix(only(docs, doc_id="doc_id", text="text", source="source"))
    share = mixed.where("taken > 0").groupBy(key(F.col("crc")).alias("_key")).agg((F.sum("taken") / F.sum("size")).alias("_share"))
    d = _tucked(docs, "doc_id", "text").withColumn("_key", key(F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))
    d = d.join(share, "_key").withColumn("_copies", F.floor(F.col("_share") + uniform("copies", F.col("_key"))))
    d = d.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    return _untucked(d, docs.columns, "doc_id", "text")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with their shard and their slot in it."""
    return sharding.assign_shards(docs, "doc_id", "text", sharding.SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality), ("near_copies", keep_one_of_near_copies), ("decontamination", drop_contaminated),
    ("mixing", mix_sources), ("sharding", shard)]

#: No SQL expresses a trained classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs, at = documents(spark, sf_dir), shared_folder(spark)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), at, name)
    return docs
