"""Bounded, repeatable samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import uniform


def training_sample(docs: DataFrame, eligible: Column, bound: int, seed: str) -> DataFrame:
    """About ``bound`` eligible rows at most, chosen by a hash of ``doc_id``.

    The rows are counted first and thinned to twice the bound where they are
    read, so that only about that many texts move.
    """
    rows = docs.where(eligible).withColumn("_draw", uniform(F.lit(seed), F.col("doc_id")))
    share = min(1.0, 2.0 * bound / max(1, rows.select("_draw").count()))
    return rows.where(F.col("_draw") < share).orderBy("_draw", "doc_id").limit(bound).drop("_draw")
