"""Joins against small lookup tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import constants as K


def lookup_join(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join a lookup by its key.

    The optimizer broadcasts a lookup whose measured bytes allow it; a larger
    one is joined by key, and adaptive execution splits the big side's hot keys.
    """
    return df.join(lookup, list(on), how)


def class_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, c) for n, c in K.CLASS_CODE.items()], "class string, code bigint")


def visibility_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.VISIBILITY_WEIGHT.items()), "visibility string, weight double")
