"""Helpers shared by the operators: tables in the shared folder, column care."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only a local master, whose one process sees every file, may go without the
    setting; it then gets a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="ridgeline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ridgeline-{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str, name: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and outlives executors."""
    df.write.mode("overwrite").parquet(f"{at}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}")


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def only(df: DataFrame, **cols: str) -> DataFrame:
    """The named columns alone, under the operator's own names.

    Further columns of the input, whatever they are called, cannot clash with
    columns that the operator adds.
    """
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in cols.items()])


def fold(doc_id: Column, modulus: int) -> Column:
    """Remainder of crc32 of the id as text; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def uniform(*parts: Column | int | str) -> Column:
    """A number in [0, 1) that depends on ``parts`` alone."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / float(1 << 53)


def ceil_div(total: int, size: int) -> int:
    return max(1, -(-int(total) // size))


def columns_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in names])
