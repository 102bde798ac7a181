"""Streams that replay tables written to the shared folder, for the checks and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.streaming.stream import drain, result_of, shared_folder, stream_evidence, stream_scores


def run_scores(spark: SparkSession, near: DataFrame) -> DataFrame:
    """Write dilated cells as files, stream them in, and report the result."""
    folder = shared_folder(spark, "scores")
    near.select("tile", "prob", "y", "code", "y_near", "p_near").write.parquet(f"{folder}/in")
    src = spark.read.parquet(f"{folder}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/in")
    return result_of(drain(spark, stream_scores(stream), folder))


def run_evidence(spark: SparkSession, ways: DataFrame) -> DataFrame:
    """Write ways as files, some of them twice, and stream them in."""
    folder = shared_folder(spark, "evidence")
    ways.select("id", "tags", "geometry").write.parquet(f"{folder}/in")
    src = spark.read.parquet(f"{folder}/in")
    src.where(F.col("id") % 5 == 0).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    d = drain(spark, stream_evidence(stream), folder)
    return d.select("gx", "gy", F.rint(F.coalesce("faint", F.lit(0.0))).cast("bigint").alias("faint_m"),
                    F.rint(F.coalesce("lifecycle", F.lit(0.0))).cast("bigint").alias("lifecycle_m"),
                    F.rint(F.coalesce("faint", F.lit(0.0)) + F.coalesce("lifecycle", F.lit(0.0))).cast("bigint").alias("total_m"),
                    F.col("n_ways").cast("bigint").alias("n_ways"))
