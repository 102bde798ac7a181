"""Incremental accumulators as Structured Streaming queries.

Scores are plain sums. Evidence counts each way once by its id: for as long as
the query lives, or, with a horizon of arrival times, among the copies that
arrive within it, so that only the ids of that long are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline import constants as K
from ridgeline.functions import tags as T
from ridgeline.operators import scoring as S
from ridgeline.operators import ways as W
from ridgeline.operators.lineage import shared_base


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def stream_scores(near: DataFrame, thresholds=K.SELECTION_THRESHOLDS) -> DataFrame:
    """Running stratified sums over arriving files of dilated cells, wide by threshold."""
    code = F.when(F.col("y") > 0, F.col("code")).otherwise(F.lit(0)).alias("code")
    aggs = [F.sum("y").cast("bigint").alias("y_sum")]
    for t in thresholds:
        n = S._tag(t)
        on = F.col("prob") >= t
        aggs += [F.sum(F.when(on, 1).otherwise(0)).alias(f"pred{n}"),
                 F.sum(F.when(on, F.coalesce("y_near", F.lit(0))).otherwise(0)).cast("bigint").alias(f"tpp{n}"),
                 F.sum(F.when(F.col("p_near") >= t, F.col("y")).otherwise(0)).cast("bigint").alias(f"tpr{n}")]
    return near.groupBy(code).agg(*aggs)


def result_of(wide: DataFrame, thresholds=K.SELECTION_THRESHOLDS) -> DataFrame:
    """Divide the running sums once, at the end."""
    rows = F.array(*[F.struct(
        F.lit(float(t)).alias("t"), F.col(f"pred{S._tag(t)}").alias("pred"), F.col(f"tpp{S._tag(t)}").alias("tp_p"),
        F.col(f"tpr{S._tag(t)}").alias("tp_r")) for t in thresholds])
    long = wide.select("code", "y_sum", F.explode(rows).alias("r")).select("code", "y_sum", "r.*")
    return S.stratified_result(S.pool_counts(long, []).where(F.col("code") > 0))


def stream_evidence(ways: DataFrame, size_m: float = 1000.0, horizon: str | None = None, arrived: str = "arrived") -> DataFrame:
    """Running evidence per grid cell; a way that arrives twice counts once.

    With ``horizon``, such as "2 days", a copy counts once with the first if it
    arrives (column ``arrived``) within that time; ids expire after it and the
    state stays as large as what arrives in one horizon. Copies that may come
    later need a longer horizon, or none. A way reaches each cell as one row, so
    distinct ways are a plain count and a cell's state is three numbers.
    """
    d = ways.withColumn("evidence", T.evidence_kind(F.col("tags"))).where(F.col("evidence").isNotNull())
    d = d.dropDuplicates(["id"]) if horizon is None else d.withWatermark(arrived, horizon).dropDuplicatesWithinWatermark(["id"])
    d = d.select("evidence", "geometry")
    return W.way_cells(d, size_m).groupBy("gx", "gy").agg(
        F.sum(F.when(F.col("evidence") == "faint", F.col("m"))).alias("faint"),
        F.sum(F.when(F.col("evidence") == "lifecycle", F.col("m"))).alias("lifecycle"),
        F.count("*").alias("n_ways"))


def drain(spark: SparkSession, df: DataFrame, folder: str) -> DataFrame:
    """Run a complete-mode query over what has arrived, into a written table."""
    out = f"{folder}/out"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (df.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/ckpt")
         .trigger(availableNow=True).foreachBatch(keep).start())
    q.awaitTermination()
    return spark.read.parquet(out)
