"""Streams whose state is bounded, over several drains."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ridgeline.sources import readers as RD
from ridgeline.streaming import stream as ST

WAY = "id bigint, tags map<string,string>, geometry array<struct<x: double, y: double>>, arrived timestamp"


def way(i, day, x=100.0):
    return (i, {"highway": "path", "trail_visibility": "bad"}, [(x, 50.0), (x + 200.0, 50.0)], datetime(2024, 1, 1) + timedelta(days=day))


def test_ids_expire_after_the_horizon(spark, tmp_path):
    """Ten drains of new ways, each with copies of the last: the ids kept do not grow."""
    folder, schema = str(tmp_path), spark.createDataFrame([], WAY).schema
    kept, n = [], 40
    for day in range(10):
        rows = [way(day * n + i, day) for i in range(n)] + [way((day - 1) * n + i, day) for i in range(5) if day]
        spark.createDataFrame(rows, WAY).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        src = spark.readStream.schema(schema).parquet(f"{folder}/in")
        q = (ST.stream_evidence(src, horizon="36 hours").writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/ckpt")
             .trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{folder}/out")).start())
        q.awaitTermination()
        kept.append(max(o.numRowsTotal for o in q.lastProgress.stateOperators))
    assert spark.read.parquet(f"{folder}/out").select(F.sum("n_ways")).first()[0] == 10 * n
    assert max(kept[4:]) <= max(kept[:4]) <= 4 * n


def test_read_points_prunes_tiles(spark, tmp_path):
    d = spark.createDataFrame([(str(t), float(t), 0.0, 0.0, 2, None) for t in range(6)], "tile string, x double, y double, z double, cls int, hag float")
    d.write.partitionBy("tile").parquet(f"{tmp_path}/p")
    odd = RD.read_points(spark, f"{tmp_path}/p", ["1", "3", "5"])
    assert sorted(r.tile for r in odd.collect()) == ["1", "3", "5"]
    assert "PartitionFilters: [isnotnull(tile" in odd._jdf.queryExecution().executedPlan().toString() or "tile#" in odd._jdf.queryExecution().executedPlan().toString()
