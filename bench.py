"""Headline queries, one JSON line.

``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import QUERIES  # noqa: E402

HEADLINE = [
    "rank_evidence_cells",   # harvest: score, exclude, top-k
    "threshold_sweep",       # relaxed precision and recall, three thresholds
    "stratified_result",     # best F1 per class over seven thresholds
    "evaluate_tiles",        # every score of a tile from one dilation
    "average_precision",     # exact pixel AP
    "median_filter_3",       # window-frame median
    "median_filter_10",      # block-array median
    "terrain_bands",         # the four terrain bands
    "grid_idw",              # points to elevation
    "height_above_ground",   # nearest ground point
    "height_above_ground_survey",  # the same over every line item
    "neighbour_distance",    # eight nearest in space
    "label_planes",          # burning ways into labels
    "signal_by_class",       # transects
    "predict",               # windowed inference and blending
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus) if cpus.isdigit() else 16))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").count().collect()
    times: dict[str, float] = {}
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
