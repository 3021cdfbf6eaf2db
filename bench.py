"""Time the headline queries; prints one JSON line.

Each query runs once to warm the JVM (the published per-frame numbers are warm
too) and then ``BENCH_REPEATS`` times in full; the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from framecloud.catalog import QUERIES

HEADLINE = (
    "deproject",
    "crop",
    "frame_cloud",
    "frame_meta",
    "color_cloud",
    "stereo_cloud",
    "stage_breakdown",
    "voxel_representatives",
    "sample_stride",
    "sample_random",
    "sample_voxel",
    "sample_voxel_random",
    "sample_fps",
    "sample_voxel_fps",
    "training_export",
    "parity_metrics",
    "native_parity",
    "latency_summary",
    "gwc_volume",
    "resize_pad",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("framecloud-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Call-site capture doubles the driver-side cost of building a plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    times = {}
    for name in names:
        seconds(spark, name, folder)
        times[name] = round(min(seconds(spark, name, folder) for _ in range(repeats)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    result = {
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
