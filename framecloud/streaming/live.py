"""Live frames: the batch build applied to each micro-batch.

Frames are independent, so the stream keeps no state. Every output carries the
batch id as a partition folder that is overwritten as a whole, which makes a
repeated micro-batch after a failure harmless.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from framecloud.config import BuildConfig
from framecloud.plans.build import build
from framecloud.plans.one_pass import OnePass
from framecloud.schema import FRAMES, KEYS

STAGES = ("raw", "cropped", "sampled", "meta", "pixels", "stereo_meta", "breakdown")


def read_frames(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of packed frames from a folder of Parquet files."""
    reader = spark.readStream.schema(FRAMES)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def write_batch(
    batch: DataFrame,
    batch_id: int,
    cameras: DataFrame,
    cfg: BuildConfig,
    paths: Mapping[str, str],
    keys: Sequence[str] = KEYS,
) -> None:
    """Write the stages named in ``paths`` from one pass over the micro-batch."""
    with OnePass(build(batch, cameras, cfg, keys, mode="live")) as stages:
        for name, path in paths.items():
            out = getattr(stages, name)
            out.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run_live(
    frames: DataFrame,
    cameras: DataFrame,
    cfg: BuildConfig,
    paths: Mapping[str, str],
    checkpoint: str,
    keys: Sequence[str] = KEYS,
    trigger: Mapping | None = None,
) -> StreamingQuery:
    """Start the stream. ``paths`` maps stage names to output folders."""
    unknown = set(paths) - set(STAGES)
    if unknown:
        raise ValueError(f"unknown stages: {sorted(unknown)}")

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, cameras, cfg, paths, keys)

    return (
        frames.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
