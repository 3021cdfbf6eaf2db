"""Point cloud, metadata, raster and training-set writers."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framecloud.operators.assembly import pack_clouds
from framecloud.operators.checks import require_keys

RGB = ("red", "green", "blue")
MODE = "errorifexists"


@F.pandas_udf(T.StringType())
def _coordinates(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
    """Shortest decimal text of the widened float32 values."""
    columns = [c.to_numpy(np.float64).tolist() for c in (x, y, z)]
    return pd.Series([f"{a} {b} {c}" for a, b, c in zip(*columns, strict=True)])


def ply_lines(points: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Text lines of one PLY file per frame with their order ``line_no``.

    A null key, of a point or a frame, fails the job: it equals no other, so the header
    would not count its points.
    """
    keys = list(keys)
    points, frames = require_keys(points, keys), require_keys(frames, keys)
    has_rgb = all(c in points.columns for c in RGB)
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sized = frames.select(*keys).join(counts, keys, "left")
    header = [
        F.lit("ply"),
        F.lit("format ascii 1.0"),
        F.concat(F.lit("element vertex "), F.coalesce(F.col("_n"), F.lit(0)).cast("string")),
        *[F.lit(f"property float {a}") for a in "xyz"],
        *([F.lit(f"property uchar {c}") for c in RGB] if has_rgb else []),
        F.lit("end_header"),
    ]
    top = sized.select(*keys, F.posexplode(F.array(*header)).alias("line_no", "value")).select(
        *keys, F.col("line_no").cast("bigint").alias("line_no"), "value"
    )
    text = _coordinates("x", "y", "z")
    if has_rgb:
        bytes_ = [
            F.floor(F.least(F.greatest(F.col(c) * 255.0, F.lit(0.0)), F.lit(255.0))).cast("string")
            for c in RGB
        ]
        text = F.concat_ws(" ", text, *bytes_)
    order = "slot" if "slot" in points.columns else "idx"
    body = points.select(
        *keys, (F.col(order) + F.lit(len(header))).cast("bigint").alias("line_no"), text.alias("value")
    )
    return top.unionByName(body)


def write_ply(
    points: DataFrame, frames: DataFrame, keys: Sequence[str], path: str, mode: str = MODE
) -> None:
    """One ASCII PLY file per frame in a folder named by its key."""
    lines = ply_lines(points, frames, keys)
    (
        lines.repartition(*keys)
        .sortWithinPartitions(*keys, "line_no")
        .drop("line_no")
        .write.mode(mode)
        .partitionBy(*keys)
        .text(path)
    )


def write_metadata(meta: DataFrame, path: str, mode: str = MODE) -> None:
    """JSON lines with keys in alphabetical order; a null field is written as null."""
    meta.select(*sorted(meta.columns)).write.mode(mode).json(path, ignoreNullFields=False)


def write_rasters(frames: DataFrame, keys: Sequence[str], arrays: Sequence[str], path: str, mode: str = MODE):
    """Packed float32 rasters as Parquet."""
    columns = [F.col(a).cast("array<float>").alias(a) for a in arrays]
    frames.select(*keys, *columns).write.mode(mode).parquet(path)


def pack_raster(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Pixels back to one row-major array per frame; a frame holds one image."""
    ordered = F.array_sort(F.collect_list(F.struct("i", value)))
    return pixels.groupBy(*keys).agg(ordered.alias("_p")).select(*keys, F.col(f"_p.{value}").alias(value))


def write_training_set(samples: DataFrame, keys: Sequence[str], path: str, mode: str = MODE) -> None:
    """Fixed-size clouds, one row per frame, partitioned by camera when there is one."""
    writer = pack_clouds(samples, keys).write.mode(mode)
    if "camera" in keys:
        writer = writer.partitionBy("camera")
    writer.parquet(path)
