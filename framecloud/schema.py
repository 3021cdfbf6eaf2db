"""Table schemas and key columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from framecloud.config import CameraRow, Intrinsics

KEYS = ("camera", "frame_id")

FRAMES = T.StructType(
    [
        T.StructField("camera", T.StringType()),
        T.StructField("frame_id", T.LongType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("depth", T.ArrayType(T.FloatType())),
        T.StructField("rgb", T.ArrayType(T.FloatType())),
        T.StructField("rgb_channels", T.IntegerType()),
        T.StructField("left_ir", T.ArrayType(T.FloatType())),
        T.StructField("right_ir", T.ArrayType(T.FloatType())),
        T.StructField("disparity", T.ArrayType(T.FloatType())),
    ]
)

_INTRINSICS = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("fx", T.DoubleType()),
        T.StructField("fy", T.DoubleType()),
        T.StructField("cx", T.DoubleType()),
        T.StructField("cy", T.DoubleType()),
    ]
)

CAMERAS = T.StructType(
    [
        T.StructField("camera", T.StringType()),
        T.StructField("aligned", T.BooleanType()),
        T.StructField("depth_scale", T.DoubleType()),
        T.StructField("color_k", _INTRINSICS),
        T.StructField("depth_k", _INTRINSICS),
        T.StructField("r", T.ArrayType(T.DoubleType())),
        T.StructField("t", T.ArrayType(T.DoubleType())),
        T.StructField("baseline_m", T.DoubleType()),
    ]
)


def camera_table(spark: SparkSession, rows: Iterable[CameraRow]) -> DataFrame:
    """The ``cameras`` table of a hand-written configuration."""

    def k(v: Intrinsics):
        return (v.width, v.height, float(v.fx), float(v.fy), float(v.cx), float(v.cy))

    data = []
    for c in rows:
        ext = c.depth_to_color_extrinsics
        data.append(
            (
                c.name,
                c.aligned_depth_to_color,
                float(c.depth_scale),
                k(c.color_intrinsics),
                k(c.depth_intrinsics),
                ext.flat_rotation() if ext else None,
                [float(v) for v in ext.translation] if ext else None,
                c.baseline_m,
            )
        )
    return spark.createDataFrame(data, CAMERAS)
