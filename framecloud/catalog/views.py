"""The driver tables seen as frames, cameras, points and timings.

``embeddings`` supplies images: 64 values are one 8 x 8 frame, its label is the
camera. ``nation`` supplies one camera row per key, ``lineitem`` a point table
that never was an image, ``events`` measured times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framecloud.functions.order import dense_index

SIDE = 8
LINE_SLICE = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed frames with every stream; unused columns are pruned at the scan."""
    e = F.col("embedding")
    rgb = F.transform(
        e,
        lambda c, i: F.array(
            F.abs(c), F.abs(F.get(e, F.lit(63) - i)), F.abs(F.get(e, i.bitwiseXOR(F.lit(1))))
        ),
    )
    three = F.lit(3.0).cast("float")
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("string").alias("camera"),
        F.col("vec_id").alias("frame_id"),
        (F.col("vec_id").cast("double") / F.lit(30.0)).alias("ts"),
        F.lit(SIDE).alias("height"),
        F.lit(SIDE).alias("width"),
        e.alias("depth"),
        F.transform(F.flatten(rgb), lambda c: c * three).alias("rgb"),
        F.lit(3).alias("rgb_channels"),
        F.transform(e, lambda c: F.abs(c) * F.lit(255.0).cast("float")).alias("left_ir"),
        F.transform(F.reverse(e), lambda c: F.abs(c) * F.lit(255.0).cast("float")).alias("right_ir"),
        F.transform(e, lambda c: c * F.lit(20.0).cast("float")).alias("disparity"),
    )


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One camera per nation key: even keys are aligned, odd keys turned and shifted."""
    n = F.col("n_nationkey")
    d = n.cast("double")
    odd = n % 2 == 1
    k = lambda fx, fy, cx, cy: F.struct(
        F.lit(SIDE).alias("width"),
        F.lit(SIDE).alias("height"),
        fx.alias("fx"),
        fy.alias("fy"),
        cx.alias("cx"),
        cy.alias("cy"),
    )
    turned = F.array(*[F.lit(v) for v in (0.8, -0.6, 0.0, 0.6, 0.8, 0.0, 0.0, 0.0, 1.0)])
    straight = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)])
    return table(spark, sf_dir, "nation").select(
        n.cast("string").alias("camera"),
        (~odd).alias("aligned"),
        F.when(n < 5, F.lit(10.0)).otherwise(F.lit(8.0)).alias("depth_scale"),
        k(F.lit(60.0), F.lit(60.0), F.lit(3.5), F.lit(3.5)).alias("color_k"),
        k(d + 56.0, d + 58.0, F.lit(3.5) - d / 8.0, F.lit(3.0) + d / 16.0).alias("depth_k"),
        F.when(odd, turned).otherwise(straight).alias("r"),
        F.array(d / 64.0, -d / 128.0, F.lit(0.0)).alias("t"),
        F.lit(0.05).alias("baseline_m"),
    )


def stereo_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cameras as a stereo rig: depth comes from infrared, none is aligned."""
    return cameras(spark, sf_dir).withColumn("aligned", F.lit(False))


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of ``lineitem``: one frame per supplier, ordered by all columns."""
    lines = table(spark, sf_dir, "lineitem")
    numbered = dense_index(lines, ["l_suppkey"], lines.columns, LINE_SLICE, "idx")
    return numbered.select(
        F.col("l_suppkey").alias("frame_id"),
        "idx",
        ((F.col("l_quantity") - 25.5) / 50.0).cast("float").alias("x"),
        (F.col("l_discount") * 10.0 - 0.5).cast("float").alias("y"),
        (F.col("l_extendedprice") / 50000.0).cast("float").alias("z"),
    )


def line_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("frame_id")).distinct()


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("backend"),
        F.col("event_type").alias("stage"),
        "event_id",
        "user_id",
        F.col("value").alias("ms"),
    )
