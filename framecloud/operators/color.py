"""Colour of points from the image of the same frame.

The colour image stays packed in its frame row: a pixel reads its three values
by position in the same stage that explodes the depth image, so attaching
colour costs no join on pixels and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framecloud.functions.numeric import count_where, div32, f32, to32
from framecloud.operators.geometry import project_to_pixel, rigid_transform


def image_max(rgb: Column) -> Column:
    """Largest value of a packed image; NaN counts as nothing."""
    return F.array_max(F.array_remove(rgb, F.lit(float("nan")).cast("float")))


def divisor(rgb: Column) -> Column:
    """255 for images that hold values above 1, else 1: decided once per image."""
    return F.when(image_max(rgb) > f32(1), f32(255)).otherwise(f32(1))


COLOR = ("red", "green", "blue")
CARRY = ("rgb", "rgb_channels", "rgb_div")
# Colour camera and depth-to-colour transform as float32 scalars of a frame row.
LENS = ("cfx", "cfy", "ccx", "ccy", "cw", "ch")
POSE = tuple(f"r{j}" for j in range(9)) + ("t0", "t1", "t2")


def color_camera_columns() -> list[Column]:
    """Scalars a pixel needs to find its place in the colour image.

    They are taken out of the camera row once per frame, not once per pixel.
    """
    k = F.col("color_k")
    lens = [to32(k[n]).alias(a) for n, a in zip(("fx", "fy", "cx", "cy"), LENS, strict=False)]
    size = [k["width"].alias("cw"), k["height"].alias("ch")]
    turn = [to32(F.get("r", F.lit(j))).alias(f"r{j}") for j in range(9)]
    shift = [to32(F.get("t", F.lit(j))).alias(f"t{j}") for j in range(3)]
    return lens + size + turn + shift


def clamp01(c: Column) -> Column:
    """Clamp to 0..1; NaN stays, which Spark orders above every number, and so does null."""
    return F.when(c <= f32(1), F.greatest(c, f32(0))).when(F.isnan(c), c).when(c > f32(1), f32(1))


def read_colors(points: DataFrame, position: str) -> DataFrame:
    """Three colour columns from the packed image at a pixel position.

    A null position gives null. Each step is a projection of its own, so that an
    intermediate value is computed once per point.
    """
    base = points.withColumn("_at", F.col(position) * F.col("rgb_channels"))
    raw = {
        name: div32(F.get("rgb", F.col("_at") + F.lit(j)), F.col("rgb_div"))
        for j, name in enumerate(COLOR)
    }
    read = base.withColumns(raw).drop("_at", *CARRY)
    return read.withColumns({name: clamp01(F.col(name)) for name in COLOR})


def with_aligned_color(pixels: DataFrame) -> DataFrame:
    """Colour at the pixel's own position."""
    return read_colors(pixels, "i")


def color_position(points: DataFrame) -> DataFrame:
    """Add ``hit`` and ``position``: the nearest pixel in the colour image, if any."""
    moved = points.withColumns(
        dict(zip(("qx", "qy", "qz"), rigid_transform(), strict=True))
    ).drop(*POSE)
    spot = moved.withColumns(
        project_to_pixel(F.col("qx"), F.col("qy"), F.col("qz"), *[F.col(n) for n in LENS[:4]])
    )
    inside = (
        (F.col("pu") >= 0) & (F.col("pu") < F.col("cw")) & (F.col("pv") >= 0) & (F.col("pv") < F.col("ch"))
    )
    found = spot.withColumn("hit", F.coalesce(inside, F.lit(False)))
    place = (F.col("pv") * F.col("cw") + F.col("pu")).cast("int")
    return found.withColumn("position", F.when(F.col("hit"), place)).drop(
        "qx", "qy", "qz", "pu", "pv", *LENS
    )


def black_where_missing(points: DataFrame, mapped: Column) -> DataFrame:
    """A point outside the colour image is black; an unmapped camera gives no colour."""
    black = F.when(mapped, f32(0))
    return points.withColumns(
        {n: F.when(F.col("position").isNotNull(), F.col(n)).otherwise(black) for n in COLOR}
    ).drop("position")


def with_projected_color(points: DataFrame) -> DataFrame:
    """Colour at the nearest pixel of the colour camera; a miss is black."""
    colored = read_colors(color_position(points), "position")
    return black_where_missing(colored, F.lit(True))


def projection_counts(points: DataFrame, keys) -> DataFrame:
    """Hits and misses of the colour projection per frame."""
    return points.groupBy(*keys).agg(
        count_where(F.col("hit")).alias("valid_projection_count"),
        count_where(~F.col("hit")).alias("invalid_projection_count"),
    )
