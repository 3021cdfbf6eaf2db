"""Stereo cost volumes from packed feature maps.

Features are packed per frame as channels x height x width. Each output cell
reads both arrays by position in the stage that explodes the cells: no join on
pixels, no aggregation and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framecloud.functions.numeric import div32, f32, sum32, to32


def _cells(frames: DataFrame, keys, planes: int, plane: str, max_disp: int, h: int, w: int):
    return (
        frames.select(
            *keys, "left", "right", F.explode(F.sequence(F.lit(0), F.lit(planes - 1))).alias(plane)
        )
        .select(
            *keys, "left", "right", plane,
            F.explode(F.sequence(F.lit(0), F.lit(max_disp - 1))).alias("d"),
        )
        .select(
            *keys, "left", "right", plane, "d",
            F.explode(F.sequence(F.lit(0), F.lit(h * w - 1))).alias("_i"),
        )
        .withColumns({"h": F.expr(f"cast(_i div {w} as int)"), "w": F.col("_i") % w})
    )


def correlation_volume(
    frames: DataFrame,
    keys: Sequence[str],
    shape: tuple[int, int, int],
    max_disp: int,
    groups: int,
    normalize: bool = False,
) -> DataFrame:
    """Dot product of each channel group of left at w and right at w - d; 0 left of the image.

    The normalised form divides by the product of both norms plus 1e-5.
    """
    channels, height, width = shape
    if channels % groups:
        raise ValueError("channels must be divisible by groups")
    per_group, area = channels // groups, height * width
    cells = _cells(frames, keys, groups, "g", max_disp, height, width)
    base = F.col("g") * (per_group * area) + F.col("_i")

    def side(array: str, k: int, shift: Column) -> Column:
        return F.get(F.col(array), base + F.lit(k * area) - shift)

    left = [side("left", k, F.lit(0)) for k in range(per_group)]
    right = [side("right", k, F.col("d")) for k in range(per_group)]
    dot = sum32([a * b for a, b in zip(left, right, strict=True)])
    if normalize:
        norms = [to32(F.sqrt(sum32([c * c for c in s]))) for s in (left, right)]
        dot = div32(dot, norms[0] * norms[1] + f32(1e-5))
    value = F.when(F.col("w") >= F.col("d"), dot).otherwise(f32(0))
    return cells.select(*keys, "g", "d", "h", "w", value.alias("value"))


def concat_volume(
    frames: DataFrame, keys: Sequence[str], shape: tuple[int, int, int], max_disp: int
) -> DataFrame:
    """Left channels followed by right channels shifted by the disparity."""
    channels, height, width = shape
    area = height * width
    cells = _cells(frames, keys, 2 * channels, "c", max_disp, height, width)
    c, i, d = F.col("c"), F.col("_i"), F.col("d")
    left = F.get(F.col("left"), c * area + i)
    right = F.when(
        F.col("w") >= d, F.get(F.col("right"), (c - channels) * area + i - d)
    ).otherwise(f32(0))
    value = F.when(c < channels, left).otherwise(right)
    return cells.select(*keys, "c", "d", "h", "w", value.alias("value"))
