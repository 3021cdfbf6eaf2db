"""Axis-aligned crop with inclusive bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framecloud.config import CropConfig
from framecloud.functions.numeric import all_of, f32


def keep_condition(cfg: CropConfig) -> Column:
    if not cfg.enabled:
        return F.lit(True)
    bounds = {"x": cfg.x, "y": cfg.y, "z": cfg.z}
    return all_of([F.col(a).between(f32(lo), f32(hi)) for a, (lo, hi) in bounds.items()])


def crop(points: DataFrame, cfg: CropConfig) -> DataFrame:
    return points.where(keep_condition(cfg)) if cfg.enabled else points


def crop_mask(points: DataFrame, cfg: CropConfig) -> DataFrame:
    return points.withColumn("keep", F.coalesce(keep_condition(cfg), F.lit(False)))


def pack_parts(xyz: DataFrame, colors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join separate coordinate and colour tables; a row without partner is an error."""
    left = xyz.withColumn("_xyz", F.lit(True))
    right = colors.withColumn("_rgb", F.lit(True))
    both = left.join(right, [*keys, "idx"], "full_outer")
    lonely = F.col("_xyz").isNull() | F.col("_rgb").isNull()
    problem = F.raise_error(F.lit("colors and points differ in length")).cast("float")
    # Every coordinate carries the check, so no filter on one of them can pass it by.
    checked = {a: F.when(lonely, problem).otherwise(F.col(a)) for a in "xyz"}
    return both.withColumns(checked).drop("_xyz", "_rgb")


def crop_parts(xyz: DataFrame, colors: DataFrame, cfg: CropConfig, keys) -> DataFrame:
    """Crop coordinates and colours that live in separate tables."""
    return crop(pack_parts(xyz, colors, keys), cfg)
