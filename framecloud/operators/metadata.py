"""Per-frame counts and flags of a build, and cloud extents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framecloud.config import CropConfig, SamplingConfig
from framecloud.functions.numeric import count_where
from framecloud.operators.checks import require_keys, require_unique
from framecloud.operators.crop import keep_condition
from framecloud.operators.sampling import VOXEL, sampling_flags, voxel_key_columns

COUNTS = ("num_raw_points", "num_cropped_points", "candidate_count")


def stage_counts(
    raw: DataFrame, keys: Sequence[str], crop: CropConfig, sampling: SamplingConfig
) -> DataFrame:
    """Raw, cropped and candidate counts of each frame from one pass over its raw points."""
    keep = F.coalesce(keep_condition(crop), F.lit(False))
    kept = raw.withColumn("_keep", keep)
    has_hits = "hit" in raw.columns
    if sampling.enabled and sampling.uses_voxels:
        voxels = {k: F.when(F.col("_keep"), c) for k, c in voxel_key_columns(sampling.voxel_size).items()}
        first = kept.withColumns(voxels).groupBy(*keys, "_keep", *VOXEL)
        hits = [count_where(F.col("hit")).alias("_hits")] if has_hits else []
        cells = first.agg(F.count(F.lit(1)).alias("_n"), *hits)
        totals = [
            F.sum("_n").alias("num_raw_points"),
            F.sum(F.when(F.col("_keep"), F.col("_n"))).alias("num_cropped_points"),
            count_where(F.col("_keep")).alias("candidate_count"),
        ]
        hits = [F.sum("_hits").alias("valid_projection_count")] if has_hits else []
        return cells.groupBy(*keys).agg(*totals, *hits)
    inside = count_where(F.col("_keep"))
    hits = [count_where(F.col("hit")).alias("valid_projection_count")] if has_hits else []
    return kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_raw_points"),
        inside.alias("num_cropped_points"),
        inside.alias("candidate_count"),
        *hits,
    )


def frame_meta(
    frames: DataFrame,
    counts: DataFrame,
    keys: Sequence[str],
    crop: CropConfig,
    sampling: SamplingConfig,
    mode: str,
    use_rgb: Column | None = None,
) -> DataFrame:
    """One metadata row per input frame, also for frames that lost every point.

    A null or repeated frame key fails the job.
    """
    keys = list(keys)
    joined = require_unique(require_keys(frames, keys), keys).join(counts, keys, "left")
    counted = [c for c in (*COUNTS, "valid_projection_count") if c in joined.columns]
    zero = F.lit(0).cast("bigint")
    filled = joined.withColumns({c: F.coalesce(F.col(c), zero) for c in counted})
    flagged = sampling_flags(
        filled.withColumn("input_count", F.col("num_cropped_points")), sampling
    )
    stage = "sampled" if sampling.enabled else ("cropped" if crop.enabled else "raw")
    bounds = {a: F.array(*[F.lit(float(b)) for b in getattr(crop, a)]) for a in "xyz"}
    return flagged.withColumns(
        {
            "stage": F.lit(stage),
            "mode": F.lit(mode),
            "use_rgb": F.lit(False) if use_rgb is None else use_rgb,
            "num_sampled_points": F.col("sampled_count"),
            "crop_enabled": F.lit(crop.enabled),
            "crop_range": F.struct(
                F.lit(crop.frame).alias("frame"), *[c.alias(a) for a, c in bounds.items()]
            ),
            "crop_empty": F.lit(crop.enabled) & (F.col("num_cropped_points") == 0),
        }
    )


def cloud_extent(points: DataFrame, frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Point count and bounding box per frame; zeros for an empty frame."""
    keys = list(keys)
    box = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.min(a).alias(f"min_{a}") for a in "xyz"],
        *[F.max(a).alias(f"max_{a}") for a in "xyz"],
    )
    names = [f"{m}_{a}" for m in ("min", "max") for a in "xyz"]
    joined = require_keys(frames.select(*keys), keys).join(box, keys, "left")
    return joined.select(
        *keys,
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
        *[F.coalesce(F.col(c), F.lit(0.0).cast("float")).alias(c) for c in names],
    )
