"""Putting frames together from separately stored streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framecloud.operators.checks import enforce, require_keys


def assemble_frames(
    depth: DataFrame, ir: DataFrame, rgb: DataFrame | None, keys: Sequence[str]
) -> DataFrame:
    """Depth and infrared must exist for a frame; colour may be absent.

    A frame with only one of the two fails the job: ``assembly_report`` tells
    which frames those are, for a caller who wants to set them aside first. A
    null key finds no partner and fails as well.
    """
    keys = list(keys)
    frames = depth.withColumn("_depth", F.lit(True)).join(
        ir.withColumn("_ir", F.lit(True)), keys, "full_outer"
    )
    rules = {"frame without depth": F.col("_depth"), "frame without infrared": F.col("_ir")}
    whole = enforce(frames, rules, F.concat_ws("/", *keys)).drop("_depth", "_ir")
    return whole if rgb is None else whole.join(rgb, keys, "left")


def assembly_report(
    depth: DataFrame, ir: DataFrame, rgb: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Audit form: every frame of any stream, which streams it has, and the verdict."""
    keys = list(keys)
    streams = {"has_depth": depth, "has_ir": ir, "has_rgb": rgb}
    marked = [
        df.select(*keys, *[F.lit(n == name).alias(n) for n in streams]) for name, df in streams.items()
    ]
    seen = marked[0].unionByName(marked[1]).unionByName(marked[2])
    found = seen.groupBy(*keys).agg(*[F.max(n).alias(n) for n in streams])
    return found.withColumn("complete", F.col("has_depth") & F.col("has_ir"))


def frame_completeness(frames: DataFrame, points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every input frame with its point count, zero where nothing is left."""
    keys = list(keys)
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("bigint")
    return (
        require_keys(frames.select(*keys), keys)
        .join(counts, keys, "left")
        .select(
            *keys,
            F.coalesce(F.col("_n"), zero).alias("n_points"),
            F.col("_n").isNull().alias("is_empty"),
        )
    )


def pack_clouds(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fixed-size clouds as one row per frame with arrays in slot order.

    A frame holds ``num_points`` slots, so the collected lists are bounded.
    """
    values = [c for c in samples.columns if c not in {*keys, "slot", "is_pad"}]
    rows = F.array_sort(F.collect_list(F.struct("slot", *values)))
    packed = samples.groupBy(*keys).agg(rows.alias("_rows"))
    return packed.select(
        *keys,
        F.size("_rows").alias("num_points"),
        *[F.col(f"_rows.{c}").alias(c) for c in values],
    )
