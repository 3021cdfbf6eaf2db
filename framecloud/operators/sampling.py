"""Fixed-size sampling: every frame leaves with exactly ``num_points`` rows.

Points come either from packed frames, where one frame holds at most one image
of points (``frame_bound``), or from an arbitrary point table, where one frame
may hold any share of the table. Without a bound every ranking is cut into
parts first (see ``functions.order``).
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framecloud.config import SamplingConfig
from framecloud.functions.checkpoints import cut
from framecloud.functions.numeric import div32, f32
from framecloud.functions.order import dense_index, first_k
from framecloud.operators.checks import require_keys, require_unique
from framecloud.operators.crop import pack_parts
from framecloud.operators.farthest import farthest_points

# Largest frame that is ranked in one task: a 4-megapixel image.
TASK_POINTS = 1 << 22
INDEX_SLICE = 1 << 16
VOXEL = ("kx", "ky", "kz")


def _one_task(frame_bound: int | None) -> bool:
    return frame_bound is not None and frame_bound <= TASK_POINTS


def voxel_key_columns(voxel_size: float) -> dict[str, Column]:
    """Voxel position per axis from coordinates only."""
    return {
        k: F.floor(div32(F.col(a), voxel_size)).cast("bigint")
        for k, a in zip(VOXEL, "xyz", strict=True)
    }


def voxel_keys(points: DataFrame, voxel_size: float) -> DataFrame:
    return points.withColumns(voxel_key_columns(voxel_size))


def voxel_representatives(
    points: DataFrame, keys: Sequence[str], voxel_size: float
) -> DataFrame:
    """The first point of each occupied voxel, with all its columns.

    One hash aggregate with map-side combine: only occupied voxels are shuffled.
    """
    values = [c for c in points.columns if c not in {*keys, "idx"}]
    return (
        voxel_keys(points, voxel_size)
        .groupBy(*keys, *VOXEL)
        .agg(F.min("idx").alias("idx"), *[F.min_by(c, "idx").alias(c) for c in values])
        .select(*points.columns)
    )


def random_digest(keys: Sequence[str], seed: int) -> Column:
    """Digest of seed, frame and point in hexadecimal digits, uniform over points."""
    parts = [F.col(k).cast("string") for k in (*keys, "idx")]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def random_key(keys: Sequence[str], seed: int) -> Column:
    """A uniform sort key that depends on seed, frame and point only.

    It gives the same sample for any partitioning and after a task is retried.
    The key is the leading 60 bits of the digest as a number, which sorts faster
    than its text; ties go to the lower index.
    """
    return F.conv(F.substring(random_digest(keys, seed), 1, 15), 16, 10).cast("bigint")


def draw_seed(cfg: SamplingConfig) -> int:
    """The configured seed, or a fresh one when the sample need not repeat."""
    if cfg.deterministic and cfg.seed is not None:
        return cfg.seed
    return random.SystemRandom().getrandbits(62)


def select_first(points: DataFrame, keys, k: int, frame_bound: int | None = None) -> DataFrame:
    return first_k(points, keys, ["idx"], k, "rank", spread=not _one_task(frame_bound))


def select_random(
    points: DataFrame, keys, k: int, seed: int, frame_bound: int | None = None
) -> DataFrame:
    return select_drawn(points.withColumn("_draw", random_key(keys, seed)), keys, k, "_draw", frame_bound)


def select_drawn(
    points: DataFrame, keys, k: int, draw: str, frame_bound: int | None = None
) -> DataFrame:
    """The ``k`` points with the lowest draw, which is dropped."""
    spread = not _one_task(frame_bound)
    return first_k(points, keys, [draw, "idx"], k, "rank", spread).drop(draw)


def select_stride(
    points: DataFrame, keys, k: int, stride: int, frame_bound: int | None = None
) -> DataFrame:
    """Every ``stride``-th point by dense position, then the first ``k`` of them."""
    if _one_task(frame_bound):
        order = W.partitionBy(*keys).orderBy("idx")
        placed = points.withColumn("_p", (F.row_number().over(order) - 1).cast("bigint"))
    else:
        placed = dense_index(points, keys, ["idx"], INDEX_SLICE, "_p")
    return (
        placed.where((F.col("_p") % stride == 0) & (F.col("_p") < F.lit(stride * k)))
        .withColumn("rank", F.expr(f"_p div {stride}").cast("int"))
        .drop("_p")
    )


def candidates(points: DataFrame, keys, cfg: SamplingConfig) -> DataFrame:
    return voxel_representatives(points, keys, cfg.voxel_size) if cfg.uses_voxels else points


def select_points(
    chosen_from: DataFrame,
    keys,
    cfg: SamplingConfig,
    frame_bound: int | None = None,
    drawn: str | None = None,
) -> DataFrame:
    """At most ``num_points`` candidates per frame with their 0-based ``rank``.

    ``drawn`` names a column that already holds the draws of a random mode.
    """
    k = cfg.num_points
    if cfg.mode in ("fps", "voxel_fps"):
        if cfg.uses_voxels and frame_bound is None:
            # Candidates are counted and then sampled: aggregate the input only once.
            chosen_from = cut(chosen_from)
        return farthest_points(chosen_from, keys, k, frame_bound)
    if drawn and cfg.mode in ("random", "voxel_random"):
        return select_drawn(chosen_from, keys, k, drawn, frame_bound)
    if cfg.mode in ("random", "voxel_random"):
        return select_random(chosen_from, keys, k, draw_seed(cfg), frame_bound)
    if cfg.mode == "stride":
        return select_stride(chosen_from, keys, k, cfg.stride, frame_bound)
    return select_first(chosen_from, keys, k, frame_bound)


def pad(
    selected: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    k: int,
    pad_mode: str,
    unique: bool = False,
) -> DataFrame:
    """Fill slots 0..k-1 of every frame in ``frames``, also of frames without points.

    Repeat: the row of rank j also takes slots j+n, j+2n, ... Zero: rank 0 also
    emits the empty slots. A frame without points gets k zero rows in both modes.
    A frame key that ``frames`` holds more than once fails the job; ``unique`` says
    that this was checked.
    """
    keys = list(keys)
    frames = frames if unique else require_unique(frames.select(*keys), keys)
    values = [c for c in selected.columns if c not in {*keys, "rank", "idx"}]
    sized = selected.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys))).drop("idx")
    per_frame = require_keys(frames.select(*keys), keys).join(sized, keys, "left")
    rank, n, last = F.col("rank"), F.col("_n"), F.lit(k - 1)
    empty = F.sequence(F.lit(0), last)
    own = F.array(rank)
    if pad_mode == "repeat":
        filled = F.sequence(rank, last, n.cast("int"))
    else:
        gap = F.sequence(n.cast("int"), last)
        filled = F.when((rank == 0) & (n < k), F.concat(own, gap)).otherwise(own)
    slots = F.when(rank.isNull(), empty).otherwise(filled)
    placed = per_frame.withColumn("slot", F.explode(slots))
    real = rank.isNotNull() & (F.lit(pad_mode == "repeat") | (F.col("slot") == rank))
    return placed.select(
        *keys,
        "slot",
        *[F.when(real, F.col(c)).otherwise(f32(0)).alias(c) for c in values],
        F.coalesce(F.col("slot") != rank, F.lit(True)).alias("is_pad"),
    )


def sample_points(
    points: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    cfg: SamplingConfig,
    frame_bound: int | None = None,
) -> DataFrame:
    """Candidates, selection and padding in one; disabled sampling passes points through."""
    if not cfg.enabled:
        return points
    selected = select_points(candidates(points, keys, cfg), keys, cfg, frame_bound)
    return pad(selected, frames, keys, cfg.num_points, cfg.pad_mode)


def sample_parts(
    xyz: DataFrame,
    colors: DataFrame,
    frames: DataFrame,
    keys: Sequence[str],
    cfg: SamplingConfig,
    frame_bound: int | None = None,
) -> DataFrame:
    """Sampling of coordinates and colours that live in separate tables."""
    return sample_points(pack_parts(xyz, colors, keys), frames, keys, cfg, frame_bound)


def sampling_counts(points: DataFrame, frames: DataFrame, keys, cfg: SamplingConfig) -> DataFrame:
    """Input, candidate and sampled counts per frame; a null key fails the job.

    ``padded`` compares candidates with the target, not the selected rows: a
    stride that leaves too few of many candidates reports false.
    """
    keys = list(keys)
    points = require_keys(points, keys)
    if cfg.enabled and cfg.uses_voxels:
        counted = (
            voxel_keys(points, cfg.voxel_size)
            .groupBy(*keys, *VOXEL)
            .agg(F.count(F.lit(1)).alias("_n"))
            .groupBy(*keys)
            .agg(F.sum("_n").alias("input_count"), F.count(F.lit(1)).alias("candidate_count"))
        )
    else:
        counted = points.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("input_count"), F.count(F.lit(1)).alias("candidate_count")
        )
    return sampling_flags(require_keys(frames.select(*keys), keys).join(counted, keys, "left"), cfg)


def sampling_flags(counted: DataFrame, cfg: SamplingConfig) -> DataFrame:
    """Derived sampling metadata next to ``input_count`` and ``candidate_count``."""
    target = F.lit(cfg.num_points).cast("bigint")
    zero = F.lit(0).cast("bigint")
    found = counted.withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("input_count", "candidate_count")}
    )
    return found.withColumns(
        {
            "sampled_count": target if cfg.enabled else F.col("input_count"),
            "input_empty": F.col("input_count") == 0,
            "padded": (F.col("candidate_count") < target) if cfg.enabled else F.lit(False),
            "sampling_enabled": F.lit(cfg.enabled),
            "sampling_mode": F.lit(cfg.mode),
            "target_num_points": F.lit(cfg.num_points),
            "pad_mode": F.lit(cfg.pad_mode),
            "voxel_size": F.lit(float(cfg.voxel_size)),
        }
    )
