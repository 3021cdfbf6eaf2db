"""Several outputs of a build from one pass over its pixels.

The pixels of a frame are reduced once to *cells*: one row for each candidate of the
sample and one for each way a pixel can be lost, with how many pixels it stands for. Cells
are kept where the frame lies; counts, metadata, stage breakdown and samples all read
them. A cell holds the position and depth of its first pixel only. The other coordinates
follow from these two, and colours are fetched for the points that were chosen.
"""

from __future__ import annotations

from functools import cached_property, reduce
from operator import add

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framecloud.config import BuildConfig
from framecloud.functions.numeric import count_where, div32, to32
from framecloud.functions.order import smallest_k
from framecloud.operators.checks import require_unique
from framecloud.operators.color import COLOR, POSE, color_position
from framecloud.operators.color import LENS as COLOR_LENS
from framecloud.operators.crop import crop, keep_condition
from framecloud.operators.geometry import LENS, deproject, explode_pixels
from framecloud.operators.sampling import (
    VOXEL,
    draw_seed,
    pad,
    random_digest,
    random_key,
    select_points,
    voxel_key_columns,
)
from framecloud.operators.stereo import breakdown_row, z_range_invalid
from framecloud.plans.build import Stages, build_meta, describe_stereo, raw_points, stereo_pixels, with_color

#: Why a pixel of a stereo frame has no depth; the reasons overlap.
REASONS = ("seen", "non_finite", "non_positive", "positive", "below_min", "above_max", "z_range")
COMPRESSED = "spark.sql.inMemoryColumnarStorage.compressed"
#: Hexadecimal digits of a draw, and bits of a position, that sort rows into buckets.
BUCKET_DIGITS, BUCKET_BITS = 3, 12


def _flags() -> Column:
    return reduce(add, [F.when(F.col(r), 1 << j).otherwise(0) for j, r in enumerate(REASONS)])


def frame_cells(packed: DataFrame, keys: list[str], cfg: BuildConfig) -> DataFrame:
    """Candidates and lost pixels of each frame.

    ``kept`` is true for a candidate, false for points outside the crop and null for
    pixels without a point. ``n`` counts pixels, ``hits`` those with a colour and
    ``invisible`` those the right camera does not see. Frames keep all their pixels in the
    counts, so every frame has at least one cell.
    """
    stereo, rgb = cfg.depth_mode == "stereo", cfg.pointcloud.use_rgb
    geometry = ("aligned", *COLOR_LENS, *POSE) if rgb else ()
    carry = [*LENS, *geometry]
    extra = ["_flags", "invisible"] if stereo else []
    if stereo:
        px = stereo_pixels(packed, keys, cfg.stereo, carry).withColumnRenamed("valid", "seen")
        px = px.withColumn("z_range", z_range_invalid(F.col("depth_m"), cfg.stereo))
        px = px.withColumn("_flags", _flags()).withColumnRenamed("depth_m", "depth")
        px = px.select(*keys, "i", "u", "v", "depth", *extra, *carry)
    else:
        px = explode_pixels(packed, keys, "depth", "depth", F.col("k_width"), carry)
    points = deproject(px)
    if rgb:
        points = color_position(points)
    kept = F.when(F.col("valid"), F.coalesce(keep_condition(cfg.crop), F.lit(False)))
    counted = {"hits": F.col("aligned") | F.col("hit")} if rgb else {}
    counted |= {"invisible": F.col("invisible")} if stereo else {}
    points = points.withColumn("kept", kept).withColumnRenamed("i", "idx")
    lost = {"flags": F.when(~F.coalesce(F.col("kept"), F.lit(False)), F.col("_flags"))} if stereo else {}
    points = points.withColumns({**counted, **lost})
    kinds = [*keys, "kept", *lost]
    if cfg.sampling.enabled and cfg.sampling.uses_voxels:
        voxels = {k: F.when(F.col("kept"), c) for k, c in voxel_key_columns(cfg.sampling.voxel_size).items()}
        return (
            points.withColumns(voxels)
            .groupBy(*kinds, *VOXEL)
            .agg(
                F.min("idx").alias("idx"),
                F.min_by("z", "idx").alias("z"),
                F.count(F.lit(1)).cast("int").alias("n"),
                *[count_where(F.col(c)).cast("int").alias(c) for c in counted],
            )
            .drop(*VOXEL)
        )
    one = {c: F.col(c).cast("int") for c in counted}
    return points.withColumns({**one, "n": F.lit(1)}).select(*kinds, "idx", "z", "n", *counted)


class OnePass:
    """Outputs of ``stages`` that share one scan, one shuffle and one explosion of frames.

    Use it as a context manager: cells are kept in memory and on disk until it ends.
    Lost executors only cost their cells, which Spark computes again. Key, time and camera
    columns are read a second time, images are not; only coloured samples go back to the
    colour images. A frame key that occurs more than once fails every output.
    """

    def __init__(self, stages: Stages):
        self.stages, self.cfg, self.keys = stages, stages.cfg, stages.keys
        self.seed = draw_seed(stages.cfg.sampling)
        self._kept: list[DataFrame] = []

    def __enter__(self) -> OnePass:
        # Cells are narrow and read a few times: packing them takes longer than computing them.
        conf = self.stages.frames.sparkSession.conf
        self._packing = conf.get(COMPRESSED)
        conf.set(COMPRESSED, "false")
        return self

    def __exit__(self, *_) -> None:
        self.stages.frames.sparkSession.conf.set(COMPRESSED, self._packing)
        for df in self._kept:
            df.unpersist()
        self._kept.clear()

    def _keep(self, df: DataFrame) -> DataFrame:
        """Compute a table now: only then do plans know that it lies by frame."""
        self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        df.count()
        return df

    @cached_property
    def placed(self) -> DataFrame:
        """Packed frames by frame; kept as well where a model computes them."""
        modelled = self.cfg.depth_mode == "stereo" and self.cfg.stereo.backend
        return self._keep(self.stages.placed) if modelled else self.stages.placed

    @cached_property
    def raw(self) -> DataFrame:
        return raw_points(self.placed, self.keys, self.cfg).drop("hit")

    @cached_property
    def cropped(self) -> DataFrame:
        return crop(self.raw, self.cfg.crop)

    @cached_property
    def pixels(self) -> DataFrame:
        self._require_stereo()
        return stereo_pixels(self.placed, self.keys, self.cfg.stereo)

    @cached_property
    def cells(self) -> DataFrame:
        cells = frame_cells(self.placed, self.keys, self.cfg)
        return self._keep(cells.withColumn("bucket", F.when(F.col("kept"), self._bucket())))

    @property
    def _random(self) -> bool:
        return self.cfg.sampling.mode in ("random", "voxel_random")

    def _bucket(self) -> Column:
        """Leading part of what the sample is ordered by."""
        if self._random:
            return F.substring(random_digest(self.keys, self.seed), 1, BUCKET_DIGITS)
        spare = max(0, self.stages.frame_bound.bit_length() - BUCKET_BITS)
        return F.shiftright("idx", spare).cast("int")

    @cached_property
    def counts(self) -> DataFrame:
        """Counts of every frame, candidates included."""
        n, kept = F.col("n"), F.coalesce(F.col("kept"), F.lit(False))
        point = F.col("kept").isNotNull()
        some = lambda condition, c="n": F.coalesce(F.sum(F.when(condition, F.col(c))), F.lit(0))
        named = {
            "num_raw_points": some(point),
            "num_cropped_points": some(kept),
            "candidate_count": count_where(kept),
        }
        if self.cfg.pointcloud.use_rgb:
            named["valid_projection_count"] = some(point, "hits")
        if self.cfg.depth_mode == "stereo":
            seen = kept | (F.col("flags").bitwiseAND(1) != 0)
            bit = lambda r: ~kept & (F.col("flags").bitwiseAND(1 << REASONS.index(r)) != 0)
            named |= {
                "total": F.sum(n),
                "valid": some(seen),
                "invalid": some(~seen),
                "invisible": F.sum("invisible"),
                "positive": some(kept | bit("positive")),
                **{r: some(bit(r)) for r in ("non_finite", "non_positive", "below_min", "above_max", "z_range")},
            }
        return self.cells.groupBy(*self.keys).agg(*[c.alias(a) for a, c in named.items()])

    @cached_property
    def meta(self) -> DataFrame:
        names = ["num_raw_points", "num_cropped_points", "candidate_count"]
        if self.cfg.pointcloud.use_rgb:
            names.append("valid_projection_count")
        return build_meta(self.stages, self.counts.select(*self.keys, *names))

    def _require_stereo(self) -> None:
        if self.cfg.depth_mode != "stereo":
            raise ValueError("stereo outputs need a stereo depth source")

    @cached_property
    def stereo_meta(self) -> DataFrame:
        self._require_stereo()
        kept = F.lit(self.cfg.stereo.remove_invisible)
        reasons = self.counts.select(
            *self.keys,
            "total",
            "valid",
            "invalid",
            "non_finite",
            F.col("non_positive").alias("non_positive_or_epsilon"),
            F.when(kept, F.col("invisible")).otherwise(F.lit(0).cast("bigint")).alias("invisible_right_coordinate"),
            F.col("below_min").alias("below_min_depth"),
            F.col("above_max").alias("above_max_depth"),
        )
        return describe_stereo(self.stages, reasons)

    @cached_property
    def breakdown(self) -> DataFrame:
        """Pixels lost to the model, to geometry, to the crop and to sampling, per frame."""
        self._require_stereo()
        layers = self.counts.select(
            *self.keys,
            F.col("total").alias("image_pixel_count"),
            (F.col("total") - F.col("positive")).alias("invalid_disparity_count"),
            F.col("invisible").alias("remove_invisible_count"),
            F.col("z_range").alias("z_range_invalid_count"),
            F.col("valid").alias("final_valid_disparity_count"),
            F.col("invalid").alias("final_invalid_disparity_count"),
        )
        return breakdown_row(layers, self.meta, self.keys)

    def _nearby(self, candidates: DataFrame) -> DataFrame:
        """What can be among the first ``num_points``, in the order the mode samples by."""
        k = self.cfg.sampling.num_points
        if self.cfg.sampling.mode in ("fps", "voxel_fps", "stride"):
            return candidates
        return smallest_k(candidates, self.keys, "bucket", k)

    @cached_property
    def sampled(self) -> DataFrame:
        sampling, keys = self.cfg.sampling, self.keys
        near = self._nearby(self.cells.where("kept")) if sampling.enabled else self.cells.where("kept")
        near = near.select(*keys, "idx", "z")
        lens = require_unique(self.stages.lenses, keys)
        if sampling.mode in ("fps", "voxel_fps") or not sampling.enabled:
            near = _coordinates(near, lens, keys)
        if not sampling.enabled:
            chosen = near
        elif self._random:
            ordered = near.withColumn("_draw", random_key(keys, self.seed))
            chosen = select_points(ordered, keys, sampling, self.stages.frame_bound, drawn="_draw")
        else:
            chosen = select_points(near, keys, sampling, self.stages.frame_bound)
        if sampling.enabled and sampling.mode not in ("fps", "voxel_fps"):
            chosen = _coordinates(chosen, lens, keys)
        if self.cfg.pointcloud.use_rgb:
            chosen = self._colored(chosen)
        if not sampling.enabled:
            return chosen.select(*keys, "idx", *"xyz", *(COLOR if self.cfg.pointcloud.use_rgb else ()))
        frames = require_unique(self.stages.lenses.select(*keys), keys)
        return pad(chosen, frames, keys, sampling.num_points, sampling.pad_mode, unique=True)

    def _colored(self, chosen: DataFrame) -> DataFrame:
        """Colours of chosen points: one row of points a frame meets one packed image."""
        names = [c for c in chosen.columns if c not in self.keys]
        packed = chosen.groupBy(*self.keys).agg(F.collect_list(F.struct(*names)).alias("_points"))
        points = self.stages.images.join(packed.hint("shuffle_hash"), self.keys).select("*", F.inline("_points")).drop("_points")
        return with_color(points).select(*self.keys, *names, *COLOR)


def _coordinates(points: DataFrame, lens: DataFrame, keys: list[str]) -> DataFrame:
    """x and y of points that hold their pixel position and z, as deprojection gives them."""
    u, v = to32(F.col("idx") % F.col("k_width")), to32(F.expr("idx div k_width"))
    placed = points.join(lens.hint("shuffle_hash"), keys).withColumns(
        {
            "x": div32((u - F.col("cx")) * F.col("z"), F.col("fx")),
            "y": div32((v - F.col("cy")) * F.col("z"), F.col("fy")),
        }
    )
    others = [c for c in points.columns if c not in (*keys, "z")]
    return placed.select(*keys, *others, *"xyz")
