"""Frames to fixed-size clouds: one function for batch tables and micro-batches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framecloud.config import BuildConfig, StereoConfig
from framecloud.functions.joins import BROADCAST_ROWS
from framecloud.functions.numeric import all_of
from framecloud.operators.color import (
    CARRY,
    COLOR,
    POSE,
    black_where_missing,
    color_camera_columns,
    color_position,
    divisor,
    read_colors,
)
from framecloud.operators.checks import audit, require_keys, require_unique
from framecloud.operators.color import LENS as COLOR_LENS
from framecloud.operators.crop import crop
from framecloud.operators.geometry import (
    LENS,
    active_intrinsics,
    attach_cameras,
    camera_known,
    deproject,
    disparity_columns,
    explode_pixels,
    lens_columns,
    valid_points,
)
from framecloud.operators.metadata import frame_meta, stage_counts
from framecloud.operators.sampling import sample_points
from framecloud.operators.stereo import backend_factory, disparity_reasons, infer_disparity
from framecloud.schema import KEYS

_RGB_CARRY = (*CARRY, *COLOR_LENS, *POSE, "aligned", "mapped")


class Stages:
    """Results of one build; each is planned when it is first asked for.

    Packed frames are partitioned by frame once, before they are exploded. The
    voxel aggregate, the ranking and the padding join all reuse that layout, so
    exploded points are never shuffled.
    """

    def __init__(
        self,
        frames: DataFrame,
        cameras: DataFrame,
        cfg: BuildConfig,
        keys: Sequence[str],
        mode: str,
        partitions: int | None,
        by_frame: bool,
    ):
        require_settings(cfg)
        self.cfg, self.keys, self.mode = cfg, list(keys), mode
        self.frames = frames
        self.partitions, self.by_frame = partitions, by_frame
        self.cameras, self.frame_bound = bounded_cameras(cameras)

    @cached_property
    def packed(self) -> DataFrame:
        return prepare(self.frames, self.cameras, self.cfg, self.keys)

    @cached_property
    def _raw(self) -> DataFrame:
        return raw_points(self.packed, self.keys, self.cfg)

    def _laid(self, packed: DataFrame) -> DataFrame:
        """Packed rows laid by frame, for everything that groups by frame.

        The partition number is explicit: adaptive execution would merge
        partitions by their packed size, which says little about the work.
        """
        if self.by_frame:
            return packed
        configured = packed.sparkSession.conf.get("spark.sql.shuffle.partitions")
        return packed.repartition(self.partitions or int(configured), *self.keys)

    @cached_property
    def placed(self) -> DataFrame:
        return self._laid(self.packed)

    @cached_property
    def _by_frame(self) -> DataFrame:
        return raw_points(self.placed, self.keys, self.cfg)

    @cached_property
    def images(self) -> DataFrame:
        """Colour images with what a point needs to find its pixel, by frame."""
        rules = camera_frame_rules(self.cfg, self.keys) | color_rules(self.cfg)
        frames = attach_cameras(self.frames, self.cameras, checked=True, rules=rules)
        return self._laid(_with_image(frames, self.cfg).select(*self.keys, *_image_columns()))

    @cached_property
    def lenses(self) -> DataFrame:
        """Image width and lens of each frame; reads no image."""
        frames = self.frames.select(*dict.fromkeys([*self.keys, "camera"]))
        rules = camera_frame_rules(self.cfg, self.keys)
        joined = attach_cameras(frames, self.cameras, checked=True, rules=rules).withColumn("k", _lens(self.cfg))
        return joined.select(*self.keys, F.col("k.width").alias("k_width"), *lens_columns()[1:])

    @cached_property
    def raw(self) -> DataFrame:
        return self._raw.drop("hit")

    @cached_property
    def cropped(self) -> DataFrame:
        return crop(self.raw, self.cfg.crop)

    @cached_property
    def sampled(self) -> DataFrame:
        cropped = crop(self._by_frame.drop("hit"), self.cfg.crop)
        return sample_points(
            cropped, self.frames, self.keys, self.cfg.sampling, frame_bound=self.frame_bound
        )

    @cached_property
    def meta(self) -> DataFrame:
        return build_meta(self)

    @cached_property
    def pixels(self) -> DataFrame:
        """Disparity, depth and validity per pixel; only a stereo source has them."""
        if self.cfg.depth_mode != "stereo":
            raise ValueError("perception pixels need a stereo depth source")
        return stereo_pixels(self.packed, self.keys, self.cfg.stereo)

    @cached_property
    def stereo_meta(self) -> DataFrame:
        """Disparity validity counts of each frame next to the settings that gave them."""
        return build_stereo_meta(self)


def _mapping(cfg: BuildConfig) -> Column:
    """Colour mapping of a camera: configured, or by its alignment."""
    if cfg.pointcloud.rgb_mapping is not None:
        return F.lit(cfg.pointcloud.rgb_mapping)
    return F.when(F.col("aligned"), "aligned").otherwise("project_depth_to_color")


def require_settings(cfg: BuildConfig) -> None:
    """Refuse stereo settings that no build can follow."""
    if cfg.depth_mode != "stereo":
        return
    if cfg.stereo.rectification_mode == "opencv":
        raise ValueError("rectify infrared images before the build; opencv mode is not done here")
    if cfg.stereo.backend:
        backend_factory(cfg.stereo.backend)


def _baseline(cfg: StereoConfig) -> Column:
    """Baseline of the camera row, else the configured one."""
    configured = F.lit(cfg.baseline_m if cfg.baseline_m > 0 else None).cast("double")
    return F.coalesce(F.col("baseline_m"), configured)


def _lens(cfg: BuildConfig) -> Column:
    return F.col("depth_k") if cfg.depth_mode == "stereo" else active_intrinsics()


def camera_frame_rules(cfg: BuildConfig, keys: Sequence[str]) -> dict[str, Column]:
    """What must hold of a frame joined with its camera row, whatever its images are.

    A rule that presumes another one holds where that one is broken, so a frame is
    reported for its cause alone.
    """
    unknown = ~camera_known()
    rules = {
        "frame key is null": all_of([F.col(k).isNotNull() for k in keys]),
        "unknown camera": ~unknown,
    }
    if cfg.depth_mode == "stereo":
        agree = F.abs(F.col("baseline_m") - F.lit(float(cfg.stereo.baseline_m))) <= F.lit(1e-5)
        unset = F.lit(cfg.stereo.baseline_m <= 0) | F.col("baseline_m").isNull()
        rules |= {
            "stereo depth needs a camera that is not aligned to colour": unknown | ~F.col("aligned"),
            "stereo depth needs a positive baseline": unknown | (_baseline(cfg.stereo) > 0),
            "configured baseline disagrees with the camera": unknown | unset | agree,
        }
    return rules


def _project(cfg: BuildConfig) -> Column:
    return ~F.col("aligned") & (_mapping(cfg) == "project_depth_to_color")


def _with_image(placed: DataFrame, cfg: BuildConfig) -> DataFrame:
    return placed.withColumn("mapped", F.col("aligned") | _project(cfg)).withColumn(
        "rgb_div", divisor(F.col("rgb"))
    )


def _image_columns() -> list:
    return [*CARRY, "aligned", "mapped", *color_camera_columns()]


def _has_pixels(array: str) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))


def image_rules(cfg: BuildConfig) -> dict[str, Column]:
    """What must hold of the images a build reads."""
    array = "disparity" if cfg.depth_mode == "stereo" else "depth"
    unknown, missing = ~camera_known(), ~_has_pixels(array)
    k = _lens(cfg)
    rules = {
        f"{array} image is missing": ~missing,
        f"{array} image does not match the camera": unknown
        | missing
        | (F.size(array) == k["height"] * k["width"]),
    }
    return rules | color_rules(cfg)


def color_rules(cfg: BuildConfig) -> dict[str, Column]:
    """What must hold of the colour image, if the build has colours."""
    if not cfg.pointcloud.use_rgb:
        return {}
    c, unknown = F.col("color_k"), ~camera_known()
    no_rgb, channels = F.col("rgb").isNull(), F.coalesce(F.col("rgb_channels"), F.lit(0))
    return {
        "frame has no colour image": ~no_rgb,
        "colour image needs three channels": no_rgb | (channels >= 3),
        "colour image does not match the colour camera": unknown
        | no_rgb
        | (channels < 3)
        | (F.size("rgb") == c["height"] * c["width"] * channels),
        "colour needs extrinsics": unknown
        | ~_project(cfg)
        | (F.col("r").isNotNull() & F.col("t").isNotNull()),
    }


def reject_report(
    frames: DataFrame, cameras: DataFrame, cfg: BuildConfig, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Audit form of what a build refuses: one row per frame with its broken rules.

    The rows that are ``ok`` are those a build with the same settings accepts; the
    checks a disparity backend makes on its infrared images come on top.
    """
    require_settings(cfg)
    rules = camera_frame_rules(cfg, keys)
    if not (cfg.depth_mode == "stereo" and cfg.stereo.backend):
        rules |= image_rules(cfg)
    side, _ = bounded_cameras(cameras)
    return audit(frames.join(side, "camera", "left"), keys, rules)


def prepare(frames: DataFrame, cameras: DataFrame, cfg: BuildConfig, keys: Sequence[str]):
    """Packed frames with camera scalars, pruned to what the pixel stage reads.

    A frame that breaks a rule fails the job. A disparity backend named in the
    settings runs here, and its result replaces a ``disparity`` column.
    """
    stereo = cfg.depth_mode == "stereo"
    array = "disparity" if stereo else "depth"
    if stereo and cfg.stereo.backend:
        frames = infer_disparity(require_keys(frames, keys), cfg.stereo.backend)
    rules = camera_frame_rules(cfg, keys) | image_rules(cfg)
    placed = attach_cameras(frames, cameras, checked=True, rules=rules)
    # Exploding an array lets the optimizer drop null and empty ones before any filter.
    # One null pixel in their place keeps such a frame until the rules refuse it.
    no_pixel = F.array(F.lit(None).cast("float"))
    image = F.when(_has_pixels(array), F.col(array)).otherwise(no_pixel)
    placed = placed.withColumn(array, image).withColumn("k", _lens(cfg)).withColumn(
        "depth_scale", F.lit(1.0) if stereo else F.col("depth_scale")
    )
    columns: list = [*keys, array, F.col("k.width").alias("k_width"), *lens_columns()]
    if stereo:
        fx_baseline = F.col("k.fx") * _baseline(cfg.stereo)
        columns.append(fx_baseline.cast("float").alias("fx_baseline"))
    if cfg.pointcloud.use_rgb:
        placed = _with_image(placed, cfg)
        columns += _image_columns()
    return placed.select(*columns)


def with_color(points: DataFrame) -> DataFrame:
    """Colour by the camera's own rule: same pixel when aligned, else projected.

    A projected point outside the colour image is black; an unmapped camera
    gives no colour.
    """
    projected = color_position(points)
    placed = projected.withColumn(
        "position", F.when(F.col("aligned"), F.col("idx")).when(F.col("mapped"), F.col("position"))
    ).withColumn("hit", F.col("aligned") | F.col("hit"))
    return black_where_missing(read_colors(placed, "position"), F.col("mapped"))


def stereo_pixels(packed: DataFrame, keys: Sequence[str], cfg: StereoConfig, carry=()):
    px = explode_pixels(
        packed, keys, "disparity", "disparity", F.col("k_width"), carry=("fx_baseline", *carry)
    )
    rules = disparity_columns(
        F.col("disparity"),
        F.col("u"),
        F.col("fx_baseline"),
        epsilon=cfg.min_disparity_px,
        min_depth=cfg.min_depth_m,
        max_depth=cfg.max_depth_m,
        remove_invisible=cfg.remove_invisible,
    )
    return px.withColumns(rules).drop("fx_baseline")


def raw_points(packed: DataFrame, keys: Sequence[str], cfg: BuildConfig) -> DataFrame:
    """Valid camera-frame points of each frame; ``idx`` is the pixel position."""
    carry = [*LENS, *(_RGB_CARRY if cfg.pointcloud.use_rgb else ())]
    if cfg.depth_mode == "stereo":
        px = stereo_pixels(packed, keys, cfg.stereo, carry)
        px = px.select(*keys, "i", "u", "v", F.col("depth_m").alias("depth"), *carry)
    else:
        px = explode_pixels(packed, keys, "depth", "depth", F.col("k_width"), carry)
    points = valid_points(deproject(px))
    if cfg.pointcloud.use_rgb:
        points = with_color(points)
        return points.select(*keys, "idx", *"xyz", *COLOR, "hit")
    return points.select(*keys, "idx", *"xyz")


def bounded_cameras(cameras: DataFrame) -> tuple[DataFrame, int]:
    """Cameras, hinted for broadcast if few, and the most pixels any of them delivers.

    The shape check makes the pixel bound hold for every frame.
    """
    area = [F.col(f"{k}.width") * F.col(f"{k}.height") for k in ("color_k", "depth_k")]
    seen = cameras.agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(*area)).alias("area")).first()
    side = F.broadcast(cameras) if seen["n"] <= BROADCAST_ROWS else cameras
    return side, int(seen["area"] or 0)


def build_meta(stages: Stages, counts: DataFrame | None = None) -> DataFrame:
    """Metadata of every frame, with colour counts when colour is on.

    ``counts`` are those of ``stage_counts`` where they are known already.
    """
    cfg, keys = stages.cfg, stages.keys
    if counts is None:
        counts = stage_counts(stages._by_frame, keys, cfg.crop, cfg.sampling)
    named = dict.fromkeys([*keys, "camera", "ts"])
    frames = stages.frames.select(*named)
    rules = camera_frame_rules(cfg, keys)
    described = attach_cameras(frames, stages.cameras, checked=True, rules=rules).select(
        *keys,
        F.col("ts").alias("timestamp"),
        F.col("aligned").alias("aligned_depth_to_color"),
        _mapping(cfg).alias("rgb_mapping"),
        F.when(F.lit(cfg.depth_mode == "stereo"), "ir1")
        .when(F.col("aligned"), "color")
        .otherwise("depth")
        .alias("intrinsics"),
    )
    mapped = F.col("aligned_depth_to_color") | (F.col("rgb_mapping") == "project_depth_to_color")
    use_rgb = mapped if cfg.pointcloud.use_rgb else F.lit(False)
    meta = frame_meta(described, counts, keys, cfg.crop, cfg.sampling, stages.mode, use_rgb)
    if not cfg.pointcloud.use_rgb:
        return meta
    misses = F.col("num_raw_points") - F.col("valid_projection_count")
    return meta.withColumns(
        {
            "invalid_projection_count": F.when(use_rgb, misses),
            "rgb_reason": F.when(~use_rgb, "raw_depth_rgb_mapping_not_configured"),
        }
    )


def build_stereo_meta(stages: Stages) -> DataFrame:
    return describe_stereo(stages, disparity_reasons(stages.pixels, stages.keys, stages.cfg.stereo))


def describe_stereo(stages: Stages, counts: DataFrame) -> DataFrame:
    """Validity counts of each frame next to the settings that gave them."""
    cfg, keys = stages.cfg.stereo, stages.keys
    rules = camera_frame_rules(stages.cfg, keys)
    frames = stages.frames.select(*dict.fromkeys([*keys, "camera"]))
    described = attach_cameras(frames, stages.cameras, checked=True, rules=rules).select(
        *keys, F.col("depth_k.fx").alias("fx_px"), _baseline(cfg).alias("baseline_m")
    )
    settings = {
        "depth_source": F.lit("stereo"),
        "unit": F.lit("meter"),
        "effective_depth_scale": F.lit(1.0),
        "backend": F.lit(cfg.backend or "recorded"),
        "max_disp": F.lit(cfg.max_disp),
        "valid_iters": F.lit(cfg.valid_iters),
        "precision": F.lit(cfg.precision),
        "min_disparity_px": F.lit(cfg.min_disparity_px),
        "min_depth_m": F.lit(cfg.min_depth_m),
        "max_depth_m": F.lit(cfg.max_depth_m).cast("double"),
        "remove_invisible": F.lit(cfg.remove_invisible),
    }
    return require_unique(described, keys).join(counts, keys, "left").withColumns(settings)


def build(
    frames: DataFrame,
    cameras: DataFrame,
    cfg: BuildConfig,
    keys: Sequence[str] = KEYS,
    mode: str = "recorded",
    partitions: int | None = None,
    by_frame: bool = False,
) -> Stages:
    """Raw, cropped and sampled clouds plus metadata of every frame.

    ``keys`` name one frame and must be unique in ``frames``. A frame with a null
    key or image, an unknown camera or an image of another size fails the job;
    ``reject_report`` names such frames beforehand. A stereo source takes the
    backend its settings name, which runs in each output that needs disparity: to
    run it once for many outputs, write the frames of ``infer_disparity`` and build
    from them with no backend named. ``partitions``
    sets how many partitions packed frames are shuffled into, by default the
    session's shuffle partitions; aim at some 100 MB of packed frames each. ``by_frame`` says that ``frames`` is already hash
    partitioned by ``keys``, as a table bucketed by them is: nothing is shuffled
    then.
    """
    return Stages(frames, cameras, cfg, keys, mode, partitions, by_frame)
