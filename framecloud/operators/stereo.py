"""Infrared input checks, pluggable disparity backends and stereo depth."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framecloud.config import StereoConfig
from framecloud.functions.numeric import count_where, div32, f32, safe_ratio
from framecloud.operators.geometry import disparity_columns, explode_pixels

# Channel statistics of the 0..255 network input.
IMAGENET_MEAN_0_255 = (123.675, 116.28, 103.53)
IMAGENET_STD_0_255 = (58.395, 57.12, 57.375)

Disparity = Callable[[np.ndarray, np.ndarray], np.ndarray]
_BACKENDS: dict[str, Callable[[], Disparity]] = {}


def ir_problems(image: Column, channels: Column, height: Column, width: Column) -> Column:
    """Reasons why a packed infrared image is not a raw 0..255 image; empty when it is."""
    bad_channels = ~F.coalesce(channels, F.lit(0)).isin(1, 3)
    bad_size = F.size(image) != height * width * channels
    not_finite = ~F.forall(image, lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    out_of_range = F.exists(image, lambda c: (c < f32(0)) | (c > f32(255)))
    rules = {
        "missing": image.isNull(),
        "channels": bad_channels,
        "shape": bad_size,
        "not_finite": not_finite,
        "range": out_of_range,
    }
    return F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])
    )


def ir_report(frames: DataFrame, keys: Sequence[str], image: str, channels: Column) -> DataFrame:
    """Audit form: one row per frame with the verdict and its reasons."""
    reasons = ir_problems(F.col(image), channels, F.col("height"), F.col("width"))
    return frames.select(*keys, reasons.alias("reasons")).withColumn(
        "ir_ok", F.size("reasons") == 0
    )


def require_ir(frames: DataFrame, image: str, channels: Column) -> DataFrame:
    """Strict form: the first bad image fails the job."""
    reasons = ir_problems(F.col(image), channels, F.col("height"), F.col("width"))
    message = F.concat(F.lit(f"{image} is not a raw image: "), F.array_join(reasons, ", "))
    return frames.withColumn(
        image,
        F.when(F.size(reasons) > 0, F.raise_error(message).cast("array<float>")).otherwise(
            F.col(image)
        ),
    )


def ir_planes(
    frames: DataFrame, keys: Sequence[str], image: str, channels: Column
) -> DataFrame:
    """Three-channel planar form of an infrared image, grey replicated.

    Rows (channel, i, value); the image stays packed and is read by position.
    """
    grid = (
        frames.withColumn("_c", channels)
        .select(
            *keys,
            image,
            "_c",
            F.explode(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1)).alias("i"),
        )
        .select(*keys, image, "_c", "i", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("channel"))
    )
    source = F.when(F.col("_c") == 1, F.lit(0)).otherwise(F.col("channel"))
    value = F.get(F.col(image), F.col("i") * F.col("_c") + source)
    return grid.select(*keys, "channel", "i", value.alias("value"))


def _by_channel(values: Sequence[float]) -> Column:
    c = F.col("channel")
    return F.when(c == 0, f32(values[0])).when(c == 1, f32(values[1])).otherwise(f32(values[2]))


def imagenet_normalize(planes: DataFrame) -> DataFrame:
    mean, std = _by_channel(IMAGENET_MEAN_0_255), _by_channel(IMAGENET_STD_0_255)
    return planes.withColumn("value", div32(F.col("value") - mean, std))


def register_backend(name: str, factory: Callable[[], Disparity]) -> None:
    """Add a disparity backend.

    ``factory`` runs once per Python task and returns a function of two
    3 x H x W float32 arrays (left, right) giving an H x W disparity.
    """
    _BACKENDS[name] = factory


def backend_factory(name: str) -> Callable[[], Disparity]:
    if name not in _BACKENDS:
        raise ValueError(f"unknown disparity backend {name!r}; known: {sorted(_BACKENDS)}")
    return _BACKENDS[name]


def full_resolution(output: np.ndarray, height: int, width: int) -> np.ndarray:
    """Backend output as one flat float32 image; leading axes of length 1 are dropped."""
    output = np.asarray(output)
    while output.ndim > 2 and output.shape[0] == 1:
        output = output[0]
    if output.shape != (height, width):
        raise ValueError(f"backend disparity {output.shape} is not {(height, width)}")
    return output.astype(np.float32).ravel()


def _image(flat: np.ndarray, height: int, width: int) -> np.ndarray:
    image = np.asarray(flat, dtype=np.float32).reshape(height, width, -1)
    return np.repeat(image, 3, axis=2).transpose(2, 0, 1) if image.shape[2] == 1 else (
        image.transpose(2, 0, 1)
    )


def infer_disparity(
    frames: DataFrame, backend: str, left: str = "left_ir", right: str = "right_ir"
) -> DataFrame:
    """Add ``disparity`` computed by a registered backend.

    Only the two images cross to Python; the other frame columns stay in the JVM.
    """
    factory = backend_factory(backend)

    @F.pandas_udf("array<float>")
    def infer(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        model = factory()
        for lefts, rights, heights, widths in parts:
            rows = []
            for a, b, h, w in zip(lefts, rights, heights, widths, strict=True):
                h, w = int(h), int(w)
                rows.append(full_resolution(model(_image(a, h, w), _image(b, h, w)), h, w))
            yield pd.Series(rows)

    # Nondeterministic, so that no later filter on the result runs the model again.
    infer = infer.asNondeterministic()
    checked = frames
    for image in (left, right):
        channels = F.floor(F.size(image) / (F.col("height") * F.col("width"))).cast("int")
        checked = require_ir(checked, image, channels)
    return checked.withColumn("disparity", infer(left, right, "height", "width"))


def disparity_pixels(
    frames: DataFrame,
    keys: Sequence[str],
    cfg: StereoConfig,
    fx_baseline: Column,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Exploded disparity with metric depth and all validity rules per pixel."""
    with_fb = frames.withColumn("_fb", fx_baseline.cast("float"))
    px = explode_pixels(
        with_fb, keys, "disparity", "disparity", F.col("width"), carry=("_fb", *carry)
    )
    rules = disparity_columns(
        F.col("disparity"),
        F.col("u"),
        F.col("_fb"),
        epsilon=cfg.min_disparity_px,
        min_depth=cfg.min_depth_m,
        max_depth=cfg.max_depth_m,
        remove_invisible=cfg.remove_invisible,
    )
    return px.withColumns(rules).drop("_fb")


def disparity_reasons(pixels: DataFrame, keys: Sequence[str], cfg: StereoConfig) -> DataFrame:
    """Validity counts per frame; the counters overlap by definition."""
    invisible = F.col("invisible") & F.lit(cfg.remove_invisible)
    return pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        count_where(F.col("valid")).alias("valid"),
        count_where(~F.col("valid")).alias("invalid"),
        count_where(F.col("non_finite")).alias("non_finite"),
        count_where(F.col("non_positive")).alias("non_positive_or_epsilon"),
        count_where(invisible).alias("invisible_right_coordinate"),
        count_where(F.col("below_min")).alias("below_min_depth"),
        count_where(F.col("above_max")).alias("above_max_depth"),
    )


def finite_positive_ratio(pixels: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    c = F.col(value)
    good = ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))) & (c > 0)
    return pixels.groupBy(*keys).agg(
        safe_ratio(count_where(good), F.count(F.lit(1))).alias("finite_positive_ratio")
    )


def z_range_invalid(depth_m: Column, cfg: StereoConfig) -> Column:
    """Depth outside the configured range, read after invalid depth became zero.

    So it never sees depth above the maximum, and holds for every zeroed pixel
    once a minimum is set.
    """
    finite = ~F.isnan(depth_m) & (F.abs(depth_m) < F.lit(float("inf")))
    low = depth_m < f32(cfg.min_depth_m)
    high = depth_m > f32(cfg.max_depth_m) if cfg.max_depth_m is not None else F.lit(False)
    return finite & (low | high)


def mask_layers(pixels: DataFrame, keys: Sequence[str], cfg: StereoConfig) -> DataFrame:
    return pixels.select(
        *keys,
        "i",
        (~F.col("positive")).alias("invalid_disparity"),
        F.col("invisible").alias("remove_invisible"),
        z_range_invalid(F.col("depth_m"), cfg).alias("z_range_invalid"),
    )


def stage_breakdown(
    pixels: DataFrame, meta: DataFrame, keys: Sequence[str], cfg: StereoConfig
) -> DataFrame:
    """Pixels lost to the model, to geometry, to the crop and to sampling, per frame.

    ``pixels`` is exploded disparity, ``meta`` the metadata of the same frames.
    Unlike the validity counts, invisible pixels are counted even when they are kept.
    """
    layers = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("image_pixel_count"),
        count_where(~F.col("positive")).alias("invalid_disparity_count"),
        count_where(F.col("invisible")).alias("remove_invisible_count"),
        count_where(z_range_invalid(F.col("depth_m"), cfg)).alias("z_range_invalid_count"),
        count_where(F.col("valid")).alias("final_valid_disparity_count"),
        count_where(~F.col("valid")).alias("final_invalid_disparity_count"),
    )
    return breakdown_row(layers, meta, keys)


def breakdown_row(layers: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixel layers of each frame next to what its metadata counts."""
    raw, cropped, sampled = (
        F.col(f"num_{s}_points") for s in ("raw", "cropped", "sampled")
    )
    counts = meta.select(
        *keys, "num_raw_points", "num_cropped_points", "num_sampled_points", "padded"
    )
    return layers.join(counts, list(keys)).select(
        *keys,
        *layers.columns[len(keys):],
        raw.alias("deprojection_input_points"),
        (F.col("image_pixel_count") - raw).alias("deprojection_removed_points"),
        cropped.alias("crop_output_points"),
        (raw - cropped).alias("crop_removed_points"),
        sampled.alias("sampling_output_points"),
        (cropped - sampled).alias("sampling_removed_or_padded_points"),
        F.col("padded").alias("sampling_padded"),
    )
