"""Raster to 8 bit, padding, resizing and other per-pixel raster work.

Rasters stay packed. An operator that reads source pixels by computed position
explodes the *target* grid and looks the source up in the same stage, so no
resampling needs a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framecloud.functions.numeric import div32, f32, non_zero, to32

INF = float("inf")


def _finite_values(image: Column) -> Column:
    return F.filter(image, lambda c: ~F.isnan(c) & (F.abs(c) < F.lit(INF)))


def _interpolated(ordered: Column, q: float) -> Column:
    at = (F.size(ordered) - 1).cast("double") * F.lit(q)
    low = F.get(ordered, F.floor(at).cast("int")).cast("double")
    high = F.get(ordered, F.ceil(at).cast("int")).cast("double")
    return low + (high - low) * (at - F.floor(at))


def contrast_stretch(frames: DataFrame, keys: Sequence[str], image: str) -> DataFrame:
    """8-bit pixels between the 1st and 99th percentile of the image's finite values.

    A frame is one image, so its percentiles come from its own sorted array
    without a shuffle. Values that are not finite give 0.
    """
    low, high = F.col("_lo"), F.col("_hi")
    ranged = (
        frames.withColumn("_s", F.array_sort(_finite_values(F.col(image))))
        .withColumns({"_lo": _interpolated(F.col("_s"), 0.01), "_hi": _interpolated(F.col("_s"), 0.99)})
        .withColumn("_hi", F.when(high <= low, low + 1.0).otherwise(high))
        .select(*keys, "_lo", "_hi", F.posexplode(image).alias("i", "c"))
    )
    c = F.col("c").cast("double")
    scaled = F.least(F.greatest((c - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    finite = ~F.isnan(c) & (F.abs(c) < F.lit(INF))
    byte = F.when(finite, F.floor(scaled * 255.0)).otherwise(0).cast("int")
    return ranged.select(*keys, "i", byte.alias("byte"))


def _byte(c: Column) -> Column:
    clipped = F.least(F.greatest(c, f32(0)), f32(255))
    return F.when(F.isnan(c), 0).otherwise(F.floor(clipped)).cast("int")


def color_to_bytes(frames: DataFrame, keys: Sequence[str], rgb: str, channels: Column) -> DataFrame:
    """First three channels to 8 bit; images within 0..1 are scaled by 255 first."""
    wide = frames.withColumn("_c", channels)
    kept = F.transform(
        F.col(rgb), lambda c, p: F.when((p % F.col("_c")) < 3, c).otherwise(f32(-INF))
    )
    top = F.array_max(F.array_remove(kept, F.lit(float("nan")).cast("float")))
    flat = wide.withColumn("_m", F.when(top <= f32(1), f32(255)).otherwise(f32(1))).select(
        *keys, "_c", "_m", F.posexplode(rgb).alias("p", "c")
    )
    return flat.where(F.col("p") % F.col("_c") < 3).select(
        *keys,
        F.expr("cast(p div _c as int)").alias("i"),
        (F.col("p") % F.col("_c")).alias("channel"),
        _byte(F.col("c") * F.col("_m")).alias("byte"),
    )


def mask_to_bytes(mask: Column) -> Column:
    return F.when(mask > 0, 255).otherwise(0)


def target_grid(
    frames: DataFrame, keys: Sequence[str], height: int, width: int, carry: Sequence[str]
) -> DataFrame:
    """One row per target pixel with its column ``u`` and row ``v``."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(height * width - 1))).alias("i")
    return frames.select(*keys, *carry, cells).withColumns(
        {"u": F.col("i") % width, "v": F.expr(f"cast(i div {width} as int)")}
    )


def planar_pad(
    frames: DataFrame, keys: Sequence[str], rgb: str, src: tuple[int, int], dst: tuple[int, int]
) -> DataFrame:
    """Interleaved 3-channel image to planar rows, channels reversed, zero outside."""
    (sh, sw), (dh, dw) = src, dst
    grid = target_grid(frames, keys, dh, dw, [rgb]).select(
        *keys, rgb, "i", "u", "v", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("channel")
    )
    at = (F.col("v") * sw + F.col("u")) * 3 + (2 - F.col("channel"))
    inside = (F.col("u") < sw) & (F.col("v") < sh)
    value = F.when(inside, F.get(F.col(rgb), at)).otherwise(f32(0))
    return grid.select(*keys, "channel", "i", value.alias("value"))


def _source_position(cell: Column, src: int, dst: int) -> Column:
    """Half-pixel-centre source coordinate of a target cell, in float32."""
    step = div32(f32(src), dst)
    return (to32(cell) + f32(0.5)) * step - f32(0.5)


def _clip(c: Column, size: int) -> Column:
    return F.greatest(F.lit(0), F.least(c.cast("int"), F.lit(size - 1)))


def resize_pad(
    frames: DataFrame,
    keys: Sequence[str],
    rgb: str,
    src: tuple[int, int],
    scaled: tuple[int, int],
    dst: tuple[int, int],
) -> DataFrame:
    """Bilinear resize to ``scaled``, edge-replicated up to ``dst``, channels reversed."""
    (sh, sw), (ch, cw), (dh, dw) = src, scaled, dst
    grid = target_grid(frames, keys, dh, dw, [rgb])
    fx = _source_position(F.least(F.col("u"), F.lit(cw - 1)), sw, cw)
    fy = _source_position(F.least(F.col("v"), F.lit(ch - 1)), sh, ch)
    placed = grid.withColumns({"_fx": fx, "_fy": fy}).withColumns(
        {
            "_x0": _clip(F.floor("_fx"), sw),
            "_y0": _clip(F.floor("_fy"), sh),
            "_wx": F.col("_fx") - to32(F.floor("_fx")),
            "_wy": F.col("_fy") - to32(F.floor("_fy")),
        }
    )
    corners = placed.withColumns(
        {
            "_x1": F.least(F.col("_x0") + 1, F.lit(sw - 1)),
            "_y1": F.least(F.col("_y0") + 1, F.lit(sh - 1)),
        }
    ).withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(2))))

    def at(y: str, x: str) -> Column:
        return F.get(F.col(rgb), (F.col(y) * sw + F.col(x)) * 3 + (2 - F.col("channel")))

    wx, wy, one = F.col("_wx"), F.col("_wy"), f32(1)
    top = (one - wx) * at("_y0", "_x0") + wx * at("_y0", "_x1")
    bottom = (one - wx) * at("_y1", "_x0") + wx * at("_y1", "_x1")
    value = (one - wy) * top + wy * bottom
    return corners.select(*keys, "channel", "i", value.alias("value"))


def crop_raster(
    frames: DataFrame, keys: Sequence[str], array: str, src_width: int, dst: tuple[int, int]
) -> DataFrame:
    """Top-left ``dst`` region of a raster, re-indexed."""
    grid = target_grid(frames, keys, dst[0], dst[1], [array])
    at = F.col("v") * src_width + F.col("u")
    return grid.select(*keys, "i", F.get(F.col(array), at).alias("value"))


def upsample(
    frames: DataFrame,
    keys: Sequence[str],
    array: str,
    src: tuple[int, int],
    dst: tuple[int, int],
    scale: float,
) -> DataFrame:
    """Nearest-neighbour resize (half to even) with values multiplied by ``scale``."""
    (sh, sw), (dh, dw) = src, dst
    x = _clip(F.rint(_source_position(F.col("u"), sw, dw)), sw)
    y = _clip(F.rint(_source_position(F.col("v"), sh, dh)), sh)
    grid = target_grid(frames, keys, dh, dw, [array])
    return grid.select(*keys, "i", (F.get(F.col(array), y * sw + x) * f32(scale)).alias("value"))


def clamp_min(c: Column, minimum: float) -> Column:
    """Larger of value and bound; NaN becomes the bound."""
    return F.when(F.isnan(c), f32(minimum)).otherwise(F.greatest(c, f32(minimum)))


def plain_depth(disparity: Column, u: Column, fx_baseline: Column) -> Column:
    """Depth without range rules: invisible pixels give 0, zero disparity infinity."""
    d = disparity
    invisible = (to32(u) - d) < f32(0)
    return (
        F.when(invisible, f32(0))
        .otherwise(F.coalesce(div32(to32(fx_baseline), non_zero(d)), f32(math.inf)))
    )
