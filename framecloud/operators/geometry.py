"""Camera lookup, pixel grid, deprojection and disparity to depth."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framecloud.functions.joins import checked_broadcast
from framecloud.functions.numeric import all_of, div32, f32, is_finite, non_zero, sum32, to32
from framecloud.operators.checks import enforce

LENS = ("scale", "fx", "fy", "cx", "cy")


def camera_known() -> Column:
    """Whether a frame found its camera row."""
    return F.col("depth_scale").isNotNull()


def attach_cameras(
    frames: DataFrame,
    cameras: DataFrame,
    checked: bool = False,
    rules: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Join the camera row to each frame; a frame of an unknown camera is an error.

    ``checked`` says that the caller already decided about broadcasting. ``rules``
    are enforced on the joined rows instead of the one about the camera. They are
    a filter, so they hold whichever columns are read afterwards.
    """
    side = cameras if checked else checked_broadcast(cameras)
    joined = frames.join(side, "camera", "left")
    name = F.coalesce(F.col("camera").cast("string"), F.lit("null"))
    return enforce(joined, rules or {"unknown camera": camera_known()}, F.concat(F.lit("camera "), name))


def active_intrinsics() -> Column:
    """Colour intrinsics where depth is aligned to colour, else depth intrinsics."""
    return F.when(F.col("aligned"), F.col("color_k")).otherwise(F.col("depth_k"))


def resolve_depth(frames: DataFrame, stereo: Column) -> DataFrame:
    """Choose depth, scale and intrinsics together, row by row.

    Where ``stereo`` holds the raster is metric stereo depth (``stereo_depth``)
    at scale 1 in the left infrared frame, which the depth intrinsics describe.
    """
    pick = lambda a, b: F.when(stereo, a).otherwise(b)
    k = pick(F.col("depth_k"), active_intrinsics())
    return frames.withColumns(
        {
            "raster": pick(F.col("stereo_depth"), F.col("depth")),
            "effective_scale": pick(F.lit(1.0), F.col("depth_scale")),
            "k": k,
            "intrinsics": pick(
                F.lit("ir1"), F.when(F.col("aligned"), "color").otherwise("depth")
            ),
        }
    )


def lens_columns(k: str = "k", scale: str = "depth_scale") -> list[Column]:
    """The five float32 scalars a pixel needs from its camera.

    A focal length of zero becomes null, which leaves no valid point.
    """
    focal = [non_zero(to32(F.col(f"{k}.{n}"))).alias(n) for n in ("fx", "fy")]
    center = [to32(F.col(f"{k}.{n}")).alias(n) for n in ("cx", "cy")]
    return [to32(F.col(scale)).alias("scale"), *focal, *center]


def check_shape(frames: DataFrame, array: str, height: Column, width: Column) -> DataFrame:
    """Strict image shape check: a null image, or one of another size, fails the job."""
    fits = F.coalesce(F.size(array) == height * width, F.lit(False))
    found = F.concat(F.lit(f"{array} size "), F.size(array), F.lit(" does not match the camera"))
    message = F.coalesce(found, F.lit(f"{array} image is missing"))
    return frames.withColumn(
        array,
        F.when(fits, F.col(array)).otherwise(F.raise_error(message).cast("array<float>")),
    )


def shape_report(
    frames: DataFrame, keys: Sequence[str], array: str, height: Column, width: Column
) -> DataFrame:
    """Audit form of the shape check: one row per frame with the verdict."""
    size = F.coalesce(F.size(array), F.lit(-1))
    return frames.select(
        *keys,
        size.alias("found_pixels"),
        (height * width).alias("expected_pixels"),
        F.coalesce(size == height * width, F.lit(False)).alias("shape_ok"),
    )


def explode_pixels(
    frames: DataFrame,
    keys: Sequence[str],
    array: str,
    value: str,
    width: Column,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per pixel in row-major order with its column ``u`` and row ``v``."""
    flat = frames.withColumn("_w", width).select(
        *keys, *carry, "_w", F.posexplode(array).alias("i", value)
    )
    return flat.withColumns(
        {"u": F.col("i") % F.col("_w"), "v": F.expr("cast(i div _w as int)")}
    ).drop("_w")


def deproject(pixels: DataFrame, depth: str = "depth", drop: Sequence[str] = LENS) -> DataFrame:
    """Camera-frame coordinates of each pixel plus its validity."""
    z = F.col(depth) * F.col("scale")
    u, v = to32(F.col("u")), to32(F.col("v"))
    located = pixels.withColumn("z", z).withColumns(
        {
            "x": div32((u - F.col("cx")) * F.col("z"), F.col("fx")),
            "y": div32((v - F.col("cy")) * F.col("z"), F.col("fy")),
        }
    )
    infinity = f32(math.inf)
    inside = [F.abs("x") < infinity, F.abs("y") < infinity, F.col("z") > f32(0), F.col("z") < infinity]
    return located.withColumn("valid", F.coalesce(all_of(inside), F.lit(False))).drop(*drop)


def valid_points(pixels: DataFrame) -> DataFrame:
    """Raw cloud: valid pixels only, ``idx`` is the pixel position."""
    return pixels.where("valid").withColumnRenamed("i", "idx").drop("u", "v", "valid")


def disparity_columns(
    disparity: Column,
    u: Column,
    fx_baseline: Column,
    epsilon: float = 1e-3,
    min_depth: float = 0.0,
    max_depth: float | None = None,
    remove_invisible: bool = True,
) -> dict[str, Column]:
    """Metric depth of a disparity pixel and every rule it meets.

    Rules overlap: a negative disparity is both non-positive and below the
    minimum depth. Invalid depth is exactly zero.
    """
    if not (epsilon > 0.0 and min_depth >= 0.0 and (max_depth is None or max_depth > 0.0)):
        raise ValueError("epsilon and max_depth must be positive, min_depth non-negative")
    d = disparity
    finite = is_finite(d)
    positive = finite & (d > f32(epsilon))
    raw = F.coalesce(div32(to32(fx_baseline), non_zero(d)), f32(math.inf))
    raw_finite = is_finite(raw)
    invisible = positive & ((to32(u) - d) < f32(0))
    below = raw_finite & (raw < f32(min_depth))
    above = raw_finite & (raw > f32(max_depth)) if max_depth is not None else F.lit(False)
    valid = positive & raw_finite & ~below & ~above
    if remove_invisible:
        valid = valid & ~invisible
    return {
        "depth_m": F.when(valid, raw).otherwise(f32(0)),
        "valid": valid,
        "non_finite": ~finite,
        "non_positive": finite & (d <= f32(epsilon)),
        "positive": positive,
        "invisible": invisible,
        "below_min": below,
        "above_max": above,
    }


def rigid_transform(names: Sequence[str] = ("x", "y", "z")) -> list[Column]:
    """R p + t in float32 from the scalar columns r0..r8 (row-major) and t0..t2."""
    out = []
    for row in range(3):
        terms = [F.col(f"r{3 * row + j}") * F.col(names[j]) for j in range(3)]
        out.append(sum32(terms) + F.col(f"t{row}"))
    return out


def project_to_pixel(
    x: Column, y: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column
) -> dict[str, Column]:
    """Nearest pixel (half to even) of a camera-frame point as ``pu`` and ``pv``.

    Null for a point that is not in front of the camera or not finite.
    """
    ahead = is_finite(x) & is_finite(y) & (z > f32(0)) & (z < f32(math.inf))
    depth = F.when(ahead, z)
    return {
        "pu": F.rint(div32(x * fx, depth) + cx),
        "pv": F.rint(div32(y * fy, depth) + cy),
    }
