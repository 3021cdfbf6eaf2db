"""Disparity to depth, validity accounting, infrared checks, backends, volumes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framecloud.catalog import views
from framecloud.catalog.registry import query
from framecloud.config import StereoConfig
from framecloud.operators import stereo as st
from framecloud.operators.raster import clamp_min, plain_depth
from framecloud.operators.volume import concat_volume, correlation_volume
from framecloud.schema import KEYS

RULES = StereoConfig(min_disparity_px=0.001, min_depth_m=1.2, max_depth_m=4.0)
FX_BASELINE = 5.0

DISP = """d0 as (
  select cast(label as varchar) as camera, vec_id as frame_id,
    unnest(range(len(embedding)))::int as i, unnest(embedding) * 20.0::float as d from embeddings),
d1 as (select *, (i % 8)::float as u,
    case when d = 0 then 'inf'::float else 5.0::float / d end as z,
    isfinite(d) and d > 0.001::float as positive from d0),
d2 as (select *, positive and (u - d) < 0 as invisible,
    isfinite(z) and z < 1.2::float as below_min, isfinite(z) and z > 4.0::float as above_max from d1),
d3 as (select *, positive and isfinite(z) and not below_min and not above_max and not invisible
    as valid from d2),
disp as (select *, case when valid then z else 0.0::float end as depth_m from d3)"""


def pixels(spark, sf_dir):
    frames = views.frames(spark, sf_dir).select(*KEYS, "disparity", "width")
    return st.disparity_pixels(frames, KEYS, RULES, F.lit(FX_BASELINE))


@query("disparity_depth", f"with {DISP} select camera, frame_id, i, depth_m, valid from disp")
def disparity_depth(spark, sf_dir):
    return pixels(spark, sf_dir).select(*KEYS, "i", "depth_m", "valid")


@query(
    "disparity_reasons",
    f"""with {DISP} select camera, frame_id, count(*) as total, count(*) filter (valid) as valid,
      count(*) filter (not valid) as invalid, count(*) filter (not isfinite(d)) as non_finite,
      count(*) filter (isfinite(d) and d <= 0.001::float) as non_positive_or_epsilon,
      count(*) filter (invisible) as invisible_right_coordinate,
      count(*) filter (below_min) as below_min_depth,
      count(*) filter (above_max) as above_max_depth from disp group by camera, frame_id""",
)
def disparity_reasons(spark, sf_dir):
    return st.disparity_reasons(pixels(spark, sf_dir), KEYS, RULES)


@query(
    "disparity_masks",
    f"""with {DISP} select camera, frame_id, i, not positive as invalid_disparity,
      invisible as remove_invisible,
      isfinite(depth_m) and (depth_m < 1.2::float or depth_m > 4.0::float) as z_range_invalid
    from disp""",
)
def disparity_masks(spark, sf_dir):
    return st.mask_layers(pixels(spark, sf_dir), KEYS, RULES)


@query(
    "finite_positive_ratio",
    f"""with {DISP} select camera, frame_id,
      round(count(*) filter (isfinite(d) and d > 0) / count(*)::double, 6) as finite_positive_ratio
    from disp group by camera, frame_id""",
)
def finite_positive_ratio(spark, sf_dir):
    ratio = st.finite_positive_ratio(pixels(spark, sf_dir), KEYS, "disparity")
    return ratio.select(*KEYS, F.round("finite_positive_ratio", 6).alias("finite_positive_ratio"))


@query(
    "ir_validate",
    """select cast(label as varchar) as camera, vec_id as frame_id,
      concat_ws(',', case when list_max(embedding) > 0.4::float then 'range' end) as reasons,
      not list_max(embedding) > 0.4::float as ir_ok
    from embeddings""",
)
def ir_validate(spark, sf_dir):
    """Images hold abs(value) x 255; values above 0.4 are written as 300, out of range."""
    frames = views.frames(spark, sf_dir).withColumn(
        "left_ir",
        F.transform(
            "depth",
            lambda c: F.when(c > F.lit(0.4).cast("float"), F.lit(300.0))
            .otherwise(F.abs(c) * 255.0)
            .cast("float"),
        ),
    )
    report = st.ir_report(frames, KEYS, "left_ir", F.lit(1))
    return report.select(*KEYS, F.array_join("reasons", ",").alias("reasons"), "ir_ok")


_PLANES = """planes as (
  select cast(label as varchar) as camera, vec_id as frame_id, unnest(range(64))::int as i,
    unnest(embedding) as e, unnest(list_reverse(embedding)) as back from embeddings),
chan as (select camera, frame_id, i, abs(e) * 255.0::float as value, unnest(range(3))::int as channel
  from planes)"""


@query("ir_planes", f"with {_PLANES} select camera, frame_id, channel, i, value from chan")
def ir_planes(spark, sf_dir):
    return st.ir_planes(views.frames(spark, sf_dir), KEYS, "left_ir", F.lit(1))


@query(
    "imagenet_norm",
    f"""with {_PLANES} select camera, frame_id, channel, i,
      (value - (case channel when 0 then 123.675 when 1 then 116.28 else 103.53 end)::float)
        / (case channel when 0 then 58.395 when 1 then 57.12 else 57.375 end)::float as value
    from chan""",
)
def imagenet_norm(spark, sf_dir):
    planes = st.ir_planes(views.frames(spark, sf_dir), KEYS, "left_ir", F.lit(1))
    return st.imagenet_normalize(planes)


def _mean_difference():
    """A tiny backend: distance of both grey images, divided by 16."""

    def infer(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (np.abs(left[0] - right[0]) / np.float32(16.0))[None]

    return infer


st.register_backend("grey_difference", _mean_difference)


@query(
    "stereo_inference",
    f"""with {_PLANES} select camera, frame_id, i,
      abs(abs(e) * 255.0::float - abs(back) * 255.0::float) / 16.0::float as disparity
    from planes""",
)
def stereo_inference(spark, sf_dir):
    """Disparity from a registered Python backend over both infrared images."""
    frames = views.frames(spark, sf_dir).select(*KEYS, "height", "width", "left_ir", "right_ir")
    found = st.infer_disparity(frames, "grey_difference")
    return found.select(*KEYS, F.posexplode("disparity").alias("i", "disparity"))


@query(
    "clamp",
    f"with {DISP} select camera, frame_id, i, greatest(d, 0.5::float) as clamped from disp",
)
def clamp(spark, sf_dir):
    px = pixels(spark, sf_dir)
    return px.select(*KEYS, "i", clamp_min(F.col("disparity"), 0.5).alias("clamped"))


@query(
    "device_depth",
    f"""with {DISP}, c as (select *, case when isnan(d) then 0.0::float else greatest(d, 0.0::float) end as dc
      from disp)
    select camera, frame_id, i, case when u - dc < 0 then 0.0::float
      when dc = 0 then 'inf'::float else 5.0::float / dc end as depth_m from c""",
)
def device_depth(spark, sf_dir):
    """Depth as the device kernels give it: NaN is clamped to the bound, so its depth is infinite."""
    px = pixels(spark, sf_dir).withColumn("d", clamp_min(F.col("disparity"), 0.0))
    return px.select(*KEYS, "i", plain_depth(F.col("d"), F.col("u"), F.lit(FX_BASELINE)).alias("depth_m"))


SHAPE, GROUPS, MAX_DISP = (8, 1, 8), 2, 4

# Packed feature maps of a pair: 8 channels, one row of 8 values each.
_PAIR = """pair as (
  select l.vec_id // 2 as pair_id, l.embedding as le, r.embedding as re
  from embeddings l join embeddings r on r.vec_id = l.vec_id + 1 where l.vec_id % 2 = 0),
cell as (select *, unnest(range(8))::int as w from pair),
cell2 as (select *, unnest(range(4))::int as d from cell)"""


def _feature_pairs(spark, sf_dir):
    e = views.table(spark, sf_dir, "embeddings")
    pair = F.expr("vec_id div 2").alias("pair_id")
    left = e.where("vec_id % 2 = 0").select(pair, F.col("embedding").alias("left"))
    right = e.where("vec_id % 2 = 1").select(pair, F.col("embedding").alias("right"))
    return left.join(right, "pair_id")


def _gwc_sql(normalize: bool) -> str:
    at = lambda a, k: f"{a}[(g * 4 + {k}) * 8 + w{'' if a == 'le' else ' - d'} + 1]"
    total = lambda a, b: " + ".join(f"{at(a, k)} * {at(b, k)}" for k in range(4))
    dot = f"({total('le', 're')})"
    if normalize:
        dot += (
            f" / (sqrt({total('le', 'le')})::float * sqrt({total('re', 're')})::float + 1e-5::float)"
        )
    return f"""with {_PAIR}, cell3 as (select *, unnest(range(2))::int as g from cell2)
      select pair_id, g, d, 0 as h, w,
        round(case when w >= d then {dot} else 0.0::float end::double, 5) as value from cell3"""


def _volume(spark, sf_dir, normalize: bool):
    pairs = _feature_pairs(spark, sf_dir)
    volume = correlation_volume(pairs, ["pair_id"], SHAPE, MAX_DISP, GROUPS, normalize)
    return volume.withColumn("value", F.round(F.col("value").cast("double"), 5))


@query("gwc_volume", _gwc_sql(False))
def gwc_volume(spark, sf_dir):
    return _volume(spark, sf_dir, False)


@query("gwc_volume_norm", _gwc_sql(True))
def gwc_volume_norm(spark, sf_dir):
    return _volume(spark, sf_dir, True)


@query(
    "concat_volume",
    f"""with {_PAIR}, cell3 as (select *, unnest(range(16))::int as c from cell2)
      select pair_id, c, d, 0 as h, w,
        case when c < 8 then le[c * 8 + w + 1] when w >= d then re[(c - 8) * 8 + w - d + 1]
          else 0.0::float end as value from cell3""",
)
def concat_volume_query(spark, sf_dir):
    return concat_volume(_feature_pairs(spark, sf_dir), ["pair_id"], SHAPE, MAX_DISP)
