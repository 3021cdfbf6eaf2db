"""Colour normalisation, aligned and projected colour."""

from __future__ import annotations

from pyspark.sql import functions as F

from framecloud.catalog import sql as S
from framecloud.catalog import views
from framecloud.catalog.registry import query
from framecloud.operators.color import (
    CARRY,
    COLOR,
    POSE,
    color_camera_columns,
    divisor,
    image_max,
    projection_counts,
    with_aligned_color,
    with_projected_color,
)
from framecloud.operators.color import LENS as COLOR_LENS
from framecloud.operators.geometry import (
    LENS,
    active_intrinsics,
    attach_cameras,
    deproject,
    explode_pixels,
    lens_columns,
    rigid_transform,
    valid_points,
)
from framecloud.schema import KEYS

# Colour of pixel i before scaling, and the divisor of its image.
IMG = """img as (
  select cast(label as varchar) as camera, vec_id as frame_id, embedding as e,
    case when list_max(list_transform(embedding, lambda c: abs(c) * 3.0::float)) > 1.0
      then 255.0::float else 1.0::float end as div
  from embeddings)"""


def sql_color(at: str) -> str:
    """Three channel expressions at position ``at`` of the image array ``e``."""
    source = (f"e[({at}) + 1]", f"e[64 - ({at})]", f"e[xor({at}, 1) + 1]")
    return ", ".join(
        f"least(greatest((abs({s}) * 3.0::float) / div, 0.0::float), 1.0::float) as {n}"
        for s, n in zip(source, COLOR, strict=True)
    )


def _packed(spark, sf_dir):
    placed = attach_cameras(views.frames(spark, sf_dir), views.cameras(spark, sf_dir))
    placed = placed.withColumns({"k": active_intrinsics(), "rgb_div": divisor(F.col("rgb"))})
    return placed.select(
        *KEYS, "depth", *CARRY, "aligned", F.col("k.width").alias("w"), *lens_columns(),
        *color_camera_columns(),
    )


def _points(spark, sf_dir, aligned: bool, carry):
    packed = _packed(spark, sf_dir)
    chosen = packed.where("aligned" if aligned else "not aligned")
    return deproject(explode_pixels(chosen, KEYS, "depth", "depth", F.col("w"), (*LENS, *carry)))


@query("image_max", S.with_(IMG, select="""select camera, frame_id, div,
  list_max(list_transform(e, lambda c: abs(c) * 3.0::float)) as top from img"""))
def image_max_query(spark, sf_dir):
    rgb = F.col("rgb")
    return views.frames(spark, sf_dir).select(
        *KEYS, divisor(rgb).alias("div"), image_max(rgb).alias("top")
    )


@query(
    "color_aligned",
    S.with_(
        S.RAW,
        IMG,
        select=f"""select camera, frame_id, idx, {sql_color('idx')}
          from raw join img using (camera, frame_id) where aligned""",
    ),
)
def color_aligned(spark, sf_dir):
    px = _points(spark, sf_dir, True, CARRY)
    return valid_points(with_aligned_color(px)).select(*KEYS, "idx", *COLOR)


MOVED = """moved as (
  select camera, frame_id, idx,
    ((rc * x + (-rs) * y) + 0.0::float * z) + tx as qx,
    ((rs * x + rc * y) + 0.0::float * z) + ty as qy,
    ((0.0::float * x + 0.0::float * y) + 1.0::float * z) + 0.0::float as qz
  from raw where not aligned)"""
HITS = """spot as (
  select *, round_even((qx * 60.0::float) / qz + 3.5::float, 0) as pu,
    round_even((qy * 60.0::float) / qz + 3.5::float, 0) as pv from moved),
hits as (select *, pu >= 0 and pu < 8 and pv >= 0 and pv < 8 as hit from spot)"""


@query(
    "rigid_transform",
    S.with_(S.RAW, MOVED, select="select camera, frame_id, idx, qx, qy, qz from moved"),
)
def rigid_transform_query(spark, sf_dir):
    points = valid_points(_points(spark, sf_dir, False, POSE))
    moved = rigid_transform()
    return points.select(
        *KEYS, "idx", *[c.alias(n) for c, n in zip(moved, ("qx", "qy", "qz"), strict=True)]
    )


def _projected(spark, sf_dir):
    carry = (*CARRY, *COLOR_LENS, *POSE)
    return with_projected_color(valid_points(_points(spark, sf_dir, False, carry)))


_CHANNELS = ", ".join(f"case when hit then {n} else 0.0::float end as {n}" for n in COLOR)


@query(
    "color_projected",
    S.with_(
        S.RAW,
        MOVED,
        HITS,
        IMG,
        f"""col as (select camera, frame_id, idx, hit, {sql_color(
            'case when hit then (pv * 8 + pu)::int else 0 end')}
          from hits join img using (camera, frame_id))""",
        select=f"select camera, frame_id, idx, hit, {_CHANNELS} from col",
    ),
)
def color_projected(spark, sf_dir):
    return _projected(spark, sf_dir).select(*KEYS, "idx", "hit", *COLOR)


@query(
    "color_projection_counts",
    S.with_(
        S.RAW,
        MOVED,
        HITS,
        select="""select camera, frame_id, count(*) filter (hit) as valid_projection_count,
          count(*) filter (not hit) as invalid_projection_count from hits group by camera, frame_id""",
    ),
)
def color_projection_counts(spark, sf_dir):
    return projection_counts(_projected(spark, sf_dir), KEYS)
