"""Deprojection, crop, camera lookup and extents."""

from __future__ import annotations

from pyspark.sql import functions as F

from framecloud.catalog import sql as S
from framecloud.catalog import views
from framecloud.catalog.registry import query
from framecloud.config import CropConfig
from framecloud.operators.assembly import assemble_frames, frame_completeness
from framecloud.operators.crop import crop, crop_mask, crop_parts
from framecloud.operators.geometry import (
    attach_cameras,
    active_intrinsics,
    check_shape,
    deproject,
    explode_pixels,
    lens_columns,
    resolve_depth,
    shape_report,
    valid_points,
)
from framecloud.operators.metadata import cloud_extent
from framecloud.schema import KEYS

XYZ = ["idx", "x", "y", "z"]
WINDOW = CropConfig(enabled=True, x=(-0.1, 0.1), z=(0.1, 2.0))
WINDOW_SQL = S.crop_where(x=(-0.1, 0.1), z=(0.1, 2.0))
TIGHT = CropConfig(enabled=True, x=(-0.02, 0.02), y=(-0.02, 0.02), z=(0.5, 1.5))
TIGHT_SQL = S.crop_where((-0.02, 0.02), (-0.02, 0.02), (0.5, 1.5))


def pixels(spark, sf_dir):
    """Deprojected pixels of all frames, invalid ones included."""
    placed = attach_cameras(views.frames(spark, sf_dir), views.cameras(spark, sf_dir))
    placed = placed.withColumn("k", active_intrinsics())
    placed = check_shape(placed, "depth", F.col("k.height"), F.col("k.width"))
    packed = placed.select(*KEYS, "depth", F.col("k.width").alias("w"), *lens_columns())
    exploded = explode_pixels(
        packed, KEYS, "depth", "depth", F.col("w"), ("scale", "fx", "fy", "cx", "cy")
    )
    return deproject(exploded)


def raw(spark, sf_dir):
    return valid_points(pixels(spark, sf_dir)).select(*KEYS, *XYZ)


@query("deproject", S.with_(S.RAW, select="select camera, frame_id, idx, x, y, z from raw"))
def deproject_query(spark, sf_dir):
    return raw(spark, sf_dir)


@query(
    "deproject_masked",
    S.with_(
        S.PT,
        select="""select camera, frame_id, idx as i, (idx % 8)::int as u, (idx // 8)::int as v,
          x, y, z, isfinite(x) and isfinite(y) and isfinite(z) and z > 0 as valid from pt""",
    ),
)
def deproject_masked(spark, sf_dir):
    return pixels(spark, sf_dir).select(*KEYS, "i", "u", "v", "x", "y", "z", "valid")


@query("crop", S.with_(S.RAW, select=f"select camera, frame_id, idx, x, y, z from raw where {WINDOW_SQL}"))
def crop_query(spark, sf_dir):
    return crop(raw(spark, sf_dir), WINDOW)


@query("crop_mask", S.with_(S.RAW, select=f"select camera, frame_id, idx, ({WINDOW_SQL}) as keep from raw"))
def crop_mask_query(spark, sf_dir):
    return crop_mask(raw(spark, sf_dir), WINDOW).select(*KEYS, "idx", "keep")


def color_part(spark, sf_dir):
    """A colour table keyed like the raw points: coordinates turned into values."""
    return raw(spark, sf_dir).select(
        *KEYS,
        "idx",
        (F.col("z") * F.lit(0.5).cast("float")).alias("red"),
        (F.col("x") * F.lit(2.0).cast("float")).alias("green"),
        (-F.col("y")).alias("blue"),
    )


PART_COLORS = "z * 0.5::float as red, x * 2.0::float as green, -y as blue"


@query(
    "crop_parts",
    S.with_(S.RAW, select=f"select camera, frame_id, idx, x, y, z, {PART_COLORS} from raw where {WINDOW_SQL}"),
)
def crop_parts_query(spark, sf_dir):
    return crop_parts(raw(spark, sf_dir), color_part(spark, sf_dir), WINDOW, KEYS)


@query(
    "camera_join",
    S.with_(
        S.CAM,
        select="""select cast(label as varchar) as camera, vec_id as frame_id, aligned,
          case when aligned then 60.0 else dfx::double end as fx,
          case when aligned then 3.5 else dcx::double end as cx, scale::double as depth_scale
        from embeddings join cam on cam.camera = cast(label as varchar)""",
    ),
)
def camera_join(spark, sf_dir):
    placed = attach_cameras(views.frames(spark, sf_dir), views.cameras(spark, sf_dir))
    k = active_intrinsics()
    return placed.select(
        *KEYS, "aligned", k["fx"].alias("fx"), k["cx"].alias("cx"), "depth_scale"
    )


@query(
    "depth_source_switch",
    S.with_(
        S.CAM,
        S.PX,
        select="""select camera, frame_id, i,
          case when camera::int % 3 = 0 then abs(depth) else depth * scale end as depth_m,
          case when camera::int % 3 = 0 then 'ir1' when aligned then 'color' else 'depth' end as intrinsics,
          case when camera::int % 3 <> 0 and aligned then 60.0 else dfx::double end as fx
        from px join cam using (camera)""",
    ),
)
def depth_source_switch(spark, sf_dir):
    """Cameras 0, 3, 6, 9 deliver stereo depth, the others sensor depth."""
    placed = attach_cameras(views.frames(spark, sf_dir), views.cameras(spark, sf_dir))
    stereo = F.col("camera").cast("int") % 3 == 0
    placed = placed.withColumn("stereo_depth", F.transform("depth", lambda c: F.abs(c)))
    resolved = resolve_depth(placed, stereo)
    return resolved.select(
        *KEYS,
        "intrinsics",
        F.col("k.fx").alias("fx"),
        F.col("effective_scale").cast("float").alias("s"),
        F.posexplode("raster").alias("i", "c"),
    ).select(*KEYS, "i", (F.col("c") * F.col("s")).alias("depth_m"), "intrinsics", "fx")


@query(
    "shape_check",
    """select cast(label as varchar) as camera, vec_id as frame_id, len(embedding)::int as found_pixels,
      (case when label = 7 then 72 else 64 end)::int as expected_pixels,
      len(embedding) = (case when label = 7 then 72 else 64 end) as shape_ok from embeddings""",
)
def shape_check(spark, sf_dir):
    """Camera 7 is described with nine rows, so its frames fail the check."""
    described = views.frames(spark, sf_dir).withColumn(
        "height", F.when(F.col("camera") == "7", 9).otherwise(F.col("height"))
    )
    return shape_report(described, KEYS, "depth", F.col("height"), F.col("width"))


_EXTENT = ", ".join(
    f"coalesce({m}({a}), 0.0::float) as {m}_{a}" for m in ("min", "max") for a in "xyz"
)


@query(
    "cloud_extent",
    S.with_(
        S.RAW,
        S.FRAMES,
        f"cr as (select * from raw where {TIGHT_SQL})",
        select=f"""select f.camera, f.frame_id, count(cr.idx) as n, {_EXTENT}
          from frames f left join cr on f.camera = cr.camera and f.frame_id = cr.frame_id
          group by f.camera, f.frame_id""",
    ),
)
def cloud_extent_query(spark, sf_dir):
    return cloud_extent(crop(raw(spark, sf_dir), TIGHT), views.frames(spark, sf_dir), KEYS)


@query(
    "frame_completeness",
    S.with_(
        S.RAW,
        S.FRAMES,
        f"cr as (select * from raw where {TIGHT_SQL})",
        select="""select f.camera, f.frame_id, count(cr.idx) as n_points, count(cr.idx) = 0 as is_empty
          from frames f left join cr on f.camera = cr.camera and f.frame_id = cr.frame_id
          group by f.camera, f.frame_id""",
    ),
)
def frame_completeness_query(spark, sf_dir):
    return frame_completeness(
        views.frames(spark, sf_dir), crop(raw(spark, sf_dir), TIGHT), KEYS
    )


@query(
    "frame_assembly",
    """select cast(label as varchar) as camera, vec_id as frame_id, vec_id::double / 30.0 as ts,
      embedding as depth, list_transform(embedding, lambda c: abs(c) * 255.0::float) as left_ir,
      list_transform(list_reverse(embedding), lambda c: abs(c) * 255.0::float) as right_ir,
      case when label <> 9 then list_transform(range(192), lambda j: abs(
        case j % 3 when 0 then embedding[j // 3 + 1] when 1 then embedding[64 - j // 3]
          else embedding[xor(j // 3, 1) + 1] end) * 3.0::float) end as rgb
    from embeddings""",
)
def frame_assembly(spark, sf_dir):
    """Streams stored apart; camera 9 has no colour stream."""
    every = views.frames(spark, sf_dir)
    depth = every.select(*KEYS, "ts", "depth")
    ir = every.select(*KEYS, "left_ir", "right_ir")
    rgb = every.where(F.col("camera") != "9").select(*KEYS, "rgb")
    return assemble_frames(depth, ir, rgb, KEYS)


@query("frame_lookup", "select vec_id as frame_id, label from embeddings where vec_id = 123")
def frame_lookup(spark, sf_dir):
    """One recorded frame by its index; the predicate reaches the Parquet scan."""
    from framecloud.sources.recorded import frame_at

    found = frame_at(views.table(spark, sf_dir, "embeddings"), 123, "vec_id")
    return found.select(F.col("vec_id").alias("frame_id"), "label")
