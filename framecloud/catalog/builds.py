"""Whole builds: recorded, coloured, stereo and live."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from framecloud.catalog import sql as S
from framecloud.catalog import views
from framecloud.catalog.clouds import TIGHT, TIGHT_SQL, WINDOW, WINDOW_SQL
from framecloud.catalog.colors import IMG, sql_color
from framecloud.operators.color import COLOR
from framecloud.catalog.registry import query
from framecloud.config import BuildConfig, PointCloudConfig, SamplingConfig, StereoConfig
from framecloud.functions.checkpoints import checkpoint_dir
from framecloud.operators.stereo import stage_breakdown
from framecloud.plans.build import build, reject_report
from framecloud.schema import FRAMES, KEYS
from framecloud.sinks.writers import ply_lines
from framecloud.streaming.live import read_frames, run_live

SAMPLING = SamplingConfig("voxel_random", 16, voxel_size=0.05, seed=42, deterministic=True)
PLAIN = BuildConfig(crop=WINDOW, sampling=SAMPLING)

CLOUD_SQL = S.with_(
    S.RAW,
    S.FRAMES,
    f"src as (select camera, frame_id, idx, x, y, z from raw where {WINDOW_SQL})",
    S.sampled(S.KEYS, "voxel_random", 16, 0.05, 42),
    select="select * from outp",
)


def built(spark, sf_dir, cfg, mode="recorded"):
    cameras = views.stereo_cameras if cfg.depth_mode == "stereo" else views.cameras
    return build(views.frames(spark, sf_dir), cameras(spark, sf_dir), cfg, mode=mode)


@query("frame_cloud", CLOUD_SQL)
def frame_cloud(spark, sf_dir):
    """Flagship: deproject, crop, one point per voxel, random sample, pad."""
    return built(spark, sf_dir, PLAIN).sampled


EMPTY = BuildConfig(crop=TIGHT, sampling=SAMPLING)


@query(
    "frame_meta",
    S.with_(
        S.RAW,
        S.FRAMES,
        f"cnt as (select camera, frame_id, count(*) as n_raw, count(*) filter ({TIGHT_SQL}) as n_crop, "
        f"count(distinct case when {TIGHT_SQL} then row({S.voxels(0.05)}) end) as n_cand "
        "from raw group by camera, frame_id)",
        select="""select camera, frame_id, frame_id::double / 30.0 as timestamp,
          camera::int % 2 = 0 as aligned_depth_to_color,
          case when camera::int % 2 = 0 then 'color' else 'depth' end as intrinsics,
          coalesce(n_raw, 0) as num_raw_points, coalesce(n_crop, 0) as num_cropped_points,
          16::bigint as num_sampled_points, coalesce(n_cand, 0) as candidate_count,
          coalesce(n_crop, 0) = 0 as crop_empty, coalesce(n_crop, 0) = 0 as input_empty,
          coalesce(n_cand, 0) < 16 as padded, 'sampled' as stage, 'recorded' as mode,
          true as crop_enabled, false as use_rgb
        from frames left join cnt using (camera, frame_id)""",
    ),
)
def frame_meta(spark, sf_dir):
    meta = built(spark, sf_dir, EMPTY).meta
    return meta.select(
        *KEYS, "timestamp", "aligned_depth_to_color", "intrinsics", "num_raw_points",
        "num_cropped_points", "num_sampled_points", "candidate_count", "crop_empty",
        "input_empty", "padded", "stage", "mode", "crop_enabled", "use_rgb",
    )


COLORED = BuildConfig(
    pointcloud=PointCloudConfig(use_rgb=True, output_format="xyzrgb"), crop=WINDOW, sampling=SAMPLING
)

# Colour of every raw point: own pixel when aligned, else the projected one.
COLOR_RAW = f"""mv as (
  select *, ((rc * x + (-rs) * y) + 0.0::float * z) + tx as qx,
    ((rs * x + rc * y) + 0.0::float * z) + ty as qy, z as qz from raw),
sp as (select *, round_even((qx * 60.0::float) / qz + 3.5::float, 0) as pu,
  round_even((qy * 60.0::float) / qz + 3.5::float, 0) as pv from mv),
ht as (select *, aligned or (pu >= 0 and pu < 8 and pv >= 0 and pv < 8) as hit from sp),
pos as (select *, (case when aligned then idx when hit then pv * 8 + pu else 0 end)::int as spot_at from ht),
c0 as (select camera, frame_id, idx, x, y, z, hit, {sql_color('spot_at')}
  from pos join img using (camera, frame_id)),
craw as (select camera, frame_id, idx, x, y, z, hit,
  {', '.join(f'case when hit then {n} else 0.0::float end as {n}' for n in COLOR)} from c0)"""


@query(
    "color_cloud",
    S.with_(
        S.RAW,
        S.FRAMES,
        IMG,
        COLOR_RAW,
        f"src as (select camera, frame_id, idx, x, y, z, red, green, blue from craw where {WINDOW_SQL})",
        S.sampled(S.KEYS, "voxel_random", 16, 0.05, 42, extra="red, green, blue"),
        select="select * from outp",
    ),
)
def color_cloud(spark, sf_dir):
    return built(spark, sf_dir, COLORED).sampled


@query(
    "color_meta",
    S.with_(
        S.RAW,
        S.FRAMES,
        IMG,
        COLOR_RAW,
        "cnt as (select camera, frame_id, count(*) filter (hit) as h, count(*) filter (not hit) as m "
        "from craw group by camera, frame_id)",
        select="""select camera, frame_id, true as use_rgb,
          case when camera::int % 2 = 0 then 'aligned' else 'project_depth_to_color' end as rgb_mapping,
          coalesce(h, 0) as valid_projection_count, coalesce(m, 0) as invalid_projection_count
        from frames left join cnt using (camera, frame_id)""",
    ),
)
def color_meta(spark, sf_dir):
    return built(spark, sf_dir, COLORED).meta.select(
        *KEYS, "use_rgb", "rgb_mapping", "valid_projection_count", "invalid_projection_count"
    )


STEREO = BuildConfig(
    crop=WINDOW,
    sampling=SAMPLING,
    depth_mode="stereo",
    stereo=StereoConfig(min_depth_m=0.2, max_depth_m=1.5),
)

STEREO_RAW = f"""{S.CAM}, d0 as (
  select cast(label as varchar) as camera, vec_id as frame_id,
    unnest(range(len(embedding)))::int as idx, unnest(embedding) * 20.0::float as d from embeddings),
d1 as (select d0.*, dfx, dfy, dcx, dcy, (dfx::double * 0.05::double)::float as fb,
    d > 0.001::float as positive, d > 0.001::float and (idx % 8)::float - d < 0 as invisible
  from d0 join cam using (camera)),
d2 as (select *, case when d = 0 then 'inf'::float else fb / d end as zz from d1),
d3 as (select *, positive and not invisible and isfinite(zz) and zz >= 0.2::float and zz <= 1.5::float as valid from d2),
spx as (select *, case when valid then zz else 0.0::float end as z from d3),
raw as (select camera, frame_id, idx, (((idx % 8)::float - dcx) * z) / dfx as x,
  (((idx // 8)::float - dcy) * z) / dfy as y, z from spx where z > 0)"""


@query(
    "stereo_cloud",
    S.with_(
        STEREO_RAW,
        S.FRAMES,
        f"src as (select * from raw where {WINDOW_SQL})",
        S.sampled(S.KEYS, "voxel_random", 16, 0.05, 42),
        select="select * from outp",
    ),
)
def stereo_cloud(spark, sf_dir):
    return built(spark, sf_dir, STEREO).sampled


INFERRED = replace(STEREO, stereo=replace(STEREO.stereo, backend="grey_difference"))


@query(
    "stereo_end_to_end",
    S.with_(
        STEREO_RAW.replace(
            "unnest(embedding) * 20.0::float as d",
            "abs(abs(unnest(embedding)) * 255.0::float - abs(unnest(list_reverse(embedding))) * 255.0::float)"
            " / 16.0::float as d",
        ),
        S.FRAMES,
        f"src as (select * from raw where {WINDOW_SQL})",
        S.sampled(S.KEYS, "voxel_random", 16, 0.05, 42),
        select="select * from outp",
    ),
)
def stereo_end_to_end(spark, sf_dir):
    """Infrared pairs to sampled clouds: the build runs the backend of its settings."""
    frames = views.frames(spark, sf_dir).drop("disparity")
    return build(frames, views.stereo_cameras(spark, sf_dir), INFERRED).sampled


@query(
    "reject_report",
    """with f as (select
        case when vec_id % 17 = 0 then '99' else cast(label as varchar) end as camera,
        case when vec_id % 19 <> 0 then vec_id end as frame_id,
        case when vec_id % 11 = 0 then null when vec_id % 13 = 0 then 63 else len(embedding) end as n
      from embeddings),
    g as (select f.*, c.n_nationkey is not null as known
      from f left join nation c on cast(c.n_nationkey as varchar) = f.camera),
    h as (select camera, frame_id, concat_ws('; ',
        case when frame_id is null then 'frame key is null' end,
        case when not known then 'unknown camera' end,
        case when n is null then 'depth image is missing' end,
        case when known and n <> 64 then 'depth image does not match the camera' end) as violations from g)
    select *, violations = '' as ok from h""",
)
def rejects(spark, sf_dir):
    """Frames with null keys, null or short images and unknown cameras, placed by a rule."""
    n = F.col("frame_id")
    short = F.when(n % 13 == 0, F.slice("depth", 1, 63)).otherwise(F.col("depth"))
    broken = views.frames(spark, sf_dir).select(
        F.when(n % 17 == 0, "99").otherwise(F.col("camera")).alias("camera"),
        F.when(n % 19 != 0, n).alias("frame_id"),
        F.when(n % 11 != 0, short).alias("depth"),
    )
    report = reject_report(broken, views.cameras(spark, sf_dir), PLAIN)
    return report.withColumn("violations", F.array_join("violations", "; "))


@query(
    "perception_pixels",
    S.with_(
        STEREO_RAW,
        select="select camera, frame_id, idx as i, d as disparity, z as depth_m, valid from spx",
    ),
)
def perception_pixels(spark, sf_dir):
    return built(spark, sf_dir, STEREO).pixels.select(*KEYS, "i", "disparity", "depth_m", "valid")


@query(
    "stage_breakdown",
    S.with_(
        STEREO_RAW,
        f"""lay as (select camera, frame_id, count(*) as image_pixel_count,
          count(*) filter (not positive) as invalid_disparity_count,
          count(*) filter (invisible) as remove_invisible_count,
          count(*) filter (z < 0.2::float or z > 1.5::float) as z_range_invalid_count,
          count(*) filter (valid) as final_valid_disparity_count,
          count(*) filter (not valid) as final_invalid_disparity_count from spx group by camera, frame_id),
        cnt as (select camera, frame_id, count(*) as n_raw, count(*) filter ({WINDOW_SQL}) as n_crop,
          count(distinct case when {WINDOW_SQL} then row({S.voxels(0.05)}) end) as n_cand
          from raw group by camera, frame_id),
        al as (select lay.*, coalesce(n_raw, 0) as r, coalesce(n_crop, 0) as c, coalesce(n_cand, 0) as n
          from lay left join cnt using (camera, frame_id))""",
        select="""select camera, frame_id, image_pixel_count, invalid_disparity_count,
          remove_invisible_count, z_range_invalid_count, final_valid_disparity_count,
          final_invalid_disparity_count, r as deprojection_input_points,
          image_pixel_count - r as deprojection_removed_points, c as crop_output_points,
          r - c as crop_removed_points, 16::bigint as sampling_output_points,
          c - 16 as sampling_removed_or_padded_points, n < 16 as sampling_padded from al""",
    ),
)
def breakdown(spark, sf_dir):
    stages = built(spark, sf_dir, STEREO)
    return stage_breakdown(stages.pixels, stages.meta, KEYS, STEREO.stereo)


def drained(spark, sf_dir, cfg, stages):
    """Folders of the stages of a file stream of all frames that has run to its end."""
    base = f"{checkpoint_dir(spark)}/live-{uuid.uuid4().hex}"
    frames = views.frames(spark, sf_dir).select(*FRAMES.fieldNames())
    frames.repartition(4).write.parquet(f"{base}/in")
    paths = {name: f"{base}/{name}" for name in stages}
    live = run_live(
        read_frames(spark, f"{base}/in", files_per_trigger=2),
        views.cameras(spark, sf_dir),
        cfg,
        paths,
        f"{base}/checkpoint",
        trigger={"availableNow": True},
    )
    live.awaitTermination()
    return paths


@query("live_equals_batch", CLOUD_SQL)
def live_equals_batch(spark, sf_dir):
    """The flagship through a file stream: same rows as the batch build."""
    paths = drained(spark, sf_dir, PLAIN, ["sampled", "meta"])
    return spark.read.parquet(paths["sampled"]).drop("batch_id")


@query(
    "live_meta",
    S.with_(
        S.RAW,
        S.FRAMES,
        f"cnt as (select camera, frame_id, count(*) as n_raw, count(*) filter ({WINDOW_SQL}) as n_crop, "
        f"count(distinct case when {WINDOW_SQL} then row({S.voxels(0.05)}) end) as n_cand "
        "from raw group by camera, frame_id)",
        select="""select camera, frame_id, frame_id::double / 30.0 as timestamp, 'live' as mode,
          'sampled' as stage, coalesce(n_raw, 0) as num_raw_points,
          coalesce(n_crop, 0) as num_cropped_points, coalesce(n_cand, 0) as candidate_count,
          16::bigint as num_sampled_points, coalesce(n_cand, 0) < 16 as padded
        from frames left join cnt using (camera, frame_id)""",
    ),
)
def live_meta(spark, sf_dir):
    """Metadata with counts that a drained stream wrote."""
    paths = drained(spark, sf_dir, PLAIN, ["meta"])
    return spark.read.parquet(paths["meta"]).select(
        *KEYS, "timestamp", "mode", "stage", "num_raw_points", "num_cropped_points",
        "candidate_count", "num_sampled_points", "padded",
    )


@query(
    "stereo_meta",
    S.with_(
        STEREO_RAW,
        select="""select camera, frame_id, max(dfx)::double as fx_px, 0.05::double as baseline_m,
          1.0::double as effective_depth_scale, count(*) as total, count(*) filter (valid) as valid,
          count(*) filter (not valid) as invalid, count(*) filter (not isfinite(d)) as non_finite,
          count(*) filter (isfinite(d) and d <= 0.001::float) as non_positive_or_epsilon,
          count(*) filter (invisible) as invisible_right_coordinate,
          count(*) filter (isfinite(zz) and zz < 0.2::float) as below_min_depth,
          count(*) filter (isfinite(zz) and zz > 1.5::float) as above_max_depth
        from spx group by camera, frame_id""",
    ),
)
def stereo_meta(spark, sf_dir):
    meta = built(spark, sf_dir, STEREO).stereo_meta
    return meta.select(
        *KEYS, "fx_px", "baseline_m", "effective_depth_scale", "total", "valid", "invalid",
        "non_finite", "non_positive_or_epsilon", "invisible_right_coordinate",
        "below_min_depth", "above_max_depth",
    )


@query(
    "ply_text",
    S.with_(
        S.FRAMES,
        S.RAW,
        "cnt as (select camera, frame_id, count(*) as n from raw group by camera, frame_id)",
        select="""select camera, frame_id, unnest(range(7)) as line_no,
            unnest(['ply', 'format ascii 1.0', 'element vertex ' || coalesce(n, 0), 'property float x',
              'property float y', 'property float z', 'end_header']) as value
          from frames left join cnt using (camera, frame_id)
          union all
          select camera, frame_id, idx + 7, concat_ws(' ', x::double::varchar, y::double::varchar,
            z::double::varchar) from raw""",
    ),
)
def ply_text(spark, sf_dir):
    """All lines of one ASCII cloud file per frame."""
    stages = built(spark, sf_dir, BuildConfig(sampling=SamplingConfig(enabled=False)))
    return ply_lines(stages.raw, views.frames(spark, sf_dir), list(KEYS))


@query(
    "ply_color_text",
    S.with_(
        S.RAW,
        S.FRAMES,
        IMG,
        COLOR_RAW,
        "cnt as (select camera, frame_id, count(*) as n from craw group by camera, frame_id)",
        select=f"""select camera, frame_id, unnest(range(10)) as line_no,
            unnest(['ply', 'format ascii 1.0', 'element vertex ' || coalesce(n, 0), 'property float x',
              'property float y', 'property float z', 'property uchar red', 'property uchar green',
              'property uchar blue', 'end_header']) as value
          from frames left join cnt using (camera, frame_id)
          union all
          select camera, frame_id, idx + 10, concat_ws(' ', x::double::varchar, y::double::varchar,
            z::double::varchar, {', '.join(f'floor(least(greatest({n}::double * 255.0::double, 0), 255))::int::varchar' for n in COLOR)})
          from craw""",
    ),
)
def ply_color_text(spark, sf_dir):
    """Lines of coloured clouds: each colour is a byte."""
    cfg = BuildConfig(
        pointcloud=PointCloudConfig(use_rgb=True, output_format="xyzrgb"),
        sampling=SamplingConfig(enabled=False),
    )
    return ply_lines(built(spark, sf_dir, cfg).raw, views.frames(spark, sf_dir), list(KEYS))
