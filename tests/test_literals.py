"""Literal cases with known results."""

import math

import numpy as np
import pytest
from helpers import camera, cloud, frame, key_table, points, xyz
from pyspark.sql import functions as F

from framecloud.config import (
    BuildConfig,
    CropConfig,
    Extrinsics,
    PointCloudConfig,
    SamplingConfig,
    StereoConfig,
)
from framecloud.operators import stereo as st
from framecloud.operators.color import divisor
from framecloud.operators.crop import crop, crop_mask, crop_parts
from framecloud.operators.geometry import resolve_depth
from framecloud.operators.metadata import cloud_extent
from framecloud.operators.raster import clamp_min, plain_depth, upsample
from framecloud.operators.sampling import sample_points, sampling_counts, select_points
from framecloud.plans.build import build
from framecloud.schema import KEYS

OFF = SamplingConfig(enabled=False)
RAW = BuildConfig(sampling=OFF)


def test_plane_has_nine_points_one_metre_away(spark):
    frames = frame(spark, {"height": 3, "width": 3, "depth": [1000.0] * 9})
    out = xyz(build(frames, camera(spark, scale=0.001), RAW).raw)
    assert len(out) == 9 and all(z == 1.0 for _, _, z in out)
    assert out[4][:2] == (0.0, 0.0)


@pytest.mark.parametrize("aligned, first", [(True, -1.0), (False, 0.0)])
def test_alignment_selects_the_intrinsics(spark, aligned, first):
    frames = frame(spark, {"height": 3, "width": 3, "depth": [1.0] * 9})
    cams = camera(spark, aligned=aligned, color_c=1.0, depth_c=0.0)
    assert xyz(build(frames, cams, RAW).raw)[0][0] == first


def test_only_finite_positive_depth_is_valid(spark):
    depth = [0.0, 1.0, -1.0, 2.0, math.nan, math.inf, -math.inf, 3.0, None]
    frames = frame(spark, {"height": 3, "width": 3, "depth": depth})
    got = build(frames, camera(spark), RAW).raw.orderBy("idx").collect()
    assert [r.idx for r in got] == [1, 3, 7]


def test_wrong_image_size_fails(spark):
    frames = frame(spark, {"height": 3, "width": 3, "depth": [1.0] * 8})
    with pytest.raises(Exception, match="does not match the camera"):
        build(frames, camera(spark), RAW).raw.collect()


def test_unknown_camera_fails(spark):
    frames = frame(spark, {"camera": "other", "height": 3, "width": 3, "depth": [1.0] * 9})
    with pytest.raises(Exception, match="unknown camera"):
        build(frames, camera(spark), RAW).raw.collect()


def test_bytes_are_scaled_once_per_image(spark):
    rgb = spark.createDataFrame(
        [(0, [255.0] * 3), (1, [0.0, 1.0, 1.0]), (2, [math.nan, 2.0, 0.0]), (3, [math.nan] * 3)],
        "k int, rgb array<float>",
    )
    out = [r.d for r in rgb.select("k", divisor(F.col("rgb")).alias("d")).orderBy("k").collect()]
    assert out == [255.0, 1.0, 255.0, 1.0]


def test_projected_colour_hits_and_misses(spark):
    # Points move by one pixel to the right: the right column falls outside.
    rgb = [0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0]
    frames = frame(
        spark,
        {"height": 2, "width": 2, "depth": [1.0] * 4, "rgb": [float(c) for c in rgb], "rgb_channels": 3},
    )
    cams = camera(spark, 2, 2, aligned=False, color_c=0.0, depth_c=0.0, t=(1.0, 0.0, 0.0))
    cfg = BuildConfig(pointcloud=PointCloudConfig(use_rgb=True, output_format="xyzrgb"), sampling=OFF)
    stages = build(frames, cams, cfg)
    rows = stages.raw.orderBy("idx").collect()
    assert [(r.red, r.green, r.blue) for r in rows[:2]] == [(0.0, 1.0, 0.0), (0.0, 0.0, 0.0)]
    meta = stages.meta.first()
    assert (meta.valid_projection_count, meta.invalid_projection_count) == (2, 2)
    assert meta.use_rgb and meta.rgb_mapping == "project_depth_to_color"


def test_colour_without_mapping_gives_coordinates_only(spark):
    frames = frame(
        spark, {"height": 2, "width": 2, "depth": [1.0] * 4, "rgb": [1.0] * 12, "rgb_channels": 3}
    )
    cfg = BuildConfig(
        pointcloud=PointCloudConfig(use_rgb=True, rgb_mapping="aligned"), sampling=OFF
    )
    stages = build(frames, camera(spark, 2, 2, aligned=False), cfg)
    assert stages.raw.first().red is None
    assert stages.meta.first().rgb_reason == "raw_depth_rgb_mapping_not_configured"


@pytest.mark.parametrize(
    "change, message",
    [
        ({"rgb": None}, "no colour image"),
        ({"rgb": [1.0] * 9}, "colour camera"),
        ({"rgb": [1.0] * 8, "rgb_channels": 2}, "three channels"),
        ({}, "extrinsics"),
    ],
)
def test_colour_that_cannot_be_used_fails(spark, change, message):
    row = {"height": 2, "width": 2, "depth": [1.0] * 4, "rgb": [1.0] * 12, "rgb_channels": 3, **change}
    cfg = BuildConfig(pointcloud=PointCloudConfig(use_rgb=True), sampling=OFF)
    with pytest.raises(Exception, match=message):
        build(frame(spark, row), camera(spark, 2, 2, aligned=False), cfg).raw.collect()


def test_crop_mask_and_inclusive_float32_bounds(spark):
    four = cloud(spark, [(0, 0, 0.5), (0.6, 0, 0.5), (0, -0.6, 0.5), (0, 0, 1.5)])
    cfg = CropConfig(enabled=True, x=(-0.5, 0.5), y=(-0.5, 0.5), z=(0.05, 1.0))
    assert [r.keep for r in crop_mask(four, cfg).orderBy("idx").collect()] == [True, False, False, False]
    edge = cloud(spark, [(0.1, 0.2, 0.3), (-0.1, -0.2, 0.7), (0.1, -0.2, 0.3)])
    tight = CropConfig(enabled=True, x=(-0.1, 0.1), y=(-0.2, 0.2), z=(0.3, 0.7))
    assert crop(edge, tight).count() == 3
    assert crop(four, CropConfig(enabled=False)).count() == 4


def test_parts_of_different_length_fail(spark):
    xyz_part = cloud(spark, [(0, 0, 1), (0, 0, 2)])
    colors = spark.createDataFrame(
        [("cam", 0, 0, 1.0, 1.0, 1.0)],
        "camera string, frame_id bigint, idx bigint, red float, green float, blue float",
    )
    with pytest.raises(Exception, match="differ in length"):
        crop_parts(xyz_part, colors, CropConfig(enabled=True, z=(0.0, 1.5)), KEYS).collect()


def sampled(spark, coordinates, cfg, bound=64):
    return sample_points(cloud(spark, coordinates), key_table(spark, 0), KEYS, cfg, bound)


@pytest.mark.parametrize("bound", [64, None])
def test_repeat_padding(spark, bound):
    out = sampled(spark, [(1, 0, 1), (2, 0, 1)], SamplingConfig("stride", 5), bound)
    rows = out.orderBy("slot").collect()
    assert [r.x for r in rows] == [1, 2, 1, 2, 1]
    assert [r.is_pad for r in rows] == [False, False, True, True, True]


def test_zero_padding(spark):
    rows = sampled(spark, [(1, 2, 3)], SamplingConfig("random", 4, pad_mode="zero")).orderBy("slot").collect()
    assert [(r.x, r.y, r.z, r.is_pad) for r in rows] == [(1, 2, 3, False)] + [(0, 0, 0, True)] * 3


@pytest.mark.parametrize("pad_mode", ["repeat", "zero"])
def test_frame_without_points_becomes_zeros(spark, pad_mode):
    out = sampled(spark, [], SamplingConfig("voxel", 7, pad_mode=pad_mode)).collect()
    assert len(out) == 7 and all(r.is_pad and (r.x, r.y, r.z) == (0, 0, 0) for r in out)


def test_crop_that_removes_everything(spark):
    frames = frame(spark, {"height": 3, "width": 3, "depth": [1.0] * 9})
    cfg = BuildConfig(crop=CropConfig(enabled=True, z=(5.0, 6.0)), sampling=SamplingConfig(num_points=8))
    stages = build(frames, camera(spark), cfg)
    assert stages.sampled.count() == 8
    meta = stages.meta.first()
    assert meta.crop_empty and meta.input_empty and meta.padded and meta.num_sampled_points == 8
    assert meta.num_raw_points == 9 and meta.num_cropped_points == 0


def test_stride_judges_padding_on_candidates(spark):
    many = cloud(spark, [(i, 0, 1) for i in range(1000)])
    cfg = SamplingConfig("stride", 600, stride=2)
    counts = sampling_counts(many, key_table(spark, 0), KEYS, cfg).first()
    assert counts.candidate_count == 1000 and counts.padded is False
    out = sample_points(many, key_table(spark, 0), KEYS, cfg)
    assert out.count() == 600 and out.where("is_pad").count() == 100
    assert [r.x for r in out.where("slot < 3").orderBy("slot").collect()] == [0, 2, 4]


def test_voxel_representative_is_the_lowest_index(spark):
    inside = [(0.01, 0.01, 0.01), (0.02, 0.02, 0.02), (-0.01, 0.01, 0.01), (0.03, 0.01, 0.02)]
    chosen = select_points_of(spark, inside, SamplingConfig("voxel", 4, voxel_size=0.1))
    assert chosen == [0, 2]


def select_points_of(spark, coordinates, cfg):
    from framecloud.operators.sampling import candidates

    found = candidates(cloud(spark, coordinates), KEYS, cfg)
    return [r.idx for r in select_points(found, KEYS, cfg, 64).orderBy("rank").collect()]


def test_farthest_points_of_a_line(spark):
    assert select_points_of(spark, [(0, 0, 0), (1, 0, 0), (3, 0, 0)], SamplingConfig("fps", 3)) == [0, 2, 1]


def test_random_sample_repeats_only_with_a_seed(spark):
    many = [(i, 0, 1) for i in range(500)]
    seeded = SamplingConfig("random", 50, seed=5, deterministic=True)
    a, b = (select_points_of(spark, many, seeded) for _ in range(2))
    assert a == b and len(set(a)) == 50
    free = SamplingConfig("random", 50, seed=5)
    assert select_points_of(spark, many, free) != select_points_of(spark, many, free)


def disparity(spark, values, width, **cfg):
    settings = StereoConfig(**cfg)
    rows = frame(spark, {"height": len(values) // width, "width": width, "disparity": values})
    return st.disparity_pixels(rows, KEYS, settings, F.lit(100.0 * 0.05)), settings


def test_disparity_to_depth_and_reasons(spark):
    px, cfg = disparity(spark, [2.0, 4.0, math.nan, 0.0], 2, remove_invisible=False)
    assert [r.depth_m for r in px.orderBy("i").collect()] == [2.5, 1.25, 0.0, 0.0]
    counts = st.disparity_reasons(px, KEYS, cfg).first()
    assert (counts.total, counts.valid, counts.non_finite, counts.non_positive_or_epsilon) == (4, 2, 1, 1)
    assert counts.invisible_right_coordinate == 0


def test_invisible_pixels_are_removed(spark):
    px, cfg = disparity(spark, [2.0] * 10, 5)
    counts = st.disparity_reasons(px, KEYS, cfg).first()
    assert (counts.invisible_right_coordinate, counts.valid) == (4, 6)
    assert all((r.depth_m == 0.0) == (r.u < 2) for r in px.collect())


def test_overlapping_reasons(spark):
    px, cfg = disparity(spark, [-1.0, math.inf, -math.inf, 1.0], 4, min_depth_m=0.1, max_depth_m=2.0, remove_invisible=False)
    c = st.disparity_reasons(px, KEYS, cfg).first()
    assert (c.non_finite, c.non_positive_or_epsilon, c.below_min_depth, c.above_max_depth) == (2, 1, 3, 1)


@pytest.mark.parametrize("bad", [{"min_disparity_px": 0.0}, {"min_depth_m": -1.0}, {"max_depth_m": 0.0}])
def test_bad_stereo_settings_are_rejected(bad):
    with pytest.raises(ValueError):
        StereoConfig(**bad)


def test_stereo_build_with_a_backend(spark):
    st.register_backend("ten", lambda: lambda left, right: np.full(left.shape[1:], 10.0))
    grey = [1.0] * 32 * 2
    frames = frame(
        spark,
        {"height": 2, "width": 32, "left_ir": grey, "right_ir": grey, "depth": [1000.0] * 64,
         "rgb": [255.0] * 192, "rgb_channels": 3},
    )
    frames = st.infer_disparity(frames.drop("disparity"), "ten")
    cfg = BuildConfig(
        pointcloud=PointCloudConfig(use_rgb=True, output_format="xyzrgb"),
        sampling=SamplingConfig("stride", 16),
        depth_mode="stereo",
        stereo=StereoConfig(),
    )
    cams = camera(spark, 32, 2, aligned=False, f=100.0, color_c=1.0, depth_c=1.0, t=(1e-6, 0.0, 0.0))
    stages = build(frames, cams, cfg)
    rows = stages.sampled.collect()
    assert len(rows) == 16 and {r.z for r in rows} == {0.5} and {r.red for r in rows} == {1.0}
    assert stages.meta.first().intrinsics == "ir1"
    assert {r.valid for r in stages.pixels.where("u >= 10").collect()} == {True}
    with pytest.raises(ValueError, match="unknown disparity backend"):
        st.infer_disparity(frames, "none")


def test_perception_needs_a_stereo_source(spark):
    frames = frame(spark, {"height": 3, "width": 3, "depth": [1.0] * 9})
    with pytest.raises(ValueError, match="stereo"):
        build(frames, camera(spark), RAW).pixels  # noqa: B018


def test_infrared_rules(spark):
    rows = frame(
        spark,
        {"height": 1, "width": 2, "left_ir": [0.0, 255.0]},
        {"height": 1, "width": 2, "left_ir": [0.0, 256.0]},
        {"height": 1, "width": 2, "left_ir": [math.nan, 1.0]},
        {"height": 1, "width": 2, "left_ir": [1.0]},
        {"height": 1, "width": 2, "left_ir": None},
    )
    report = st.ir_report(rows, KEYS, "left_ir", F.lit(1)).orderBy("frame_id").collect()
    assert [r.ir_ok for r in report] == [True, False, False, False, False]
    planes = st.ir_planes(rows.where("frame_id = 0"), KEYS, "left_ir", F.lit(1))
    assert sorted((r.channel, r.i, r.value) for r in planes.collect()) == [
        (c, i, v) for c in range(3) for i, v in enumerate((0.0, 255.0))
    ]
    with pytest.raises(Exception, match="range"):
        st.require_ir(rows.where("frame_id = 1"), "left_ir", F.lit(1)).select("left_ir").collect()


def test_depth_source_switch_takes_scale_and_lens_together(spark):
    frames = frame(spark, {"depth": [1000.0]}).join(
        camera(spark, 1, 1, aligned=True, scale=0.001, color_c=7.0, depth_c=9.0), "camera"
    ).withColumn("stereo_depth", F.array(F.lit(0.5).cast("float")))
    for stereo, scale, cx, name in ((True, 1.0, 9.0, "ir1"), (False, 0.001, 7.0, "color")):
        row = resolve_depth(frames, F.lit(stereo)).first()
        assert (row.effective_scale, row.k.cx, row.intrinsics) == (scale, cx, name)


def test_extent_of_an_empty_frame_is_zero(spark):
    row = cloud_extent(cloud(spark, []), key_table(spark, 3), KEYS).first()
    assert (row.n, row.min_x, row.max_z) == (0, 0.0, 0.0)


def test_plain_depth_and_clamp(spark):
    row = spark.createDataFrame([(1, 2.0), (5, 0.0), (5, 4.0), (0, math.nan)], "u int, d float")
    out = row.select(
        plain_depth(F.col("d"), F.col("u"), F.lit(5.0)).alias("z"), clamp_min(F.col("d"), 0.5).alias("c")
    ).collect()
    assert [r.z for r in out[:3]] == [0.0, math.inf, 1.25]
    assert [r.c for r in out] == [2.0, 0.5, 4.0, 0.5]


def test_upsample_rounds_half_to_even(spark):
    row = frame(spark, {"depth": [1.0, 2.0, 3.0, 4.0]})
    out = upsample(row, KEYS, "depth", (2, 2), (2, 4), 10.0).orderBy("i").collect()
    # Source positions -0.25, 0.25, 0.75, 1.25.
    assert [r.value for r in out] == [10.0, 10.0, 20.0, 20.0, 30.0, 30.0, 40.0, 40.0]


def test_configuration_from_a_mapping():
    raw = {
        "pointcloud": {"use_rgb": True, "output_format": "xyz"},
        "crop": {"x": [-1, 1]},
        "sampling": {"mode": "FPS", "num_points": 12, "stride": 0},
        "depth_source": {"mode": "network", "network": {"max_disp": 192, "backend": "a"}},
    }
    cfg = BuildConfig.from_mapping(raw, {"network": "network"})
    assert cfg.crop.enabled and cfg.crop.x == (-1.0, 1.0) and cfg.crop.z == (0.0, math.inf)
    assert (cfg.sampling.mode, cfg.sampling.stride, cfg.depth_mode) == ("fps", 1, "stereo")
    assert cfg.stereo.max_disp == 192 and cfg.pointcloud.use_rgb
    assert BuildConfig.from_mapping({}).sampling == SamplingConfig("voxel_random", 1024)
    flat = Extrinsics.from_mapping({"rotation_matrix_row_major": list(range(9)), "translation_m": [1, 2, 3]})
    assert flat.flat_rotation() == [float(i) for i in range(9)]


@pytest.mark.parametrize(
    "section, value",
    [
        ("crop", {"x": [1, -1]}),
        ("sampling", {"mode": "grid"}),
        ("sampling", {"num_points": 0}),
        ("sampling", {"voxel_size": 0}),
        ("sampling", {"pad_mode": "mirror"}),
        ("pointcloud", {"output_format": "ply"}),
        ("pointcloud", {"rgb_mapping": "nearest"}),
        ("depth_source", {"mode": "stereo"}),
        ("depth_source", {"mode": "stereo", "stereo": {"max_disp": 10}}),
        ("depth_source", {"mode": "stereo", "other": {"max_disp": 192}}),
        ("depth_source", {"mode": "fram", "stereo": {"max_disp": 192}}),
    ],
)
def test_bad_configuration_is_rejected(section, value):
    with pytest.raises(ValueError):
        BuildConfig.from_mapping({section: value})


def test_points_table_with_colours_keeps_them(spark):
    schema = "camera string, frame_id bigint, idx bigint, x float, y float, z float, red float"
    rows = points(spark, [("cam", 0, i, float(i), 0.0, 1.0, i / 10) for i in range(4)], schema)
    out = sample_points(rows, key_table(spark, 0), KEYS, SamplingConfig("voxel", 3, voxel_size=1.5), 64)
    assert [(r.x, round(r.red, 3)) for r in out.orderBy("slot").collect()] == [(0, 0.0), (2, 0.2), (3, 0.3)]
