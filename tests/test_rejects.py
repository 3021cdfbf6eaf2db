"""Input that must fail the job or be reported, never turn into empty clouds."""

import json

import numpy as np
import pytest
from helpers import camera, cloud, frame, key_table
from pyspark.sql import functions as F

from framecloud.config import BuildConfig, PointCloudConfig, SamplingConfig, StereoConfig
from framecloud.operators import parity as pa
from framecloud.operators import stereo as st
from framecloud.operators.assembly import assemble_frames, assembly_report, frame_completeness
from framecloud.operators.color import clamp01
from framecloud.operators.geometry import check_shape
from framecloud.operators.metadata import cloud_extent
from framecloud.operators.sampling import sample_points
from framecloud.plans.build import build, reject_report
from framecloud.schema import KEYS
from framecloud.sources.artifacts import read_manifest
from framecloud.sources.calibration import apply_calibration
from framecloud.sources.ply import read_ply
from framecloud.sources.recorded import read_frame_files

FOUR = SamplingConfig("stride", 4)
PLAIN = BuildConfig(sampling=FOUR)
STEREO = BuildConfig(sampling=FOUR, depth_mode="stereo", stereo=StereoConfig())
IMAGE = {"height": 3, "width": 3}


def one(spark, **change):
    return frame(spark, {**IMAGE, "depth": [1.0] * 9, "disparity": [1.0] * 9, **change})


@pytest.mark.parametrize("output", ["raw", "sampled", "meta"])
@pytest.mark.parametrize(
    "cfg, change, message",
    [
        (PLAIN, {"depth": None}, "depth image is missing"),
        (PLAIN, {"depth": []}, "depth image is missing"),
        (PLAIN, {"frame_id": None}, "frame key is null"),
        (PLAIN, {"camera": None}, "frame key is null"),
        (STEREO, {"disparity": None}, "disparity image is missing"),
        (STEREO, {"camera": "other"}, "unknown camera"),
    ],
)
def test_frames_that_give_no_cloud_fail(spark, cfg, change, message, output):
    stages = build(one(spark, **change), camera(spark, aligned=False), cfg)
    with pytest.raises(Exception, match=message):
        getattr(stages, output).collect()


def test_unknown_camera_fails_in_stereo_metadata(spark):
    cfg = BuildConfig(sampling=FOUR, depth_mode="stereo", stereo=StereoConfig(baseline_m=0.05))
    stages = build(one(spark, camera="other"), camera(spark, aligned=False), cfg)
    with pytest.raises(Exception, match="unknown camera"):
        stages.stereo_meta.collect()


def test_colour_without_channel_count_fails(spark):
    cfg = BuildConfig(pointcloud=PointCloudConfig(use_rgb=True), sampling=FOUR)
    with pytest.raises(Exception, match="three channels"):
        build(one(spark, rgb=[0.2] * 27), camera(spark), cfg).raw.collect()


def test_null_colour_stays_null(spark):
    values = spark.createDataFrame([(None,), (2.0,), (-1.0,)], "c float")
    assert [r.c for r in values.select(clamp01(F.col("c")).alias("c")).collect()] == [None, 1.0, 0.0]


def test_null_image_fails_the_shape_check(spark):
    with pytest.raises(Exception, match="depth image is missing"):
        check_shape(one(spark, depth=None), "depth", F.lit(3), F.lit(3)).collect()


def test_report_names_each_cause_once(spark):
    rows = [
        {},
        {"depth": None},
        {"depth": [1.0] * 8},
        {"camera": "other", "depth": [1.0] * 8},
        {"frame_id": None},
    ]
    frames = frame(spark, *[{**IMAGE, "depth": [1.0] * 9, "ts": float(j), **r} for j, r in enumerate(rows)])
    report = reject_report(frames, camera(spark), PLAIN, ["camera", "frame_id", "ts"])
    assert [r.violations for r in report.orderBy("ts").collect()] == [
        [],
        ["depth image is missing"],
        ["depth image does not match the camera"],
        ["unknown camera"],
        ["frame key is null"],
    ]
    # The null key goes by a filter: its check may run before a join.
    accepted = report.where("ok").select(*KEYS)
    keyed = frames.where("frame_id is not null")
    assert build(keyed.join(accepted, list(KEYS)), camera(spark), PLAIN).sampled.count() == FOUR.num_points


def test_null_keys_fail_in_operators_that_join_by_them(spark):
    keys, points = key_table(spark, 0, None), cloud(spark, [(0, 0, 1)])
    for made in (
        sample_points(points, keys, KEYS, FOUR, 9),
        frame_completeness(keys, points, KEYS),
        cloud_extent(points, keys, KEYS),
    ):
        with pytest.raises(Exception, match="frame key is null"):
            made.collect()


def test_frames_lacking_a_stream(spark):
    depth, ir, rgb = key_table(spark, 0, 1), key_table(spark, 0, 2), key_table(spark, 1)
    ir_image = ir.withColumn("left_ir", F.lit(1))
    with pytest.raises(Exception, match="without (infrared|depth)"):
        assemble_frames(depth, ir_image, None, KEYS).collect()
    found = {r.frame_id: r for r in assembly_report(depth, ir_image, rgb, KEYS).collect()}
    assert [found[i].complete for i in (0, 1, 2)] == [True, False, False]
    assert found[1].has_rgb and not found[1].has_ir and not found[2].has_depth


def rasters(spark, rows, schema="camera string, frame_id bigint, disparity array<float>, depth array<float>"):
    return spark.createDataFrame(rows, schema)


def test_missing_candidate_frames_are_not_covered(spark):
    full = [1.0, 2.0]
    reference = rasters(spark, [("cam", 0, full, full), ("cam", 1, full, full)])
    named = "camera string, frame_id bigint, backend string, disparity array<float>, depth array<float>"
    candidate = rasters(
        spark, [("cam", 0, "a", full, full), ("cam", 0, "b", full, full), ("cam", 1, "b", full, full)], named
    )
    px = pa.pair_rasters(reference, candidate, KEYS, ["disparity", "depth"])
    metrics = {r.backend: r for r in pa.parity_metrics(px, ["backend"]).collect()}
    assert (metrics["a"].reference_valid_count, metrics["a"].candidate_valid_count) == (4, 2)
    assert metrics["a"].valid_overlap_ratio == metrics["a"].finite_positive_ratio == 0.5
    checks = {r.backend: r.passed for r in pa.parity_checks(pa.parity_metrics(px, ["backend"]), ["backend"]).collect()}
    assert checks == {"a": False, "b": True}
    none = candidate.where("false")
    assert pa.pair_rasters(reference, none, KEYS, ["disparity", "depth"]).count() == 0


@pytest.mark.parametrize(
    "ref, cand, message", [([1.0, 2.0], [1.0], "differ in length"), (None, [1.0], "reference depth image is missing")]
)
def test_images_that_cannot_be_paired_fail(spark, ref, cand, message):
    schema = "camera string, frame_id bigint, depth array<float>"
    pair = [rasters(spark, [("cam", 0, image)], schema) for image in (ref, cand)]
    with pytest.raises(Exception, match=message):
        pa.pair_rasters(*pair, KEYS, ["depth"]).collect()


@pytest.mark.parametrize(
    "aligned, stereo, message",
    [
        (True, StereoConfig(), "not aligned to colour"),
        (False, StereoConfig(baseline_m=0.5), "baseline disagrees"),
    ],
)
def test_stereo_cameras_that_do_not_fit_fail(spark, aligned, stereo, message):
    cfg = BuildConfig(sampling=FOUR, depth_mode="stereo", stereo=stereo)
    stages = build(one(spark), camera(spark, aligned=aligned), cfg)
    for made in (stages.raw, stages.stereo_meta):
        with pytest.raises(Exception, match=message):
            made.collect()


@pytest.mark.parametrize("setting", [{"backend": "nope"}, {"rectification_mode": "opencv"}])
def test_stereo_settings_no_build_can_follow(spark, setting):
    cfg = BuildConfig(depth_mode="stereo", stereo=StereoConfig(**setting))
    with pytest.raises(ValueError, match="unknown disparity backend|rectify"):
        build(one(spark), camera(spark, aligned=False), cfg)


def test_build_runs_the_named_backend(spark):
    st.register_backend("five", lambda: lambda left, right: np.full(left.shape[1:], 5.0))
    images = {"height": 2, "width": 32, "left_ir": [1.0] * 64, "right_ir": [2.0] * 64}
    cfg = BuildConfig(
        sampling=SamplingConfig("stride", 16), depth_mode="stereo", stereo=StereoConfig(backend="five")
    )
    cams = camera(spark, 32, 2, aligned=False, f=100.0)
    stages = build(frame(spark, images), cams, cfg)
    assert {r.z for r in stages.sampled.collect()} == {1.0}
    meta = stages.stereo_meta.first()
    assert (meta.backend, meta.total, meta.valid) == ("five", 64, 54)
    with pytest.raises(Exception, match="right_ir is not a raw image"):
        build(frame(spark, {**images, "right_ir": None}), cams, cfg).sampled.collect()


def calibration(spark, baseline=0.05, shift=-0.05):
    lens = (2, 2, 50.0, 50.0, 1.0, 1.0)
    kind = "struct<width:int,height:int,fx:double,fy:double,cx:double,cy:double>"
    eye = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    schema = (
        f"camera string, left_k {kind}, right_k {kind}, left_distortion array<double>, right_distortion "
        "array<double>, r array<double>, t array<double>, color_r array<double>, color_t array<double>, "
        "baseline_m double"
    )
    row = ("cam", lens, lens, [0.0], [0.0], eye, [shift, 0.0, 0.0], eye, [0.01, 0.0, 0.0], baseline)
    return spark.createDataFrame([row], schema)


def test_calibration_replaces_the_depth_lens(spark):
    cams = camera(spark, aligned=False)
    row = apply_calibration(cams, calibration(spark)).first()
    assert row.asDict().keys() == set(cams.columns)
    assert (row.camera, row.depth_k.fx, row.t, row.baseline_m) == ("cam", 50.0, [0.01, 0.0, 0.0], 0.05)
    assert row.color_k.fx == 1.0


@pytest.mark.parametrize(
    "change, message",
    [({"baseline": 0.06, "shift": -0.06}, "disagrees"), ({"shift": 0.05}, "right_of_left"), (None, "no calibration")],
)
def test_calibration_that_does_not_fit_fails(spark, change, message):
    table = calibration(spark, **(change or {}))
    table = table if change else table.where("false")
    with pytest.raises(Exception, match=message):
        apply_calibration(camera(spark, aligned=False), table).collect()


def test_manifest_may_map_names_to_records_or_hashes(spark, tmp_path):
    recorded = {"a.bin": {"sha256": "11", "size": 3}, "b.bin": "22", "c.bin": None}
    (tmp_path / "m.json").write_text(json.dumps({"artifacts": recorded}))
    rows = read_manifest(spark, str(tmp_path / "m.json")).collect()
    assert {(r.path, r.sha256, r.size) for r in rows} == {("a.bin", "11", 3), ("b.bin", "22", None)}
    (tmp_path / "none.json").write_text("{}")
    assert read_manifest(spark, str(tmp_path / "none.json")).count() == 0


def test_cut_and_windows_clouds(spark, tmp_path):
    head = "ply\r\nformat ascii 1.0\r\nelement vertex {}\r\nend_header\r\n1 2 3\r\n4 5 6\r\n"
    (tmp_path / "ok.ply").write_text(head.format(2))
    rows = read_ply(spark, str(tmp_path / "ok.ply")).orderBy("idx").collect()
    assert [(r.idx, r.x, r.y, r.z, r.red) for r in rows] == [(0, 1, 2, 3, None), (1, 4, 5, 6, None)]
    (tmp_path / "cut.ply").write_text(head.format(5))
    with pytest.raises(Exception, match="names 5 vertices"):
        read_ply(spark, str(tmp_path / "cut.ply")).collect()


def test_frame_key_from_the_file_name(spark, tmp_path):
    folder = tmp_path / "head_rgb"
    folder.mkdir()
    np.save(folder / "frame_0042.npy", np.ones((2, 2)))
    row = read_frame_files(spark, str(folder)).first()
    assert (row.camera, row.frame_id) == ("head_rgb", 42)
    assert read_frame_files(spark, str(folder), camera="x").first().camera == "x"
