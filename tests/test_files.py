"""Readers and writers round trip in a temporary folder."""

import hashlib
import json

import numpy as np
import pytest
from helpers import cloud, frame, key_table
from pyspark.sql import functions as F

from framecloud.catalog import QUERIES
from framecloud.functions.files import write_files
from framecloud.operators import checks as ck
from framecloud.schema import KEYS
from framecloud.sinks import writers as out
from framecloud.sources.artifacts import hash_files, read_manifest
from framecloud.sources.calibration import calibration_of, read_calibration
from framecloud.sources.ply import read_ply, require_stages
from framecloud.sources.recorded import frame_at, read_frame_files, read_sidecar


def test_npz_and_npy_frames(spark, tmp_path):
    np.savez(
        tmp_path / "a.npz",
        left_ir=np.zeros((2, 2), np.uint8),
        right_ir=np.ones((2, 2), np.uint8),
        color=np.full((2, 2, 3), 7, np.uint8),
        timestamp=np.float64(12.5),
        global_frame_index=np.int64(7),
        unknown=np.zeros(3),
    )
    np.save(tmp_path / "b.npy", np.arange(6, dtype=np.uint16).reshape(2, 3))
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_frame_files(spark, str(tmp_path)).collect()}
    a, b = rows["a.npz"], rows["b.npy"]
    assert (a.frame_id, a.ts, a.height, a.width, a.rgb_channels, a.ir_channels) == (7, 12.5, 2, 2, 3, 1)
    assert a.rgb == [7.0] * 12 and a.right_ir == [1.0] * 4 and a.depth is None
    assert b.depth == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and (b.height, b.width) == (2, 3)


@pytest.mark.parametrize("kind", ["pickle", "text", "empty"])
def test_bad_frame_files_fail(spark, tmp_path, kind):
    if kind == "pickle":
        np.save(tmp_path / "a.npy", np.array({"depth": 1}, dtype=object), allow_pickle=True)
    elif kind == "text":
        (tmp_path / "a.txt").write_text("1")
    else:
        np.savez(tmp_path / "a.npz", other=np.zeros(1))
    with pytest.raises(Exception, match="pickle|unsupported frame file|no known frame arrays"):
        read_frame_files(spark, str(tmp_path)).collect()


def test_sidecar_scan_and_lookup(spark, tmp_path):
    rows = spark.range(20).withColumnRenamed("id", "global_frame_index")
    for chunk in range(2):
        part = rows.where(F.col("global_frame_index") % 2 == chunk).coalesce(1)
        folder = tmp_path / f"w{chunk}"
        part.write.parquet(str(folder))
        target = tmp_path / "data" / f"chunk-00{chunk}"
        target.mkdir(parents=True)
        next(folder.glob("part-*.parquet")).rename(target / "file-000.parquet")
    sidecar = read_sidecar(spark, str(tmp_path))
    assert sidecar.count() == 20
    assert [r.global_frame_index for r in frame_at(sidecar, 13).collect()] == [13]


def calibration(tmp_path):
    stream = lambda c: {"intrinsics": {"width": 640, "height": 480, "fx": 600.0, "fy": 600.0, "cx": 320.0, "cy": 240.0, "coeffs": c}}
    flat = {"rotation_matrix_row_major": [1, 0, 0, 0, 1, 0, 0, 0, 1.0], "translation_m": [-0.05, 0, 0]}
    rows = {"rotation": [[1, 0, 0], [0, 1.0, 0], [0, 0, 1]], "translation": [-0.05, 1e-5, 0]}

    def entry(ext, baseline):
        return {
            "streams": {"infrared1": stream([0, 0]), "infrared2": stream([0, 1e-12])},
            "extrinsics": {"infrared1_to_infrared2": ext, "infrared1_to_color": flat},
            "baseline": baseline,
        }

    cameras = {
        "head_rgb": entry(flat, {"recommended_baseline_m": 0.05, "baseline_m_abs_x": 9.0}),
        "left_wrist_rgb": entry(rows, {"baseline_m_abs_x": 0.05}),
        "extra": entry(rows, {}),
    }
    path = tmp_path / "calibration.json"
    path.write_text(json.dumps({"cameras": cameras}, indent=2))
    return str(path)


def test_calibration_with_aliases_and_baseline_fallback(spark, tmp_path):
    table = read_calibration(spark, calibration(tmp_path))
    wanted = spark.createDataFrame([("head",), ("left_wrist",), ("extra",), ("gone",)], "camera string")
    found = {r.asked: r for r in calibration_of(table, wanted).collect()}
    assert [found[n].baseline_m for n in ("head", "left_wrist", "extra")] == [0.05, 0.05, 0.0]
    assert found["head"].r == found["left_wrist"].r == [1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert found["left_wrist"].t == [-0.05, 1e-5, 0.0] and not found["gone"].found
    gate = ck.audit(table, ["camera"], ck.rectification_rules()).collect()
    assert {r.camera: r.ok for r in gate} == {"head_rgb": True, "left_wrist_rgb": True, "extra": False}
    with pytest.raises(Exception, match="baseline_positive"):
        ck.enforce(table, ck.rectification_rules(), F.col("camera")).collect()


def test_ply_round_trip(spark, tmp_path):
    points = cloud(spark, [(0.1, -2.0, 1e-5), (3.0, 4.5, 1e20)]).withColumns(
        {"red": F.lit(0.5).cast("float"), "green": F.lit(2.0).cast("float"), "blue": F.lit(-1.0).cast("float")}
    )
    path = str(tmp_path / "ply")
    out.write_ply(points, key_table(spark, 0), KEYS, path)
    text = next((tmp_path / "ply" / "camera=cam" / "frame_id=0").glob("part-*")).read_text()
    lines = text.splitlines()
    assert lines[:3] == ["ply", "format ascii 1.0", "element vertex 2"] and lines[9] == "end_header"
    small, big = float(np.float32(0.1)), float(np.float32(1e20))
    assert lines[10] == f"{small} -2.0 {float(np.float32(1e-5))} 127 255 0"
    assert lines[11] == f"3.0 4.5 {big} 127 255 0"
    back = read_ply(spark, path + "/*/*").orderBy("idx").collect()
    assert [(r.x, r.y, r.red) for r in back] == [(small, -2.0, 127), (3.0, 4.5, 127)]
    with pytest.raises(Exception, match="(?i)already exists"):
        out.write_ply(points, key_table(spark, 0), KEYS, path)


def test_empty_cloud_file_is_refused_and_missing_stages_are_listed(spark, tmp_path):
    for stage in ("raw", "cropped"):
        (tmp_path / "one").mkdir(exist_ok=True)
        (tmp_path / "one" / f"{stage}.ply").write_text("ply\nend_header\n1 2 3\n")
    read = read_ply(spark, str(tmp_path / "one"))
    assert read.where("red is null").count() == 2
    folders = spark.createDataFrame([("one",)], "directory string")
    assert [r.stage for r in require_stages(read, folders).collect()] == ["sampled"]
    (tmp_path / "one" / "sampled.ply").write_text("ply\nend_header\n")
    with pytest.raises(Exception, match="empty or invalid point cloud"):
        read_ply(spark, str(tmp_path / "one")).collect()


def test_artifacts_against_their_manifest(spark, tmp_path):
    folder = tmp_path / "artifacts"
    folder.mkdir()
    digest = {}
    for name in ("same.bin", "other.bin", "extra.bin"):
        (folder / name).write_bytes(name.encode())
        digest[name] = hashlib.sha256(name.encode()).hexdigest()
    records = [
        {"path": "/old/same.bin", "sha256": digest["same.bin"], "size": 8},
        {"name": "other.bin", "sha256": "0" * 64},
        {"path": "gone.bin", "sha256": "1" * 64},
        {"path": "/later/same.bin", "sha256": "2" * 64},
    ]
    (tmp_path / "manifest.json").write_text(json.dumps({"backend": "a", "artifacts": records}))
    names = ("same", "other", "extra", "gone")
    wanted = spark.createDataFrame([(f"file:{folder}/{n}.bin",) for n in names], "path string")
    manifest = read_manifest(spark, str(tmp_path / "manifest.json"))
    status = ck.artifact_status(manifest, hash_files(spark, str(folder)), wanted).collect()
    assert {r.path.rsplit("/", 1)[1][:-4]: r.status for r in status} == {
        "same": "ok", "other": "changed", "extra": "unrecorded", "gone": "missing",
    }


def test_precision_flags(spark):
    rows = spark.createDataFrame(
        [(1, "fp16", True, None), (2, "fp16", False, None), (3, "fp32", False, True)],
        "id int, precision string, engine boolean, post_engine boolean",
    )
    bad = ck.precision_mismatches(rows, ["id"], ["engine", "post_engine"]).collect()
    assert sorted((r.id, r.record) for r in bad) == [(2, "engine"), (3, "post_engine")]


def test_metadata_rasters_and_training_set(spark, tmp_path):
    meta = spark.createDataFrame([("cam", 0, 3)], "camera string, frame_id bigint, a_count int")
    out.write_metadata(meta, str(tmp_path / "meta"))
    line = spark.read.text(str(tmp_path / "meta")).first().value
    assert list(json.loads(line)) == ["a_count", "camera", "frame_id"]

    rasters = frame(spark, {"disparity": [1.5, 2.5], "depth": [3.0, 4.0]})
    out.write_rasters(rasters, KEYS, ["disparity", "depth"], str(tmp_path / "raster"))
    row = spark.read.parquet(str(tmp_path / "raster")).first()
    assert row.disparity == [1.5, 2.5] and row.depth == [3.0, 4.0]
    px = rasters.select(*KEYS, F.posexplode("depth").alias("i", "depth"))
    assert out.pack_raster(px, KEYS, "depth").first().depth == [3.0, 4.0]

    samples = spark.createDataFrame(
        [("cam", 0, s, float(s), 0.0, 1.0, False) for s in (2, 0, 1)],
        "camera string, frame_id bigint, slot int, x float, y float, z float, is_pad boolean",
    )
    out.write_training_set(samples, KEYS, str(tmp_path / "train"))
    assert (tmp_path / "train" / "camera=cam").is_dir()
    row = spark.read.parquet(str(tmp_path / "train")).first()
    assert row.x == [0.0, 1.0, 2.0] and row.num_points == 3


def test_metadata_keeps_null_fields(spark, tmp_path):
    out.write_metadata(spark.createDataFrame([(1, None)], "b int, a string"), str(tmp_path / "meta"))
    assert [r.value for r in spark.read.text(str(tmp_path / "meta")).collect()] == ['{"a":null,"b":1}']


def test_each_row_gets_a_file_of_its_own(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"text {k} é\n") for k in range(500)], "k bigint, v string")
    for _ in range(2):  # a repeated attempt leaves the same files
        write_files(rows, f"file:{tmp_path}/out", "k", "v", folders=7)
    found = spark.read.text(f"{tmp_path}/out", wholetext=True).selectExpr("value", "_metadata.file_path as path")
    assert {(r.path.rpartition("/")[2], r.value) for r in found.collect()} == {
        (str(k), f"text {k} é\n\n") for k in range(500)
    }
    assert found.count() == 500 and len(list((tmp_path / "out").iterdir())) <= 7
    write_files(rows.where("false"), f"{tmp_path}/none", "k", "v")
    assert spark.read.text(f"{tmp_path}/none", wholetext=True).count() == 0


@pytest.mark.parametrize("name", ["contract_files", "artifact_files"])
def test_many_files_lie_in_few_folders_and_contracts_are_read_once(spark, tiny, tmp_path, monkeypatch, name):
    monkeypatch.setattr("framecloud.catalog.checks.checkpoint_dir", lambda _: str(tmp_path))
    suppliers = spark.read.parquet(f"{tiny}/supplier.parquet")
    many = suppliers.crossJoin(spark.range(20)).withColumn("s_suppkey", F.expr("s_suppkey + id * 1000000")).drop("id")
    many.coalesce(1).write.parquet(str(tmp_path / "sf" / "supplier.parquet"))
    df = QUERIES[name](spark, str(tmp_path / "sf"))
    assert df.count() > 0
    folders = [p for base in tmp_path.glob(f"{name.split('_')[0]}*-*") for p in base.rglob("*") if p.is_dir()]
    assert 0 < len(folders) <= 2 * 64 + 2
    if name == "contract_files":
        assert "FileScan text" not in df._jdf.queryExecution().toString()
