"""Run contracts read from files, settings rules and hashes of large files."""

import hashlib
import json

import pytest
from helpers import cloud, key_table
from pyspark.sql import functions as F

from framecloud.operators import checks as ck
from framecloud.schema import KEYS
from framecloud.sinks.writers import ply_lines
from framecloud.sources.artifacts import hash_files, read_manifest
from framecloud.sources.contracts import (
    configured,
    contract_report,
    read_contracts,
    read_engine_configs,
    resolve_configs,
)

CONTRACT = {
    "backend": "plugin", "height": 480, "width": 640, "max_disp": 192, "valid_iters": 8,
    "precision": "fp16", "normalization_contract": "imagenet", "workspace_gib": 8,
    "input_names": ["left", "right"], "output_names": ["disparity"],
}
ONE = "1 as run"


def settings(spark, **change):
    values = {**CONTRACT, "run": 1, **change}
    schema = (
        "run int, backend string, height int, width int, max_disp int, valid_iters int, precision string,"
        " normalization_contract string, workspace_gib double, input_names array<string>, output_names array<string>"
    )
    names = [c.split()[0] for c in schema.split(", ")]
    row = tuple(float(values[n]) if n == "workspace_gib" and values[n] is not None else values[n] for n in names)
    return configured(spark.createDataFrame([row], schema), ["run"])


def report(spark, tmp_path, manifest=None, config=None, yaml=None, **change):
    (tmp_path / "m.json").write_text(json.dumps({**CONTRACT, **(manifest or {})}))
    (tmp_path / "c.yaml").write_text(yaml or json.dumps({**CONTRACT, **(config or {})}))
    found = contract_report(
        settings(spark, **change),
        read_contracts(spark, str(tmp_path / "m.json")).selectExpr(ONE, "contract"),
        read_engine_configs(spark, str(tmp_path / "c.yaml")).selectExpr(ONE, "contract"),
        ["run"],
    )
    return sorted((r.side, r.field, r.expected, r.found) for r in found.collect())


def test_equal_contracts_have_no_rows(spark, tmp_path):
    engines = {"engine": {"fp16": True}, "post_engine": {}, "feature_engine": "none"}
    assert report(spark, tmp_path, {**engines, "height": 480.0, "other": 1}) == []


def test_what_is_not_configured_is_not_compared(spark, tmp_path):
    other = {"workspace_gib": 4, "input_names": ["x"]}
    assert report(spark, tmp_path, other, workspace_gib=None, input_names=[]) == []


def test_each_difference_is_a_row(spark, tmp_path):
    got = report(spark, tmp_path, {"height": "480", "engine": {"fp16": False}, "output_names": None})
    assert got == [
        ("engines", "height", '"480"', "480.0"),
        ("manifest", "engine.fp16", "true", "false"),
        ("manifest", "height", "480.0", '"480"'),
        ("manifest", "output_names", '["disparity"]', None),
    ]


def test_settings_files_in_yaml(spark, tmp_path):
    yaml = "\n".join(f"{k}: {json.dumps(v)}" for k, v in CONTRACT.items() if k != "max_disp")
    assert report(spark, tmp_path, yaml=yaml) == [
        ("config", "max_disp", "192.0", None),
        ("engines", "max_disp", "192.0", None),
    ]
    with pytest.raises(Exception, match="cannot be parsed"):
        report(spark, tmp_path, yaml="a: [1")
    with pytest.raises(Exception, match="must be a JSON object"):
        report(spark, tmp_path, yaml="- 1")


@pytest.mark.parametrize("text", ["[1]", "null", '"x"', "no json"])
def test_manifest_must_be_an_object(spark, tmp_path, text):
    (tmp_path / "m.json").write_text(text)
    with pytest.raises(Exception, match="must be a JSON object"):
        read_manifest(spark, str(tmp_path / "m.json")).collect()
    with pytest.raises(Exception, match="must be a JSON object"):
        read_contracts(spark, str(tmp_path / "m.json")).collect()


def test_settings_file_of_an_engine(spark):
    rows = [
        ("explicit", "/a/e.engine", "/x/own.yaml", "/a/m.json", "d.yaml"),
        ("declared", "/a/e.engine", None, "/a/m.json", "d.yaml"),
        ("stem", "/a/e.engine", None, None, None),
        ("two stems", "/b/e.engine", None, None, None),
        ("only one", "/c/e.engine", None, None, None),
        ("several", "/a/other.engine", None, None, None),
        ("none", "/d/e.engine", None, None, None),
        ("gone", "/c/e.engine", "/c/gone.yaml", None, None),
    ]
    engines = spark.createDataFrame(rows, "id string, engine string, explicit string, manifest string, declared string")
    paths = ["file:///x/own.yaml", "/a/d.yaml", "/a/e.yaml", "/b/e.yaml", "/b/e.yml", "/c/z.yml", "/d/e.json"]
    configs = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r.id: (r.config, r.problem) for r in resolve_configs(engines, configs, ["id"]).collect()}
    assert got == {
        "explicit": ("file:///x/own.yaml", None),
        "declared": ("/a/d.yaml", None),
        "stem": ("/a/e.yaml", None),
        "two stems": (None, "ambiguous"),
        "only one": ("/c/z.yml", None),
        "several": (None, "ambiguous"),
        "none": (None, "missing"),
        "gone": (None, "missing"),
    }


def test_large_files_are_hashed_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("framecloud.sources.artifacts.BLOCK", 1000)
    data = {"a b.bin": b"y", "sub/c%d.bin": bytes(range(256)) * 40, "e.bin": b"x" * 10}
    for name, content in data.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    want = sorted((hashlib.sha256(c).hexdigest(), len(c)) for c in data.values())
    for limit in (-1, 10, 1 << 20):
        found = hash_files(spark, str(tmp_path), streamed_from=limit).collect()
        assert sorted((r.sha256, r.size) for r in found) == want


def test_camera_without_calibration_keeps_its_row(spark):
    schema = "camera string, baseline_m double"
    asked = spark.createDataFrame([("a", 0.05), ("b", 0.0), ("c", None), ("d", 0.05), ("e", 0.0)], schema)
    known = spark.createDataFrame([("a", 0.05), ("b", 0.07), ("c", 0.07), ("d", 0.06)], schema)
    got = {r.camera: r.agrees for r in ck.baseline_agreement(asked, known, ["camera"]).collect()}
    assert got == {"a": True, "b": True, "c": True, "d": False, "e": False}


def test_setting_rules(spark):
    rows = spark.createDataFrame(
        [("voxel", "zero", 1, 0.1), (None, "edge", 0, 0.0)],
        "sampling_mode string, pad_mode string, num_points int, voxel_size double",
    )
    good, bad = ck.audit(rows, ["num_points"], ck.sampling_rules()).orderBy(F.desc("num_points")).collect()
    assert good.ok and len(bad.violations) == 4


def test_ply_refuses_null_keys(spark):
    points = cloud(spark, [(0.1, 0.2, 0.3)]).withColumn("frame_id", F.lit(None).cast("bigint"))
    with pytest.raises(Exception, match="frame key is null"):
        ply_lines(points, key_table(spark, 0), KEYS).collect()
