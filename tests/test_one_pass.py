"""Outputs of one pass equal those built one by one, and share scan, shuffle and explosion."""

from dataclasses import replace

import numpy as np
import pytest
from helpers import camera, frame

from framecloud.catalog import views
from framecloud.catalog.builds import COLORED, PLAIN, STEREO
from framecloud.config import BuildConfig, CropConfig, SamplingConfig, StereoConfig
from framecloud.operators.stereo import register_backend, stage_breakdown
from framecloud.plans.build import build
from framecloud.plans.one_pass import OnePass
from framecloud.schema import FRAMES, KEYS

MODES = ["random", "stride", "fps", "voxel", "voxel_fps", "voxel_random", "off"]


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def stages_of(spark, folder, cfg):
    cameras = views.stereo_cameras if cfg.depth_mode == "stereo" else views.cameras
    return build(views.frames(spark, folder), cameras(spark, folder), cfg)


def with_mode(cfg, mode):
    if mode == "off":
        return replace(cfg, sampling=replace(cfg.sampling, enabled=False))
    return replace(cfg, sampling=replace(cfg.sampling, mode=mode))


@pytest.mark.parametrize("mode", MODES)
def test_samples_and_metadata_are_the_same(spark, tiny, mode):
    cfg = with_mode(PLAIN, mode)
    apart = stages_of(spark, tiny, cfg)
    with OnePass(stages_of(spark, tiny, cfg)) as once:
        assert rows(once.sampled) == rows(apart.sampled)
        assert rows(once.meta) == rows(apart.meta)
        assert rows(once.raw) == rows(apart.raw) and rows(once.cropped) == rows(apart.cropped)


@pytest.mark.parametrize("mode", ["voxel_random", "stride", "off"])
def test_coloured_outputs_are_the_same(spark, tiny, mode):
    cfg = with_mode(COLORED, mode)
    apart = stages_of(spark, tiny, cfg)
    with OnePass(stages_of(spark, tiny, cfg)) as once:
        assert rows(once.sampled) == rows(apart.sampled)
        assert rows(once.meta) == rows(apart.meta)


@pytest.mark.parametrize("invisible", [True, False])
@pytest.mark.parametrize("mode", ["voxel_random", "random"])
def test_stereo_outputs_are_the_same(spark, tiny, mode, invisible):
    cfg = with_mode(replace(STEREO, stereo=replace(STEREO.stereo, remove_invisible=invisible)), mode)
    apart = stages_of(spark, tiny, cfg)
    with OnePass(stages_of(spark, tiny, cfg)) as once:
        assert rows(once.sampled) == rows(apart.sampled)
        assert rows(once.meta) == rows(apart.meta)
        assert rows(once.stereo_meta) == rows(apart.stereo_meta)
        assert rows(once.breakdown) == rows(stage_breakdown(apart.pixels, apart.meta, KEYS, cfg.stereo))


def nodes(plan):
    """Operators of a plan that ran; what a kept table holds lies below its leaf."""
    name = plan.nodeName()
    yield plan
    if name.startswith("AdaptiveSparkPlan"):
        below = [plan.executedPlan()]
    elif "QueryStage" in name:
        below = [plan.plan()]
    else:
        below = [plan.children().apply(k) for k in range(plan.children().size())]
    for child in below:
        yield from nodes(child)


def texts(df):
    return [n.simpleString(1000) for n in nodes(df._jdf.queryExecution().executedPlan())]


def test_images_are_read_shuffled_and_exploded_once(spark, tiny, tmp_path):
    """Every output reads the kept cells; below them lie one scan, exchange and explosion."""
    views.frames(spark, tiny).select(*FRAMES.fieldNames()).write.parquet(f"{tmp_path}/frames")
    frames = spark.read.parquet(f"{tmp_path}/frames")
    with OnePass(build(frames, views.stereo_cameras(spark, tiny), STEREO)) as once:
        manager = spark._jsparkSession.sharedState().cacheManager()
        kept = manager.lookupCachedData(once.cells._jdf).get().cachedRepresentation().cacheBuilder().cachedPlan()
        lines = [n.simpleString(1000) for n in nodes(kept)]
        assert sum("Generate posexplode" in t for t in lines) == 1
        assert sum(t.startswith("Exchange hashpartitioning") for t in lines) == 1
        assert sum("disparity" in t and t.startswith("FileScan") for t in lines) == 1
        for out in (once.sampled, once.meta, once.stereo_meta, once.breakdown):
            lines = texts(out)
            assert any(t.startswith("InMemoryTableScan") for t in lines)
            assert not any("posexplode" in t for t in lines)
            assert not any(t.startswith("FileScan") and "disparity" in t for t in lines)
            # Cells and their counts stay where they are; only keys and camera columns move.
            plan = out._jdf.queryExecution().executedPlan()
            for moved in (n for n in nodes(plan) if n.nodeName() == "Exchange"):
                below = [n.simpleString(200) for n in nodes(moved)]
                assert not any(t.startswith("InMemoryTableScan") for t in below), below


def test_nothing_stays_in_the_store(spark, tiny):
    context = spark.sparkContext._jsc.sc()
    before = context.getPersistentRDDs().size()
    with OnePass(stages_of(spark, tiny, PLAIN)) as once:
        once.sampled.count()
        assert context.getPersistentRDDs().size() > before
    assert context.getPersistentRDDs().size() == before


def test_a_model_sees_each_frame_once(spark, tmp_path):
    """Four outputs of a stereo build, one call of the backend for each frame."""
    log = tmp_path / "calls"
    log.mkdir()

    def factory():
        import uuid

        def model(left, right):
            (log / uuid.uuid4().hex).write_text("x")
            return np.full(left.shape[1:], 2.0, np.float32)

        return model

    register_backend("counting", factory)
    image = [1.0] * 12
    frames = frame(spark, *[{"left_ir": image, "right_ir": image, "height": 3, "width": 4} for _ in range(5)])
    cameras = camera(spark, 4, 3, aligned=False)
    cfg = BuildConfig(
        depth_mode="stereo",
        stereo=StereoConfig(backend="counting", baseline_m=0.05, remove_invisible=False),
        sampling=SamplingConfig("voxel_random", 4, voxel_size=0.01, seed=1, deterministic=True),
    )
    with OnePass(build(frames, cameras, cfg)) as once:
        for out in (once.sampled, once.meta, once.stereo_meta, once.breakdown, once.pixels, once.raw):
            assert out.count()
    assert len(list(log.iterdir())) == 5


def test_a_repeated_frame_key_fails_every_output(spark):
    cfg = BuildConfig(crop=CropConfig(), sampling=SamplingConfig("random", 4, seed=1, deterministic=True))
    frames = frame(spark, {"frame_id": 1, "depth": [1.0] * 9}, {"frame_id": 1, "depth": [2.0] * 9}, {"frame_id": 2, "depth": [0.0] * 9})
    for make in (lambda: build(frames, camera(spark), cfg), lambda: OnePass(build(frames, camera(spark), cfg))):
        for name in ("sampled", "meta"):
            with pytest.raises(Exception, match="more than once"):
                getattr(make(), name).collect()
    with OnePass(build(frames.where("frame_id = 2"), camera(spark), cfg)) as once:
        assert once.sampled.count() == 4 and once.meta.first().num_raw_points == 0
