"""Live builds equal batch builds, also when a micro-batch is repeated."""

import pytest

from framecloud.catalog import views
from framecloud.catalog.builds import EMPTY, PLAIN
from framecloud.plans.build import build
from framecloud.schema import FRAMES
from framecloud.streaming.live import read_frames, run_live, write_batch

rows = lambda df: sorted(map(repr, df.collect()))


def test_drained_stream_equals_batch_in_every_stage(spark, tiny, tmp_path):
    frames = views.frames(spark, tiny).select(*FRAMES.fieldNames())
    cameras = views.cameras(spark, tiny)
    frames.repartition(6).write.parquet(str(tmp_path / "in"))
    paths = {s: str(tmp_path / s) for s in ("raw", "cropped", "sampled", "meta")}
    query = run_live(
        read_frames(spark, str(tmp_path / "in"), files_per_trigger=2),
        cameras, EMPTY, paths, str(tmp_path / "cp"), trigger={"availableNow": True},
    )
    query.awaitTermination()
    batch = build(frames, cameras, EMPTY, mode="live")
    for stage, path in paths.items():
        live = spark.read.parquet(path)
        assert live.select("batch_id").distinct().count() == 3
        want = getattr(batch, stage)
        assert rows(live.select(*want.columns)) == rows(want), stage


def test_repeated_batch_replaces_its_output(spark, tiny, tmp_path):
    frames = views.frames(spark, tiny).select(*FRAMES.fieldNames())
    cameras = views.cameras(spark, tiny)
    paths = {"sampled": str(tmp_path / "out")}
    for _ in range(2):
        write_batch(frames, 4, cameras, PLAIN, paths)
    assert spark.read.parquet(paths["sampled"]).count() == frames.count() * 16


def test_unknown_stage_is_refused(spark, tiny, tmp_path):
    with pytest.raises(ValueError, match="unknown stages"):
        run_live(None, None, PLAIN, {"mesh": "x"}, str(tmp_path))
