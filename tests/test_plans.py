"""Shape of the physical plans that matter at scale."""

import re

from framecloud.catalog import QUERIES


def plan(spark, tiny, name):
    return QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()


def test_flagship_shuffles_packed_frames_once(spark, tiny):
    text = plan(spark, tiny, "frame_cloud")
    # One exchange of packed frames, one of the bare keys for empty frames.
    assert len(re.findall(r"\bExchange hashpartitioning", text)) == 2
    below_explode = text.split("Generate posexplode")[1]
    assert "Exchange hashpartitioning" in below_explode
    assert "BroadcastHashJoin" in below_explode and "Python" not in text


def test_only_needed_columns_are_read(spark, tiny):
    schemas = re.findall(r"ReadSchema: struct<([^>]*>?[^>]*)>", plan(spark, tiny, "frame_cloud"))
    assert any("embedding" in s for s in schemas)
    assert any("embedding" not in s and "vec_id" in s for s in schemas)


def test_lookup_reaches_the_scan(spark, tiny):
    assert "EqualTo(vec_id,123)" in plan(spark, tiny, "frame_lookup")


def test_voxel_aggregate_hashes_and_combines_before_the_shuffle(spark, tiny):
    text = plan(spark, tiny, "voxel_representatives")
    assert "partial_min_by" in text and "SortAggregate" not in text


def test_volumes_and_rasters_need_no_shuffle(spark, tiny):
    for name in ("planar_pad", "resize_pad", "upsample", "crop_raster", "contrast_stretch", "ir_planes"):
        assert "Exchange" not in plan(spark, tiny, name), name


def test_metadata_is_counted_where_the_frames_lie(spark, tiny):
    text = plan(spark, tiny, "color_meta")
    below = text.split("Generate posexplode")[0]
    assert "Python" not in text and below.count("Exchange hashpartitioning") <= 1


def test_bucketed_frames_are_not_shuffled(spark, tiny):
    from framecloud.catalog import views
    from framecloud.catalog.builds import PLAIN
    from framecloud.plans.build import build
    from framecloud.schema import FRAMES, KEYS

    frames = views.frames(spark, tiny).select(*FRAMES.fieldNames())
    spark.sql("drop table if exists bucketed_frames")
    frames.write.bucketBy(4, *KEYS).saveAsTable("bucketed_frames")
    try:
        table = spark.table("bucketed_frames")
        cameras = views.cameras(spark, tiny)
        bucketed = build(table, cameras, PLAIN, by_frame=True).sampled
        text = bucketed._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in text
        plain = build(frames, cameras, PLAIN, partitions=3).sampled
        assert sorted(map(tuple, bucketed.collect())) == sorted(map(tuple, plain.collect()))
    finally:
        spark.sql("drop table bucketed_frames")


def test_hot_groups_are_limited_before_the_shuffle(spark, tiny):
    text = plan(spark, tiny, "sample_random")
    assert text.count("Partial") >= 1 and "_salt" in text
