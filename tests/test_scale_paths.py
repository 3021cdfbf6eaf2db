"""Paths that only large or skewed groups take, against brute force."""

import numpy as np
import pandas as pd
import pytest
from helpers import key_table
from pyspark.sql import functions as F

from framecloud.config import SamplingConfig
from framecloud.functions import joins, order
from framecloud.operators import farthest, sampling
from framecloud.schema import KEYS


def skewed_cloud(spark, sizes, seed=1, grid=None, parts=5):
    """One frame per entry of ``sizes``; ``grid`` rounds coordinates so that ties occur."""
    rng = np.random.default_rng(seed)
    frames = []
    for frame_id, n in enumerate(sizes):
        xyz = rng.normal(size=(n, 3)).astype(np.float32)
        if grid:
            xyz = np.round(xyz / grid).astype(np.float32) * np.float32(grid)
        frames.append(
            pd.DataFrame(
                {"camera": "cam", "frame_id": frame_id, "idx": np.arange(n) * 3, **dict(zip("xyz", xyz.T))}
            )
        )
    pdf = pd.concat(frames).sample(frac=1.0, random_state=seed)
    schema = "camera string, frame_id bigint, idx bigint, x float, y float, z float"
    return spark.createDataFrame(pdf, schema).repartition(parts), pdf


def brute_farthest(pdf, k):
    out = {}
    for frame_id, g in pdf.groupby("frame_id"):
        g = g.sort_values("idx")
        p = g[["x", "y", "z"]].to_numpy(np.float32)
        dist = np.full(len(p), np.inf, np.float32)
        chosen = [0]
        while len(chosen) < min(k, len(p)):
            d = (p - p[chosen[-1]]) ** 2
            dist = np.minimum(dist, (d[:, 0] + d[:, 1]) + d[:, 2])
            chosen.append(int(np.argmax(dist)))
        out[frame_id] = g["idx"].to_numpy()[chosen].tolist()
    return out


@pytest.mark.parametrize("grid, front, cells", [(None, 4, 4), (0.5, 2, 3), (None, 1, 1)])
def test_farthest_points_of_oversized_frames(spark, grid, front, cells):
    k = 20 if cells > 1 else 5
    points, pdf = skewed_cloud(spark, [400, 30, 150, 3], grid=grid)
    out = farthest.farthest_points(
        points, KEYS, k, group_points=100, front_points=front, chunk_points=128, grid=cells
    )
    got = {f: g.sort_values("rank")["idx"].tolist() for f, g in out.toPandas().groupby("frame_id")}
    assert got == brute_farthest(pdf, k)


def test_farthest_points_of_identical_points(spark):
    points = spark.range(300).select(
        F.lit("cam").alias("camera"), F.lit(0).cast("bigint").alias("frame_id"),
        F.col("id").alias("idx"), *[F.lit(1.0).cast("float").alias(a) for a in "xyz"],
    )
    out = farthest.farthest_points(points, KEYS, 4, group_points=100, front_points=3, chunk_points=64, grid=2)
    assert [r.idx for r in out.orderBy("rank").collect()] == [0, 0, 0, 0]


def test_dense_index_of_a_hot_group(spark):
    rng = np.random.default_rng(3)
    n = 5000
    pdf = pd.DataFrame(
        {
            "k": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 50, n)),
            "a": rng.integers(-500, 500, n),
            "b": rng.permutation(n),
        }
    )
    out = order.dense_index(spark.createDataFrame(pdf), ["k"], ["a", "b"], 64, "pos").toPandas()
    want = pdf.sort_values(["k", "a", "b"]).assign(pos=lambda d: d.groupby("k").cumcount())
    merged = out.merge(want, on=["k", "a", "b"], suffixes=("", "_want"))
    assert len(merged) == n and (merged["pos"] == merged["pos_want"]).all()


def test_first_k_spreads_a_hot_group_without_changing_the_result(spark):
    points, _ = skewed_cloud(spark, [4000, 10, 700])
    plain = order.first_k(points, KEYS, ["idx"], 100, "rank")
    spread = order.first_k(points, KEYS, ["idx"], 100, "rank", spread=True)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, spread.collect()))


@pytest.mark.parametrize("nearest", [False, True])
@pytest.mark.parametrize("limit", [0, 50_000])
def test_order_statistics_inside_and_beyond_the_sketch(spark, monkeypatch, nearest, limit):
    monkeypatch.setattr(order, "SMALL_GROUP", limit)
    rng = np.random.default_rng(5)
    n = 60_000
    hot = pd.DataFrame({"g": "hot", "v": np.round(rng.lognormal(size=n), 3)})
    wide = pd.DataFrame({"g": "wide", "v": rng.normal(size=n) * 1e6})
    flat = pd.DataFrame({"g": "flat", "v": np.full(9_000, 2.5)})
    pdf = pd.concat([hot, wide, flat] + ([] if limit == 0 else [pd.DataFrame({"g": "one", "v": [4.0]})]))
    df = spark.createDataFrame(pdf).repartition(7)
    qs = {"p0": 0.0, "p01": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = order.order_statistics(
        df, ["g"], {"v": qs}, nearest_rank=nearest, also=[F.count(F.lit(1)).alias("n")]
    ).toPandas().set_index("g")
    for g, values in pdf.groupby("g")["v"]:
        ordered = np.sort(values.to_numpy())
        for name, q in qs.items():
            want = ordered[round((len(ordered) - 1) * q)] if nearest else np.percentile(ordered, q * 100)
            assert got.loc[g, name] == pytest.approx(want, rel=1e-12, abs=1e-12), (g, name)
        assert got.loc[g, "n"] == len(ordered)


def test_order_statistics_without_keys_and_with_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (4.0, None)], "v double, w double")
    row = order.order_statistics(df, [], {"v": {"m": 0.5}, "w": {"e": 0.5}}).first()
    assert (row.m, row.e) == (2.0, None)


MODES = [
    SamplingConfig("stride", 40, stride=3),
    SamplingConfig("random", 40, seed=1, deterministic=True),
    SamplingConfig("voxel", 40, voxel_size=0.5),
    SamplingConfig("voxel_random", 40, voxel_size=0.5, seed=1, deterministic=True),
    SamplingConfig("fps", 10),
    SamplingConfig("voxel_fps", 10, voxel_size=0.5),
]


@pytest.mark.parametrize("cfg", MODES, ids=[m.mode for m in MODES])
def test_samples_do_not_depend_on_partitioning_or_bound(spark, cfg):
    results = []
    for parts, bound in ((1, None), (7, None), (7, 10_000)):
        points, pdf = skewed_cloud(spark, [900, 20, 0, 60], parts=parts)
        frames = key_table(spark, 0, 1, 2, 3)
        out = sampling.sample_points(points, frames, KEYS, cfg, bound)
        results.append(sorted(map(tuple, out.collect())))
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 4 * cfg.num_points


def test_broadcast_hint_is_checked(spark):
    small, large = spark.range(10), spark.range(50)
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(joins.checked_broadcast(small, 20)).lower()
    assert "broadcast" not in plan(joins.checked_broadcast(large, 20)).lower()
