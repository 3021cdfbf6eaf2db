"""Farthest-point sampling, exact for frames of any size.

Frames up to ``GROUP_POINTS`` points run as one group each. A larger frame is
never gathered: its points stay in chunks that keep their distance to the chosen
set, and are assigned to the cells of a coarse grid. Each round takes the
farthest few points of every cell as a front and chooses greedily inside it. A
point outside the front is at most as far as the next point of its cell, and as
the far corner of its cell's box from any point chosen since; the choice goes on
while the best front point is farther than that bound for every cell. Float32
rounding is monotone, so the bound holds for rounded distances too.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framecloud.functions.checkpoints import cut
from framecloud.functions.order import first_k

GROUP_POINTS = 1 << 22
CHUNK_POINTS = 1 << 16
GRID = 16
FRONT_POINTS = 16


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _squared(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    d = points - at
    d *= d
    return (d[0] + d[1]) + d[2]


def greedy(points: np.ndarray, k: int) -> np.ndarray:
    """Positions of ``k`` farthest points of a 3 x n float32 array, starting at 0."""
    n = points.shape[1]
    chosen = np.zeros(min(n, k), dtype=np.int64)
    distance = np.full(n, np.inf, dtype=np.float32)
    for j in range(1, len(chosen)):
        last = points[:, chosen[j - 1], None]
        np.minimum(distance, _squared(points, last), out=distance)
        chosen[j] = distance.argmax()
    return chosen


def _xyz(table: pa.Table) -> np.ndarray:
    return np.stack([_column(table, c).astype(np.float32, copy=False) for c in "xyz"])


def _ranked_type(points: DataFrame) -> T.StructType:
    return T.StructType([*points.schema.fields, T.StructField("rank", T.IntegerType())])


def _whole_frames(points: DataFrame, keys: list[str], k: int) -> DataFrame:
    def sample(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        chosen = greedy(_xyz(table), k)
        rank = pa.array(np.arange(len(chosen), dtype=np.int32))
        return table.take(pa.array(chosen)).append_column("rank", rank)

    return points.groupBy(*keys).applyInArrow(sample, _ranked_type(points))


def farthest_points(
    points: DataFrame,
    keys: Sequence[str],
    k: int,
    frame_bound: int | None = None,
    group_points: int = GROUP_POINTS,
    front_points: int = FRONT_POINTS,
    chunk_points: int = CHUNK_POINTS,
    grid: int = GRID,
) -> DataFrame:
    """``k`` farthest points per frame with their 0-based ``rank``.

    ``frame_bound`` is a proven upper bound on points per frame, for example the
    image area; without one the frames are counted first.
    """
    keys = list(keys)
    if frame_bound is not None and frame_bound <= group_points:
        return _whole_frames(points, keys, k)
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *_box())
    large = cut(counts.where(F.col("_n") > group_points))
    if large.isEmpty():
        return _whole_frames(points, keys, k)
    small = points.join(large.select(*keys), keys, "left_anti")
    state = cut(_state(points.join(large, keys), keys, chunk_points, grid))
    split = _large_frames(state, keys, k, front_points)
    picked = split.join(points, [*keys, "idx"]).select(*points.columns, "rank")
    return _whole_frames(small, keys, k).unionByName(picked)


def _box() -> list:
    return [fn(a).alias(f"_{name}_{a}") for a in "xyz" for name, fn in (("lo", F.min), ("hi", F.max))]


def _state(points: DataFrame, keys: list[str], chunk_points: int, grid: int) -> DataFrame:
    """Points of large frames with chunk, grid cell and an infinite distance."""
    cell = F.lit(0)
    for a in "xyz":
        low, width = F.col(f"_lo_{a}"), F.col(f"_hi_{a}") - F.col(f"_lo_{a}")
        step = F.floor((F.col(a) - low) / F.when(width > 0, width) * grid)
        cell = cell * grid + F.least(F.coalesce(step, F.lit(0)), F.lit(grid - 1))
    return points.select(
        *keys,
        "_n",
        F.col("idx").cast("bigint").alias("idx"),
        *"xyz",
        F.expr(f"cast(idx as bigint) div {chunk_points}").alias("_chunk"),
        cell.cast("int").alias("_cell"),
        F.lit(float("inf")).cast("float").alias("_dist"),
    )


def _large_frames(state: DataFrame, keys: list[str], k: int, front_points: int) -> DataFrame:
    """(keys, idx, rank) of the chosen points of frames too large for one group."""
    boxes = cut(state.groupBy(*keys, "_cell").agg(*_box()))
    first = first_k(state, keys, ["idx"], 1, "rank", spread=True)
    chosen = fresh = cut(first.select(*keys, "_n", "idx", *"xyz", "rank"))
    order = [F.col("_dist").desc(), F.col("idx")]
    while True:
        done = chosen.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_have"), F.first("_n").alias("_n")
        )
        open_frames = cut(done.where(F.col("_have") < F.least(F.lit(k), F.col("_n"))))
        if open_frames.isEmpty():
            return chosen.select(*keys, "idx", "rank")
        state = cut(_nearer(state.join(open_frames.select(*keys), keys, "left_semi"), fresh, keys))
        front = first_k(state, [*keys, "_cell"], order, front_points + 1, "_place", spread=True)
        front = front.join(boxes, [*keys, "_cell"]).join(open_frames.select(*keys, "_have"), keys)
        fresh = cut(_front_greedy(front, keys, k, front_points))
        chosen = cut(chosen.unionByName(fresh))


def _nearer(state: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Lower each point's distance by the points chosen since the last round."""
    chunks = state.select(*keys, "_chunk").distinct()
    joined = chunks.join(fresh.select(*keys, *"xyz"), keys)
    # Fresh column identities, as both sides of the cogroup stem from ``state``.
    reach = joined.select(*[F.col(c).alias(c) for c in joined.columns])
    schema = state.schema

    def lower(points: pa.Table, targets: pa.Table) -> pa.Table:
        at = _xyz(points)
        distance = _column(points, "_dist").astype(np.float32)
        goals = _xyz(targets)
        for j in range(goals.shape[1]):
            np.minimum(distance, _squared(at, goals[:, j, None]), out=distance)
        place = points.schema.get_field_index("_dist")
        return points.set_column(place, "_dist", pa.array(distance, pa.float32()))

    by = [*keys, "_chunk"]
    return state.groupBy(*by).cogroup(reach.groupBy(*by)).applyInArrow(lower, schema)


def _far_corner(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Squared distance from a point to the farthest corner of each box."""
    reach = np.maximum(np.abs(low - at), np.abs(high - at))
    reach *= reach
    return (reach[0] + reach[1]) + reach[2]


def _front_greedy(front: DataFrame, keys: list[str], k: int, front_points: int) -> DataFrame:
    """Greedy choice inside each front for as long as no point outside can win."""
    kept = [*keys, "_n", "idx", "x", "y", "z"]
    fields = [f for f in front.schema.fields if f.name in kept]
    schema = T.StructType(
        [*sorted(fields, key=lambda f: kept.index(f.name)), T.StructField("rank", T.IntegerType())]
    )

    def box(table: pa.Table, side: str, rows: np.ndarray) -> np.ndarray:
        return np.stack([_column(table, f"_{side}_{a}")[rows] for a in "xyz"])

    def sample(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        place = _column(table, "_place")
        distance = _column(table, "_dist").astype(np.float32)
        have, total = (int(_column(table, c)[0]) for c in ("_have", "_n"))
        inside = np.flatnonzero(place < front_points)
        # The next point of a cell bounds all that its front leaves out.
        rest = np.flatnonzero(place == front_points)
        bound, low, high = distance[rest], box(table, "lo", rest), box(table, "hi", rest)
        at, near = _xyz(table)[:, inside], distance[inside]
        picks = []
        while have + len(picks) < min(k, total):
            best = int(near.argmax())
            # All distances are exact at first, so the first choice always holds.
            if picks and len(bound) and near[best] <= bound.max():
                break
            picks.append(best)
            last = at[:, best, None]
            np.minimum(near, _squared(at, last), out=near)
            np.minimum(bound, _far_corner(low, high, last), out=bound)
        rank = pa.array(np.arange(have, have + len(picks), dtype=np.int32))
        rows = table.select(kept).take(pa.array(inside[np.array(picks, dtype=np.int64)]))
        return rows.append_column("rank", rank)

    return front.groupBy(*keys).applyInArrow(sample, schema)
