"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree halves a bounded sample by the median along the difference of two random
members until few are left. All vectors descend to one leaf per tree. A query takes
leaves from one priority queue shared by all trees, those its point lies farthest
inside first, and what the leaves hold is ranked by exact cosine.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framecloud.functions.joins import checked_broadcast
from framecloud.functions.order import first_k
from framecloud.llm.storage import written

TREES = 12
#: Bound of the sample that the trees are fitted on; every vector is indexed.
SAMPLE = 40_000
#: Vectors a leaf should hold, and the fewest sample members it may.
LEAF_ROWS, LEAF_SAMPLE = 256, 8
#: Queries compared with all vectors to learn how many a search must look at, and the recall wanted there.
PROBES, PROBE_RECALL = 64, 0.96
#: Components of the vectors that one task ranks at a time, about.
GROUP_VALUES = 2_000_000
#: Points whose distances from all planes are held at a time.
MARGIN_ROWS = 64


@dataclass(frozen=True)
class Forest:
    """Flat trees. ``below`` holds child nodes; a negative child is leaf -child - 1."""

    planes: np.ndarray
    cuts: np.ndarray
    below: np.ndarray
    roots: np.ndarray
    leaves: int

    @staticmethod
    def fit(sample: np.ndarray, trees: int, leaf: int, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        planes, cuts, below, roots = [], [], [], []
        leaves = 0

        def grow(members: np.ndarray) -> int:
            nonlocal leaves
            left = right = members[:0]
            for _ in range(3 if len(members) > leaf else 0):
                a, b = sample[rng.choice(members, 2, replace=False)].astype(np.float64)
                plane = a - b
                size = np.linalg.norm(plane)
                if size == 0:
                    continue
                plane /= size
                along = sample[members] @ plane
                cut = float(np.median(along))
                left, right = members[along < cut], members[along >= cut]
                if len(left) and len(right):
                    break
            if len(left) == 0 or len(right) == 0:
                leaves += 1
                return -leaves
            node = len(planes)
            planes.append(plane)
            cuts.append(cut)
            below.append((0, 0))
            below[node] = (grow(left), grow(right))
            return node

        for _ in range(trees):
            roots.append(grow(np.arange(len(sample))))
        width = sample.shape[1] if sample.ndim == 2 else 1
        return Forest(
            np.array(planes, np.float64).reshape(-1, width),
            np.array(cuts, np.float64),
            np.array(below, np.int64).reshape(-1, 2),
            np.array(roots, np.int64),
            leaves,
        )

    def leaves_of(self, points: np.ndarray) -> np.ndarray:
        """Leaf of each point in each tree."""
        out = np.empty((len(points), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(points), root)
            inner = np.flatnonzero(node >= 0)
            while len(inner):
                at = node[inner]
                side = np.einsum("ij,ij->i", points[inner], self.planes[at]) >= self.cuts[at]
                node[inner] = self.below[at, side.astype(np.int64)]
                inner = inner[node[inner] >= 0]
            out[:, t] = -node - 1
        return out

    def margins(self, points: np.ndarray) -> Iterator[np.ndarray]:
        """How far each point lies beyond each plane, some points at a time."""
        for start in range(0, len(points), MARGIN_ROWS):
            beyond = points[start : start + MARGIN_ROWS] @ self.planes.T
            beyond -= self.cuts
            yield from beyond

    @cached_property
    def children(self) -> list[list[int]]:
        return self.below.tolist()

    def walk(self, margins: np.ndarray) -> Iterator[int]:
        """Leaves of all trees, those the point of these margins lies farthest inside first."""
        children, margin_of, push, pop = self.children, margins.item, heapq.heappush, heapq.heappop
        queue = [(-np.inf, int(r)) for r in self.roots]
        heapq.heapify(queue)
        while queue:
            outside, node = pop(queue)
            while node >= 0:
                margin = margin_of(node)
                left, right = children[node]
                if margin >= 0:
                    push(queue, (margin if margin > outside else outside, left))
                    node = right
                else:
                    push(queue, (-margin if -margin > outside else outside, right))
                    node = left
            yield -node - 1

    def search(self, margins: np.ndarray, sizes: list[int], enough: int) -> list[int]:
        """Leaves, best first, until they hold ``enough`` vectors together."""
        found, held = [], 0
        for leaf in self.walk(margins):
            found.append(leaf)
            held += sizes[leaf]
            if held >= enough:
                break
        return found


def usable(vector: str) -> Column:
    """A vector with a length whose components are all there and finite."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def cosine(a: str, b: str) -> Column:
    """Cosine in double precision, summed in order of the components."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = (F.col(c).cast("array<double>") for c in (a, b))
    return dot(x, y) / (F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def unit_rows(column: pa.Array) -> np.ndarray:
    points = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    points /= np.abs(points).max(1, keepdims=True, initial=1e-300)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def nearest_rows(asking: np.ndarray, visits: pa.Array, stored: np.ndarray, leaf: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and places of the ``keep`` nearest ``stored`` rows of the leaves each asking row visits.

    ``stored`` lies by ``leaf`` and holds no vector twice. Each leaf is compared with all that
    visit it at once. Where fewer rows are visited, places are -1.
    """
    visitors = np.repeat(np.arange(len(asking)), visits.value_lengths().to_numpy())
    visited = visits.flatten().to_numpy()
    by_leaf = np.argsort(visited, kind="stable")
    visitors, visited = visitors[by_leaf], visited[by_leaf]
    scores = np.full((len(asking), keep), -np.inf)
    places = np.full((len(asking), keep), -1)
    for here, first, size in zip(*np.unique(leaf, return_index=True, return_counts=True), strict=True):
        present = visitors[np.searchsorted(visited, here, "left") : np.searchsorted(visited, here, "right")]
        step = max(1, GROUP_VALUES // size)
        for start in range(0, len(present), step):
            rows = present[start : start + step]
            near = asking[rows] @ stored[first : first + size].T
            left = np.arange(len(rows))
            # The largest takes the place of the worst kept, until no row has a larger one.
            while len(left):
                best, worst = near[left].argmax(1), scores[rows[left]].argmin(1)
                better = near[left, best] > scores[rows[left], worst]
                left, best, worst = left[better], best[better], worst[better]
                scores[rows[left], worst], places[rows[left], worst] = near[left, best], first + best
                near[left, best] = -np.inf
    return scores, places


def enough_for(forest: Forest, held: np.ndarray, points: DataFrame, placed: DataFrame, asked: DataFrame, k: int) -> int:
    """Vectors to look at for ``PROBE_RECALL``, measured on ``PROBES`` queries.

    Their nearest points are found by comparing them with all points, in batches; a
    search in full then tells after how many vectors each of those turns up.
    """
    probes = points.select("node", "v").join(asked, "node").orderBy(F.xxhash64("node")).limit(PROBES)
    probes = probes.select("node", "v").toArrow().combine_chunks()
    nodes, asking = probes.column("node").to_numpy(), unit_rows(probes.column("v").combine_chunks())
    shared = points.sparkSession.sparkContext.broadcast((nodes, asking))

    def compare(batches):
        own, q = shared.value
        for batch in batches:
            node = batch.column(0).to_numpy()
            near = q @ unit_rows(batch.column(1)).T
            near[own[:, None] == node] = -np.inf
            best = np.argpartition(-near, min(k, len(node)) - 1, axis=1)[:, :k]
            columns = np.repeat(own, best.shape[1]), node[best].ravel(), np.take_along_axis(near, best, 1).ravel()
            yield pa.record_batch([pa.array(c) for c in columns], names=["query", "node", "near"])

    found = points.select("node", "v").mapInArrow(compare, "query bigint, node bigint, near double")
    order = W.partitionBy("query").orderBy(F.col("near").desc(), "node")
    found = found.where("near >= -1").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    wanted: dict[int, list[set[int]]] = {}
    for r in found.join(placed, "node").select("query", "leaves").collect():
        wanted.setdefault(r["query"], []).append(set(r["leaves"]))
    looked = []
    for node, margins in zip(nodes.tolist(), forest.margins(asking), strict=True):
        missing, seen = wanted.get(node, []), 0
        for leaf in forest.walk(margins):
            if not missing:
                break
            seen += int(held[leaf])
            looked += [seen] * sum(leaf in m for m in missing)
            missing = [m for m in missing if leaf not in m]
    return int(np.quantile(looked, PROBE_RECALL, method="higher")) if looked else 1


def nearest(
    vectors: DataFrame,
    is_query: Column,
    folder: str,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    trees: int = TREES,
    search: int | None = None,
) -> DataFrame:
    """query_id, rank, ``key`` and score of the ``k`` nearest found for each query row.

    Candidates are all rows but those with the query's own id; ties go to the
    smaller id. Null, zero and non-finite vectors and null ids take no part, nor do
    vectors of another length than the longest. Repeated rows count once. Fewer
    candidates than ``k`` give fewer rows and an empty table none.

    Equal vectors are indexed and searched once, with their ``k + 1`` smallest ids,
    so a vector that a third of the rows share is one point. A search looks at
    ``search`` vectors, counted once per tree; by default at so many that a bounded
    number of queries, compared with all vectors, find ``PROBE_RECALL`` of their
    nearest. ``folder`` receives the intermediate tables.
    """
    rows = vectors.where(usable(vector) & F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"), is_query.alias("asks")
    )
    sizes = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.where(F.size("v") == sizes).withColumn("h", F.xxhash64("v"))
    # Most vectors stand in one row, which is a point as it is; only the others are ranked by id.
    often = checked_broadcast(written(rows.groupBy("h").count().where("count > 1").select("h"), f"{folder}/often"))
    alone = rows.join(often, "h", "left_anti").select("h", "v", F.array("id").alias("ids"), F.coalesce("asks", F.lit(False)).alias("asks"))
    shared = rows.join(often, "h", "left_semi")
    ids = first_k(shared.select("h", "v", "id").distinct(), ["h", "v"], ["id"], k + 1, "_r", spread=True)
    ids = ids.groupBy("h", "v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    points = alone.unionByName(ids.withColumn("asks", F.lit(None).cast("boolean")))
    points = written(points.withColumn("node", F.monotonically_increasing_id()), f"{folder}/points")
    of_shared = shared.where("asks").select("h", "v", F.col("id").alias("query_id")).distinct()
    of_shared = of_shared.join(points.where("asks is null").select("h", "v", "node"), ["h", "v"]).select("query_id", "node")
    asked = points.where("asks").select(F.col("ids")[0].alias("query_id"), "node").unionByName(of_shared)
    asked = written(asked, f"{folder}/asked")
    asking_nodes = checked_broadcast(asked.select("node").distinct())
    total = points.count()
    if total == 0:
        return asked.select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias(key), F.lit(0.0).alias("score"))

    sample = points.orderBy(F.xxhash64("h"), "node").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    leaf = max(LEAF_SAMPLE, LEAF_ROWS * min(SAMPLE, total) // total)
    forest = Forest.fit(unit_rows(sample), trees, leaf)
    model = vectors.sparkSession.sparkContext.broadcast(forest)

    def place(batches):
        for batch in batches:
            at = model.value.leaves_of(unit_rows(batch.column(1)))
            yield pa.record_batch([batch.column(0), pa.array(list(at), pa.list_(pa.int64()))], names=["node", "leaves"])

    placed = points.select("node", "v").mapInArrow(place, "node bigint, leaves array<bigint>")
    placed = written(placed, f"{folder}/placed")
    held = np.zeros(forest.leaves, np.int64)
    # One count per leaf of the model, whose size the sample bounds.
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        held[r["leaf"]] = r["count"]
    if search is None:
        search = enough_for(forest, held, points, placed, asking_nodes, k)
    # Leaves that follow each other lie close together, so a query visits few groups of them.
    # No group has leaves of two trees, so it holds each vector once.
    room = max(1, GROUP_VALUES // sizes)
    tree, inside = np.divmod(np.cumsum(held) - held, total)
    group_of = tree * -(-total // room) + inside // room
    parts = np.ceil(np.bincount(group_of, held) / (2 * room)).astype(int).clip(1).tolist()
    kind, counts = vectors.schema[vector].dataType.simpleString(), held.tolist()

    def look(batches):
        for batch in batches:
            rows, groups, leaves = [], [], []
            for row, margins in enumerate(model.value.margins(unit_rows(batch.column(1)))):
                found = np.sort(np.array(model.value.search(margins, counts, search)))
                of = group_of[found]
                for some in np.split(found, np.flatnonzero(np.diff(of)) + 1):
                    rows.append(row)
                    groups.append(int(group_of[some[0]]))
                    leaves.append(some)
            seeking = batch.take(pa.array(rows, pa.int64()))
            columns = [*seeking.columns, pa.array(groups, pa.int64()), pa.array(leaves, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, names=["node", "v", "group", "leaves"])

    # As many rows as the forest has leaves, which the sample bounds.
    grouped = vectors.sparkSession.createDataFrame(
        [(leaf, g, parts[g]) for leaf, g in enumerate(group_of.tolist())], "leaf bigint, group bigint, parts int"
    )
    seekers = points.select("node", "v").join(asking_nodes, "node").select("node", "v")
    visits = seekers.mapInArrow(look, f"node bigint, v {kind}, group bigint, leaves array<bigint>")
    of_group = grouped.select("group", "parts").distinct()
    visits = visits.join(F.broadcast(of_group), "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    visits = visits.select("node", "v", "leaves", "group", "part")
    stored = points.select("node", "v").join(placed, "node").select("node", "v", F.explode("leaves").alias("leaf"))
    stored = stored.join(F.broadcast(grouped), "leaf")
    stored = stored.select("node", "v", "leaf", "group", F.expr("cast(pmod(xxhash64(node), parts) as int)").alias("part"))
    keep = k + 1
    found = pa.schema({"query": pa.int64(), "node": pa.int64(), "near": pa.float64()})

    def rank(seeking: pa.Table, holding: pa.Table) -> pa.Table:
        """The nearest of the leaves each query visits in this group."""
        if not seeking.num_rows or not holding.num_rows:
            return found.empty_table()
        holding = holding.sort_by("leaf")
        scores, places = nearest_rows(
            unit_rows(seeking.column("v").combine_chunks()),
            seeking.column("leaves").combine_chunks(),
            unit_rows(holding.column("v").combine_chunks()),
            holding.column("leaf").to_numpy(),
            keep,
        )
        row, nth = np.nonzero(places >= 0)
        columns = seeking.column("node").to_numpy()[row], holding.column("node").to_numpy()[places[row, nth]], scores[row, nth]
        return pa.table([pa.array(c) for c in columns], schema=found)

    by = ["group", "part"]
    pairs = visits.groupBy(*by).cogroup(stored.groupBy(*by)).applyInArrow(rank, "query bigint, node bigint, near double")
    pairs = pairs.groupBy("query", "node").agg(F.max("near").alias("near"))
    best = W.partitionBy("query").orderBy(F.col("near").desc(), "node")
    pairs = pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= keep).select("query", "node")
    pairs = checked_broadcast(written(pairs, f"{folder}/pairs"))

    left = points.select(F.col("node").alias("query"), F.col("v").alias("qv"))
    exact = pairs.join(left, "query").join(points.select("node", "v", "ids"), "node")
    exact = exact.select("query", cosine("qv", "v").alias("score"), F.explode("ids").alias(key))
    answers = asked.join(exact, F.col("query") == asked["node"]).where(F.col(key) != F.col("query_id"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    ranked = answers.select("query_id", F.row_number().over(order).alias("rank"), key, "score")
    return ranked.where(F.col("rank") <= k)
