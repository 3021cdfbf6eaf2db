"""Sharding by a weighted hash tree.

A row descends region, rack and shard. At each level every child draws a number
from the row's key and the child's path, divided by the child's weight, and the
smallest draw wins. Draws of other children never change, so a new weight moves
rows only into or out of the subtree that carries it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Hexadecimal digits of the digest in a draw: 52 bits, exact in a double.
DIGITS = 13
#: Pieces in which the slots of a shard are numbered.
SLOT_BUCKETS = 4096


@dataclass(frozen=True)
class Tree:
    """Regions of racks of shards: {region: {rack: {shard number: weight}}}."""

    regions: Mapping[str, Mapping[str, Mapping[int, float]]]

    def __post_init__(self) -> None:
        numbers = [s for racks in self.regions.values() for shards in racks.values() for s in shards]
        if not numbers or len(numbers) != len(set(numbers)):
            raise ValueError("a tree needs shards, each with a number of its own")
        if any(w <= 0 for r in self.regions.values() for s in r.values() for w in s.values()):
            raise ValueError("weights must be positive; leave a shard out instead")

    def grown(self, shard: int, weight: float = 1.0) -> Tree:
        """With one more shard in a region of its own.

        No other weight changes, so rows move only into the new shard. A shard
        added to a present rack raises the weights above it, and rows drawn there
        by that may land on its neighbours.
        """
        return Tree({**self.regions, f"region{len(self.regions)}": {"rack0": {shard: weight}}})

    def nodes(self) -> list[tuple[int, str, float, int | None, int]]:
        """Inner and leaf nodes as (parent, path, weight, shard, own number), root 0."""
        found: list[tuple[int, str, float, int | None, int]] = []
        count = 0

        def weight(node) -> float:
            return sum(map(weight, node.values())) if isinstance(node, Mapping) else float(node)

        def walk(parent: int, path: str, children: Mapping) -> None:
            nonlocal count
            for name, child in children.items():
                count += 1
                own, here = count, f"{path}/{name}"
                found.append((parent, here, weight(child), None if isinstance(child, Mapping) else name, own))
                if isinstance(child, Mapping):
                    walk(own, here, child)

        walk(0, "", self.regions)
        return found


def even_tree(shards: int, regions: int = 2, racks: int = 2) -> Tree:
    """Equal shards spread in order over ``regions`` of ``racks`` racks."""
    per_rack = -(-shards // (regions * racks))
    layout: dict = {}
    for s in range(shards):
        rack, region = s // per_rack, s // (per_rack * racks)
        layout.setdefault(f"region{region}", {}).setdefault(f"rack{rack % racks}", {})[s] = 1.0
    return Tree(layout)


def draw(key: Column, path: Column, weight: Column) -> Column:
    """Exponential draw of a child for a key: the smaller, the likelier the heavier."""
    digest = F.md5(F.concat(key, F.lit("#"), path))
    number = F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double")
    return -F.log((number + 0.5) / F.lit(float(16**DIGITS))) / weight


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard of a text key: three descents, each over the children of one node."""
    nodes = tree.nodes()
    children: dict[int, list] = {}
    for parent, path, weight, shard, own in nodes:
        children.setdefault(parent, []).append((path, weight, own if shard is None else shard))
    inner = sorted(children)
    place = {n: k for k, n in enumerate(inner)}
    leaf = {path for _, path, _, shard, _ in nodes if shard is not None}
    table = F.array(
        *[
            F.array(
                *[
                    F.struct(
                        F.lit(path).alias("path"),
                        F.lit(float(weight)).alias("weight"),
                        F.lit(number if path in leaf else place[number]).alias("next"),
                    )
                    for path, weight, number in children[n]
                ]
            )
            for n in inner
        ]
    )

    def descend(node: Column) -> Column:
        drawn = F.transform(
            F.get(table, node),
            lambda c: F.struct(draw(key, c["path"], c["weight"]).alias("draw"), c["next"].alias("next")),
        )
        return F.array_min(drawn)["next"]

    return descend(descend(descend(F.lit(0))))


def assign(
    df: DataFrame,
    tree: Tree,
    grown: Tree | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Size, checksum, shard and slot of every row, under the law ``key``.

    Columns: ``key``, size (UTF-8 bytes of the text, none for null, plus 1),
    text_crc32, law, shard, slot (gapless from 0 in each shard) and grown_shard
    (null without ``grown``). Rows with a null key share the key ``null``; rows
    that repeat a key go to one shard and take neighbouring slots in order of
    checksum and size. Other columns are not carried along.

    Slots are numbered in pieces of a shard by the digest of the key, shifted by
    the counts of earlier pieces: at most ``SLOT_BUCKETS`` counts per shard. The
    text never leaves the scan.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    rows = df.select(
        F.col(key).alias("_key"),
        (F.octet_length(content) + 1).cast("bigint").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        shard_of(name, tree).cast("int").alias("shard"),
        (shard_of(name, grown).cast("int") if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.conv(F.substring(F.md5(name), 1, 3), 16, 10).cast("int").alias("_piece"),
    )
    counts = df.select(
        shard_of(name, tree).cast("int").alias("shard"),
        F.conv(F.substring(F.md5(name), 1, 3), 16, 10).cast("int").alias("_piece"),
    ).groupBy("shard", "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("shard").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(
        "shard", "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = W.partitionBy("shard", "_piece").orderBy(F.col("_key").asc_nulls_first(), "text_crc32", "size")
    return (
        rows.withColumn("_at", F.row_number().over(inside) - 1)
        .join(F.broadcast(shifts), ["shard", "_piece"])  # at most 4,096 rows a shard
        .select(
            F.col("_key").alias(key),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_at") + F.col("_shift")).cast("bigint").alias("slot"),
            "grown_shard",
        )
    )


def draw_sql(key: str, tree: Tree) -> dict[str, str]:
    """The same draws in SQL: a node list and, per level, the winning child."""
    leaves = ", ".join(
        f"({parent}, '{path}', {weight!r}, {own if shard is None else shard}, {shard is not None})"
        for parent, path, weight, shard, own in tree.nodes()
    )
    score = f"-ln((('0x' || substr(md5({key} || '#' || path), 1, {DIGITS}))::bigint + 0.5) / {float(16**DIGITS)!r}) / weight"
    return {"nodes": f"(values {leaves}) as n(parent, path, weight, next, leaf)", "score": score}
