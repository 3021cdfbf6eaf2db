"""Connected components of a link table, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framecloud.functions.checkpoints import cut


def _nearest(edges: DataFrame, key: str) -> DataFrame:
    """Edges with the smallest neighbour of ``key`` (or itself) as ``m``."""
    least = edges.groupBy(key).agg(F.min("b" if key == "a" else "a").alias("m"))
    # Dealt anew, the minima leave the join an exchange of its own, so a hub can be split.
    return edges.join(least.hint("rebalance"), key)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for every linked node.

    ``links`` has long columns a and b; direction, repeats and self-links do not
    matter and rows with a null end are ignored. Stars are formed in turn around
    larger and smaller neighbours until nothing changes, which takes a number of
    rounds logarithmic in the size. Each round is checkpointed. An empty table
    gives an empty result.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = cut(
        links.where("a is not null and b is not null and a <> b")
        .select(high.alias("a"), low.alias("b"))
        .distinct()
    )
    seen = None
    while True:
        # Larger neighbours move to the smallest neighbour.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = _nearest(both, "a").select("a", "b", F.least("a", "m").alias("m"))
        large = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Smaller neighbours and the node itself move to the smallest of them.
        near = _nearest(large, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))
        edges = cut(small.where("a <> b").distinct())
        state = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.max(F.xxhash64("b", "a"))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)
