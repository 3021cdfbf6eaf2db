"""Positions, first-k and exact order statistics that survive hot groups.

A window over one group runs in one task, so each helper first cuts a group
into parts of bounded size and only then ranks what is left.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framecloud.functions.checkpoints import cut
from framecloud.functions.joins import checked_broadcast

SPREAD = 1024
BRACKET_PARTS = 1024
SKETCH_ACCURACY = 10_000
SMALL_GROUP = 50_000


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    width: int,
    name: str,
) -> DataFrame:
    """Add ``name``: the 0-based position of each row in its key group.

    ``order[0]`` must be an integer column. Its range is cut into slices of
    ``width`` values; rows are numbered inside a slice and shifted by the number
    of rows in earlier slices, so a group with a third of all rows is numbered
    by many tasks.
    """
    keys = list(keys)
    part = F.coalesce(F.expr(f"`{order[0]}` div {int(width)}"), F.lit(-(2**63)))
    cut = df.withColumn("_part", part)
    sizes = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(
        *keys, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = W.partitionBy(*keys, "_part").orderBy(*order)
    return (
        cut.withColumn("_pos", F.row_number().over(inside) - 1)
        .join(shifts, [*keys, "_part"])
        .withColumn(name, (F.col("_pos") + F.col("_shift")).cast("bigint"))
        .drop("_part", "_pos", "_shift")
    )


def first_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    k: int,
    rank: str,
    spread: bool = False,
) -> DataFrame:
    """Keep the first ``k`` rows per group in ``order`` and add a 0-based rank.

    With ``spread`` each input partition first keeps its own first ``k`` rows of
    a group, which Spark does before the shuffle, and these are ranked in
    ``SPREAD`` parts. The final ranking then sees at most ``SPREAD * k`` rows of
    a group, whatever its size. Any split gives the same result.
    """
    keys = list(keys)
    if spread:
        salted = df.withColumn("_salt", F.spark_partition_id() % SPREAD)
        part = W.partitionBy(*reversed(keys), "_salt").orderBy(*order)
        df = (
            salted.withColumn("_rn", F.row_number().over(part))
            .where(F.col("_rn") <= k)
            .drop("_rn", "_salt")
        )
    # The last key tells frames apart, so the sort should look at it first.
    whole = W.partitionBy(*reversed(keys)).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(whole))
        .where(F.col("_rn") <= k)
        .withColumn(rank, F.col("_rn") - 1)
        .drop("_rn")
    )


def smallest_k(df: DataFrame, keys: Sequence[str], bucket: str, k: int) -> DataFrame:
    """Rows that can be among the first ``k`` of their group in an order led by ``bucket``.

    Buckets are counted, and rows beyond the bucket that holds the k-th row go: a few more
    than ``k`` rows of a group are left to be sorted. ``df`` is read twice, so it should be
    kept; where it lies by ``keys`` nothing is shuffled.
    """
    keys = list(keys)
    upto = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    cuts = (
        df.groupBy(*keys, bucket)
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
        .where(F.col("_before") < k)
        .groupBy(*keys)
        .agg(F.max(bucket).alias("_cut"))
    )
    joined = df.join(cuts.hint("shuffle_hash"), keys)
    return joined.where(F.col(bucket) <= F.col("_cut")).drop("_cut")


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    quantiles: Mapping[str, Mapping[str, float]],
    nearest_rank: bool = False,
    also: Sequence[Column] = (),
) -> DataFrame:
    """Exact quantiles per key: ``quantiles`` maps a value column to {result: q}.

    Linear interpolation between the two neighbouring ranks, or with
    ``nearest_rank`` the value at the half-to-even rounded rank. ``also`` holds
    further aggregates of the same groups, computed in the same first pass.

    The built-in exact percentile keeps all values of a group in one task.
    Here a mergeable sketch brackets each rank, the second pass counts the rows
    below a bracket where they lie, and only distinct values inside a bracket
    are ranked.
    """
    if not keys:
        whole = df.withColumn("_all", F.lit(0))
        return order_statistics(whole, ["_all"], quantiles, nearest_rank, also).drop("_all")
    keys = list(keys)
    wanted = [(v, name, q) for v, names in quantiles.items() for name, q in names.items()]
    slack = 4.0 / SKETCH_ACCURACY
    sketches, targets = [], []
    for j, (value, name, q) in enumerate(wanted):
        v = F.col(value).cast("double")
        probes = [max(q - slack, 0.0), min(q + slack, 1.0)]
        sketches += [
            F.count(v).alias(f"_n{j}"),
            F.min(v).alias(f"_min{j}"),
            F.max(v).alias(f"_max{j}"),
            F.percentile_approx(v, probes, SKETCH_ACCURACY).alias(f"_probe{j}"),
        ]
        n = F.col(f"_n{j}")
        small = n <= SMALL_GROUP
        low = F.when(small | F.lit(q - slack <= 0.0), F.col(f"_min{j}"))
        high = F.when(small | F.lit(q + slack >= 1.0), F.col(f"_max{j}"))
        at = (n - 1).cast("double") * F.lit(float(q))
        first, last = (F.rint(at), F.rint(at)) if nearest_rank else (F.floor(at), F.ceil(at))
        targets.append(
            F.struct(
                F.lit(name).alias("_q"),
                low.otherwise(F.col(f"_probe{j}")[0]).alias("_low"),
                high.otherwise(F.col(f"_probe{j}")[1]).alias("_high"),
                first.cast("bigint").alias("_first"),
                last.cast("bigint").alias("_last"),
                (F.lit(0.0) if nearest_rank else at - F.floor(at)).alias("_weight"),
            )
        )
    stats = df.groupBy(*keys).agg(*also, *sketches)
    kept = [c for c in stats.columns if c not in keys and not c.startswith("_")]
    # One row per key: computed once, then counted before it may be broadcast.
    summary = cut(stats.select(*keys, *kept, F.array(*targets).alias("_targets")))
    small_side = checked_broadcast(summary)

    cells = [
        F.struct(
            F.col("_targets")[j].alias("_t"), F.col(value).cast("double").alias("_v")
        )
        for j, (value, _, _) in enumerate(wanted)
    ]
    values = [F.col(v) for v in quantiles]
    paired = df.select(*keys, *values).join(small_side.select(*keys, "_targets"), keys)
    inside = (
        paired.select(*keys, F.inline(F.array(*cells)))
        .select(*keys, "_t.*", "_v")
        .where(F.col("_v") <= F.col("_high"))
    )
    # All rows below a bracket become one counted row with a null value; what is
    # left is under a thousandth of a large group and is kept for two readers.
    low, high = F.col("_low"), F.col("_high")
    step = F.floor((F.col("_v") - low) / F.when(high > low, high - low) * F.lit(BRACKET_PARTS))
    counted = cut(
        inside.withColumn("_v", F.when(F.col("_v") >= low, F.col("_v")))
        .withColumn(
            "_part", F.when(F.col("_v").isNull(), -1).otherwise(F.coalesce(step, F.lit(0)))
        )
        .groupBy(*keys, "_q", "_part", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    ranks = small_side.select(*keys, F.inline("_targets")).drop("_low", "_high")
    earlier = W.partitionBy(*keys, "_q").orderBy("_part")
    parts = (
        counted.groupBy(*keys, "_q", "_part")
        .agg(F.sum("_c").alias("_size"))
        .withColumn("_upto", F.sum("_size").over(earlier.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("_shift", F.col("_upto") - F.col("_size"))
        .join(ranks, [*keys, "_q"])
    )

    def holds(start: str, end: str, rank: str) -> Column:
        return (F.col(start) <= F.col(rank)) & (F.col(rank) < F.col(end))

    hit = parts.where(holds("_shift", "_upto", "_first") | holds("_shift", "_upto", "_last"))
    run = W.partitionBy(*keys, "_q", "_part").orderBy("_v")
    placed = (
        counted.join(hit.drop("_size", "_upto"), [*keys, "_q", "_part"])
        .withColumn("_end", F.sum("_c").over(run.rowsBetween(W.unboundedPreceding, 0)) + F.col("_shift"))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )

    def at_rank(rank: str) -> Column:
        return F.max(F.when(holds("_start", "_end", rank), F.col("_v")))

    picked = placed.groupBy(*keys, "_q").agg(
        at_rank("_first").alias("_a"), at_rank("_last").alias("_b"), F.first("_weight").alias("_w")
    )
    missed = F.col("_a").isNull() | F.col("_b").isNull()
    value = F.when(
        missed, F.raise_error(F.lit("rank outside its sketch bracket")).cast("double")
    ).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w"))
    found = (
        picked.withColumn("_value", value)
        .groupBy(*keys)
        .agg(*[F.max(F.when(F.col("_q") == n, F.col("_value"))).alias(n) for _, n, _ in wanted])
    )
    return summary.drop("_targets").join(found, keys, "left")
