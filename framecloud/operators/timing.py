"""Latency statistics over tables of measured times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framecloud.functions.order import order_statistics

# Marks of one build in their order.
STAGES = ("deprojection", "rgb_mapping", "crop", "sampling")


def latency_summary(timings: DataFrame, by: Sequence[str], value: str = "ms") -> DataFrame:
    """Mean, median and 95th percentile (linear interpolation)."""
    quantiles = {value: {"p50_ms": 0.5, "p95_ms": 0.95}}
    return order_statistics(timings, by, quantiles, also=[F.avg(value).alias("mean_ms")])


def nearest_rank(
    timings: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Values at rank round((n - 1) q), half to even."""
    return order_statistics(timings, by, {value: quantiles}, nearest_rank=True)


def run_totals(timings: DataFrame, by: Sequence[str], value: str = "seconds") -> DataFrame:
    """Iterations, total and mean time per run."""
    total = F.sum(value)
    n = F.count(F.lit(1))
    return timings.groupBy(*by).agg(
        n.cast("double").alias("iterations"),
        total.alias("total_seconds"),
        (total / F.greatest(n, F.lit(1))).alias("mean_seconds"),
    )


def stage_deltas(marks: DataFrame, run: Sequence[str], mark: str, at: str) -> DataFrame:
    """Time spent in each stage from the mark times of a run.

    ``mark`` names the stage that just ended; ``start`` and ``end`` frame the run.
    A run has six marks, so a pivoting aggregate replaces an ordered window.
    """
    names = ("start", *STAGES, "end")
    wide = marks.groupBy(*run).agg(
        *[F.max(F.when(F.col(mark) == n, F.col(at))).alias(f"_{n}") for n in names]
    )
    deltas = [
        (F.col(f"_{now}") - F.col(f"_{before}")).alias(now)
        for before, now in zip(names, STAGES, strict=False)
    ]
    return wide.select(
        *run, *deltas, (F.col("_end") - F.col("_start")).alias("total_builder_pipeline")
    )
