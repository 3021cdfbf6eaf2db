"""Latency reports over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from framecloud.catalog import views
from framecloud.catalog.registry import query
from framecloud.operators import timing as tm

BY = ["backend", "stage"]


@query(
    "latency_summary",
    """select user_id % 4 as backend, event_type as stage, round(avg(value), 6) as mean_ms,
      round(quantile_cont(value, 0.5), 6) as p50_ms, round(quantile_cont(value, 0.95), 6) as p95_ms
    from events group by 1, 2""",
)
def latency_summary(spark, sf_dir):
    summary = tm.latency_summary(views.timings(spark, sf_dir), BY)
    return summary.select(*BY, *[F.round(c, 6).alias(c) for c in ("mean_ms", "p50_ms", "p95_ms")])


@query(
    "latency_nearest_rank",
    """with o as (select user_id % 4 as backend, event_type as stage, value,
      row_number() over (partition by user_id % 4, event_type order by value) - 1 as pos,
      count(*) over (partition by user_id % 4, event_type) as n from events)
    select backend, stage,
      max(case when pos = round_even((n - 1) * 0.5::double, 0) then value end) as p50,
      max(case when pos = round_even((n - 1) * 0.95::double, 0) then value end) as p95
    from o group by backend, stage""",
)
def latency_nearest_rank(spark, sf_dir):
    return tm.nearest_rank(views.timings(spark, sf_dir), BY, "ms", {"p50": 0.5, "p95": 0.95})


@query(
    "run_totals",
    """select user_id as run_id, count(*)::double as iterations, round(sum(value), 4) as total_seconds,
      round(sum(value) / greatest(count(*), 1), 6) as mean_seconds from events group by user_id""",
)
def run_totals(spark, sf_dir):
    timed = views.timings(spark, sf_dir).select(F.col("user_id").alias("run_id"), "ms")
    totals = tm.run_totals(timed, ["run_id"], "ms")
    return totals.select(
        "run_id",
        "iterations",
        F.round("total_seconds", 4).alias("total_seconds"),
        F.round("mean_seconds", 6).alias("mean_seconds"),
    )


_MARKS = ("start", *tm.STAGES, "end")
_NAMED = " ".join(f"when {j} then '{n}'" for j, n in enumerate(_MARKS))
_PIVOT = ", ".join(
    f"max(case when event_id % 6 = {j} then value end) as m{j}" for j in range(len(_MARKS))
)


@query(
    "stage_deltas",
    f"""with w as (select event_id // 6 as run_id, {_PIVOT} from events group by 1)
    select run_id, m1 - m0 as deprojection, m2 - m1 as rgb_mapping, m3 - m2 as crop,
      m4 - m3 as sampling, m5 - m0 as total_builder_pipeline from w""",
)
def stage_deltas(spark, sf_dir):
    """Six consecutive events are the marks of one run."""
    marks = views.timings(spark, sf_dir).select(
        F.expr("event_id div 6").alias("run_id"),
        F.expr(f"case event_id % 6 {_NAMED} end").alias("mark"),
        "ms",
    )
    return tm.stage_deltas(marks, ["run_id"], "mark", "ms")
