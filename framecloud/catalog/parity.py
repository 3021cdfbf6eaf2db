"""Comparison of depth sources over the disparity frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from framecloud.catalog import views
from framecloud.catalog.registry import query
from framecloud.operators import parity as pa
from framecloud.schema import KEYS

BY = ["backend"]
ARRAYS = ["disparity", "depth"]
# Candidate backends: factor on the reference disparity and offset in pixels.
BACKENDS = {"engine_a": (1.01, 0.0), "engine_b": (1.0, 0.05), "engine_c": (0.7, -0.4)}


def _depth(d):
    return F.when(d > F.lit(0).cast("float"), (F.lit(5.0).cast("float") / d).cast("float")).otherwise(
        F.lit(0).cast("float")
    )


def _sources(spark, sf_dir):
    base = views.frames(spark, sf_dir).select(*KEYS, "disparity")
    reference = base.withColumn("depth", F.transform("disparity", _depth))
    options = F.array(
        *[
            F.struct(
                F.lit(n).alias("backend"),
                F.lit(f).cast("float").alias("f"),
                F.lit(o).cast("float").alias("o"),
            )
            for n, (f, o) in BACKENDS.items()
        ]
    )
    shifted = base.select("*", F.inline(options)).withColumn(
        "disparity", F.transform("disparity", lambda d: d * F.col("f") + F.col("o"))
    )
    candidate = shifted.withColumn("depth", F.transform("disparity", _depth)).drop("f", "o")
    return reference, candidate


def pixels(spark, sf_dir):
    reference, candidate = _sources(spark, sf_dir)
    return pa.pair_rasters(reference, candidate, KEYS, ARRAYS)


_OPTIONS = ", ".join(f"('{n}', {f}::float, {o}::float)" for n, (f, o) in BACKENDS.items())
PAIRS = f"""opt(backend, f, o) as (values {_OPTIONS}),
p0 as (select vec_id, unnest(embedding) * 20.0::float as rd from embeddings),
p1 as (select backend, rd, rd * f + o as cd from p0 cross join opt),
p2 as (select *, case when rd > 0 then 5.0::float / rd else 0.0::float end as rz,
  case when cd > 0 then 5.0::float / cd else 0.0::float end as cz from p1),
p3 as (select *, rd > 0 and cd > 0 as both_ok from p2),
pairs as (select *, case when both_ok then abs(cd - rd) end::double as de,
  case when both_ok then abs(cz - rz) end::double as ze,
  case when both_ok then greatest(rz, 1e-6::float) end::double as zr from p3)"""
METRICS = f"""{PAIRS}, metrics as (
  select backend, count(*) filter (both_ok) / greatest(count(*) filter (rd > 0), 1)::double as valid_overlap_ratio,
    count(*) filter (cd > 0) / count(*)::double as finite_positive_ratio,
    count(*) filter (rd > 0) as reference_valid_count, count(*) filter (cd > 0) as candidate_valid_count,
    avg(de) as disparity_mae_px, max(de) as disparity_max_px, avg(ze) as depth_mae_m,
    avg(ze / zr) as depth_relative_error_mean,
    quantile_cont(de, 0.5) as disparity_median_px, quantile_cont(de, 0.95) as disparity_p95_px,
    quantile_cont(ze, 0.5) as depth_median_m, quantile_cont(ze, 0.95) as depth_p95_m
  from pairs group by backend)"""
FLOATS = (
    "valid_overlap_ratio", "finite_positive_ratio", "disparity_mae_px", "disparity_max_px",
    "depth_mae_m", "depth_relative_error_mean", "disparity_median_px", "disparity_p95_px",
    "depth_median_m", "depth_p95_m",
)


# One source lacks every third frame.
GAPS = PAIRS.replace(
    "rd * f + o as cd", "case when not (backend = 'engine_b' and vec_id % 3 = 0) then rd * f + o end as cd"
)


def _rounded(df, names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(
    "parity_metrics",
    f"with {METRICS} select backend, reference_valid_count, candidate_valid_count, "
    + ", ".join(f"round({n}, 6) as {n}" for n in FLOATS)
    + " from metrics",
)
def parity_metrics(spark, sf_dir):
    return _rounded(pa.parity_metrics(pixels(spark, sf_dir), BY), FLOATS)


_CHECKS = {
    "valid_overlap_ratio": ">= 0.95",
    "finite_positive_ratio": ">= 0.95",
    "disparity_mae_px": "<= 1.0",
    "disparity_p95_px": "<= 3.0",
    "depth_mae_m": "<= 0.03",
    "depth_relative_error_mean": "<= 0.10",
}


@query(
    "parity_checks",
    f"with {METRICS}, checks as (select backend, "
    + ", ".join(f"coalesce({n} {t}, false) as ok_{n}" for n, t in _CHECKS.items())
    + " from metrics) select *, "
    + " and ".join(f"ok_{n}" for n in _CHECKS)
    + " as passed from checks",
)
def parity_checks(spark, sf_dir):
    return pa.parity_checks(pa.parity_metrics(pixels(spark, sf_dir), BY), BY)


@query(
    "parity_coverage",
    f"with {METRICS.replace(PAIRS, GAPS)}, checks as (select *, "
    + " and ".join(f"coalesce({n} {t}, false)" for n, t in _CHECKS.items())
    + " as passed from metrics) select backend, reference_valid_count, candidate_valid_count, passed, "
    + "round(valid_overlap_ratio, 6) as valid_overlap_ratio, "
    + "round(finite_positive_ratio, 6) as finite_positive_ratio from checks",
)
def parity_coverage(spark, sf_dir):
    """A source that lacks frames: its missing pixels count as not covered."""
    reference, candidate = _sources(spark, sf_dir)
    lacking = (F.col("backend") == "engine_b") & (F.col("frame_id") % 3 == 0)
    px = pa.pair_rasters(reference, candidate.where(~lacking), KEYS, ARRAYS)
    metrics = pa.parity_metrics(px, BY)
    passed = pa.parity_checks(metrics, BY).select(*BY, "passed")
    counts = ["reference_valid_count", "candidate_valid_count"]
    ratios = ["valid_overlap_ratio", "finite_positive_ratio"]
    return _rounded(metrics.select(*BY, *counts, *ratios), ratios).join(passed, BY)


NATIVE = (
    "native_depth_valid_ratio", "estimated_depth_valid_ratio", "valid_overlap_ratio_over_image",
    "valid_overlap_ratio_over_native", "depth_abs_error_mean_m", "depth_relative_error_mean",
    "depth_abs_error_median_m", "depth_abs_error_p95_m",
)


@query(
    "native_parity",
    """with n0 as (select cast(label as varchar) as camera, unnest(embedding) as e from embeddings),
    n1 as (select camera, e * 1.5::float as native, case when e * 20.0::float > 0 then
      5.0::float / (e * 20.0::float) else 0.0::float end as est from n0),
    n2 as (select *, native > 0 and est > 0 as both_ok from n1),
    n3 as (select *, case when both_ok then abs(est - native) end::double as err,
      case when both_ok then greatest(native, 1e-6::float) end::double as ref from n2)
    select camera, round(count(*) filter (native > 0) / count(*)::double, 6) as native_depth_valid_ratio,
      round(count(*) filter (est > 0) / count(*)::double, 6) as estimated_depth_valid_ratio,
      round(count(*) filter (both_ok) / count(*)::double, 6) as valid_overlap_ratio_over_image,
      round(count(*) filter (both_ok) / greatest(count(*) filter (native > 0), 1)::double, 6)
        as valid_overlap_ratio_over_native,
      round(avg(err), 6) as depth_abs_error_mean_m,
      round(avg(err / ref), 6) as depth_relative_error_mean,
      round(quantile_cont(err, 0.5), 6) as depth_abs_error_median_m,
      round(quantile_cont(err, 0.95), 6) as depth_abs_error_p95_m
    from n3 group by camera""",
)
def native_parity(spark, sf_dir):
    frames = views.frames(spark, sf_dir)
    native = frames.select(*KEYS, "depth")
    estimated = frames.select(*KEYS, F.transform("disparity", _depth).alias("depth"))
    px = pa.pair_rasters(native, estimated, KEYS, ["depth"])
    return _rounded(pa.native_parity(px, ["camera"], F.lit(1.5)), NATIVE)
