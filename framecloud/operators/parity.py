"""Comparison of two depth sources pixel by pixel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framecloud.functions.numeric import count_where, f32, is_finite, safe_ratio, to32
from framecloud.functions.order import order_statistics

# Acceptance thresholds of the backend comparison.
THRESHOLDS = {
    "valid_overlap_ratio_min": 0.95,
    "disparity_mae_max_px": 1.0,
    "disparity_p95_max_px": 3.0,
    "depth_mae_max_m": 0.03,
    "depth_relative_error_max": 0.10,
    "finite_positive_ratio_min": 0.95,
}
RELATIVE_FLOOR = 1e-6
MAX_SOURCES = 1000


def _positive(c: Column) -> Column:
    return is_finite(c) & F.coalesce(c > f32(0), F.lit(False))


def pair_rasters(
    reference: DataFrame, candidate: DataFrame, keys: Sequence[str], arrays: Sequence[str]
) -> DataFrame:
    """Pixels of two sources side by side: ``ref_<name>`` and ``cand_<name>``.

    The join is on the frame only and on packed rows; pixels are paired by
    position afterwards, so no pixel is shuffled on its own.

    Every reference frame is paired with every candidate source, which the other
    columns of ``candidate`` name. A frame or image that a source lacks gives null
    candidate pixels, so it counts as not covered. Images of different length and
    a null reference image fail the job. A candidate frame without a reference has
    nothing to be compared with and is left out. The names of the sources, at most
    ``MAX_SOURCES``, are read first.
    """
    keys = list(keys)
    ref = reference.select(*keys, *[F.col(a).alias(f"ref_{a}") for a in arrays])
    extra = [c for c in candidate.columns if c not in {*keys, *arrays}]
    cand = candidate.select(*keys, *extra, *[F.col(a).alias(f"cand_{a}") for a in arrays])
    if extra:
        ref = ref.select("*", F.inline(_source_names(candidate, extra)))
    joined = ref.join(cand, [*keys, *extra], "left")
    filled = {}
    for a in arrays:
        mine, other = F.col(f"cand_{a}"), F.col(f"ref_{a}")
        missing = F.transform(other, lambda v: F.lit(None).cast(_element(candidate, a)))
        problem = (
            F.when(other.isNull(), f"reference {a} image is missing")
            .when(F.size(mine) != F.size(other), f"{a} images differ in length")
        )
        failed = F.raise_error(problem).cast(candidate.schema[a].dataType)
        filled[f"cand_{a}"] = F.when(problem.isNotNull(), failed).otherwise(F.coalesce(mine, missing))
    names = [f"{side}_{a}" for a in arrays for side in ("ref", "cand")]
    zipped = F.arrays_zip(*names)
    return joined.withColumns(filled).select(*keys, *extra, F.inline(zipped).alias(*names))


def _element(df: DataFrame, array: str):
    return df.schema[array].dataType.elementType


def _source_names(candidate: DataFrame, names: Sequence[str]) -> Column:
    """The distinct candidate sources as an array of structs."""
    found = candidate.select(*names).distinct().limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"columns {list(names)} name more than {MAX_SOURCES} candidate sources")
    types = {n: candidate.schema[n].dataType for n in names}
    rows = [F.struct(*[F.lit(row[n]).cast(t).alias(n) for n, t in types.items()]) for row in found]
    kind = ", ".join(f"`{n}`: {t.simpleString()}" for n, t in types.items())
    return F.array(*rows).cast(f"array<struct<{kind}>>")


def parity_metrics(pixels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Overlap, disparity error and depth error of each candidate.

    Error columns are null where no pixel is valid on both sides.
    """
    by = list(by)
    rd, cd, rz, cz = (F.col(c) for c in ("ref_disparity", "cand_disparity", "ref_depth", "cand_depth"))
    both = _positive(rd) & _positive(cd)
    depth_ok = both & _positive(rz) & _positive(cz)
    errors = pixels.select(
        *by,
        _positive(rd).alias("ref_ok"),
        _positive(cd).alias("cand_ok"),
        F.when(both, F.abs(cd - rd)).alias("disp_error"),
        F.when(depth_ok, F.abs(cz - rz)).alias("depth_error"),
        F.when(depth_ok, F.greatest(rz, f32(RELATIVE_FLOOR))).alias("_ref"),
    )
    wide = errors.withColumn(
        "_relative", F.col("depth_error").cast("double") / F.col("_ref").cast("double")
    )
    overlap = count_where(F.col("disp_error").isNotNull())
    means = [
        safe_ratio(overlap, count_where(F.col("ref_ok"))).alias("valid_overlap_ratio"),
        safe_ratio(count_where(F.col("cand_ok")), F.count(F.lit(1))).alias("finite_positive_ratio"),
        count_where(F.col("ref_ok")).alias("reference_valid_count"),
        count_where(F.col("cand_ok")).alias("candidate_valid_count"),
        F.avg(F.col("disp_error").cast("double")).alias("disparity_mae_px"),
        F.max(F.col("disp_error").cast("double")).alias("disparity_max_px"),
        F.avg(F.col("depth_error").cast("double")).alias("depth_mae_m"),
        F.avg("_relative").alias("depth_relative_error_mean"),
    ]
    quantiles = {
        "disp_error": {"disparity_median_px": 0.5, "disparity_p95_px": 0.95},
        "depth_error": {"depth_median_m": 0.5, "depth_p95_m": 0.95},
    }
    return order_statistics(wide, by, quantiles, also=means)


def parity_checks(metrics: DataFrame, by: Sequence[str], limits: Mapping[str, float] = THRESHOLDS):
    """One boolean per threshold; a metric that does not exist fails."""
    at_least = {
        "valid_overlap_ratio": "valid_overlap_ratio_min",
        "finite_positive_ratio": "finite_positive_ratio_min",
    }
    at_most = {
        "disparity_mae_px": "disparity_mae_max_px",
        "disparity_p95_px": "disparity_p95_max_px",
        "depth_mae_m": "depth_mae_max_m",
        "depth_relative_error_mean": "depth_relative_error_max",
    }
    tests = {m: F.col(m) >= F.lit(float(limits[t])) for m, t in at_least.items()}
    tests |= {m: F.col(m) <= F.lit(float(limits[t])) for m, t in at_most.items()}
    checks = {f"ok_{m}": F.coalesce(t, F.lit(False)) for m, t in tests.items()}
    checked = metrics.select(*by, *[c.alias(n) for n, c in checks.items()])
    passed = F.lit(True)
    for name in checks:
        passed = passed & F.col(name)
    return checked.withColumn("passed", passed)


def require_parity(metrics: DataFrame, by: Sequence[str], limits=THRESHOLDS) -> DataFrame:
    """Strict form: a candidate outside the thresholds fails the job."""
    message = F.concat(F.lit("parity thresholds failed for "), F.concat_ws("/", *by))
    checked = parity_checks(metrics, by, limits)
    return checked.withColumn(
        "passed",
        F.when(F.col("passed"), True).otherwise(F.raise_error(message).cast("boolean")),
    )


def native_parity(pixels: DataFrame, by: Sequence[str], scale: Column) -> DataFrame:
    """Native sensor depth (raw units) against estimated depth (metres).

    ``pixels`` holds ``ref_depth`` (native) and ``cand_depth`` (estimated).
    """
    by = list(by)
    scaled = pixels.withColumn("_native", F.col("ref_depth") * to32(scale))
    native, estimated = F.col("_native"), F.col("cand_depth")
    both = _positive(native) & _positive(estimated)
    errors = scaled.select(
        *by,
        _positive(native).alias("native_ok"),
        _positive(estimated).alias("estimated_ok"),
        F.when(both, F.abs(estimated - native)).alias("error"),
        F.when(both, F.greatest(native, f32(RELATIVE_FLOOR))).alias("_ref"),
    ).withColumn("_relative", F.col("error").cast("double") / F.col("_ref").cast("double"))
    n = F.count(F.lit(1))
    overlap = count_where(F.col("error").isNotNull())
    native_count = count_where(F.col("native_ok"))
    means = [
        safe_ratio(native_count, n).alias("native_depth_valid_ratio"),
        safe_ratio(count_where(F.col("estimated_ok")), n).alias("estimated_depth_valid_ratio"),
        safe_ratio(overlap, n).alias("valid_overlap_ratio_over_image"),
        safe_ratio(overlap, native_count).alias("valid_overlap_ratio_over_native"),
        F.avg(F.col("error").cast("double")).alias("depth_abs_error_mean_m"),
        F.avg("_relative").alias("depth_relative_error_mean"),
    ]
    quantiles = {"error": {"depth_abs_error_median_m": 0.5, "depth_abs_error_p95_m": 0.95}}
    return order_statistics(errors, by, quantiles, also=means)
