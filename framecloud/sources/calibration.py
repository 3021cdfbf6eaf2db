"""Stereo calibration from JSON files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framecloud.functions.joins import checked_broadcast
from framecloud.operators.checks import enforce, rectification_rules, resolve_alias

_STREAM = (
    "struct<intrinsics:struct<width:int,height:int,fx:double,fy:double,cx:double,cy:double,"
    "coeffs:array<double>>>"
)
# A rotation may be nine numbers or three rows of three; both arrive as text.
_EXTRINSIC = (
    "struct<rotation_matrix_row_major:string,rotation:string,"
    "translation_m:array<double>,translation:array<double>>"
)
_SCHEMA = (
    "cameras map<string,struct<"
    f"streams:struct<infrared1:{_STREAM},infrared2:{_STREAM}>,"
    f"extrinsics:struct<infrared1_to_infrared2:{_EXTRINSIC},infrared1_to_color:{_EXTRINSIC}>,"
    "baseline:struct<recommended_baseline_m:double,baseline_m_abs_x:double>>>"
)


def _rotation(extrinsic: Column) -> Column:
    text = F.coalesce(extrinsic["rotation_matrix_row_major"], extrinsic["rotation"])
    numbers = F.regexp_extract_all(text, F.lit(r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"))
    return F.transform(numbers, lambda c: c.cast("double"))


def _translation(extrinsic: Column) -> Column:
    return F.coalesce(extrinsic["translation_m"], extrinsic["translation"])


def _lens(stream: Column) -> Column:
    i = stream["intrinsics"]
    return F.struct(*[i[n].alias(n) for n in ("width", "height", "fx", "fy", "cx", "cy")])


def _coeffs(stream: Column) -> Column:
    return F.coalesce(stream["intrinsics"]["coeffs"], F.array().cast("array<double>"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """One row per camera: intrinsics, distortion, extrinsics and baseline."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", _SCHEMA, {"mode": "FAILFAST"}).alias("j"))
    c = F.col("c")
    left, right = c["streams"]["infrared1"], c["streams"]["infrared2"]
    to_right = c["extrinsics"]["infrared1_to_infrared2"]
    to_color = c["extrinsics"]["infrared1_to_color"]
    baseline = c["baseline"]
    return parsed.select(F.explode("j.cameras").alias("camera", "c")).select(
        "camera",
        _lens(left).alias("left_k"),
        _lens(right).alias("right_k"),
        _coeffs(left).alias("left_distortion"),
        _coeffs(right).alias("right_distortion"),
        _rotation(to_right).alias("r"),
        _translation(to_right).alias("t"),
        _rotation(to_color).alias("color_r"),
        _translation(to_color).alias("color_t"),
        F.coalesce(
            baseline["recommended_baseline_m"], baseline["baseline_m_abs_x"], F.lit(0.0)
        ).alias("baseline_m"),
    )


def calibration_of(calibration: DataFrame, wanted: DataFrame) -> DataFrame:
    """Calibration of the cameras in ``wanted`` (camera), short names resolved.

    A camera without calibration stays with ``found`` false.
    """
    named = wanted.select(
        F.col("camera").alias("asked"), resolve_alias(F.col("camera")).alias("camera")
    )
    joined = named.join(calibration, "camera", "left")
    return joined.withColumn("found", F.col("left_k").isNotNull())


def apply_calibration(cameras: DataFrame, calibration: DataFrame) -> DataFrame:
    """Camera table of a stereo rig: calibrated infrared lenses replace depth lenses.

    The left infrared lens becomes ``depth_k`` and its pose towards the colour camera
    ``r`` and ``t``; the baseline is the calibrated one. Short camera names are
    resolved. A camera without calibration, a pair that is not rectified, or a
    positive baseline in ``cameras`` that differs from the calibrated one by more than
    0.00001 m fails the job.
    """
    own = {"camera": "_asked", "depth_k": "_depth_k", "r": "_r", "t": "_t", "baseline_m": "_baseline"}
    named = cameras.withColumnsRenamed(own).withColumn("camera", resolve_alias(F.col("_asked")))
    joined = named.join(checked_broadcast(calibration), "camera", "left")
    absent = F.col("left_k").isNull()
    unset = ~F.coalesce(F.col("_baseline") > 0, F.lit(False))
    rules = {"camera has no calibration": ~absent}
    rules |= {name: absent | rule for name, rule in rectification_rules().items()}
    rules["configured baseline disagrees with the calibration"] = (
        absent | unset | (F.abs(F.col("_baseline") - F.col("baseline_m")) <= F.lit(1e-5))
    )
    checked = enforce(joined, rules, F.concat_ws(" ", F.lit("camera"), "_asked"))
    replaced = {
        "camera": F.col("_asked"),
        "depth_k": F.col("left_k"),
        "r": F.col("color_r"),
        "t": F.col("color_t"),
    }
    return checked.select(*[replaced.get(c, F.col(c)).alias(c) for c in cameras.columns])
