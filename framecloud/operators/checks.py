"""Row-wise rules on camera, calibration and manifest tables.

Each rule set comes as an audit (one row per input row with its list of broken
rules) and as a strict form that fails the job on the first bad row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framecloud.config import (
    PAD_MODES,
    PRECISIONS,
    RECTIFICATION_MODES,
    RGB_MAPPINGS,
    SAMPLING_MODES,
)
from framecloud.functions.numeric import all_of

IDENTITY = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0)

# Short camera names used by recordings.
CAMERA_ALIASES = {
    "head": "head_rgb",
    "left_wrist": "left_wrist_rgb",
    "right_wrist": "right_wrist_rgb",
}


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the rules that do not hold; a null outcome counts as broken."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*broken))


def audit(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    checked = df.select(*keys, violations(rules).alias("violations"))
    return checked.withColumn("ok", F.size("violations") == 0)


def enforce(df: DataFrame, rules: Mapping[str, Column], label: Column) -> DataFrame:
    """Pass rows through, failing the job where a rule is broken."""
    broken = violations(rules)
    message = F.concat(label.cast("string"), F.lit(": "), F.array_join(broken, ", "))
    checked = F.when(F.size(broken) == 0, True).otherwise(F.raise_error(message).cast("boolean"))
    return df.where(checked)


def require_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass rows through, failing the job where a frame key is null.

    A null key equals no other in a join, so the frame would lose all its points.
    """
    present = all_of([F.col(k).isNotNull() for k in keys])
    return enforce(df, {"frame key is null": present}, F.concat_ws("/", *keys))


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass rows through, failing the job where a frame key occurs more than once.

    Frames that share a key would merge into one cloud. Rows combine before the shuffle,
    and nothing but keys and what ``df`` carries is moved.
    """
    values = [F.first(c).alias(c) for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"), *values)
    once = {"frame key occurs more than once": F.col("_times") == 1}
    return enforce(counted, once, F.concat_ws("/", *keys)).drop("_times").select(*df.columns)


def _near(a: Column, b: Column | float, tolerance: float) -> Column:
    other = F.lit(b) if isinstance(b, float) else b
    return F.abs(a - other) <= F.lit(tolerance)


def rectification_rules() -> dict[str, Column]:
    """A stereo pair must already be rectified.

    Columns: left_k, right_k, left_distortion, right_distortion, r, t, baseline_m.
    """
    left, right, t = F.col("left_k"), F.col("right_k"), F.col("t")
    base = F.col("baseline_m")
    zero = lambda array: F.forall(array, lambda c: F.abs(c) <= F.lit(1e-9))
    return {
        "baseline_positive": base > 0,
        "same_size": (left["width"] == right["width"]) & (left["height"] == right["height"]),
        "same_intrinsics": all_of([_near(left[n], right[n], 1e-5) for n in ("fx", "fy", "cx", "cy")]),
        "zero_distortion": zero(F.col("left_distortion")) & zero(F.col("right_distortion")),
        "identity_rotation": all_of([_near(F.col("r")[j], v, 1e-6) for j, v in enumerate(IDENTITY)]),
        "horizontal_baseline": F.abs(t[0]) >= 0.999 * F.greatest(F.abs(base), F.lit(1e-9)),
        "right_of_left": t[0] < 0,
        "no_vertical_or_forward": F.greatest(F.abs(t[1]), F.abs(t[2])) <= F.lit(1e-4),
    }


def baseline_agreement(configured: DataFrame, calibrated: DataFrame, keys) -> DataFrame:
    """Configured against calibrated baseline; an unset (zero or null) configuration agrees.

    Every configured camera keeps its row. One without a calibration has a null
    ``calibrated_m`` and does not agree, whatever is configured.
    """
    keys = list(keys)
    left = configured.select(*keys, F.col("baseline_m").alias("configured_m"))
    right = calibrated.select(*keys, F.col("baseline_m").alias("calibrated_m"))
    close = _near(F.col("configured_m"), F.col("calibrated_m"), 1e-5)
    return left.join(right, keys, "left").withColumn(
        "agrees",
        F.when(F.col("calibrated_m").isNull(), False)
        .when(F.col("configured_m") > 0, close)
        .otherwise(True),
    )


def camera_rules() -> dict[str, Column]:
    """Rules of one camera row together with the settings used for it.

    Columns: the ``cameras`` table plus depth_mode, use_rgb, output_format,
    rgb_mapping, crop_x/y/z (arrays of two), num_points, voxel_size.
    """
    c = F.col
    stereo = c("depth_mode") == "stereo"
    needs_extrinsics = (
        c("use_rgb")
        & (c("output_format") == "xyzrgb")
        & ~c("aligned")
        & (c("rgb_mapping") == "project_depth_to_color")
        & (c("depth_mode") == "frame")
    )
    rules = {
        f"{k}_positive": all_of(
            [c(f"{k}.{n}") > 0 for n in ("width", "height", "fx", "fy")]
        )
        for k in ("color_k", "depth_k")
    }
    rules["depth_scale_positive"] = c("depth_scale") > 0
    rules["depth_mode_known"] = c("depth_mode").isin("frame", "stereo")
    rules["output_format_known"] = c("output_format").isin("xyz", "xyzrgb")
    rules["rgb_mapping_known"] = c("rgb_mapping").isin(*RGB_MAPPINGS)
    for axis in "xyz":
        rules[f"crop_{axis}_ordered"] = c(f"crop_{axis}")[0] <= c(f"crop_{axis}")[1]
    rules["num_points_positive"] = c("num_points") > 0
    rules["voxel_size_positive"] = c("voxel_size") > 0
    rules["stereo_needs_unaligned"] = ~(stereo & c("aligned"))
    rules["projection_needs_extrinsics"] = ~needs_extrinsics | (
        c("r").isNotNull() & c("t").isNotNull()
    )
    return rules


def stereo_rules() -> dict[str, Column]:
    """Ranges of stereo settings kept as table rows."""
    c = F.col
    return {
        "max_disp": (c("max_disp") > 0) & (c("max_disp") % 4 == 0),
        "valid_iters": c("valid_iters") > 0,
        "precision": c("precision").isin(*PRECISIONS),
        "rectification_mode": c("rectification_mode").isin(*RECTIFICATION_MODES),
        "min_disparity_px": c("min_disparity_px") > 0,
        "min_depth_m": c("min_depth_m") >= 0,
        "max_depth_m": c("max_depth_m").isNull() | (c("max_depth_m") > 0),
    }


def sampling_rules() -> dict[str, Column]:
    """Sampling settings kept as table rows: sampling_mode, pad_mode, num_points, voxel_size."""
    c = F.col
    return {
        "sampling_mode_known": F.lower("sampling_mode").isin(*SAMPLING_MODES),
        "pad_mode_known": F.lower("pad_mode").isin(*PAD_MODES),
        "num_points_positive": c("num_points") > 0,
        "voxel_size_positive": c("voxel_size") > 0,
    }


def engine_rules(backends: Sequence[str], height: int, width: int) -> dict[str, Column]:
    """Settings a stereo engine was built for, as table rows.

    Columns: backend, height, width, cv_group, builder_optimization_level and
    workspace_gib; ``backends`` are the names in use, and ``height`` and ``width``
    the image size the network takes.
    """
    c = F.col
    return {
        "backend_known": F.lower("backend").isin(*[b.lower() for b in backends]),
        "image_size": (c("height") == height) & (c("width") == width),
        "cv_group_positive": c("cv_group") > 0,
        "optimization_level": c("builder_optimization_level").between(0, 5),
        "workspace_positive": c("workspace_gib") > 0,
    }


def index_agreement(read: DataFrame, keys: Sequence[str], asked: str, got: str) -> DataFrame:
    """Whether the reader returned the frame that was asked for."""
    return read.select(
        *keys, asked, got, F.coalesce(F.col(asked) == F.col(got), F.lit(False)).alias("agrees")
    )


def resolve_alias(camera: Column, aliases: Mapping[str, str] = CAMERA_ALIASES) -> Column:
    """Full camera name; names without an alias stay as they are."""
    pairs = [F.lit(v) for item in aliases.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), camera), camera)


def contract_mismatches(
    expected: DataFrame, found: DataFrame, keys: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """One row per manifest field that differs from the configured value."""
    keys = list(keys)

    def unpivot(df: DataFrame, name: str) -> DataFrame:
        cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields]
        return df.select(*keys, F.inline(F.array(*cells)))

    both = unpivot(expected, "expected").join(
        unpivot(found, "found"), [*keys, "field"], "full_outer"
    )
    return both.where(~F.col("expected").eqNullSafe(F.col("found")))


def precision_mismatches(manifest: DataFrame, keys: Sequence[str], records: Sequence[str]) -> DataFrame:
    """Artifact records whose fp16 flag contradicts the manifest's precision.

    Each record column is a nullable boolean flag.
    """
    cells = [F.struct(F.lit(r).alias("record"), F.col(r).alias("fp16")) for r in records]
    flat = manifest.select(*keys, "precision", F.inline(F.array(*cells)))
    return flat.where(
        F.col("fp16").isNotNull() & (F.col("fp16") != (F.col("precision") == "fp16"))
    )


def artifact_status(
    manifest: DataFrame, files: DataFrame, required: DataFrame, keys: Sequence[str] = ()
) -> DataFrame:
    """Status of each required artifact: ok, missing, unrecorded or changed.

    ``manifest`` holds (path, sha256, position), ``files`` (path, sha256) and
    ``required`` path. A record matches by file name, as a manifest moves with
    its folder, and the first record of a name counts. With many manifests
    ``keys`` name the one a record and a requirement belong to.
    """
    keys = list(keys)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    recorded = (
        manifest.select(*keys, name, "sha256", "position")
        .groupBy(*keys, "name")
        .agg(F.min_by("sha256", "position").alias("recorded"))
    )
    present = files.select("path", F.col("sha256").alias("actual"))
    joined = (
        required.select(*keys, "path", name)
        .join(recorded, [*keys, "name"], "left")
        .join(present, "path", "left")
    )
    status = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("recorded").isNull(), "unrecorded")
        .when(F.col("recorded") != F.col("actual"), "changed")
        .otherwise("ok")
    )
    return joined.select(*keys, "path", status.alias("status"))


def contract_differences(
    expected: DataFrame,
    found: DataFrame,
    keys: Sequence[str],
    fields: Sequence[str],
    only_set: bool = False,
) -> DataFrame:
    """(keys, field, expected, found) of every field on which two contracts differ.

    Both tables hold a map ``contract`` of canonical texts, as the readers of
    ``sources.contracts`` give them. With ``only_set`` a field that ``expected``
    leaves out is not compared. A key that ``found`` lacks differs in all its
    fields; where a key has several contracts, each is compared.
    """
    keys = list(keys)
    left = expected.select(*keys, F.col("contract").alias("_e"))
    right = found.select(*keys, F.col("contract").alias("_f"))
    cells = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                F.try_element_at("_e", F.lit(f)).alias("expected"),
                F.try_element_at("_f", F.lit(f)).alias("found"),
            )
            for f in fields
        ]
    )
    differs = ~F.col("expected").eqNullSafe(F.col("found"))
    if only_set:
        differs = differs & F.col("expected").isNotNull()
    return left.join(right, keys, "left").select(*keys, F.inline(cells)).where(differs)


def flag_differences(
    expected: DataFrame, found: DataFrame, keys: Sequence[str], records: Sequence[str]
) -> DataFrame:
    """(keys, field, expected, found) of engine records whose fp16 flag contradicts the
    configured precision; a record without the flag says nothing."""
    keys = list(keys)
    precision = F.try_element_at(F.col("contract"), F.lit("precision"))
    left = expected.select(*keys, (precision == '"fp16"').cast("string").alias("expected"))
    cells = [
        F.struct(
            F.lit(f"{r}.fp16").alias("field"),
            F.try_element_at("contract", F.lit(f"{r}.fp16")).alias("found"),
        )
        for r in records
    ]
    right = found.select(*keys, F.inline(F.array(*cells))).where("found is not null")
    both = right.join(left, keys).select(*keys, "field", "expected", "found")
    return both.where(~F.col("expected").eqNullSafe(F.col("found")))
