"""Rule audits over camera, calibration and manifest rows derived from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from framecloud.catalog import views
from framecloud.catalog.registry import query
from framecloud.functions.checkpoints import checkpoint_dir, cut
from framecloud.functions.files import write_files
from framecloud.operators import checks as ck
from framecloud.sources.artifacts import hash_files
from framecloud.sources.calibration import apply_calibration
from framecloud.sources.contracts import (
    configured,
    contract_report,
    read_contracts,
    read_engine_configs,
)


def _lens(fx, width):
    return F.struct(
        width.alias("width"),
        F.lit(480).alias("height"),
        fx.alias("fx"),
        fx.alias("fy"),
        F.lit(320.0).alias("cx"),
        F.lit(240.0).alias("cy"),
    )


def calibration(spark, sf_dir):
    """One stereo calibration per part; some sizes carry one defect each."""
    size = F.col("p_size")
    fault = lambda n, bad, good: F.when(size == n, bad).otherwise(good)
    fx = (size + 600).cast("double")
    base = fault(21, F.lit(0.0), F.col("p_retailprice") / 20000.0)
    part = views.table(spark, sf_dir, "part").withColumn("_b", base)
    b = F.col("_b")
    one, zero = F.lit(1.0), F.lit(0.0)
    return part.select(
        F.col("p_partkey").cast("string").alias("camera"),
        "p_size",
        _lens(fx, F.lit(640)).alias("left_k"),
        _lens(fault(7, fx + 0.001, fx), fault(9, F.lit(320), F.lit(640))).alias("right_k"),
        F.array(zero, fault(11, F.lit(0.001), zero)).alias("left_distortion"),
        F.array(zero, zero).alias("right_distortion"),
        F.array(
            one, fault(13, F.lit(0.001), zero), zero, zero, one, zero, zero, zero, one
        ).alias("r"),
        F.array(
            fault(15, b * -0.9, fault(19, b, -b)), fault(17, F.lit(0.01), zero), zero
        ).alias("t"),
        b.alias("baseline_m"),
    )


_RECT = {
    21: "baseline_positive",
    9: "same_size",
    7: "same_intrinsics",
    11: "zero_distortion",
    13: "identity_rotation",
    15: "horizontal_baseline",
    19: "right_of_left",
    17: "no_vertical_or_forward",
}


@query(
    "rectification_gate",
    """select cast(p_partkey as varchar) as camera, concat_ws(',',
      case when p_size = 21 then 'baseline_positive' end, case when p_size = 9 then 'same_size' end,
      case when p_size = 7 then 'same_intrinsics' end, case when p_size = 11 then 'zero_distortion' end,
      case when p_size = 13 then 'identity_rotation' end,
      case when p_size in (15, 21) then 'horizontal_baseline' end,
      case when p_size in (19, 21) then 'right_of_left' end,
      case when p_size = 17 then 'no_vertical_or_forward' end) as violations,
      p_size not in (7, 9, 11, 13, 15, 17, 19, 21) as ok from part""",
)
def rectification_gate(spark, sf_dir):
    found = ck.audit(calibration(spark, sf_dir), ["camera"], ck.rectification_rules())
    return found.withColumn("violations", F.array_join("violations", ","))


@query(
    "baseline_agreement",
    """select cast(p_partkey as varchar) as camera, configured_m, calibrated_m,
      case when calibrated_m is null then false
        when configured_m > 0 then abs(configured_m - calibrated_m) <= 1e-5::double else true end as agrees
    from (select *, case when p_size = 23 then null when p_size = 21 then 0.0::double
          else p_retailprice / 20000.0::double end as calibrated_m,
        case when p_size = 3 then 0.0::double when p_size % 5 = 0 then p_retailprice / 20000.0::double + 0.001::double
          else p_retailprice / 20000.0::double end as configured_m from part)""",
)
def baseline_agreement(spark, sf_dir):
    """Configuration from the part price; every fifth size is off by a millimetre, and
    cameras of size 23 were never calibrated."""
    price = F.col("p_retailprice") / 20000.0
    configured = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("camera"),
        F.when(F.col("p_size") == 3, F.lit(0.0))
        .when(F.col("p_size") % 5 == 0, price + 0.001)
        .otherwise(price)
        .alias("baseline_m"),
    )
    calibrated = calibration(spark, sf_dir).where("p_size <> 23")
    return ck.baseline_agreement(configured, calibrated, ["camera"])


@query(
    "camera_rules",
    """with c as (select *, c_nationkey % 2 = 0 as aligned,
        case c_mktsegment when 'BUILDING' then 'stereo' when 'MACHINERY' then 'lidar' else 'frame' end as mode
      from customer)
    select cast(c_custkey as varchar) as camera, concat_ws(',',
      case when c_nationkey = 3 then 'depth_k_positive' end,
      case when c_nationkey = 5 then 'depth_scale_positive' end,
      case when mode = 'lidar' then 'depth_mode_known' end,
      case when c_acctbal < 0 then 'crop_x_ordered' end,
      case when c_nationkey = 7 then 'num_points_positive' end,
      case when mode = 'stereo' and aligned then 'stereo_needs_unaligned' end,
      case when not aligned and mode = 'frame' and c_nationkey > 20 then 'projection_needs_extrinsics' end
      ) as violations from c""",
)
def camera_rules(spark, sf_dir):
    """One camera row per customer, with defects by nation, segment and balance."""
    n = F.col("c_nationkey")
    lens = lambda fx: F.struct(
        F.lit(640).alias("width"), F.lit(480).alias("height"), fx.alias("fx"), fx.alias("fy"),
        F.lit(320.0).alias("cx"), F.lit(240.0).alias("cy"),
    )
    ident = F.array(*[F.lit(v) for v in ck.IDENTITY])
    rows = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("camera"),
        (n % 2 == 0).alias("aligned"),
        F.when(n == 5, F.lit(0.0)).otherwise(F.lit(0.001)).alias("depth_scale"),
        lens(F.lit(600.0)).alias("color_k"),
        lens(F.when(n == 3, F.lit(0.0)).otherwise(F.lit(580.0))).alias("depth_k"),
        F.when(n <= 20, ident).alias("r"),
        F.when(n <= 20, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0))).alias("t"),
        F.when(F.col("c_mktsegment") == "BUILDING", "stereo")
        .when(F.col("c_mktsegment") == "MACHINERY", "lidar")
        .otherwise("frame")
        .alias("depth_mode"),
        F.lit(True).alias("use_rgb"),
        F.lit("xyzrgb").alias("output_format"),
        F.lit("project_depth_to_color").alias("rgb_mapping"),
        F.array(F.lit(0.0), F.when(F.col("c_acctbal") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))).alias("crop_x"),
        F.array(F.lit(-1.0), F.lit(1.0)).alias("crop_y"),
        F.array(F.lit(0.0), F.lit(2.0)).alias("crop_z"),
        F.when(n == 7, 0).otherwise(1024).alias("num_points"),
        F.lit(0.01).alias("voxel_size"),
    )
    found = ck.audit(rows, ["camera"], ck.camera_rules())
    return found.select("camera", F.array_join("violations", ",").alias("violations"))


@query(
    "stereo_setting_rules",
    """select cast(p_partkey as varchar) as camera, concat_ws(',',
      case when p_size % 4 <> 0 then 'max_disp' end,
      case when p_size = 8 then 'valid_iters' end,
      case when p_type = 'ECONOMY' then 'precision' end,
      case when p_retailprice > 1000 then 'max_depth_m' end) as violations from part""",
)
def stereo_setting_rules(spark, sf_dir):
    rows = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("camera"),
        F.col("p_size").alias("max_disp"),
        F.when(F.col("p_size") == 8, 0).otherwise(8).alias("valid_iters"),
        F.when(F.col("p_type") == "ECONOMY", "fp8").otherwise("fp16").alias("precision"),
        F.lit("auto").alias("rectification_mode"),
        F.lit(0.001).alias("min_disparity_px"),
        F.lit(0.0).alias("min_depth_m"),
        F.when(F.col("p_retailprice") > 1000, F.lit(0.0)).alias("max_depth_m"),
    )
    found = ck.audit(rows, ["camera"], ck.stereo_rules())
    return found.select("camera", F.array_join("violations", ",").alias("violations"))


@query(
    "sampling_setting_rules",
    """select cast(p_partkey as varchar) as camera, concat_ws(',',
      case when p_size % 7 = 0 then 'sampling_mode_known' end,
      case when p_size % 5 = 0 then 'pad_mode_known' end,
      case when p_size = 9 then 'num_points_positive' end,
      case when p_size % 11 = 0 then 'voxel_size_positive' end) as violations from part""",
)
def sampling_setting_rules(spark, sf_dir):
    """Sampling settings per part; a null, like a name no mode has, breaks its rule."""
    size = F.col("p_size")
    rows = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("camera"),
        F.when(size % 7 == 0, "nearest").when(size % 2 == 0, "FPS").otherwise("voxel_random").alias("sampling_mode"),
        F.when(size % 5 != 0, "zero").alias("pad_mode"),
        F.when(size == 9, 0).otherwise(1024).alias("num_points"),
        F.when(size % 11 == 0, F.lit(-0.01)).otherwise(F.lit(0.01)).alias("voxel_size"),
    )
    found = ck.audit(rows, ["camera"], ck.sampling_rules())
    return found.select("camera", F.array_join("violations", ",").alias("violations"))


@query(
    "engine_setting_rules",
    """select cast(p_partkey as varchar) as camera, concat_ws(',',
      case when p_size % 7 = 0 then 'backend_known' end,
      case when p_size % 5 = 0 or p_size = 6 then 'image_size' end,
      case when p_size = 9 then 'cv_group_positive' end,
      case when p_size % 8 > 5 then 'optimization_level' end,
      case when p_size % 11 = 0 then 'workspace_positive' end) as violations from part""",
)
def engine_setting_rules(spark, sf_dir):
    """Engine settings per part with defects by size."""
    size = F.col("p_size")
    rows = views.table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("camera"),
        F.when(size % 7 == 0, "other").when(size % 2 == 0, "Plugin").otherwise("single").alias("backend"),
        F.when(size % 5 == 0, 240).otherwise(480).alias("height"),
        F.when(size != 6, 640).alias("width"),
        F.when(size == 9, 0).otherwise(8).alias("cv_group"),
        (size % 8).alias("builder_optimization_level"),
        F.when(size % 11 == 0, 0.0).otherwise(8.0).alias("workspace_gib"),
    )
    found = ck.audit(rows, ["camera"], ck.engine_rules(("single", "plugin"), 480, 640))
    return found.select("camera", F.array_join("violations", ",").alias("violations"))


@query(
    "index_agreement",
    """select o_orderkey as read_id, o_orderkey as asked,
      o_orderkey + (case when o_orderstatus = 'P' then 1 else 0 end) as got,
      o_orderstatus <> 'P' as agrees from orders""",
)
def index_agreement(spark, sf_dir):
    """Reads asked by order key; pending orders return their neighbour."""
    read = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("read_id"),
        F.col("o_orderkey").alias("asked"),
        (F.col("o_orderkey") + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("got"),
    )
    return ck.index_agreement(read, ["read_id"], "asked", "got")


@query(
    "camera_alias",
    """select c_custkey, case c_mktsegment when 'BUILDING' then 'head_rgb' when 'MACHINERY' then 'left_wrist_rgb'
      when 'FURNITURE' then 'right_wrist_rgb' else c_mktsegment end as camera from customer""",
)
def camera_alias(spark, sf_dir):
    short = (
        F.when(F.col("c_mktsegment") == "BUILDING", "head")
        .when(F.col("c_mktsegment") == "MACHINERY", "left_wrist")
        .when(F.col("c_mktsegment") == "FURNITURE", "right_wrist")
        .otherwise(F.col("c_mktsegment"))
    )
    return views.table(spark, sf_dir, "customer").select(
        "c_custkey", ck.resolve_alias(short).alias("camera")
    )


@query(
    "manifest_contract",
    """with e as (select s_suppkey, 'backend' as field, 'plugin' as expected,
        case when s_nationkey % 3 = 0 then 'single' else 'plugin' end as found from supplier
      union all select s_suppkey, 'height', '480', case when s_acctbal < 0 then '240' else '480' end from supplier
      union all select s_suppkey, 'precision', 'fp16', case when s_nationkey % 5 = 0 then null else 'fp16' end from supplier)
    select * from e where expected is distinct from found""",
)
def manifest_contract(spark, sf_dir):
    """One manifest per supplier against one fixed contract."""
    supplier = views.table(spark, sf_dir, "supplier")
    expected = supplier.select(
        "s_suppkey",
        F.lit("plugin").alias("backend"),
        F.lit(480).alias("height"),
        F.lit("fp16").alias("precision"),
    )
    found = supplier.select(
        "s_suppkey",
        F.when(F.col("s_nationkey") % 3 == 0, "single").otherwise("plugin").alias("backend"),
        F.when(F.col("s_acctbal") < 0, 240).otherwise(480).alias("height"),
        F.when(F.col("s_nationkey") % 5 != 0, "fp16").alias("precision"),
    )
    return ck.contract_mismatches(
        expected, found, ["s_suppkey"], ["backend", "height", "precision"]
    )


@query(
    "contract_files",
    """with m as (select *, case when s_nationkey % 3 = 0 then '"single"' else '"plugin"' end as mb,
        case when s_acctbal < 0 then '240.0' else '480.0' end as mh,
        case when s_nationkey % 5 = 0 then '"8"' else '8.0' end as ci from supplier)
    select s_suppkey, 'manifest' as side, 'backend' as field, '"plugin"' as expected, mb as found from m where mb = '"single"'
    union all select s_suppkey, 'manifest', 'height', '480.0', mh from m where mh = '240.0'
    union all select s_suppkey, 'manifest', 'engine.fp16', 'true', 'false' from m where s_nationkey % 7 = 0
    union all select s_suppkey, 'config', 'valid_iters', '8.0', ci from m where ci = '"8"'
    union all select s_suppkey, 'engines', 'backend', mb, '"plugin"' from m where mb = '"single"'
    union all select s_suppkey, 'engines', 'height', mh, '480.0' from m where mh = '240.0'
    union all select s_suppkey, 'engines', 'valid_iters', '8.0', ci from m where ci = '"8"'""",
)
def contract_files(spark, sf_dir):
    """One manifest and one settings file per supplier, written, read and compared.

    Manifests differ by nation and balance, and some settings hold a number as text.
    """
    n = F.col("s_nationkey")
    supplier = views.table(spark, sf_dir, "supplier")
    shared = {"width": F.lit(640), "max_disp": F.lit(192), "normalization_contract": F.lit("imagenet")}
    settings = {**shared, "backend": F.lit("plugin"), "height": F.lit(480), "precision": F.lit("fp16")}
    manifest = settings | {
        "backend": F.when(n % 3 == 0, "single").otherwise("plugin"),
        "height": F.when(F.col("s_acctbal") < 0, 240.0).otherwise(480.0),
        "valid_iters": F.lit(8),
        "engine": F.struct((n % 7 != 0).alias("fp16")),
        "input_names": F.array(F.lit("left"), F.lit("right")),
    }
    as_text = n % 5 == 0
    config = settings | {
        "valid_iters": F.when(as_text, "8"),
        "input_names": F.array(F.lit("left"), F.lit("right")),
    }
    text = lambda cells: F.to_json(F.struct(*[c.alias(k) for k, c in cells.items()]))
    number = {**config, "valid_iters": F.when(~as_text, 8)}
    texts = {
        "manifests": text(manifest),
        "configs": F.when(as_text, text(config)).otherwise(text(number)),
    }
    base = f"{checkpoint_dir(spark)}/contracts-{uuid.uuid4().hex}"
    for name, value in texts.items():
        rows = supplier.select(F.concat("s_suppkey", F.lit(".json")).alias("name"), value.alias("value"))
        write_files(rows, f"{base}/{name}", "name", "value")
    key = F.regexp_extract("path", r"/([0-9]+)\.json$", 1).cast("bigint").alias("s_suppkey")
    asked = supplier.withColumns({**settings, "valid_iters": F.lit(8), "input_names": manifest["input_names"]})
    # The report compares each side several times; the files are opened once.
    return contract_report(
        configured(asked, ["s_suppkey"]),
        cut(read_contracts(spark, f"{base}/manifests").select(key, "contract")),
        cut(read_engine_configs(spark, f"{base}/configs").select(key, "contract")),
        ["s_suppkey"],
    )


@query(
    "artifact_files",
    """select s_suppkey, sha256(s_name || chr(10)) as sha256, length(s_name) + 1 as size from supplier""",
)
def artifact_files(spark, sf_dir):
    """Names of suppliers as artifact files: hashed where they lie, half of the sizes in blocks."""
    base = f"{checkpoint_dir(spark)}/artifacts-{uuid.uuid4().hex}"
    names = views.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("value"))
    write_files(names, base, "s_suppkey", "value")
    key = F.regexp_extract("path", r"/([0-9]+)$", 1).cast("bigint").alias("s_suppkey")
    # Names are of much the same length: a limit of their median makes both readers work.
    middle = names.select(F.percentile_approx(F.length("value") + 1, 0.5)).first()[0] or 0
    return hash_files(spark, base, streamed_from=middle - 1).select(key, "sha256", "size")


@query(
    "artifact_hashes",
    """select cast(doc_id as varchar) as path,
      case when source = 'src0' then 'missing' when lang = 'de' then 'unrecorded'
        when n_chars % 2 = 0 then 'changed' else 'ok' end as status from documents""",
)
def artifact_hashes(spark, sf_dir):
    """Documents as artifact files: their whole text is hashed against a recorded hash.

    Files of source 'src0' are gone, German ones were never recorded, and texts of
    even length were recorded before a change.
    """
    docs = views.table(spark, sf_dir, "documents").withColumn("path", F.col("doc_id").cast("string"))
    files = docs.where("source <> 'src0'").select("path", F.sha2("text", 256).alias("sha256"))
    before = F.when(F.col("n_chars") % 2 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    manifest = docs.where("lang <> 'de'").select(
        "path", F.sha2(before, 256).alias("sha256"), F.lit(0).alias("position")
    )
    return ck.artifact_status(manifest, files, docs.select("path"))


@query(
    "calibrated_cameras",
    """select cast(n_nationkey as varchar) as camera, 0.05::double as baseline_m, 600.0::double + n_nationkey as fx,
      480 as height, n_nationkey / 100.0::double as shift, n_nationkey % 2 = 0 as aligned from nation""",
)
def calibrated_cameras(spark, sf_dir):
    """Infrared lens and pose of a rectified pair put in place of the depth lens."""
    n = F.col("n_nationkey")
    lens = F.struct(
        F.lit(640).alias("width"),
        F.lit(480).alias("height"),
        (n + 600.0).alias("fx"),
        (n + 600.0).alias("fy"),
        F.lit(320.0).alias("cx"),
        F.lit(240.0).alias("cy"),
    )
    identity = F.array(*[F.lit(v) for v in ck.IDENTITY])
    zero = F.array(F.lit(0.0), F.lit(0.0))
    calibration = views.table(spark, sf_dir, "nation").select(
        n.cast("string").alias("camera"),
        lens.alias("left_k"),
        lens.alias("right_k"),
        zero.alias("left_distortion"),
        zero.alias("right_distortion"),
        identity.alias("r"),
        F.array(F.lit(-0.05), F.lit(0.0), F.lit(0.0)).alias("t"),
        identity.alias("color_r"),
        F.array(n / 100.0, F.lit(0.0), F.lit(0.0)).alias("color_t"),
        F.lit(0.05).alias("baseline_m"),
    )
    out = apply_calibration(views.cameras(spark, sf_dir), calibration)
    return out.select(
        "camera",
        "baseline_m",
        F.col("depth_k.fx").alias("fx"),
        F.col("depth_k.height").alias("height"),
        F.col("t")[0].alias("shift"),
        "aligned",
    )
