"""Run contracts: what manifests and engine settings say an artifact was built for.

A contract is a map from field name to canonical text: strings stay quoted as in
JSON, numbers become doubles, so 480 and 480.0 agree and 480 and "480" do not.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framecloud.operators.checks import contract_differences, flag_differences
from framecloud.sources.artifacts import require_objects

# Fields of a manifest and of an engine's settings.
CORE_FIELDS = (
    "backend", "height", "width", "max_disp", "valid_iters", "precision", "normalization_contract",
)
BUILD_FIELDS = ("builder_optimization_level", "workspace_gib")
NAME_FIELDS = ("input_names", "output_names")
RECORDS = ("engine", "feature_engine", "post_engine")

FIELDS = CORE_FIELDS + BUILD_FIELDS + NAME_FIELDS
FLAGS = tuple(f"{r}.fp16" for r in RECORDS)


def _canonical(text: Column) -> Column:
    """Text of one JSON value in a form that equal values share; null stays null."""
    number = F.when(text.rlike("^-?[0-9]"), text.try_cast("double")).cast("string")
    return F.when(text != "null", F.coalesce(number, text))


def parse_contracts(texts: DataFrame) -> DataFrame:
    """(path, config_path, contract) of JSON texts in columns ``path`` and ``value``.

    ``config_path`` is the settings file the text names, null where there is none. A
    field that is missing or null is absent from the map; unknown fields are ignored. A
    record that is no object has no flag. A text that is no JSON object fails the job.
    """
    parsed = require_objects(texts).withColumn("_v", F.parse_json("value"))
    field = lambda name: F.to_json(F.try_variant_get("_v", f"$.{name}", "variant"))
    names = FIELDS + FLAGS
    pairs = F.array(*[F.struct(F.lit(n).alias("k"), _canonical(field(n)).alias("v")) for n in names])
    known = F.filter(pairs, lambda p: p["v"].isNotNull())
    return parsed.select(
        "path",
        F.try_variant_get("_v", "$.config_path", "string").alias("config_path"),
        F.map_from_entries(known).alias("contract"),
    )


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contracts of the JSON manifests at ``path``, one file a row."""
    texts = spark.read.text(path, wholetext=True)
    return parse_contracts(texts.select(F.col("_metadata.file_path").alias("path"), "value"))


def read_engine_configs(spark: SparkSession, path: str) -> DataFrame:
    """Contracts of YAML or JSON engine settings at ``path``.

    A file that cannot be parsed or is no mapping fails the job with its path.
    """
    texts = spark.read.text(path, wholetext=True)
    named = texts.select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_contracts(named.mapInPandas(_as_json, "path string, value string"))


def _as_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        values = [_json_text(p, v) for p, v in zip(batch["path"], batch["value"], strict=True)]
        yield batch.assign(value=values)[["path", "value"]]


def _json_text(path: str, text: str) -> str:
    try:
        return json.dumps(json.loads(text), default=str)
    except ValueError:
        pass
    import yaml

    try:
        return json.dumps(yaml.safe_load(text), default=str)
    except yaml.YAMLError as error:
        raise ValueError(f"{path}: engine settings cannot be parsed: {error}") from error


def configured(df: DataFrame, keys: Sequence[str], columns: Mapping[str, str] | None = None) -> DataFrame:
    """Settings in columns as a contract beside their keys.

    ``columns`` maps contract fields to columns, by default each field that is a column
    of ``df`` to itself. Name lists are arrays; an empty one counts as not set.
    """
    used = columns or {f: f for f in FIELDS if f in df.columns}
    types = dict(df.dtypes)
    cells = []
    for field, column in used.items():
        value = F.col(column)
        if types[column].startswith("array"):
            value = F.when(F.size(value) > 0, value)
            text = F.to_json(value)
        elif types[column] == "string":
            # An array is what to_json takes; its brackets go again.
            text = F.regexp_extract(F.to_json(F.when(value.isNotNull(), F.array(value))), r"^\[(.*)\]$", 1)
        else:
            text = value.cast("double").cast("string")
        cells.append(F.struct(F.lit(field).alias("k"), text.alias("v")))
    known = F.filter(F.array(*cells), lambda p: p["v"].isNotNull())
    return df.select(*keys, F.map_from_entries(known).alias("contract"))


def resolve_configs(engines: DataFrame, configs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, config, problem): the settings file that belongs to each engine.

    ``engines`` holds the keys, ``engine`` (its path), ``explicit`` (a path given by the
    user or null), ``manifest`` (its path or null) and ``declared`` (the path the
    manifest names, relative to its folder, or null). ``configs`` holds ``path`` of the
    files that are there. An explicit path counts first, then the declared one, then the
    file that shares the engine's name without its ending, then the only file in its
    folder. ``problem`` is null, ``missing`` or ``ambiguous``: nothing is guessed.
    """
    keys = list(keys)
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]*$", 1)
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    declared = F.when(F.col("declared").rlike("^(/|[a-z0-9]+:)"), F.col("declared")).otherwise(
        F.concat(folder(F.col("manifest")), F.lit("/"), F.col("declared"))
    )
    named = F.coalesce(_plain("explicit"), _plain(F.when(F.col("declared") != "", declared)))
    asked = engines.select(*keys, _plain("engine").alias("engine"), named.alias("_named")).withColumns(
        {"_stem": stem(F.col("engine")), "_dir": folder(F.col("engine"))}
    )
    files = configs.select(_plain("path").alias("_file"), F.col("path").alias("_as_read")).distinct()
    yaml = files.where(F.col("_file").rlike(r"\.ya?ml$"))

    def choices(by: str, key: Column) -> DataFrame:
        """How many files share a key, and one of them."""
        return yaml.groupBy(key.alias(by)).agg(
            F.count(F.lit(1)).alias(f"{by}_n"), F.min("_as_read").alias(f"{by}_file")
        )

    exact = files.select(F.col("_file").alias("_named"), F.col("_as_read").alias("_named_file"))
    found = (
        asked.join(exact, "_named", "left")
        .join(choices("_stem", stem(F.col("_file"))), "_stem", "left")
        .join(choices("_dir", folder(F.col("_file"))), "_dir", "left")
    )
    by_name, several = F.col("_named").isNotNull(), F.lit("ambiguous")
    config = (
        F.when(by_name, F.col("_named_file"))
        .when(F.col("_stem_n") >= 1, F.when(F.col("_stem_n") == 1, F.col("_stem_file")))
        .when(F.col("_dir_n") == 1, F.col("_dir_file"))
    )
    problem = (
        F.when(config.isNotNull(), F.lit(None).cast("string"))
        .when(by_name, "missing")
        .when((F.col("_stem_n") > 1) | (F.col("_dir_n") > 1), several)
        .otherwise("missing")
    )
    return found.select(*keys, config.alias("config"), problem.alias("problem"))


def _plain(path: str | Column) -> Column:
    """A path without the scheme of local files, so that both spellings meet."""
    column = F.col(path) if isinstance(path, str) else path
    return F.regexp_replace(column, "^file:/+", "/")


def contract_report(
    expected: DataFrame, manifests: DataFrame, configs: DataFrame | None, keys: Sequence[str]
) -> DataFrame:
    """(keys, side, field, expected, found): every broken promise of a run contract.

    All tables hold the keys and a map ``contract``. ``side`` names what
    differs: ``manifest`` and ``config`` from what is configured, ``engines`` from each
    other; flags of engine records are compared with the configured precision. What is
    not configured is only compared between manifest and settings, and there only the
    fields both must hold. No row means that all agree.
    """
    keys = list(keys)
    mark = lambda df, side: df.withColumn("side", F.lit(side))
    parts = [
        mark(contract_differences(expected, manifests, keys, FIELDS, only_set=True), "manifest"),
        mark(flag_differences(expected, manifests, keys, RECORDS), "manifest"),
    ]
    if configs is not None:
        parts += [
            mark(contract_differences(expected, configs, keys, FIELDS, only_set=True), "config"),
            mark(contract_differences(manifests, configs, keys, CORE_FIELDS), "engines"),
        ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.select(*keys, "side", "field", "expected", "found")
