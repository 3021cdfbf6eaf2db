"""Artifact files and their recorded hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framecloud.functions.files import filesystem

STREAMED_FROM = 256 * 1024 * 1024
BLOCK = 8 * 1024 * 1024
_RECORD = "struct<path:string,name:string,sha256:string,size:bigint>"


def hash_files(spark: SparkSession, path: str, streamed_from: int = STREAMED_FROM) -> DataFrame:
    """(path, sha256, size) of every file below ``path``.

    A file of up to ``streamed_from`` bytes is one binary cell, which Spark hashes. A
    larger one would not fit in a cell, so a task reads it in blocks of ``BLOCK`` bytes;
    it is opened through the file system of its path, which the executors' Python must
    be able to reach. The filter on the length keeps either reader from opening the
    other's files. Spark lists no empty files, so an empty artifact counts as missing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= streamed_from).select(
        "path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")
    )
    listed = files.where(F.col("length") > streamed_from).select("path", F.col("length").alias("size"))
    # Long files take long, so each is a task of its own as far as slots go.
    parts = max(spark.sparkContext.defaultParallelism, 1)
    large = listed.repartition(parts, "path").mapInPandas(
        _digests, "path string, sha256 string, size bigint"
    )
    return small.unionByName(large)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(sha256=[_digest(p) for p in batch["path"]])[["path", "sha256", "size"]]


def _digest(path: str) -> str:
    system, inner = filesystem(path)
    found = hashlib.sha256()
    with system.open_input_stream(inner) as stream:
        while block := stream.read(BLOCK):
            found.update(block)
    return found.hexdigest()


def require_objects(texts: DataFrame) -> DataFrame:
    """Pass (path, value) rows through, failing the job where a value is no JSON object."""
    form = F.schema_of_variant(F.try_parse_json("value"))
    message = F.concat(F.col("path"), F.lit(": a manifest must be a JSON object"))
    whole = F.coalesce(form.startswith("OBJECT"), F.lit(False))
    return texts.where(F.when(whole, True).otherwise(F.raise_error(message).cast("boolean")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size, position) of the artifacts a manifest records.

    ``artifacts`` is a list of records, or a mapping from file name to a record or to
    the bare hash. A file that is no JSON object fails the job; one without artifacts
    gives no rows, and a record without a name or hash cannot vouch for a file and is
    left out.
    """
    text = require_objects(spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path")))
    raw = text.select(F.get_json_object("value", "$.artifacts").alias("a"))
    entries = F.transform(
        F.map_entries(F.from_json("a", "map<string,string>")),
        lambda e: F.struct(e["key"].alias("key"), _record_of(e["value"]).alias("r")),
    )
    from_map = F.transform(
        entries,
        lambda e: F.struct(
            e["key"].alias("path"), e["key"].alias("name"), e["r"]["sha256"], e["r"]["size"]
        ).cast(_RECORD),
    )
    listed = F.when(F.col("a").startswith("{"), from_map).otherwise(
        F.from_json("a", f"array<{_RECORD}>")
    )
    return (
        raw.select(F.posexplode(listed).alias("position", "r"))
        .select(F.coalesce("r.path", "r.name").alias("path"), "r.sha256", "r.size", "position")
        .where("path is not null and sha256 is not null")
    )


def _record_of(text: Column) -> Column:
    """A mapping's value: a JSON record, or the bare hash."""
    bare = F.struct(
        F.lit(None).alias("path"), F.lit(None).alias("name"), text.alias("sha256"), F.lit(None).alias("size")
    ).cast(_RECORD)
    return F.when(text.startswith("{"), F.from_json(text, _RECORD)).otherwise(bare)
