"""Binary files in the shared folder that all executors and the driver see."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from framecloud.functions.checkpoints import checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; nothing is created yet."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let a worker hold few rows at a time, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; a bare path and ``file:`` are local."""
    if re.match(r"(file:|/)", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def open_output(uri: str):
    """A stream to a new file; its folder is made when missing."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)  # not by the file's name


def open_input(uri: str):
    """A seekable file, mapped into memory where the store is local."""
    store, path = filesystem(uri)
    return store.open_input_file(path)


def attempt_name(folder: str, part: int, suffix: str) -> str:
    """A file name no other attempt of the same task uses.

    Only names that a finished attempt returned are read again, so what a lost or
    speculative attempt leaves behind is never seen.
    """
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def written(df: DataFrame, folder: str) -> DataFrame:
    """Run ``df`` once, keep its rows as Parquet in ``folder`` and read them back."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
