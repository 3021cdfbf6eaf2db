"""ASCII PLY clouds as point tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """One row per vertex with its position in the file; colours 0..255 or null.

    Unix and Windows line ends are read. A file without vertices, and one that holds
    another number of them than its header names, fails the job; a header may leave
    the number out.
    """
    parts = F.split("value", r"end_header[ \t]*\r?\n", 2)
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        parts[0].alias("head"),
        F.filter(F.split(F.get(parts, F.lit(1)), r"\r?\n"), lambda line: F.trim(line) != "").alias("rows"),
    )
    named = F.regexp_extract("head", r"element\s+vertex\s+([0-9]+)", 1)
    found = F.size("rows")
    problem = F.when(
        ~F.col("head").startswith("ply") | F.coalesce(found == 0, F.lit(True)),
        F.concat(F.lit("empty or invalid point cloud: "), "path"),
    ).when(
        (named != "") & (named.cast("bigint") != found),
        F.concat(F.lit("cut point cloud: "), "path", F.lit(" names "), named, F.lit(" vertices")),
    )
    checked = F.when(problem.isNull(), F.col("rows")).otherwise(F.raise_error(problem).cast("array<string>"))
    vertices = files.select("path", F.posexplode(checked).alias("idx", "line"))
    cells = vertices.select(
        "path", F.col("idx").cast("bigint").alias("idx"), F.split(F.trim("line"), r"\s+").alias("c")
    )
    colors = [
        F.when(F.size("c") >= 6, F.get("c", F.lit(3 + j))).cast("int").alias(name)
        for j, name in enumerate(("red", "green", "blue"))
    ]
    return cells.select("path", "idx", *[F.get("c", F.lit(j)).cast("float").alias(a) for j, a in enumerate("xyz")], *colors)


def require_stages(clouds: DataFrame, directories: DataFrame, stages=("raw", "cropped", "sampled")):
    """Rows (directory, stage) for which no cloud was read."""
    wanted = directories.select(
        "directory", F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage")
    )
    parts = F.split("path", "/")
    have = clouds.select(
        F.element_at(parts, -2).alias("directory"),
        F.regexp_replace(F.element_at(parts, -1), r"\.ply$", "").alias("stage"),
    ).distinct()
    return wanted.join(have, ["directory", "stage"], "left_anti")
