"""Whitening of embeddings with distributed block matrices.

Entries become integers first, so counts, sums and deviations are exact. Rows are indexed
without gaps and laid into blocks; the scatter matrix is the transposed block matrix times
itself, one small local eigendecomposition gives the whitening matrix, and the block
matrix times that projects all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from framecloud.llm.storage import written

#: Rows and columns of a block; a block of doubles has some 0.5 MB at 64 columns.
BLOCK_ROWS, BLOCK_COLUMNS = 1024, 1024
#: A block and its place among the blocks.
BLOCK = StructType().add("place", StructType().add("row", LongType()).add("column", LongType())).add("block", MatrixUDT())
#: Entries are multiples of 1/64 above an offset that keeps them positive.
STEPS, OFFSET = 64, 1_000_000
#: Variances at or below this share of the largest count as none.
FLAT = 1e-12


@dataclass(frozen=True)
class Whitening:
    """What a fit found; ``matrix`` has one column for each component."""

    n: int
    sums: list[int]
    matrix: np.ndarray
    explained: np.ndarray
    flat: np.ndarray
    identity_error: float | None


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(vector, finite)


def integer_rows(df: DataFrame, vector: str, folder: str) -> tuple[DataFrame, int, int]:
    """The usable rows as ``_row`` with ``_x``, the integer entries, and ``_at``, a row number.

    Also the number of rows and the entries of the longest vector; shorter ones end in zeros. Row
    numbers have no gaps: rows are numbered inside a partition while they are written,
    and each partition then starts where those before it end.
    """
    entry = lambda c: F.floor(c.cast("double") * F.lit(float(STEPS))).cast("bigint") + OFFSET
    kept = df.where(usable(vector)).select(F.struct("*").alias("_row"), F.transform(vector, entry).alias("_x"))
    rows = written(kept.withColumn("_id", F.monotonically_increasing_id()), f"{folder}/rows")
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per task of the write, whatever the table holds.
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_x")).alias("d"))
    starts, total, dims = [], 0, 0
    for row in counts.orderBy("_part").collect():
        starts.append((row["_part"], total))
        total, dims = total + row["n"], max(dims, row["d"])
    if not dims:
        return rows.withColumn("_at", F.col("_id")).drop("_id"), total, 0
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_part bigint, _start bigint"))
    numbered = rows.withColumn("_part", part).join(first, "_part").withColumn("_at", F.col("_start") + inside)
    missing = F.array_repeat(F.lit(OFFSET).cast("bigint"), F.lit(dims) - F.size("_x"))
    return numbered.withColumn("_x", F.concat("_x", missing)).drop("_part", "_start", "_id"), total, dims


def _centred(n: int, sums: list[int]) -> Column:
    """n x - S for each entry, an exact integer."""
    totals = F.array(*[F.lit(s) for s in sums])
    return F.zip_with("_x", totals, lambda x, s: F.lit(n) * x - s)


def as_matrix(blocks: DataFrame, block_rows: int, block_columns: int, rows: int, columns: int) -> BlockMatrix:
    """A table of ``BLOCK`` rows as a matrix, without a way through Python's rows."""
    matrix = callMLlibFunc("createBlockMatrix", blocks, block_rows, block_columns, rows, columns)
    return BlockMatrix(matrix, block_rows, block_columns)


def block_matrix(rows: DataFrame, vector: Column, length: int, columns: int) -> BlockMatrix:
    """Rows at their number ``_at`` in blocks; numbers that are not there give rows of zeros.

    The rows of a block are laid out at once: ``IndexedRowMatrix.toBlockMatrix`` shuffles each
    entry as an object of its own, in as many tasks as the square root of its partitions.
    """
    height, width, schema = BLOCK_ROWS, BLOCK_COLUMNS, to_arrow_schema(BLOCK)

    def lay(group: pa.Table) -> pa.Table:
        row, inside = np.divmod(group.column("at").to_numpy(), height)
        k = int(row[0])
        dense = np.zeros((min(height, length - k * height), columns))
        dense[inside] = group.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, columns)
        blocks = []
        for column, start in enumerate(range(0, columns, width)):
            part = dense[:, start : start + width]
            matrix = {"type": 1, "numRows": part.shape[0], "numCols": part.shape[1], "values": part.ravel(), "isTransposed": True}
            blocks.append({"place": {"row": k, "column": column}, "block": matrix})
        return pa.Table.from_pylist(blocks, schema)

    numbered = rows.select(F.col("_at").alias("at"), vector.alias("vector"))
    blocks = numbered.groupBy(F.expr(f"at div {height}")).applyInArrow(lay, BLOCK)
    return as_matrix(blocks, height, width, length, columns)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """The transposed matrix times itself, with the long side cut into ``splits`` tasks.

    Python's ``multiply`` would form the product of all blocks of one result block in one
    task; the same method of the JVM class takes the number of splits.
    """
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def projected(spark: SparkSession, matrix: BlockMatrix, whitening: np.ndarray) -> BlockMatrix:
    """The block matrix times a small local one."""
    height, width = whitening.shape
    small = [
        ((k // BLOCK_COLUMNS, 0), Matrices.dense(part.shape[0], width, part.ravel(order="F")))
        for k in range(0, height, BLOCK_COLUMNS)
        for part in [whitening[k : k + BLOCK_COLUMNS]]
    ]
    return matrix.multiply(as_matrix(spark.createDataFrame(small, BLOCK), BLOCK_COLUMNS, width, height, width))


def matrix_rows(matrix: BlockMatrix, name: str) -> DataFrame:
    """``_at`` and the row as an array, as a table that never leaves the JVM."""
    indexed = matrix.toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", indexed._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("_at"), vector_to_array("vector").alias(name))


def fit(rows: DataFrame, total: int, dims: int, components: int, folder: str) -> Whitening:
    """Fit on each distinct ``_x`` once, whatever the number of its copies.

    The driver sees sums, a matrix of ``dims`` squared and nothing that grows with rows.
    The covariance has divisor n. A component without variance (``flat``) has a zero
    column.
    """
    # The first row of equal vectors stands for them; its number places it in the blocks.
    distinct = written(rows.groupBy("_x").agg(F.min("_at").alias("_at")), f"{folder}/distinct")
    counted = distinct.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("_x")[k]).alias(f"s{k}") for k in range(dims)]).first()
    n, sums = counted["n"], [counted[f"s{k}"] for k in range(dims)]
    centred = F.transform(_centred(n, sums), lambda v: v.cast("double") / F.lit(float(n)))
    spark = rows.sparkSession
    # Kept for both products; lost blocks are computed again from the written table.
    blocks = block_matrix(distinct, centred, total, dims).persist(StorageLevel.MEMORY_AND_DISK)
    splits = int(spark.conf.get("spark.sql.shuffle.partitions"))
    covariance = scatter(blocks, splits) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    flat = values <= FLAT * max(trace, 0.0)
    spread = np.where(flat, 1.0, np.sqrt(np.where(flat, 1.0, values)))
    matrix = np.where(flat, 0.0, vectors / spread)
    explained = np.where(flat, 0.0, values) / trace if trace > 0 else np.zeros(len(values))
    white = projected(spark, blocks, matrix).persist(StorageLevel.MEMORY_AND_DISK)
    whole = scatter(white, splits) / n
    for kept in (white, blocks):
        kept._java_matrix_wrapper.call("blocks").unpersist(False)
    lively = np.flatnonzero(~flat)
    wrong = np.abs(whole[np.ix_(lively, lively)] - np.eye(len(lively)))
    return Whitening(n, sums, matrix, explained, flat, float(wrong.max()) if len(lively) else None)


def whiten(df: DataFrame, folder: str, vector: str = "embedding", components: int = 16) -> DataFrame:
    """Each usable row with its whitened vector and what the fit found.

    Adds n (distinct vectors), deviation (sum over dimensions of (n x - S) squared; null
    beyond a long), whitened and explained (arrays by component, largest variance first)
    and identity_error. Vectors that are null or hold null or non-finite entries go; rows
    and keys may repeat or be null and stay as they are. Vectors shorter than the longest
    count as ending in zeros. A component without variance has null in ``whitened`` and 0
    in ``explained``. An empty table gives an
    empty one; where all vectors are empty, rows have no components. Existing columns of the added
    names are replaced.
    """
    added = ("n", "deviation", "whitened", "explained", "identity_error")
    names = [f"_row.`{c}`" for c in df.columns if c not in added]
    rows, total, dims = integer_rows(df, vector, folder)
    if not dims:
        empty = [
            F.lit(min(total, 1)).cast("bigint").alias("n"),
            F.lit(0).cast("bigint").alias("deviation"),
            *[F.array().cast("array<double>").alias(c) for c in ("whitened", "explained")],
            F.lit(None).cast("double").alias("identity_error"),
        ]
        return rows.select(*names, *empty)
    found = fit(rows, total, dims, components, folder)
    n, sums = found.n, found.sums
    # Squares only add up, so the sum is beyond a long once a step is.
    square = F.reduce(_centred(n, sums), F.lit(0).cast("bigint"), lambda t, v: F.try_add(t, F.try_multiply(v, v)))
    centred = F.transform(_centred(n, sums), lambda v: v.cast("double") / F.lit(float(n)))
    values = matrix_rows(projected(df.sparkSession, block_matrix(rows, centred, total, dims), found.matrix), "_white")
    flat = F.array(*[F.lit(bool(f)) for f in found.flat])
    return (
        rows.join(values, "_at")
        .withColumns(
            {
                "n": F.lit(n).cast("bigint"),
                "deviation": square,
                "whitened": F.zip_with("_white", flat, lambda v, f: F.when(~f, v)),
                "explained": F.array(*[F.lit(float(e)) for e in found.explained]),
                "identity_error": F.lit(found.identity_error).cast("double"),
            }
        )
        .select(*names, *added)
    )
