"""Token totals kept up to date by signed deltas.

A batch of changes holds inserts, deletes and revisions with the count before and
after. Each row becomes signed contributions, +after and -before, which are summed
per source, language and tokenizer version. A batch is committed once, under its
number; totals are the sums of all committed deltas, so nothing is recounted.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framecloud.llm.bpe import load

KEYS = ("source", "lang", "version")
DELTA = "source string, lang string, version string, docs bigint, tokens bigint"
#: One side of a change; null where the document did not or does no longer exist.
SIDE = "struct<source:string,lang:string,version:string,tokens:bigint>"


def side(source: Column, lang: Column, version: Column, tokens: Column) -> Column:
    names = (source.alias("source"), lang.alias("lang"), version.alias("version"), tokens.alias("tokens"))
    return F.struct(*names).cast(SIDE)


def nothing() -> Column:
    return F.lit(None).cast(SIDE)


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Sum changes (columns before and after) to docs and tokens per key.

    An insert has no before, a delete no after, a revision both; a row with neither
    adds nothing. Null sources, languages and versions are keys like any other and
    null counts are 0. Repeated rows count repeatedly. Sums combine before the
    shuffle, so a source with a third of all rows costs one row per task.
    """
    parts = F.array(
        F.struct(F.lit(1).alias("sign"), F.col("after").alias("s")),
        F.struct(F.lit(-1).alias("sign"), F.col("before").alias("s")),
    )
    rows = changes.select(F.inline(parts)).where("s is not null").select("sign", "s.*")
    return rows.groupBy(*KEYS).agg(
        F.sum("sign").cast("bigint").alias("docs"),
        F.sum(F.col("sign") * F.coalesce("tokens", F.lit(0))).cast("bigint").alias("tokens"),
    )


class Rollup:
    """Totals in a folder of committed batch deltas.

    ``commit`` writes a batch's delta to a folder of its own and the writer's
    success marker makes it count. A batch that is already marked is left alone and
    one that broke off is written again, so a batch may be sent any number of
    times. One writer at a time commits a given batch number.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder.rstrip("/")

    def _path(self, batch: int) -> str:
        return f"{self._folder}/batch={int(batch)}"

    def _files(self):
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        return path, path.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Numbers of the batches that count; one small listing, no data."""
        path, files = self._files()
        if not files.exists(path):
            return []
        new = self._spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in files.listStatus(path)]
        numbers = [int(n.partition("=")[2]) for n in names if n.startswith("batch=")]
        return sorted(n for n in numbers if files.exists(new(f"{self._path(n)}/_SUCCESS")))

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch of changes; False if it was applied before."""
        if batch in self.committed():
            return False
        signed_deltas(changes).write.mode("overwrite").parquet(self._path(batch))
        return True

    def totals(self, batches: Iterable[int] | None = None) -> DataFrame:
        """docs and tokens per key over the committed batches, keys at zero left out.

        A key whose documents are all gone has no row. Without commits the result
        is empty.
        """
        counted = self.committed() if batches is None else list(batches)
        if not counted:
            return self._spark.createDataFrame([], DELTA)
        rows = self._spark.read.schema(DELTA).parquet(*map(self._path, counted))
        sums = [F.sum(c).alias(c) for c in ("docs", "tokens")]
        return rows.groupBy(*KEYS).agg(*sums).where("docs <> 0 or tokens <> 0")


def count_tokens(docs: DataFrame, path: str, text: str = "text", name: str = "tokens") -> DataFrame:
    """Replace ``text`` by its number of tokens under a byte-level BPE file.

    Null and empty texts have 0 tokens. Other columns stay; one named like the
    result is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, name)]
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("_text"))

    def run(batches):
        bpe = load(path)
        for batch in batches:
            sizes = [len(ids) for ids in bpe.encode(batch.column(len(kept)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*kept, name])

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept]
    return df.mapInArrow(run, ", ".join([*fields, f"`{name}` bigint"]))
