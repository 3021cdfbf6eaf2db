"""Schema strings for functions that add a column in Arrow batches."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fields_of(df: DataFrame) -> str:
    """The columns of ``df`` as a schema string; keeps unusual names."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
