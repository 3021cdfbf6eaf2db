"""Joins with a checked broadcast side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Dimension rows here are a few hundred bytes, so this bounds a broadcast to tens of MB.
BROADCAST_ROWS = 100_000


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting at most ``max_rows + 1`` rows.

    A larger table is returned as is and joins by shuffle, where adaptive
    execution splits hot partitions.
    """
    if df.isStreaming:
        return df
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
