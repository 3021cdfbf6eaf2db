"""Compare every query with its SQL on the same tables.

Run as a script: ``python tests/oracle.py [folder] [name ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or v is pd.NA:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else v
    return v


def _rows(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = [tuple(_cell(v) for v in row) for row in zip(*columns, strict=True)]
    return names, sorted(rows, key=repr), {n: str(table.schema.field(n).type) for n in names}


def compare(spark_df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    names, ours, types = _rows(spark_df.toArrow())
    theirs_names, theirs, their_types = _rows(con.execute(sql).to_arrow_table())
    if names != theirs_names:
        return f"columns {names} vs {theirs_names}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, first: {bad[0]} columns {names}"
    plain = lambda t: t.replace("large_", "").replace("item: ", "").replace("element: ", "").replace("l: ", "")
    off = {n: (types[n], their_types[n]) for n in names if plain(types[n]) != plain(their_types[n])}
    return f"types {off}" if off else None


def main(folder: str, only: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failures = 0
    for name in only or queries:
        start = time.time()
        try:
            if name in oracles:
                result = compare(queries[name](spark, folder), con, oracles[name])
            else:
                result = None if queries[name](spark, folder).count() >= 0 else "no rows"
        except Exception as error:  # report and go on to the next query
            result = f"{type(error).__name__}: {str(error)[:700]}"
        failures += result is not None
        print(f"{'ok  ' if result is None else 'FAIL'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
    print(f"{len(only or queries)} queries, {failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:]))
