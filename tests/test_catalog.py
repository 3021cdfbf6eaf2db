"""Every query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from framecloud.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(tiny):
    return connect(tiny)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tiny, duck, name):
    assert compare(QUERIES[name](spark, tiny), duck, SQL[name]) is None


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 500 * 16
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_device_depth_equals_its_sql_on_odd_values(spark, tmp_path):
    """NaN, infinities, signed zeros, tiny and huge values; null images have no pixels."""
    nan, inf = float("nan"), float("inf")
    odd = [nan, inf, -inf, 0.0, -0.0, 1e-45, 1e-38, 3e38, None, 0.1]
    rows = [(0, odd, 1), (1, [0.2, *odd[::-1]], 2), (2, None, 1), (3, [], 1)]
    frames = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    frames.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (part,) = (tmp_path / "parts").glob("*.parquet")
    part.rename(tmp_path / "embeddings.parquet")
    found = QUERIES["device_depth"](spark, str(tmp_path))
    assert compare(found, connect(str(tmp_path)), SQL["device_depth"]) is None
