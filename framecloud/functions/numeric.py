"""float32 arithmetic on Spark columns.

The point cloud maths is float32 end to end. Spark widens ``float / float`` to
double and refuses a zero divisor in ANSI mode, so divisions and literals go
through the helpers below and never through bare operators.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def f32(value: float) -> Column:
    """A float32 literal; a bare Python float would be compared as double."""
    return F.lit(float(value)).cast("float")


def to32(col: Column) -> Column:
    return col.cast("float")


def div32(num: Column, den: Column | float) -> Column:
    """float32 quotient. A divisor column must be null where it is zero."""
    return (num / (f32(den) if isinstance(den, (int, float)) else den)).cast("float")


def non_zero(col: Column) -> Column:
    return F.when(col != 0, col)


def is_finite(col: Column) -> Column:
    """False for NaN, both infinities and null; Spark orders NaN above infinity."""
    return F.coalesce(F.abs(col) < F.lit(INF), F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def sum32(terms: list[Column]) -> Column:
    """Left-to-right float32 sum, so the rounding order is fixed."""
    return reduce(add, terms)


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, True))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / max(den, 1) as double."""
    return num.cast("double") / F.greatest(den, F.lit(1)).cast("double")
