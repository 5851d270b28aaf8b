"""Sorting, ranks and top-K."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranges import row_index


def argsort(df: DataFrame, key: str, row: str) -> DataFrame:
    """rank, row: which row stands at each position of the sorted order (ties by row)."""
    return row_index(df, key, [row], "rank").select("rank", row)


def unsigned_order(column: Column) -> list[Column]:
    """Sort keys for longs that hold unsigned 64-bit numbers: the sign bit is their highest."""
    return [(column < 0).asc(), column.asc()]


def total_order(column: Column) -> list[Column]:
    """Sort keys for IEEE total order of doubles: -NaN .. -0.0 < 0.0 .. NaN.

    Spark has one NaN, which sorts last, and treats -0.0 as 0.0; the second key puts the
    negative zero first.
    """
    return [column.asc(), zero_sign(column).asc()]


def zero_sign(column: Column) -> Column:
    """0 for the negative zero, 1 for every other value."""
    return F.when((column == 0) & (column.cast("string") == "-0.0"), 0).otherwise(1)


def top_groups(df: DataFrame, key: str, value: Column, k: int, name: str = "total") -> DataFrame:
    return df.groupBy(key).agg(value.alias(name)).orderBy(F.desc(name), key).limit(k)
