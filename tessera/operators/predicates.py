"""Filters: comparisons, boolean combinations, masks, row positions."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OPS = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def compare(column: Column, op: str, value, floating: bool = False) -> Column:
    """``column op value``. For floating columns NaN follows IEEE: only != is true for it."""
    test = _OPS[op](column, value if isinstance(value, Column) else F.lit(value))
    if not floating:
        return test
    return (test | F.isnan(column)) if op == "!=" else (test & ~F.isnan(column))


def compare_unsigned(column: Column, op: str, value: int) -> Column:
    """``column op value`` for a long that holds an unsigned 64-bit number.

    Plain comparisons of the long itself, so they reach the scan: numbers with the highest
    bit set are negative longs, and come after all others.
    """
    top, v = column < 0, F.lit(value - (1 << 64) if value >> 63 else value)
    if op in ("=", "!="):
        return _OPS[op](column, v)
    below = op in ("<", "<=")
    inside = _OPS[op](column, v)
    if value >> 63:
        return (~top | inside) if below else (top & inside)
    return (~top & inside) if below else (top | inside)


def all_of(*tests: Column) -> Column:
    return reduce(operator.and_, tests)


def any_of(*tests: Column) -> Column:
    return reduce(operator.or_, tests)


def mask(test: Column) -> Column:
    """A boolean that is never null: null tests do not match."""
    return F.coalesce(test, F.lit(False))


def gather_by_mask(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column)).drop(column)


def gather(df: DataFrame, index: DataFrame, row: str, at: str) -> DataFrame:
    """Rows of ``df`` at the positions listed in ``index``, an equi-join on the position."""
    return index.join(df, index[at] == df[row], "inner")
