"""Aggregations beyond a plain groupBy: profiles, histograms, grids, sample statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def money(column: str | Column) -> Column:
    """Exact sum of a value with two decimals: the same whatever the order of rows."""
    c = F.col(column) if isinstance(column, str) else column
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def group_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(money(value).alias("sum_v"), F.count(value).alias("n"), F.min(value).alias("min_v"), F.max(value).alias("max_v"))


def group_boundaries(df: DataFrame, key: str, order: list[str], partition: list[str]) -> DataFrame:
    """Marks rows whose key differs from that of the row before."""
    before = F.lag(key).over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("is_start", (before.isNull() | (before != F.col(key))).cast("int"))


def histogram_mod(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts by value modulo bins; a power of two masks the low bits instead."""
    c = F.col(value).cast("long")
    bin_ = c.bitwiseAND(F.lit(bins - 1)) if bins & (bins - 1) == 0 else F.pmod(c, F.lit(bins))
    return df.groupBy(bin_.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def density_grid(df: DataFrame, axes: list[str], limits: dict[str, tuple[float, float]], cells: int = 64) -> DataFrame:
    """Counts of rows in a grid; each axis is scaled to its limits and clamped."""
    def cell(c: str) -> Column:
        lo, hi = limits[c]
        return F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((F.col(c) - lo) / (hi - lo) * cells))).cast("long").alias(f"cell_{c}")

    return df.groupBy(*[cell(c) for c in axes]).agg(F.count("*").alias("n"))


def describe_table(df: DataFrame) -> DataFrame:
    """One row for each column: type, rows, nulls, distinct, min, max; a single pass."""
    parts = []
    for name, kind in df.dtypes:
        parts += [F.count_if(F.col(name).isNull()).alias(f"{name}__nulls"), F.count_distinct(name).alias(f"{name}__distinct"), F.min(name).cast("string").alias(f"{name}__min"), F.max(name).cast("string").alias(f"{name}__max")]
    one = df.agg(F.count("*").alias("n_rows"), *parts)
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(k).alias("column_type"), F.col("n_rows"), F.col(f"{n}__nulls").alias("null_count"), F.col(f"{n}__distinct").alias("distinct_count"), F.col(f"{n}__min").alias("min_value"), F.col(f"{n}__max").alias("max_value")) for n, k in df.dtypes])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def iqr_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Sample statistics after dropping values beyond 1.5 interquartile ranges."""
    quarts = df.groupBy(key).agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.75).alias("q3"))
    kept = df.join(quarts, key)  # one row for each group: the planner may broadcast it by its size
    kept = kept.where("%s between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)" % value)
    return kept.groupBy(key).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_v"), F.percentile(value, 0.5).alias("median_v"),
        F.round(F.stddev_samp(value), 6).alias("stddev_v"), F.round(F.stddev_samp(value) / F.avg(value) * 100, 6).alias("cv_percent"),
        F.round(F.percentile(value, 0.95), 6).alias("p95"),
    )
