"""Join variants. Strategies are left to the planner unless a side's size is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = 4294967295


def latest_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the one with the largest ``order``: an aggregate, not a sort."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def join_deduplicated(probe: DataFrame, build: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join in which each key has one build row (the last written)."""
    return probe.join(latest_by_key(build, key, order), key)


def kv_lookup(queries: DataFrame, store: DataFrame, key: str, value: str, missing=MISSING) -> DataFrame:
    """Exact lookup; absent keys give the sentinel."""
    return queries.join(store.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(missing)))
