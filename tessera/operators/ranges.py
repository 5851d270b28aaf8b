"""Global order without a single task: key ranges, then a small carry between ranges.

``ranged`` deals rows into ranges of (key, tie) by Spark's own range partitioner, sorts
each and writes them with the number of the range and the place inside it. Equal keys are
told apart by the tie, so a hot key spreads over ranges, and the number of ranges follows
from the size of the rows. Whatever a global window would need from earlier rows is then
one row for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.shared import written

#: Bytes of rows in a range, by the planner's estimate.
RANGE_BYTES = 128 << 20
_ROW = (1 << 33) - 1


def _before():
    """All ranges before this one; over one row for each range."""
    return Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)


def ranges_for(df: DataFrame) -> int:
    """Ranges of about RANGE_BYTES, and one for each core at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 60 else 0  # an unknown size is a huge default
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-known // RANGE_BYTES))


def ranged(df: DataFrame, keys: list, ranges: int | None = None) -> DataFrame:
    """Adds _b, the range of a row, and _i, its place inside; both in order of the keys."""
    dealt = df.repartitionByRange(ranges or ranges_for(df), *keys).sortWithinPartitions(*keys)
    return written(dealt.withColumn("_b", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW))))


def row_index(df: DataFrame, key: str, tie: list[str], name: str = "row", ranges: int | None = None) -> DataFrame:
    """Adds the 0-based position in (key, tie) order."""
    cut = ranged(df, [key, *tie], ranges)
    sizes = cut.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.select("_b", F.coalesce(F.sum("_n").over(_before()), F.lit(0)).alias("_before"))
    return cut.join(F.broadcast(before), "_b").withColumn(name, (F.col("_before") + F.col("_i")).cast("long")).drop("_b", "_i", "_before")


def prefix_sum(df: DataFrame, key: str, tie: list[str], value: str, name: str = "prefix", ranges: int | None = None) -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one (exclusive scan)."""
    cut = ranged(df, [key, *tie], ranges)
    sums = cut.groupBy("_b").agg(F.sum(value).alias("_s"))
    before = sums.select("_b", F.coalesce(F.sum("_s").over(_before()), F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1))
    return cut.withColumn("_in", inside).join(F.broadcast(before), "_b").withColumn(name, F.col("_before") + F.coalesce("_in", F.lit(0))).drop("_b", "_i", "_in", "_before")


def asof_lookup(searches: DataFrame, key: str, lookup: DataFrame, lookup_key: str, value: str, default=-1.0, name: str = "found", ranges: int | None = None) -> DataFrame:
    """Adds the value of the largest lookup key that is no larger than the search key.

    Lookup keys must be unique; a null one answers no search, and a null search finds the
    default. Both sides are sorted together (searches of one key by a hash of their row, so
    that a hot key is dealt over ranges); each range starts from the last lookup row of the
    ranges before it.
    """
    names = searches.columns
    row = F.struct(*names)
    left = searches.select(F.col(key).alias("_k"), F.lit(1).alias("_tag"), F.xxhash64(*names).alias("_tie"), F.lit(None).cast(lookup.schema[value].dataType).alias("_v"), row.alias("_row"))
    right = lookup.where(F.col(lookup_key).isNotNull()).select(F.col(lookup_key).alias("_k"), F.lit(0).alias("_tag"), F.lit(0).cast("long").alias("_tie"), F.col(value).alias("_v"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    both = ranged(left.unionByName(right), ["_k", "_tag", "_tie"], ranges)
    ends = both.groupBy("_b").agg(F.max_by("_v", F.when(F.col("_tag") == 0, F.col("_i"))).alias("_end"))
    carry = ends.select("_b", F.last("_end", True).over(_before()).alias("_carry"))
    inside = F.last("_v", True).over(Window.partitionBy("_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    return (
        both.withColumn("_in", inside)
        .where("_tag = 1")
        .join(F.broadcast(carry), "_b")  # one row for each range
        .select("_row.*", F.when(F.col("_k").isNull(), F.lit(default)).otherwise(F.coalesce("_in", "_carry", F.lit(default))).alias(name))
    )
