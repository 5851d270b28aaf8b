"""Window recipes over a partition key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def moving_average(df: DataFrame, key: str, order: list[str], value: str, width: int = 20, name: str = "moving_avg") -> DataFrame:
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - width, 0)
    return df.withColumn(name, F.avg(value).over(frame))


def vwap(df: DataFrame, key: str, order: list[str], price: str, volume: str, width: int = 20, name: str = "vwap") -> DataFrame:
    """Volume-weighted average price of the last rows; 0 where the volume is not positive."""
    frame = Window.partitionBy(key).orderBy(*order).rowsBetween(1 - width, 0)
    total = F.sum(volume).over(frame)
    return df.withColumn(name, F.when(total > 0, F.sum(F.col(price) * F.col(volume)).over(frame) / total).otherwise(0.0))
