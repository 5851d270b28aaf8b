"""Tables written between steps to a folder that all executors see, and saved snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, else its warehouse."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")


def written(df: DataFrame) -> DataFrame:
    """The rows written as Parquet and read back: computed once, and safe when executors go."""
    path = f"{folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def checksum(df: DataFrame) -> tuple[int, str]:
    """Rows, and a sum of row hashes that no order of rows changes."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s")).first()
    return r.n, str(r.s or 0)


def save_snapshot(df: DataFrame, path: str) -> None:
    """Parquet with its number of rows and checksum beside it."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    n, s = checksum(df.sparkSession.read.parquet(f"{path}/rows"))
    df.sparkSession.createDataFrame([(json.dumps({"rows": n, "checksum": s}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a snapshot; ValueError if they are not those that were saved."""
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    df = spark.read.parquet(f"{path}/rows")
    if checksum(df) != (meta["rows"], meta["checksum"]):
        raise ValueError(f"snapshot {path} is damaged")
    return df
