"""Matrix products over array rows and coordinate rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gemv(df: DataFrame, row: str, matrix: str, vector: list[float]) -> DataFrame:
    """One dot product for each row; stays in the scan's stage."""
    x = F.array(*[F.lit(float(v)) for v in vector])
    dot = F.aggregate(F.zip_with(F.col(matrix).cast("array<double>"), x, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    return df.select(row, dot.alias("y"))


def gemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """C = A B for coordinate rows A(i, k, v) and B(k, j, v)."""
    left, right = a.withColumnRenamed("v", "va"), b.withColumnRenamed("v", "vb")
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))


def coordinates(df: DataFrame, row: str, matrix: str, row_name: str, column_name: str) -> DataFrame:
    return df.select(F.col(row).alias(row_name), F.posexplode(F.col(matrix).cast("array<double>")).alias(column_name, "v"))


#: Keys that each query of ``attention`` meets at once.
KEY_BLOCK = 4096


def attention(queries: DataFrame, keys: DataFrame, dim: int) -> DataFrame:
    """softmax(Q K' / sqrt(dim)) V in long form; keys carry k and v arrays. The keys are one
    stated block of at most ``KEY_BLOCK`` rows, each query meets all of them."""
    if keys.limit(KEY_BLOCK + 1).count() > KEY_BLOCK:
        raise ValueError(f"more than {KEY_BLOCK} keys in a block")
    score = F.aggregate(F.zip_with("q", "k", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p) / (dim**0.5)
    met = queries.join(F.broadcast(keys)).select("q_id", score.alias("s"), "v")
    top = met.groupBy("q_id").agg(F.max("s").alias("top"))
    weighted = met.join(top, "q_id").withColumn("w", F.exp(F.col("s") - F.col("top")))
    long = weighted.select("q_id", "w", F.posexplode("v").alias("d", "x"))
    return long.groupBy("q_id", "d").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("y"))
