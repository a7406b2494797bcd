"""Training pairs from retrieval: samples and hard negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stratified(df: DataFrame, by: str, key: str, n: int) -> DataFrame:
    """n rows of each stratum, picked by a hash of their key: map-side, a stratum's best n are kept by a bounded sort."""
    w = W.partitionBy(by).orderBy(F.md5(F.col(key).cast("string")), key)
    return df.withColumn("pick", F.row_number().over(w).cast("long")).where(F.col("pick") <= n)


def hard_negatives(hits: DataFrame, positives: DataFrame, depth: int = 12, n: int = 5) -> DataFrame:
    """The first n hits of each query, within depth, that aren't of the positive's file."""
    near = hits.where(F.col("rank") <= depth).join(positives.select("query_id", "path"), ["query_id", "path"], "left_anti")
    w = W.partitionBy("query_id").orderBy("rank")
    return near.withColumn("neg", F.row_number().over(w).cast("long")).where(F.col("neg") <= n)


def pool(chunks: DataFrame) -> DataFrame:
    """Chunks that are worth a query: three lines and 120 characters at least."""
    return chunks.where((F.col("end") - F.col("start") + 1 >= 3) & (F.length("text") >= 120))
