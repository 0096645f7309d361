"""Table access: one Parquet file or folder per table under a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition only where the scan gives fewer partitions than there are cores (one small file);
    a scan of many splits keeps its own partitions and pays no shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *[F.col(k) for k in keys]) if df.rdd.getNumPartitions() < n else df
