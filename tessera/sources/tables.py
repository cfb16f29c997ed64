"""Tables of a folder, and their spread over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables above this size are never shuffled only to use more cores.
SPREAD_BYTES = 256 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where it is small and has fewer pieces than there are cores, as a single small file has."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
