"""Parquet tables of one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.session import reachable


def table(spark: SparkSession, folder: str, name: str, least_bytes: int = 512 << 10, most_bytes: int = 1 << 30) -> DataFrame:
    """The rows of a table, on at least as many partitions as there are cores.

    One row group is one task, so a small table of few files would be worked on by few cores.
    Only a table of least_bytes to most_bytes is dealt out again, so never more than most_bytes
    are moved, whatever the number of cores; a larger table has splits of its own and is read as
    it lies. The rows are the same either way.
    """
    rows = reachable(spark).read.parquet(f"{folder}/{name}.parquet")
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    cores = spark.sparkContext.defaultParallelism
    if least_bytes <= size <= most_bytes and rows._jdf.rdd().getNumPartitions() < cores:
        return rows.repartition(cores)
    return rows
