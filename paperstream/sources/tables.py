"""Parquet tables of one directory, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table `name` of `directory`; a file or a folder of part files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def utc(df: DataFrame, *columns: str) -> DataFrame:
    """Zone-free timestamps as instants; the session's zone is UTC."""
    return df.withColumns({c: F.col(c).cast("timestamp") for c in columns})


def texts(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """table(), for work that is heavy per row: a table of so few parts that most cores would idle is spread over all of them. Tables of many parts are left as they are."""
    df = table(spark, directory, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def parts_for(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """So many partitions that each holds about bytes_each of the plan's estimated size, and no fewer than the session's shuffle partitions. Given as a number it also keeps AQE from merging the tasks of a stage that is heavy per row."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return least if size >= 1 << 56 else max(least, -(-size // bytes_each))
