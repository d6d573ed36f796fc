"""What the operators of this package share: tables, stored intermediates, sizes and distributed running sums."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperstream.session import shared_folder


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table to the shared folder and read back: its lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/paperstream/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session is gone; the cluster cleans its folder itself
        pass


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the plan, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Estimates beyond this are Catalyst's word for an unknown size.
UNKNOWN_BYTES = 1 << 56


def bucket_count(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """So many buckets that each holds about bytes_each, and no fewer than the session's shuffle partitions."""
    spark = df.sparkSession
    least, size = int(spark.conf.get("spark.sql.shuffle.partitions")), estimated_bytes(df)
    return least if size >= UNKNOWN_BYTES else max(least, -(-size // bytes_each))


def running_sums(df: DataFrame, keys: list[str], order: list[str], weight: str, name: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Exclusive running sums of `weight` per `keys` in `order`, with no key's rows gathered in one task.

    The rows are range-partitioned and sorted by keys and order; each partition counts from zero within each key, and
    the totals of the partitions before it are added from a table of one row per (key, partition) - at most keys plus
    partitions rows. Ties in `order` are put in the order of all other columns' text, so give a unique order for a
    stable result. Returns (df with long column `below`, totals with keys and long column `total`).
    """
    spark = df.sparkSession
    n = partitions or bucket_count(df)
    schema = T.StructType([*df.schema.fields, T.StructField("_pid", T.IntegerType()), T.StructField("_in", T.LongType())])
    columns = df.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, carry = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            w = part.column(weight).to_numpy().astype(np.int64)
            new = np.zeros(len(w), bool)
            new[0] = True
            for k in keys:
                codes = pa.compute.dictionary_encode(part.column(k).combine_chunks(), null_encoding="encode")
                codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy()
                new[1:] |= codes[1:] != codes[:-1]
            first = tuple(part.column(k)[0].as_py() for k in keys)
            upto = np.cumsum(w) - w
            at = np.flatnonzero(new)
            start = np.repeat(upto[at], np.diff([*at, len(w)]))
            below = upto - start
            if first == last:
                below[: at[1] if len(at) > 1 else len(w)] += carry
            end = len(w) - 1
            last, carry = tuple(part.column(k)[end].as_py() for k in keys), int(below[end] + w[end])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(w), pid, np.int32)), pa.array(below)], names=[*columns, "_pid", "_in"])

    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    counted = stored(ranged.mapInArrow(count, schema), name)
    parts = counted.groupBy(*keys, "_pid").agg(F.sum(weight).cast("long").alias("_sum"))
    upto = Window.partitionBy(*keys).orderBy("_pid")
    parts = parts.select(*keys, "_pid", F.coalesce(F.sum("_sum").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(*keys)).alias("total"))
    same: Column = F.lit(True)
    left, right = counted.alias("l"), parts.alias("r")
    for k in [*keys, "_pid"]:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    out = left.join(right, same).select(*[f"l.{c}" for c in columns], (F.col("_in") + F.col("_before")).alias("below"), F.col("total"))
    totals = parts.groupBy(*keys).agg(F.max("total").alias("total"))
    return out, totals
