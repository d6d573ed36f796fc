"""Structured Streaming twins: service levels with a watermark, fingerprint drift, and resumable runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperstream.operators import slo

FINGERPRINT = "source_key string, updated_at timestamp, numeric_count int, first_seen boolean, changed boolean, change_pct double, risk_band string"
_STATE = "numeric_count int, token_hash string, content_hash string"


def streaming_slo(events: DataFrame, lateness: str = "1 hour", length: str = "24 hours", slide: str | None = "12 hours") -> DataFrame:
    """window_slo over a stream: events later than `lateness` behind the newest are left out."""
    return slo.window_slo(events.withWatermark("ts", lateness), length, slide)


def fingerprint(text: Column) -> list[Column]:
    """numeric_count, token_hash and content_hash of a text."""
    t = F.coalesce(text, F.lit(""))
    tokens = F.regexp_extract_all(t, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return [F.size(tokens).alias("numeric_count"), F.when(F.size(tokens) > 0, F.sha2(F.array_join(tokens, "|"), 256)).otherwise("").alias("token_hash"), F.sha2(t, 256).alias("content_hash")]


def drift(previous: tuple | None, now: tuple) -> tuple[bool, bool, float, str]:
    """(first seen, changed, change of the count of numbers, risk band) between two fingerprints."""
    if previous is None:
        return True, False, 0.0, "none"
    change = abs(now[0] - previous[0]) / max(1, previous[0])
    return False, tuple(previous[1:]) != tuple(now[1:]), round(change, 3), "high" if change >= 0.35 else "medium" if change >= 0.15 else "low"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    seen = tuple(state.get) if state.exists else None
    rows = pd.concat(list(frames)).sort_values("updated_at", kind="stable")
    out = []
    for r in rows.itertuples():
        now = (int(r.numeric_count), r.token_hash, r.content_hash)
        out.append((key[0], r.updated_at, now[0], *drift(seen, now)))
        seen = now
    state.update(seen)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in FINGERPRINT.split(", ")])


def fingerprint_drift(stream: DataFrame, key: str = "source_key", text: str = "text", at: str = "updated_at") -> DataFrame:
    """A row per arriving version of a document: how it differs from the version before, held as keyed state."""
    prints = stream.select(F.col(key).alias("source_key"), F.col(at).alias("updated_at"), *fingerprint(F.col(text)))
    return prints.groupBy("source_key").applyInPandasWithState(_update, FINGERPRINT, _STATE, "append", GroupStateTimeout.NoTimeout)


def batch_drift(rows: DataFrame, key: str, text: str, at: str) -> DataFrame:
    """The same of a finished table: each version against the one before it by time, then content hash.

    A key's versions are cut by day: the version before a day's first is the last of the key's previous day, from a
    table of one row per key and day. So no task holds a key's whole history.
    """
    prints = rows.select(F.col(key).alias("source_key"), F.col(at).alias("updated_at"), *fingerprint(F.col(text))).withColumn("_day", F.to_date("updated_at"))
    now = F.struct("updated_at", "content_hash", "numeric_count", "token_hash")
    last = prints.groupBy("source_key", "_day").agg(F.max(now).alias("_end"))
    last = last.withColumn("_end", F.lag("_end").over(Window.partitionBy("source_key").orderBy("_day")))
    same = F.col("p.source_key").eqNullSafe(F.col("l.source_key")) & F.col("p._day").eqNullSafe(F.col("l._day"))
    joined = prints.alias("p").join(last.alias("l"), same, "left").select("p.*", "l._end")
    w = Window.partitionBy("source_key", "_day").orderBy("updated_at", "content_hash")
    p = joined.withColumn("_b", F.coalesce(F.lag(now).over(w), F.col("_end")))
    change = F.abs(F.col("numeric_count") - F.col("_b.numeric_count")) / F.greatest(F.lit(1), F.col("_b.numeric_count"))
    new = F.col("_b").isNull()
    band = F.when(new, "none").when(change >= 0.35, "high").when(change >= 0.15, "medium").otherwise("low")
    return p.select(
        "source_key", "updated_at", "numeric_count", new.alias("first_seen"), (~new & ((F.col("token_hash") != F.col("_b.token_hash")) | (F.col("content_hash") != F.col("_b.content_hash")))).alias("changed"),
        F.when(new, 0.0).otherwise(F.round(change, 3)).alias("change_pct"), band.alias("risk_band"),
    )


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work not yet done: the resume step of a run."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def run_to_end(aggregated: DataFrame, folder: str) -> DataFrame:
    """The table a streaming aggregate ends with when all input there is has been read. Each batch's whole result is written to `folder`, a shared one, where the checkpoint is too; nothing passes through the driver."""
    table, empty = f"{folder}/result", aggregated.schema

    def write(result: DataFrame, _: int) -> None:
        result.write.mode("overwrite").parquet(table)

    query = aggregated.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark = aggregated.sparkSession
    try:
        return spark.read.schema(empty).parquet(table)
    except AnalysisException:  # no batch: the input is empty
        return spark.createDataFrame([], empty)
