"""Service levels of lanes: per window, sliding, and the readiness gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits of the readiness gate.
MOST_TIMEOUTS, MOST_FALLBACKS = 0.05, 0.20


def lane_events(events: DataFrame) -> DataFrame:
    """Events once each, engine names in one case, times as instants, null or NaN latency as 0 as the lane buffer has it."""
    e = events.select("event_seq", F.lower(F.trim("engine")).alias("engine"), F.col("ts").cast("timestamp").alias("ts"), "ok", "latency_ms", "fallback_used", "timed_out").distinct()
    return e.withColumn("latency_ms", F.when(F.isnan("latency_ms"), None).otherwise(F.col("latency_ms"))).fillna({"latency_ms": 0.0, "ok": False, "fallback_used": False, "timed_out": False})


def _rate(flag: str) -> Column:
    return F.round(F.avg(F.col(flag).cast("int")), 4)


def window_slo(events: DataFrame, length: str = "24 hours", slide: str | None = None) -> DataFrame:
    """(engine, window_start, count, success_rate, timeout_rate, fallback_rate, p95_latency_ms): event-time windows; p95 is the nearest rank. Works on streams as well."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = events.groupBy("engine", w.alias("w")).agg(F.count(F.lit(1)).alias("count"), _rate("ok").alias("success_rate"), _rate("timed_out").alias("timeout_rate"), _rate("fallback_used").alias("fallback_rate"), F.round(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency_ms)"), 2).alias("p95_latency_ms"))
    return g.select("engine", F.col("w.start").alias("window_start"), "count", "success_rate", "timeout_rate", "fallback_rate", "p95_latency_ms")


def trailing_counts(events: DataFrame, hours: int = 24) -> DataFrame:
    """(event_seq, engine, n, failures): at each event, its lane's events in the hours up to it.

    A lane's events are cut by time into buckets of that length; each bucket also gets the events of the one before as
    rows that take themselves off again where the hours are over. So no task holds a lane's whole history, and each
    bucket's counts are running sums: a frame that slides would be summed anew for every event. Events without a time
    lie in no window.
    """
    span = hours * 3600 * 1_000_000
    us = F.unix_micros("ts")
    e = events.where("ts is not null").select("event_seq", "engine", us.alias("us"), (us - F.pmod(us, F.lit(span))).alias("bucket"), (~F.col("ok")).cast("int").alias("bad"))
    # twice the time, and one more for an end: an event still counts at the very end of its hours
    own = e.select("event_seq", "engine", "bucket", (F.col("us") * 2).alias("at"), F.lit(1).alias("one"), "bad")
    ends = e.select("event_seq", "engine", F.col("bucket") + span, (F.col("us") + span) * 2 + 1, F.lit(-1), -F.col("bad"))
    lane = Window.partitionBy("engine", "bucket").orderBy("at")
    upto, whole = lane.rangeBetween(Window.unboundedPreceding, Window.currentRow), lane.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = lambda c: F.sum(c).over(upto) - F.sum(F.least(F.col(c), F.lit(0))).over(whole)
    return own.union(ends).withColumns({"n": counted("one"), "failures": counted("bad")}).where("one = 1").select("event_seq", "engine", "n", "failures")


def readiness(slo: DataFrame, caps: dict[str, float], default_cap: float = 30000.0) -> DataFrame:
    """slo with `ready` and `reason`: few timeouts and fallbacks and p95 within the lane's cap."""
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col("engine")), F.lit(default_cap)) if caps else F.lit(default_cap)
    reason = F.when(F.col("timeout_rate") >= MOST_TIMEOUTS, "timeout_rate").when(F.col("fallback_rate") >= MOST_FALLBACKS, "fallback_rate").when(F.col("p95_latency_ms") > cap, "p95_latency").otherwise("ok")
    return slo.withColumn("reason", reason).withColumn("ready", F.col("reason") == "ok")
