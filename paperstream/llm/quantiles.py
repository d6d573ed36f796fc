"""Problem 4: exact percentiles per group from a distributed sort.

State of a day or partition: its (group, value, count) rows - exact, mergeable by adding counts, and much smaller than the
rows where values repeat. Percentiles of any union: the merged counts are range-partitioned and sorted by group and value,
each partition counts the rows of each of its groups, the counts of the partitions before give every value's offset in its
group, the values that hold the two ranks next to each target are located by these offsets and interpolated. No group is
gathered in one task, whatever its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperstream.llm.common import running_sums, stored

PERCENTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def value_counts(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The mergeable state: (groups, value, cnt). Null, NaN and infinite values have no place among others and are left out; negative zero is zero."""
    v = F.col(value).cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return df.where(good).groupBy(*groups, (v + 0.0).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))


def merge_counts(parts: DataFrame, groups: list[str]) -> DataFrame:
    """States of separate days or partitions combined into one per `groups`: counts of equal values add up."""
    return parts.groupBy(*groups, "value").agg(F.sum("cnt").alias("cnt"))


def percentiles(counts: DataFrame, groups: list[str], targets: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(groups, p, n, percentile) of (groups, value, cnt) rows: linear interpolation between the neighbouring order statistics, exact.

    A null in a group column is a group of its own. Groups without a counted value give no row.
    """
    placed, _ = running_sums(counts.select(*groups, "value", "cnt"), groups, ["value"], "cnt", "ranks")
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in targets])).alias("p")
    place: Column = F.col("p") * (F.col("total") - 1)
    first, last = F.col("below"), F.col("below") + F.col("cnt") - 1
    # a target is kept only where this value holds one of its two ranks
    near = reduce(Column.__or__, [(first <= F.ceil(F.lit(float(p)) * (F.col("total") - 1))) & (last >= F.floor(F.lit(float(p)) * (F.col("total") - 1))) for p in targets])
    at = placed.where(near).select("*", wanted).withColumns({"lo": F.floor(place), "hi": F.ceil(place), "part": place - F.floor(place)})
    at = at.where((first <= F.col("hi")) & (last >= F.col("lo")))
    both = at.groupBy(*groups, "p").agg(
        F.max("total").alias("n"), F.max("part").alias("part"),
        F.max(F.when((first <= F.col("lo")) & (last >= F.col("lo")), F.col("value"))).alias("x"),
        F.max(F.when((first <= F.col("hi")) & (last >= F.col("hi")), F.col("value"))).alias("y"),
    )
    return both.select(*groups, "p", "n", F.round(F.col("x") + F.col("part") * (F.col("y") - F.col("x")), 6).alias("percentile"))


def _lane(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def latency_states(events: DataFrame, candidates: DataFrame) -> DataFrame:
    """Daily states of both tables, stored: (tab, engine, route, day, value, cnt); engine names in one case.

    A repeated row is one record: events by all read columns with event_seq, candidates with doc_id and cand_seq.
    Candidates have no route and no day; both are null there. Times of zero or less are no measurements.
    """
    e = events.select("event_seq", _lane("engine").alias("engine"), _lane("route").alias("route"), F.to_date("ts").alias("day"), "latency_ms").distinct()
    c = candidates.select("doc_id", "cand_seq", _lane("engine").alias("engine"), F.lit(None).cast("string").alias("route"), F.lit(None).cast("date").alias("day"), "latency_ms").distinct()
    keys = ["tab", "engine", "route", "day"]
    e, c = (x.where("latency_ms > 0") for x in (e, c))
    one = value_counts(e.withColumn("tab", F.lit("lane_events")), keys, "latency_ms")
    two = value_counts(c.withColumn("tab", F.lit("candidates")), keys, "latency_ms")
    return stored(one.unionByName(two), "latency_days")


def latency_percentiles(events: DataFrame, candidates: DataFrame, targets: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """(tab, scope, engine, route, day, p, n, percentile).

    scope `day`: single days per engine and route; `engine_route`: all days per engine and route, from the states of the
    days; `engine`: per engine, from those. Where a scope doesn't have a column it is null.
    """
    days = latency_states(events, candidates)
    lanes = merge_counts(days, ["tab", "engine", "route"])
    engines = merge_counts(days, ["tab", "engine"])
    none = lambda t: F.lit(None).cast(t)
    columns = ["tab", "scope", "engine", "route", "day", "value", "cnt"]
    parts = [
        days.where(F.col("tab") == "lane_events").withColumn("scope", F.lit("day")),
        lanes.where(F.col("tab") == "lane_events").withColumns({"scope": F.lit("engine_route"), "day": none("date")}),
        engines.withColumns({"scope": F.lit("engine"), "route": none("string"), "day": none("date")}),
    ]
    return percentiles(reduce(DataFrame.unionByName, [p.select(columns) for p in parts]), ["tab", "scope", "engine", "route", "day"], targets)
