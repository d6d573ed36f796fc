import datetime

import numpy as np
import pytest

from paperstream.llm import quantiles
from paperstream.llm.common import running_sums


def test_exact_and_combinable(spark, rng):
    rows = [(rng.choice(["a", "b", None]), rng.randrange(4), rng.choice([None, float("nan"), -1.0, 0.0, 7.0, 7.0, float("inf"), rng.random() * 100])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g string, day int, v double")
    states = quantiles.value_counts(df, ["g", "day"], "v")
    out = {(r.g, r.p): (r.n, r.percentile) for r in quantiles.percentiles(quantiles.merge_counts(states, ["g"]), ["g"], (0.0, 0.5, 0.95, 1.0)).collect()}
    for g in ("a", "b", None):
        v = [x for k, _, x in rows if k == g and x is not None and x == x and abs(x) < float("inf")]
        for p in (0.0, 0.5, 0.95, 1.0):
            assert out[g, p][0] == len(v)
            assert out[g, p][1] == pytest.approx(np.quantile(v, p), abs=1e-6)


def test_single_value_and_empty(spark):
    one = spark.createDataFrame([("a", 3.0, 1)], "g string, value double, cnt long")
    assert [(r.n, r.percentile) for r in quantiles.percentiles(one, ["g"], (0.5,)).collect()] == [(1, 3.0)]
    assert quantiles.percentiles(one.where("false"), ["g"]).count() == 0


def test_repeated_rows_count_once(spark):
    t = datetime.datetime(2026, 1, 1, 5)
    e = [(1, "Tess", "r", t, 10.0, "x"), (1, "Tess", "r", t, 10.0, "x"), (2, "tess ", "r", t, 30.0, "x"), (3, None, None, None, None, "x")]
    events = spark.createDataFrame(e, "event_seq long, engine string, route string, ts timestamp, latency_ms double, day string")
    cands = spark.createDataFrame([], "doc_id string, cand_seq int, engine string, latency_ms double")
    rows = quantiles.latency_percentiles(events, cands, (0.5,)).where("scope = 'engine'").collect()
    assert [(r.engine, r.n, r.percentile) for r in rows] == [("tess", 2, 20.0)]


def test_running_sums_follow_the_order(spark, rng):
    rows = [("hot" if i % 3 else f"k{i % 7}", i, rng.randrange(5)) for i in range(2000)]
    placed, totals = running_sums(spark.createDataFrame(rows, "k string, i int, w int"), ["k"], ["i"], "w", "t", partitions=7)
    seen: dict = {}
    want = {}
    for k, i, w in sorted(rows, key=lambda r: r[1]):
        want[i] = seen.get(k, 0)
        seen[k] = seen.get(k, 0) + w
    assert {r.i: r.below for r in placed.collect()} == want
    assert {r.k: r.total for r in totals.collect()} == seen
