import math
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from paperstream.llm import topn

SCHEMA = "doc_id string, field string, line_index int, confidence double, gen_seq int, rank int, _score string"


def brute(rows, n):
    groups = defaultdict(set)
    for d, f, line, c, g in rows:
        if c is not None and not math.isnan(c):
            groups[d, f].add((-c, math.inf if line is None else line, math.inf if g is None else g))
    return {(d, f, None if g == math.inf else g, k) for (d, f), items in groups.items() for k, (_, _, g) in enumerate(sorted(items)[:n], 1)}


def run(spark, rows, n=3, **kw):
    df = spark.createDataFrame([(*r, 9, "clash") for r in rows], SCHEMA)
    return {tuple(r) for r in topn.top_n(df, n, **kw).select("doc_id", "field", "gen_seq", "rank").collect()}


def test_against_brute_force_with_ties_nulls_and_a_hot_group(spark, rng):
    rows = []
    for i in range(4000):
        doc = "hot" if i % 3 == 0 else f"d{rng.randrange(150)}"
        conf = rng.choice([None, float("nan"), 0.5, 0.5, 0.9, -0.0, 0.0, rng.random()])
        rows.append((doc if i % 50 else None, rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(5)]), conf, i))
    rows += rows[:500]
    assert run(spark, rows) == brute(rows, 3)
    assert run(spark, rows, 1, buckets=1) == brute(rows, 1)


def test_small_runs_are_merged(spark, rng, monkeypatch):
    monkeypatch.setattr(topn, "RUN_ROWS", 50)
    rows = [(f"d{rng.randrange(9)}", "x", rng.randrange(3), rng.randrange(4) / 4, i) for i in range(900)]
    assert run(spark, rows) == brute(rows, 3)


def test_empty_table(spark):
    assert run(spark, []) == set()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-3, 3), st.integers(0, 2), st.integers(0, 5)), max_size=60), st.integers(1, 4))
def test_loser_tree_merge(rows, n):
    cut = len(rows) // 3
    runs = [sorted(rows[i : i + cut + 1]) for i in range(0, len(rows), cut + 1)]
    flat = [r for run_ in runs for r in run_]
    keys = tuple(np.array([r[i] for r in flat], np.int64) for i in range(4))
    want = []
    for g in sorted({r[0] for r in flat}):
        want += sorted({r for r in flat if r[0] == g})[:n]
    assert [flat[i] for i in topn.merge_runs(keys, n)] == want
