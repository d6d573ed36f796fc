from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperstream.llm import mix

TARGETS = "source string, target_share double, max_repeats int"
DOCS = "doc_id long, source string, text string, n_tokens string"


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=7))
def test_pfair_deviates_by_less_than_a_block(parts):
    weights = {f"s{i}": Fraction(p, sum(parts)) for i, p in enumerate(parts)}
    slots = mix.pfair_slots(weights)
    given_ = Counter()
    for t, s in enumerate(slots, 1):
        given_[s] += 1
        assert all(abs(given_[x] - w * t) < 1 for x, w in weights.items())
    assert all(given_[x] == w * len(slots) for x, w in weights.items())


def test_small_shares_and_long_periods_keep_every_source():
    weights, total = mix.plan_shares({"a": 10**6, "b": 1000}, [("a", 0.99996, 1), ("b", 0.00004, 1), ("b", 0.00004, 1)])
    assert weights == {"a": Fraction(24999, 25000), "b": Fraction(1, 25000)} and total == Fraction(10**6 * 25000, 24999)
    with pytest.raises(ValueError):
        mix.plan_shares({"a": 1}, [("a", 0.5, 1), ("a", 0.4, 1)])
    odd = {"a": mix.exact(0.1234567), "b": mix.exact(0.8765432), "c": mix.exact(0.0000001)}
    table, (size, per) = mix.slot_table(odd, 500, {"a": 62, "b": 439, "c": 1})
    slots = {(r["source"], r["_own"]): r["_slot"] for r in table.to_pylist()}
    assert len(slots) == len(set(slots.values())) == size and per["c"] == 1 and slots["c", 0] == size - 1
    assert all((s, j) in slots for s, n in (("a", 62), ("b", 439)) for j in range(n))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=6), st.integers(1, 150))
def test_slot_tables_place_every_block(parts, total):
    weights = {f"s{i}": Fraction(p, sum(parts)) for i, p in enumerate(parts)}
    blocks = {s: -int(-(w * total) // 1) for s, w in weights.items()}
    table, (size, per) = mix.slot_table(weights, total, blocks)
    slots = {(r["source"], r["_own"]): r["_slot"] for r in table.to_pylist()}
    at = [j // per[s] * size + slots[s, j % per[s]] for s in blocks for j in range(blocks[s])]
    assert len(at) == len(set(at))


def docs(spark, rng):
    rows, i = [], 0
    for source, n in (("big", 300), ("mid", 80), ("small", 12), ("other", 30), (None, 5)):
        for _ in range(n):
            rows.append((i, source, "word " * rng.randrange(1, 60), "clash"))
            i += 1
    rows += [(i, "big", None, "x"), (i + 1, "big", "", "x")]
    return spark.createDataFrame(rows, DOCS), {r[0]: r for r in rows}


def test_shares_repeats_and_schedule(spark, rng):
    df, by = docs(spark, rng)
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("small", 0.1, 5), ("absent", 0.2, 9), (None, 0.1, 1), ("other", None, 1)], TARGETS)
    rows = mix.mix(df, targets, block_tokens=200).collect()
    size, uses, longest = Counter(), Counter(), 0
    for r in rows:
        size[r.source] += r.n_tokens
        uses[r.doc_id, r.repeat] += 1
        longest = max(longest, r.n_tokens)
        assert r.n_tokens > 0 and by[r.doc_id][1] == r.source
    assert set(size) == {"big", "mid", "small"} and max(uses.values()) == 1
    total = sum(size.values())
    for s, share in (("big", 0.6), ("mid", 0.3), ("small", 0.1)):
        assert abs(size[s] - share * total) <= 2 * longest
    per = Counter((r.doc_id) for r in rows)
    assert max(n for d, n in per.items() if by[d][1] == "big") == 1 and max(n for d, n in per.items() if by[d][1] == "small") <= 5
    assert len({(r.slot, r.source) for r in rows}) == len({r.slot for r in rows})  # a slot has one source
    report = {r.source: r for r in mix.shares(df, targets, block_tokens=200).collect()}
    assert report["absent"].tokens == 0 and report["absent"].deviation_blocks is None
    assert report["big"].tokens == size["big"] and abs(report["big"].actual_share - 0.6) < 0.05


def test_nothing_usable(spark, rng):
    df, _ = docs(spark, rng)
    assert mix.mix(df, spark.createDataFrame([("absent", 0.5, 1), ("big", 0.5, 0)], TARGETS)).count() == 0
    assert mix.mix(df.where("false"), spark.createDataFrame([("big", 1.0, 1)], TARGETS)).count() == 0
    assert mix.mix(df, spark.createDataFrame([], TARGETS)).count() == 0


def test_a_huge_cap_makes_no_needless_rows(spark, rng):
    df, _ = docs(spark, rng)
    t = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 2_000_000_000)], TARGETS)
    rows = mix.mix(df, t, block_tokens=200)
    total = rows.groupBy("source").agg({"n_tokens": "sum"}).collect()
    assert {r[0] for r in total} == {"big", "small"} and rows.agg({"repeat": "max"}).first()[0] < 500
