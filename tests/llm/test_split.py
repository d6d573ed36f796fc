import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from paperstream.llm import bpe, split

LIMITS = "profile string, max_tokens int, overlap_tokens int"
PARAGRAPH = "The first sentence is here. A second, longer one follows: it has clauses, too.\nA line ends.\n\n"


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=70), st.data())
def test_sparse_table_is_the_maximum(values, data):
    t = split.SparseTable(np.array(values), len(values))
    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a, len(values) - 1))
    assert t.best(a, b) == max(values[a : b + 1])


def check(text, pieces, limit, overlap):
    enc = bpe.encoding(bpe.VOCABULARIES)
    assert pieces[0].start_char == 0 and pieces[-1].end_char == len(text)
    for p in pieces:
        assert text[p.start_char : p.end_char] == p.text and p.n_pieces == len(pieces)
        assert len(enc.encode_ordinary(p.text)) <= limit
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert a.start_token < b.start_token <= a.end_token and a.start_char < b.start_char <= a.end_char
        assert overlap <= a.end_token - b.start_token <= overlap + 3


def test_limits_overlaps_and_boundaries(spark, rng):
    texts = {1: PARAGRAPH * 40, 2: "x" * 3000, 3: "".join(rng.choice("abcdefghij0123456789+/") for _ in range(4000)), 4: "价格表中的货物已收到请付款" * 60, 5: "word " * 900, 6: "", 7: None, 8: "short", 9: "🙂é" * 300}
    df = spark.createDataFrame([(k, v, "clash") for k, v in texts.items()], "doc_id long, text string, profile string")
    limits = spark.createDataFrame([("a", 40, 0), ("b", 64, 16), ("c", 5000, 10), ("n", None, 1), ("z", 0, 0)], LIMITS)
    rows = split.split(df, limits).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.piece_no):
        by.setdefault((r.doc_id, r.profile), []).append(r)
    assert {k for k, _ in by} == {1, 2, 3, 4, 5, 9} and {p for _, p in by} == {"a", "b"}
    for (k, profile), pieces in by.items():
        check(texts[k], pieces, *{"a": (40, 0), "b": (64, 16)}[profile])
    assert {p.cut for p in by[1, "a"]} <= {"paragraph", "line"}
    assert {p.cut for p in by[5, "a"][:-1]} == {"word"}


def test_overlap_as_large_as_the_limit_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "word " * 50)], "doc_id long, text string")
    rows = split.split(df, spark.createDataFrame([("a", 8, 20)], LIMITS)).collect()
    assert max(r.end_char for r in rows) == 250 and all(r.end_token - r.start_token <= 8 for r in rows)
    assert split.split(df, spark.createDataFrame([], LIMITS)).count() == 0
    assert split.split(df.where("false"), spark.createDataFrame([("a", 8, 2)], LIMITS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab ,.\n\té价🙂'xz"), min_size=1, max_size=200), st.integers(4, 24), st.integers(0, 24))
def test_the_limit_comes_before_the_overlap(text, limit, overlap):
    known = split.Words(bpe.VOCABULARIES)
    pieces = list(split.Cutter(text, known, bpe.splitter().findall(text), limit).pieces(limit, overlap))
    assert pieces[0][2] == 0 and pieces[-1][3] == len(text)
    assert all(known.size(text[a:b]) <= limit for _, _, a, b, _ in pieces)
    assert all(a[2] < b[2] <= a[3] for a, b in zip(pieces, pieces[1:], strict=False))


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab ,.\n\té价🙂'"), min_size=1, max_size=300), st.integers(4, 20), st.integers(0, 3))
def test_any_text_is_covered(text, limit, overlap):
    known = split.Words(bpe.VOCABULARIES)
    cutter = split.Cutter(text, known, bpe.splitter().findall(text), limit)
    pieces = list(cutter.pieces(limit, overlap))
    assert pieces[0][2] == 0 and pieces[-1][3] == len(text)
    assert all(b[2] <= a[3] and b[2] > a[2] for a, b in zip(pieces, pieces[1:], strict=False))
