import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperstream.llm import bpe, encode


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(f"{bpe.VOCABULARIES}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


TEXTS = ["", "Hello world's  test\n\n  x", "<|endoftext|> is text", "价格表 ¥3,000 naïve é", "_" * 1500, "a" * 777, "ab" * 900, "\x00�  ", "don't we'll I'd", " " * 50 + "\t\r\n"]


def test_same_ids_as_the_public_library(spark, public):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(99, None, "clash"), (None, "null key", "clash")]
    got = {r.doc_id: r.ids for r in encode.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()}
    assert got[99] == [] and got[0] == []
    for i, t in enumerate(TEXTS):
        assert got[i] == public.encode(t, add_special_tokens=False).ids
    assert got[None] == public.encode("null key", add_special_tokens=False).ids


def test_round_trip_and_empty_table(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(50, None)], "doc_id long, text string")
    back = {r.doc_id: r.text for r in encode.decode(encode.encode(df)).collect()}
    assert [back[i] for i in range(len(TEXTS))] == TEXTS and back[50] == ""
    assert encode.encode(df.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_words_by_recursive_merges(text):
    enc = bpe.encoding(bpe.VOCABULARIES)
    known = encode._worker(bpe.VOCABULARIES)
    text = bpe.clean(text)
    words = bpe.splitter().findall(text)
    assert "".join(words) == text
    known.learn(set(words))
    assert [i for w in words for i in known.ids[w]] == enc.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("aab_-e9é "), min_size=1, max_size=200))
def test_long_words_have_the_same_ids(word):
    known = encode._worker(bpe.VOCABULARIES)
    raw = word.encode()
    assert known._merge_long(raw) == known._merge([raw])[0]


def test_a_word_as_long_as_a_text():
    word = "".join(random.Random(3).choice("abcdefgh0123") for _ in range(40_000)).replace("0", "zz")
    letters = "".join(c for c in word if c.isalpha())
    known = encode.WordEncoder(bpe.VOCABULARIES)
    known.learn({letters})
    assert known.ids[letters] == bpe.encoding(bpe.VOCABULARIES).encode_ordinary(letters)


def test_a_full_cache_is_forgotten(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    e = encode.WordEncoder(bpe.VOCABULARIES)
    e.learn({"one", "two"})
    e.learn({"three", "four", "one"})
    assert set(e.ids) == {"one", "three", "four"}
