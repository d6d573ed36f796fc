"""Problem 8: long texts cut into pieces at the strongest boundary each window permits.

A text's words (by the tokenizer's public splitter) give its boundaries, each with a strength: end of a paragraph, line,
sentence, clause or word. A sparse table holds the strongest boundary, the rightmost among equals, of every window of a
power-of-two length; two look-ups answer any window. A piece starts at token s and must end within (s + least, s + limit];
the strongest boundary there is its end, and the next piece starts `overlap` tokens before it.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperstream.llm import bpe

#: Boundary strengths, by name.
STRENGTHS = ("token", "word", "clause", "sentence", "line", "paragraph")
#: A piece is at least this part of its limit long, where the text has that much left.
LEAST_PART = 0.5
#: Output is sent on at about this many characters.
BATCH_CHARS = 4_000_000

_SENTENCE = frozenset(".!?。！？…")
_CLAUSE = frozenset(",;:，；：、)")


class SparseTable:
    """Range maximum over whole numbers: level k holds the maxima of windows of 2^k."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values]
        width = 1
        while 2 * width <= min(longest, len(values)):
            low = self.levels[-1]
            self.levels.append(np.maximum(low[:-width], low[width:]))
            width *= 2

    def best(self, first: int, last: int) -> int:
        """The maximum of values[first..last]."""
        k = (last - first + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[first], level[last + 1 - (1 << k)]))


class Words(dict):
    """word -> its row in `facts`: tokens, characters, break after it, lines it consists of; one per worker."""

    def __init__(self, folder: str):
        self.encoder = bpe.encoding(folder)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.facts = np.zeros((1 << 12, 4), np.int64)

    def size(self, text: str) -> int:
        return len(self.encoder.encode_ordinary(text))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        body = word.rstrip()
        lines = word.count("\n") + word.count("\r") - word.count("\r\n")
        end = body[-1:]
        after = (5 if lines > 1 else 4) if lines else 3 if end in _SENTENCE else 2 if end in _CLAUSE else 1
        self.facts[at] = self.size(word), len(word), after, 0 if body else lines
        self[word] = at
        return at


class Cutter:
    """The boundaries of one text, cut under any number of profiles."""

    def __init__(self, text: str, known: Words, words: list[str], longest: int):
        self.text, self.known = text, known
        idx = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        tokens, chars, after, blank = known.facts[idx].T
        self.words = words
        self.token_at = np.r_[0, np.cumsum(tokens)]  # boundary b lies after word b-1
        self.char_at = np.r_[0, np.cumsum(chars)]
        strength = after.copy()
        # a sentence end counts only before white space or the end; white space words carry the break of their lines
        nxt_blank = np.r_[blank[1:], 0]
        starts_line = nxt_blank > 0
        strength[starts_line] = 0  # cut behind the line break, not before it
        strength[-1] = 5
        self.strength = np.r_[0, np.maximum(strength, 1)]
        self.total = int(self.token_at[-1])
        self.table = SparseTable(self.strength * (len(words) + 2) + np.arange(len(words) + 1), longest + 1)
        self.at, self.chars = self.token_at.tolist(), self.char_at.tolist()

    def _inside(self, token: int, up: bool) -> tuple[int, int]:
        """(token position, character) at `token`, or where that lies within a character, at the next whole one before or after it."""
        b = bisect_right(self.at, token) - 1
        if self.at[b] == token:
            return token, self.chars[b]
        word = self.words[b]
        pieces = self.known.encoder.decode_tokens_bytes(self.known.encoder.encode_ordinary(word))
        data = b"".join(pieces)
        ends = np.cumsum([len(p) for p in pieces]).tolist()
        k = token - self.at[b]
        while 0 < k < len(pieces) and data[ends[k - 1]] & 0xC0 == 0x80:
            k += 1 if up else -1
        if k <= 0:
            return self.at[b], self.chars[b]
        return self.at[b] + k, self.chars[b] + len(data[: ends[k - 1]].decode("utf-8"))

    def _alone(self, s: int, s_char: int, e: int, e_char: int) -> int:
        """Tokens of text[s_char:e_char] encoded by itself: those within the text, but for words cut at either end, which are encoded anew with a neighbour."""
        first, last = bisect_left(self.at, s), bisect_right(self.at, e) - 1
        whole_start, whole_end = self.at[first] == s, self.at[last] == e
        if whole_start and whole_end:
            return e - s
        lead = first if whole_start else min(first + 1, len(self.at) - 1)
        trail = last if whole_end else max(last - 1, 0)
        if lead >= trail:
            return self.known.size(self.text[s_char:e_char])
        return self.known.size(self.text[s_char : self.chars[lead]]) + self.at[trail] - self.at[lead] + self.known.size(self.text[self.chars[trail] : e_char])

    def pieces(self, limit: int, overlap: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(first token, end token, first character, end character, strength of the end)."""
        if limit <= 0:
            return
        overlap = max(0, min(overlap, limit - 1))
        s, s_char = 0, 0
        while True:
            if self.total - s <= limit and self._alone(s, s_char, self.total, len(self.text)) <= limit:
                yield s, self.total, s_char, len(self.text), 5
                return
            most = limit
            while True:
                # within the limit comes first: where the overlap leaves no piece that keeps it, this piece and the overlap get shorter
                floor = overlap if most > overlap + 1 else 0
                least = s + max(floor + 1, int(most * LEAST_PART))
                first, last = bisect_left(self.at, least), bisect_right(self.at, s + most) - 1
                if first <= last:
                    key = self.table.best(first, last)
                    strength, b = divmod(key, len(self.words) + 2)
                    e, e_char = self.at[b], self.chars[b]
                else:  # no word ends in the window: cut within the word, between characters
                    strength = 0
                    e, e_char = self._inside(s + most, up=False)
                    if e <= s + floor:
                        e, e_char = self._inside(s + floor + 1, up=True)
                # a piece that starts or ends within a word may take more tokens by itself than within the text
                if most <= 1 or self._alone(s, s_char, e, e_char) <= limit:
                    break
                most -= 1
            yield s, e, s_char, e_char, strength
            if e >= self.total:
                return
            n, n_char = self._inside(e - overlap, up=False)
            if n <= s:  # a shorter overlap, from the next whole character on
                n, n_char = self._inside(s + 1, up=True)
            s, s_char = (n, n_char) if s < n < e else (e, e_char)


def kept(documents: DataFrame, limits: DataFrame, *, vocabularies: str = bpe.VOCABULARIES) -> DataFrame:
    """(profile, limit_kept, overlap_kept, whole_kept) per profile that has pieces: no piece is over the limit, consecutive pieces share the overlap - up to three tokens more -, and the pieces cover their texts from end to end."""
    by = Window.partitionBy("doc_id", "profile").orderBy("piece_no")
    made = split(documents, limits, vocabularies=vocabularies).withColumn("chars", F.length("text")).select("doc_id", "profile", "piece_no", "n_pieces", "start_token", "end_token", "start_char", "end_char", "chars")
    shared = F.lag("end_token").over(by) - F.col("start_token")
    made = made.withColumns({"shared": shared, "meets": F.coalesce(F.lag("end_char").over(by) >= F.col("start_char"), F.col("start_char") == 0)})
    made = made.join(F.broadcast(limits.select("profile", "max_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap"))), "profile")
    return made.groupBy("profile").agg(
        F.every(F.col("end_token") - F.col("start_token") <= F.col("max_tokens")).alias("limit_kept"),
        F.every(F.coalesce(F.col("shared").between(F.col("overlap"), F.col("overlap") + 3), F.lit(True))).alias("overlap_kept"),
        F.every("meets").alias("whole_kept"),
    )


_workers: dict[str, Words] = {}


def split(documents: DataFrame, limits: DataFrame, *, key: str = "doc_id", text: str = "text", vocabularies: str = bpe.VOCABULARIES) -> DataFrame:
    """(key, profile, piece_no, n_pieces, start_token, end_token, start_char, end_char, cut, text): pieces of every text longer than a profile's max_tokens.

    Token positions are those of the text's own encoding, so consecutive pieces share exactly overlap_tokens tokens - a few
    more where that would divide a character, and fewer where a piece could not keep the limit otherwise, which takes
    overlaps of nearly the limit. A piece encoded by itself keeps the limit; only a limit too small for a single
    character's tokens is exceeded, by that character. `cut` names the end's boundary. Null, empty and short texts have no piece; profiles with null
    or non-positive max_tokens are left out; a null overlap is 0 and an overlap not below max_tokens counts as
    max_tokens - 1. Repeated rows come out as often as they come in. No shuffle; piece_limits is collected: it is one row
    per profile.
    """
    profiles = sorted({(r[0], r[1], r[2] or 0) for r in limits.select("profile", "max_tokens", "overlap_tokens").collect() if r[1] and r[1] > 0}, key=str)
    if not profiles:
        documents = documents.where("false")
    kind = documents.schema[key].dataType.simpleString()
    names = [key, "profile", "piece_no", "n_pieces", "start_token", "end_token", "start_char", "end_char", "cut", "text"]
    kinds = [kind, "string", "int", "int", "int", "int", "int", "int", "string", "string"]
    shortest, longest = min((p[1] for p in profiles), default=0), max((p[1] for p in profiles), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = bpe.splitter().findall
        known = _workers.setdefault(vocabularies, Words(vocabularies))
        rows: list[tuple] = []
        keys: list[pa.Scalar] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int32()) for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *arrays], names=names)

        for batch in batches:
            key_type = batch.column(0).type
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not value or len(value.encode("utf-8", "replace")) <= shortest:  # a token is a byte at least
                    continue
                if len(known) > bpe.CACHE_WORDS:
                    known.reset()
                value = bpe.clean(value)
                cutter = Cutter(value, known, words_of(value), longest)
                for profile, limit, overlap in profiles:
                    if cutter.total <= limit:
                        continue
                    made = list(cutter.pieces(limit, overlap))
                    for i, (s, e, sc, ec, strength) in enumerate(made):
                        rows.append((profile, i, len(made), s, e, sc, ec, STRENGTHS[strength], value[sc:ec]))
                        keys.append(doc)
                        held += ec - sc
                if held > BATCH_CHARS:
                    yield batch_of()
                    rows, keys, held = [], [], 0
        if rows:
            yield batch_of()

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))
