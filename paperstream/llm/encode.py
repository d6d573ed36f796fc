"""Problem 6: ids of every text by a public byte-level BPE, merged relationally.

Each task splits its texts into words by the tokenizer's public pattern. Words not seen before by the worker become
token-position rows in an in-process DuckDB; a recursive query joins neighbouring tokens to the merge table and contracts
each word's minimum-rank pair, leftmost first, until no pair is left; an ordered aggregation gives the word's ids. The
occurrences of one pair that do not overlap are contracted in the same step: a merged token only occurs in merges of
higher rank, so the steps in between could not pick another pair. A text's ids are its words' ids in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperstream.llm import bpe

#: Words of more bytes are contracted by a heap of their pairs: the recursion would keep every step of a word as long as a text.
LONG_WORD = 400
#: Distinct words of one recursive query; bounds its state.
QUERY_WORDS = 20_000

_STEP = """
    SELECT {step} AS step, w, pos, CASE WHEN k % 2 = 1 THEN merged ELSE tok END AS tok
    FROM (
        SELECT *, lag(coalesce(k, 0), 1, 0) OVER (PARTITION BY w ORDER BY idx) AS k_before
        FROM (
            SELECT *, CASE WHEN hit THEN row_number() OVER (PARTITION BY w, hit, idx - nth ORDER BY idx) END AS k
            FROM (
                SELECT *, sum(hit::INT) OVER (PARTITION BY w ORDER BY idx ROWS UNBOUNDED PRECEDING) AS nth
                FROM (
                    SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY w), false) AS hit, min(rank) OVER (PARTITION BY w) AS best
                    FROM (
                        SELECT p.*, m.rank, m.merged
                        FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY w ORDER BY pos) AS idx FROM {state}) p
                        LEFT JOIN merges m ON p.tok = m.l AND p.nxt = m.r
                    )
                )
                WHERE best IS NOT NULL
            )
        )
    )
    WHERE k_before % 2 = 0
"""

_RECURSIVE = f"""
    WITH RECURSIVE state(step, w, pos, tok) AS (
        SELECT 0, w, pos, tok FROM start
        UNION ALL
        {_STEP.format(step="step + 1", state="state")}
    )
    SELECT w, list(tok ORDER BY pos) AS ids
    FROM (SELECT *, max(step) OVER (PARTITION BY w) AS last FROM state)
    WHERE step = last GROUP BY w ORDER BY w
"""


class WordEncoder:
    """Ids of words; one per worker. Words once merged are kept, up to bpe.CACHE_WORDS of them."""

    def __init__(self, folder: str):
        import duckdb

        self.byte_ids, merges = bpe.load_merges(folder)
        # no folder for spilled data: the state is bounded by QUERY_WORDS and LONG_WORD
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "autoinstall_known_extensions": False})
        table = pa.table({n: merges[:, i] for i, n in enumerate(("l", "r", "rank", "merged"))})
        self.table, self.merges = merges, {}
        self.db.register("given", table)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.ids: dict[str, list[int]] = {}

    def learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.ids)
        if len(self.ids) + len(new) > bpe.CACHE_WORDS:
            self.ids.clear()
            new = sorted(words)
        raw = [w.encode("utf-8", "replace") for w in new]
        short = [i for i, b in enumerate(raw) if len(b) <= LONG_WORD]
        for at in range(0, len(short), QUERY_WORDS):
            part = short[at : at + QUERY_WORDS]
            for i, ids in zip(part, self._merge([raw[i] for i in part]), strict=True):
                self.ids[new[i]] = ids
        for i, b in enumerate(raw):
            if len(b) > LONG_WORD:
                self.ids[new[i]] = self._merge_long(b)

    def _start(self, raw: list[bytes]) -> None:
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(raw), np.uint8)
        start = pa.table({
            "w": np.repeat(np.arange(len(raw), dtype=np.int32), sizes),
            "pos": (np.arange(len(data)) - np.repeat(ends - sizes, sizes)).astype(np.int32),
            "tok": self.byte_ids[data],
        })
        self.db.register("start", start)

    def _merge(self, raw: list[bytes]) -> list[list[int]]:
        self._start(raw)
        found = self.db.sql(_RECURSIVE).to_arrow_table()
        return found.column("ids").to_pylist()

    def _merge_long(self, raw: bytes) -> list[int]:
        if not self.merges:
            self.merges = {(a, b): (rank, into) for a, b, rank, into in self.table.tolist()}
        return merge_long(self.byte_ids[np.frombuffer(raw, np.uint8)].tolist(), self.merges)


def merge_long(tokens: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """The tokens with the pair of least rank, leftmost first, contracted until no pair is left, in n log n steps."""
    n = len(tokens)
    following, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in merges]
    heapify(heap)
    while heap:
        _, i, a, b = heappop(heap)
        j = following[i]
        if j < 0 or tokens[i] != a or tokens[j] != b:
            continue  # one of the two is gone
        tokens[i], tokens[j] = merges[a, b][1], -1
        following[i] = k = following[j]
        if k >= 0:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0 and y >= 0 and (p := (tokens[x], tokens[y])) in merges:
                heappush(heap, (merges[p][0], x, *p))
    return [t for t in tokens if t >= 0]


class WordDecoder:
    """Texts of lists of ids; one per worker."""

    def __init__(self, folder: str):
        import duckdb

        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "autoinstall_known_extensions": False})
        tokens = bpe.token_bytes(folder)
        self.db.register("given", pa.table({"tok": np.arange(len(tokens), dtype=np.int32), "hex": [t.hex() for t in tokens]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")

    def texts(self, rows: pa.ListArray) -> dict[int, str]:
        """{row: text} of the rows that have ids: token-position rows joined to the vocabulary and put together by an ordered aggregation."""
        sizes = pa.compute.fill_null(pa.compute.list_value_length(rows), 0).to_numpy()
        flat = pa.compute.list_flatten(rows)
        self.db.register("positions", pa.table({"row": np.repeat(np.arange(len(sizes)), sizes), "pos": np.arange(len(flat)), "tok": flat}))
        made = self.db.execute("SELECT row, string_agg(hex, '' ORDER BY pos) FROM positions JOIN vocabulary USING (tok) GROUP BY row").fetchall()
        return {row: bytes.fromhex(x).decode("utf-8", "replace") for row, x in made}


_decoders: dict[str, WordDecoder] = {}
_workers: dict[str, WordEncoder] = {}


def _worker(folder: str) -> WordEncoder:
    if folder not in _workers:
        _workers[folder] = WordEncoder(folder)
    return _workers[folder]


def encode(df: DataFrame, *, key: str = "doc_id", text: str = "text", vocabularies: str = bpe.VOCABULARIES) -> DataFrame:
    """(key, ids array<int>): one row per row of df, no shuffle.

    Null and empty texts have the empty list; strings that look like control tokens are ordinary text and no special
    token is added. Repeated rows come out as often as they come in (documents.doc_id is unique); other columns, null
    keys included, play no part. A lone surrogate is encoded as '?'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, known = bpe.splitter().findall, _worker(vocabularies)
        for batch in batches:
            split = [words_of(t) if t else [] for t in batch.column(1).to_pylist()]
            known.learn(set().union(*split))
            get = known.ids.__getitem__
            rows = [list(chain.from_iterable(map(get, words))) for words in split]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
            flat = np.fromiter(chain.from_iterable(rows), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, *, key: str = "doc_id", ids: str = "ids", vocabularies: str = bpe.VOCABULARIES) -> DataFrame:
    """(key, text): the inverse of encode; null ids give null, an empty list the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabularies not in _decoders:
            _decoders[vocabularies] = WordDecoder(vocabularies)
        for batch in batches:
            whole = _decoders[vocabularies].texts(batch.column(1))
            texts = [whole.get(i, "") if known else None for i, known in enumerate(batch.column(1).is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")
