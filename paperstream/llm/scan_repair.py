"""Problem 5: noise of scanned pages found line by line, and the text repaired into paragraphs.

The lines of a page are taken apart into running lines, page labels and body; the body's words form one stream without
lines, decoded as the cheapest path against the word counts of documents.text, with splits, merges, character confusions
and hyphens as edges; the repaired lines are gathered into paragraphs by dynamic programming.

No lexicon is gathered anywhere. Words that make up FREQUENT of all words or more - by that at most 1 / FREQUENT of them -
are broadcast and stand as they are. Every other form a page asks for - its rare tokens, and tokens joined at line ends or
with their neighbours - is looked up by equi-joins: with its own count by the form, with the words it may be a misreading
of by the strokes both are made of. What is found of a form is judged once and joined back to the pages that ask.

Running lines are those that stand at the edges of several pages of a document, counted by (document, line key); a page
gets the keys equal or one edit near to its own lines' by equi-joins. What such lines look like is learnt from documents of
many pages and used where an attempt shows a line only once. A page meets the next one with text by its place among the
pages with text, a distributed running count, so a document of any length is spread over all tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperstream.llm import scan_decode as sd
from paperstream.llm.address_parse import one_edit
from paperstream.llm.common import bucket_count, running_sums, stored

#: Lines at a page's top and bottom that can be running.
ZONE = 3
#: A line key is running if on at least two pages and on this part of the document's pages (left and right pages may differ).
PAGE_PART = 0.3
#: Lines whose shape is seldom running are body even if repeated.
SELDOM = 0.2
#: Documents from which shapes are learnt have so many pages; a shape counts from so many lines and this part of all lines - so there are at most 1 / SHAPE_OFTEN shapes -, as running from SHAPE_PART.
LEARN_PAGES, SHAPE_LINES, SHAPE_OFTEN, SHAPE_PART = 4, 5, 2e-5, 0.6
#: Rows of one key are spread over so many tasks.
SALTS = 16


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n): lower-case word counts over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(sd.count_words(t for t in batch.column(0).to_pylist() if t))
            if len(counts) > 500_000:
                yield _counts_batch(counts)
                counts = Counter()
        yield _counts_batch(counts)

    return documents.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _counts_batch(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


_readers: dict[int, sd.Reader] = {}


def _reader(packed: _Packed) -> sd.Reader:
    if packed.id not in _readers:
        _readers.clear()
        _readers[packed.id] = sd.Reader(sd.Lexicon(_floats(packed)))
    return _readers[packed.id]


class _Packed:
    """A broadcast with an id that is the same in all workers."""

    def __init__(self, broadcast, number: int):  # noqa: ANN001
        self.broadcast, self.id = broadcast, number

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def _pack(df: DataFrame, columns: tuple[str, str]) -> _Packed:
    rows = df.select(*columns).collect()  # at most 1 / FREQUENT or 1 / SHAPE_OFTEN rows, by what they are
    data = zlib.compress("\n".join(f"{a} {b!r}" for a, b in rows).encode())
    return _Packed(df.sparkSession.sparkContext.broadcast(data), zlib.crc32(data))


def _floats(packed: _Packed) -> dict[str, float]:
    return {a: float(b) for a, b in (x.rsplit(" ", 1) for x in zlib.decompress(packed.value).decode().split("\n") if x)}


def _eligible_zone(lines: list[str]) -> list[tuple[int, bool]]:
    """(line index, at the top) of the lines at a page's edges."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    head, foot = full[:ZONE], full[-ZONE:]
    return [(i, True) for i in head] + [(i, False) for i in foot if i not in head]


def _edges(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, key, shape): running keys and label keys of each page's edges; key '' once per page that has text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not text or text.isspace() or doc is None or page is None:
                    continue
                lines = text.split("\n")
                rows.append((doc, page, "", ""))
                for i, _ in _eligible_zone(lines):
                    if label := sd.page_label(lines[i]):
                        rows.append((doc, page, f"#{label[0]}{label[1] - page}", ""))
                    elif key := sd.line_key(lines[i]):
                        rows.append((doc, page, key, sd.line_shape(lines[i].strip())))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["doc_id", "page_no", "key", "shape"])

    return pages.mapInArrow(run, "doc_id string, page_no int, key string, shape string").distinct()


def _pieces(key: Column, length: Column) -> list[Column]:
    """The first and last letters of a key of about `length`: one edit, an exchange of neighbours included, leaves one of the two as it is."""
    half = F.floor((length - 2) / 2).cast("int")
    return [F.concat_ws(" ", F.lit(side), length.cast("string"), part) for side, part in (("a", F.substring(key, F.lit(1), half)), ("z", F.substring(key, F.length(key) - half + 1, half)))]


def running_keys(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, page_no, n_pages, keys): of each page with text, its document's running and label keys that its own lines have or nearly have; (shape, part): shapes learnt, with the part of lines that were running).

    Joins run on (document, key), salted by the page, so the lines of one huge document are spread.
    """
    salts = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int")
    per_key = edges.groupBy("doc_id", "key").agg(F.count_distinct("page_no").alias("pages"), F.max("shape").alias("shape"))
    per_doc = salts(per_key.where("key = ''").select("doc_id", F.col("pages").alias("n_pages")))
    judged = per_key.where("key <> ''").withColumn("salt", salt("key")).join(per_doc, ["doc_id", "salt"])
    judged = judged.withColumn("runs", (F.col("pages") >= 2) & ((F.col("pages") >= PAGE_PART * F.col("n_pages")) | F.col("key").startswith("#")))
    judged = stored(judged.select("doc_id", "key", "shape", "pages", "n_pages", "runs"), "line_keys")
    runs = judged.where("runs").select("doc_id", "key")
    lines = edges.where("key <> ''").select("doc_id", "page_no", "key").distinct()
    exact = lines.withColumn("salt", salt("page_no")).join(salts(runs), ["doc_id", "salt", "key"]).select("doc_id", "page_no", "key")
    size = F.length("key")
    pieces = F.explode(F.array(*[p for x in (-1, 0, 1) for p in _pieces(F.col("key"), size + x)]))
    near = lines.where(~F.col("key").startswith("#")).select("doc_id", "page_no", F.col("key").alias("own"), pieces.alias("piece")).withColumn("salt", salt("page_no"))
    near = near.join(salts(runs.where(~F.col("key").startswith("#")).select("doc_id", "key", F.explode(F.array(*_pieces(F.col("key"), size))).alias("piece"))), ["doc_id", "salt", "piece"])
    near = near.where((F.col("own") != F.col("key")) & (F.levenshtein("own", "key") <= 2)).select("doc_id", "page_no", "key")
    keys = exact.unionByName(near).groupBy("doc_id", "page_no").agg(F.collect_set("key").alias("keys"))
    pages = edges.where("key = ''").select("doc_id", "page_no").withColumn("salt", salt("page_no")).join(per_doc, ["doc_id", "salt"]).drop("salt").join(keys, ["doc_id", "page_no"], "left")
    shapes = judged.where((F.col("shape") != "") & (F.col("n_pages") >= LEARN_PAGES)).groupBy("shape").agg(F.sum("pages").alias("lines"), F.sum(F.when(F.col("runs"), F.col("pages")).otherwise(0)).alias("running"))
    shapes = stored(shapes.where(F.col("lines") >= SHAPE_LINES), "shapes")
    total = shapes.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    return pages, shapes.where(F.col("lines") >= SHAPE_OFTEN * total).select("shape", F.round(F.col("running") / F.col("lines"), 4).alias("part"))


def _split_page(lines: list[str], page: int, n_pages: int, keys: set[str], shapes: dict[str, float]) -> tuple[set[int], set[int]]:
    """(running lines, label lines) of a scanned page."""
    running: set[int] = set()
    labels: set[int] = set()
    for i, _ in _eligible_zone(lines):
        if label := sd.page_label(lines[i]):
            explicit = label[0] not in ("0", "r")
            outermost = not any(x.strip() for x in lines[:i]) or not any(x.strip() for x in lines[i + 1 :])
            if explicit or f"#{label[0]}{label[1] - page}" in keys or (outermost and label[1] == page):
                labels.add(i)
        elif (key := sd.line_key(lines[i])) and (key in keys or any(one_edit(key, k) for k in keys)) and shapes.get(sd.line_shape(lines[i].strip()), 1.0) >= SELDOM:
            running.add(i)
    if n_pages < LEARN_PAGES:  # too few pages to show what repeats: lines made like running ones, from the edge inwards
        _spread(lines, running, labels, shapes, ends_only=False, opening=page <= 1)
    return running, labels


def _spread(lines: list[str], running: set[int], labels: set[int], shapes: dict[str, float], *, ends_only: bool, opening: bool) -> None:
    """Adds lines of running shape that touch the edge of the page or lines already taken. What opens a document is its letterhead or title as long as nothing repeats it."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    for _ in range(ZONE):
        grown = False
        for x, i in enumerate(full):
            if i in running or i in labels or (opening and x < ZONE):
                continue
            near = i - 1 in running or i - 1 in labels or i + 1 in running or i + 1 in labels
            edge = x == len(full) - 1 or (x == 0 and not ends_only)
            if (near or edge) and sd.line_key(lines[i]) and shapes.get(sd.line_shape(lines[i].strip()), 0.0) >= SHAPE_PART:
                running.add(i)
                grown = True
        if not grown:
            return


def _split_attempt(lines: list[str], shapes: dict[str, float]) -> tuple[set[int], set[int]]:
    """(running lines, label lines) of an attempt, whose pages follow one another without a mark."""
    running: set[int] = set()
    labels: set[int] = set()
    keys = {i: k for i, x in enumerate(lines) if (k := sd.line_key(x))}
    often = Counter(keys.values())
    for i, k in keys.items():
        if often[k] >= 2 and (shapes.get(sd.line_shape(lines[i].strip()), 0.0) >= SELDOM or often[k] >= 3):
            running.add(i)
    found = {i: label for i, x in enumerate(lines) if x.strip() and (label := sd.page_label(x))}
    labels |= {i for i, label in found.items() if label[0] not in ("0", "r")}
    full = [i for i, x in enumerate(lines) if x.strip()]
    place = {i: x for x, i in enumerate(full)}
    sure = lambda j: j in keys and shapes.get(sd.line_shape(lines[j].strip()), 0.0) >= SHAPE_PART
    for _ in range(2):
        _spread(lines, running, labels, shapes, ends_only=True, opening=True)
        for i, label in sorted(found.items()):
            x = place[i]
            beside = [full[y] for y in (x - 1, x + 1) if 0 <= y < len(full)]
            next_number = label[1] == 1 + sum(j < i for j in labels)
            if label[0] == "r" or next_number or x in (0, len(full) - 1) or any(j in running or (abs(j - i) == 1 and sure(j)) for j in beside):
                labels.add(i)
    return running, labels


#: One row per page or attempt: its noise, and its paragraphs before those of neighbouring pages are joined. place: the page's number among the pages with text.
_READ = "tab string, doc_id string, page_no int, rec_key string, fld string, lines array<int>, kinds array<string>, paragraphs array<string>, goes_on boolean, glued boolean, place bigint"

_MARKS, _WORDS = pa.list_(pa.int32()), pa.list_(pa.string())


def _joined(fixed: list[str], groups: list[list[int]], pos: dict[int, int]) -> list[str]:
    """The paragraphs' texts; the rows of a table stay lines."""
    texts = ([x for i in g if (x := fixed[pos[i]])] for g in groups)
    return [p for g in texts if g and (p := ("\n".join(g) if g[0].startswith("|") else sd.join_lines(g)).strip())]


def _body(lines: list[str], *out: Iterable[int]) -> list[int]:
    gone = set().union(*out)
    return [i for i, x in enumerate(lines) if x.strip() and i not in gone]


def _asked(reader: sd.Reader, lines: list[str], body: list[int]) -> tuple[list[str], list[str]]:
    """(the body's tokens, the forms to be looked up for them)."""
    stream, ends = sd.flat([lines[i].split() for i in body])
    return stream, list(reader.asks(stream, ends))


def _split_pages(pages: DataFrame, frequent: _Packed, shapes: _Packed) -> DataFrame:
    """pages (doc_id, page_no, extracted_text, n_pages, keys) with running and labels (line indexes), the first and last body tokens, and the forms to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, known = _reader(frequent), _floats(shapes)
        for batch in batches:
            rows = []
            for page, text, n_pages, keys in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                lines = (text or "").split("\n")
                running, labels = _split_page(lines, page, n_pages or 1, set(keys or ()), known)
                stream, forms = _asked(reader, lines, _body(lines, running, labels))
                rows.append((sorted(running), sorted(labels), stream[0] if stream else None, stream[-1] if stream else None, forms))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (_MARKS, _MARKS, pa.string(), pa.string(), _WORDS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "page_no", "extracted_text", "running", "labels", "first", "last", "forms"])

    schema = "doc_id string, page_no int, extracted_text string, running array<int>, labels array<int>, first string, last string, forms array<string>"
    return pages.select("doc_id", "page_no", "extracted_text", "n_pages", "keys").mapInArrow(run, schema)


def _neighbours(split: DataFrame, frequent: _Packed) -> DataFrame:
    """(doc_id, page_no, place, following, forms) of the pages with body text: the place among them in page order, the first token of the next one, and the forms to be looked up for a word broken between the two."""
    firsts = split.where("first is not null").groupBy("doc_id", "page_no").agg(F.min("first").alias("first"), F.min("last").alias("last"), F.lit(1).alias("one"))
    placed, _ = running_sums(firsts, ["doc_id"], ["page_no"], "one", "page_places", bucket_count(split))
    placed = stored(placed.select("doc_id", "page_no", "first", "last", F.col("below").alias("place")), "places")
    ahead = placed.select("doc_id", (F.col("place") - 1).alias("place"), F.col("first").alias("following"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(frequent)
        for batch in batches:
            forms = [sorted(reader.asks_divided(a, b)) if b and a[-1] in sd.HYPHENS else [] for a, b in zip(batch.column("last").to_pylist(), batch.column("following").to_pylist(), strict=True)]
            names = ["doc_id", "page_no", "place", "following"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(forms, _WORDS)], names=[*names, "forms"])

    return placed.join(ahead, ["doc_id", "place"], "left").select("doc_id", "page_no", "place", "following", "last").mapInArrow(run, "doc_id string, page_no int, place bigint, following string, forms array<string>")


_FOUND = "array<struct<form: string, part: double, word: string, word_part: double, places: array<int>>>"


def sd_strokes(word: str) -> Column:
    """scan_decode.strokes as a Column."""
    one = {chr(a): b for a, b in sd._STROKES.items() if len(b) == 1}
    out = F.translate(word, "".join(one), "".join(one.values()))
    for a, b in sd._STROKES.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(chr(a)), F.lit(b))
    return out


def readings(asked: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(form, part, word, word_part, places) of the distinct forms of `asked` of which anything is known.

    Only words of LEAST or more, at most 1 / LEAST of them, can be readings, so few words share the strokes of a form.
    """
    forms = asked.select("form").distinct()
    own = forms.join(words.select(F.col("word").alias("form"), "n"), "form", "left").select("form", (F.coalesce("n", F.lit(0)) / total).alias("part"))
    likely = words.where(F.col("n") >= sd.LEAST * total).select(F.struct((F.col("n") / total).alias("part"), "word").alias("near"), sd_strokes("word").alias("strokes"))
    pairs = own.withColumn("strokes", sd_strokes("form")).join(likely, "strokes", "left").where("near is null or near.word <> form")
    near = own.where("part > 0").select("form", "part", F.lit(None).cast("struct<part: double, word: string>").alias("near")).unionByName(pairs.where("near is not null").select("form", "part", "near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for form, part, near in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x := sd.found(form, part, [(y["word"], y["part"]) for y in near]):
                    rows.append((form, *x))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.float64(), pa.string(), pa.float64(), _MARKS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["form", "part", "word", "word_part", "places"])

    return near.groupBy("form").agg(F.max("part").alias("part"), F.collect_list("near").alias("near")).mapInArrow(run, "form string, part double, word string, word_part double, places array<int>")


def _found(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(tab, doc_id, page_no, found): what is known of the forms each page or attempt asks for. A form that many pages ask for is spread over SALTS tasks."""
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).select("salt", "form", F.struct("form", "part", "word", "word_part", "places").alias("x"))
    each = asked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "page_no"), F.lit(SALTS)).cast("int")).join(salted, ["salt", "form"])
    return each.groupBy("tab", "doc_id", "page_no").agg(F.collect_set("x").alias("found"))


def _learn(reader: sd.Reader, found: list[dict] | None) -> None:
    reader.lex.learn((x["form"], sd.Found(x["part"], x["word"], x["word_part"], tuple(x["places"]))) for x in found or ())


def _read_pages(pages: DataFrame, frequent: _Packed) -> DataFrame:
    """pages: the columns of _split_pages, place, following (first body word of the next page that has text), found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(frequent)
        for batch in batches:
            rows = []
            for doc, page, text, running, labels, following, place, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _learn(reader, found)
                lines, out = (text or "").split("\n"), {*running, *labels}
                body = _body(lines, out)
                noise, fixed, glued = reader.read(lines, body, following or "")
                noise |= {(i, "running") for i in running} | {(i, "page_no") for i in labels}
                groups = sd.paragraphs([x if i not in out else "" for i, x in enumerate(lines)])
                paras = _joined(fixed, groups, {i: k for k, i in enumerate(body)})
                last = lines[body[-1]].rstrip() if body else ""
                goes_on = glued or (bool(last) and last[-1] not in ".。!?！？:|")
                order = sorted(noise)
                rows.append(("scan_pages", doc, page, f"{doc}:{page}", "extracted_text", [i + 1 for i, _ in order], [k for _, k in order], paras, goes_on, glued, place))
            yield _read_batch(rows)

    return pages.select("doc_id", "page_no", "extracted_text", "running", "labels", "following", "place", "found").mapInArrow(run, _READ)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), _MARKS, _WORDS, _WORDS, pa.bool_(), pa.bool_(), pa.int64()]
    names = ["tab", "doc_id", "page_no", "rec_key", "fld", "lines", "kinds", "paragraphs", "goes_on", "glued", "place"]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


_KNOWN = pa.list_(pa.struct([(n, pa.string()) for n in ("kind", "line", "prev", "following")]))
_KNOWN_DDL = "array<struct<kind: string, line: string, prev: string, following: string>>"


def _split_attempts(candidates: DataFrame, frequent: _Packed, shapes: _Packed) -> DataFrame:
    """Attempts with running and labels (line indexes), `known`: these lines with their neighbours, whether the text runs on past the markdown, and the forms to be looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, make = _reader(frequent), _floats(shapes)
        for batch in batches:
            rows = []
            for md, tx in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                lines = (md or "").split("\n")
                running, labels = _split_attempt(lines, make) if md and not md.isspace() else (set(), set())
                known = [dict(zip(("kind", "line", "prev", "following"), x, strict=True)) for x in _known_lines(lines, running, labels)]
                rows.append((sorted(running), sorted(labels), known, bool(tx) and not tx.isspace() and _goes_on(lines, tx), _asked(reader, lines, _body(lines, running, labels))[1]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (_MARKS, _MARKS, _KNOWN, pa.bool_(), _WORDS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "page_no", "markdown", "text", "running", "labels", "known", "more", "forms"])

    own = candidates.select("doc_id", F.col("cand_seq").cast("int").alias("page_no"), "markdown", "text").where(F.col("doc_id").isNotNull() & F.col("page_no").isNotNull())
    return own.mapInArrow(run, f"doc_id string, page_no int, markdown string, text string, running array<int>, labels array<int>, known {_KNOWN_DDL}, more boolean, forms array<string>")


def _read_attempts(attempts: DataFrame, frequent: _Packed) -> DataFrame:
    """The readings of attempts (the columns of _split_attempts, the rest_ columns of _rests, found): of a text that runs on, the noise of the markdown's lines and that of the rest. An attempt's paragraphs go to the end of the longer of the two; they stand with its markdown, if blank too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader(frequent)
        for batch in batches:
            rows = []
            for doc, seq, md, tx, running, labels, rest, rest_kinds, broken, start, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                _learn(reader, found)
                key, lines, out = f"{doc}:{seq}", (md or "").split("\n"), {*running, *labels}
                noise: set[tuple[int, str]] = set()
                paras = _with_rest(reader, lines, out, rest, broken, start) if rest is not None else None
                if md and not md.isspace():
                    body = _body(lines, out)
                    noise, fixed, _ = reader.read(lines, body)
                    noise |= {(i, "running") for i in running} | {(i, "page_no") for i in labels}
                    if paras is None:
                        paras = _joined(fixed, sd.paragraphs([x if i not in out else "" for i, x in enumerate(lines)]), {i: k for k, i in enumerate(body)})
                if paras is not None:
                    order = sorted(noise)
                    rows.append(("candidates", doc, seq, key, "markdown", [i + 1 for i, _ in order], [k for _, k in order], paras, False, False, None))
                if tx and not tx.isspace():
                    kinds = _held_kinds(lines, noise, tx)
                    if rest is not None:
                        kinds |= {*rest_kinds, *_stream_kinds(reader, rest)}
                    rows.append(("candidates", doc, seq, key, "text", [1] * len(kinds), sorted(kinds), [], False, False, None))
            yield _read_batch(rows)

    return attempts.select("doc_id", "page_no", "markdown", "text", "running", "labels", "rest", "rest_kinds", "rest_broken", "rest_start", "found").mapInArrow(run, _READ)


def _held_kinds(lines: list[str], noise: set[tuple[int, str]], text: str) -> set[str]:
    """Kinds of noise of a markdown's lines that a text still holds."""
    kinds: set[str] = set()
    if not noise:
        return kinds
    flat = " ".join(text.split())
    starts, at = {}, 0
    for i, line in enumerate(lines):
        words = " ".join(line.split())
        starts[i] = at
        at += len(words) + (1 if words else 0)
    for i, kind in noise:
        if starts[i] < len(flat) and (kind != "hyphen" or starts[i] + len(" ".join(lines[i].split())) < len(flat)):
            kinds.add(kind)
    return kinds


def _goes_on(lines: list[str], text: str) -> bool:
    """Whether a text runs on past its markdown, which was cut."""
    return len("".join(text.split())) > sum(len("".join(x.split())) for x in lines) + 1


def _known_lines(lines: list[str], running: set[int], labels: set[int]) -> list[tuple[str, str, str, str]]:
    """(kind, line, last token before it, first token after it) of an attempt's running lines and labels, to be found again where a text has no lines."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    out = set()
    for x, i in enumerate(full):
        if i in running or i in labels:
            near = (lines[full[x - 1]].split()[-1] if x else "", lines[full[x + 1]].split()[0] if x + 1 < len(full) else "")
            out.add(("page_no" if i in labels else "running", " ".join(lines[i].split()), *near))
    return sorted(out)


_LABEL_START = re.compile(r"[\W_]|\d|(?:page|pg|p)\b", re.IGNORECASE)
#: Most words of a label; of a running line.
_LABEL_WORDS, _LINE_WORDS = 5, 9


def _lines_in(rest: list[str], known: list[tuple[str, str, str, str]], shapes: dict[str, float]) -> dict[int, str]:
    """{token: 'running' or 'page_no'}: running lines and labels in a stream of tokens without lines.

    Labels with a word, brackets, dashes or a total stand in no sentence and are taken as they are. Bare numbers need the
    neighbour they have in another attempt, or a running line beside them. Running lines are those known from the
    document's attempts, and beside one or a label what has the shape of one.
    """
    out: dict[int, str] = {}
    folded = [sd.folded(t) for t in rest]
    before, after = lambda p: rest[p - 1] if p else "", lambda p: rest[p] if p < len(rest) else ""
    unsure: list[tuple[int, int, str]] = []
    for kind, line, prev, following in known:
        words = [sd.folded(w) for w in line.split()] if kind == "page_no" else sd.line_key(line).split()
        if not words:
            continue
        own = " ".join(words)
        for p in range(len(rest) - len(words) + 1):
            q = p + len(words)
            if folded[p] != words[0] and folded[q - 1] != words[-1]:
                continue
            window = " ".join(folded[p:q])
            if window != own and (kind == "page_no" or not one_edit(window, own)):
                continue
            if len(words) == 1 and kind == "running" and not rest[p][:1].isupper():
                continue  # the same word within a sentence
            beside = (prev and before(p) == prev) or (following and after(q) == following)
            if beside or (kind == "running" and (len(words) > 3 or (len(words) > 1 and " ".join(rest[p:q]).isupper()))):
                out.update(dict.fromkeys(range(p, q), kind))
            elif kind == "running":
                unsure.append((p, q, kind))
    # a label within a running line: 'ANNUAL REVIEW | Page 3', 'Page 2 ANNUAL REVIEW'
    leads = any(k == "running" and (m := sd.line_key(x)) and sd.folded(x.split()[0]) != m.split()[0] for k, x, _, _ in known)
    p = 0
    while p < len(rest):
        if p not in out and _LABEL_START.match(rest[p]):
            for q in range(min(len(rest), p + _LABEL_WORDS), p, -1):
                label = sd.page_label(" ".join(rest[p:q])) if out.keys().isdisjoint(range(p, q)) else None
                if label and label[0] not in ("0", "r") and "|" not in label[0]:
                    part = before(p) == "|" or (leads and out.get(q) == "running")
                    out.update(dict.fromkeys(range(p - (before(p) == "|"), q), "running" if part else "page_no"))
                    p = q - 1
                    break
        p += 1
    beside = lambda p, q: p - 1 in out or q in out
    bare = any(k == "page_no" and (m := sd.page_label(x)) and m[0] in ("0", "r") for k, x, _, _ in known)
    for _ in range(ZONE):
        grown = {}
        for p, q, kind in unsure:
            if beside(p, q):
                grown.update(dict.fromkeys(range(p, q), kind))
        for p in sorted({x + 1 for x in out} | {x - w for x in out for w in range(1, _LINE_WORDS + 1)}):
            if p < 0 or p >= len(rest) or p in out:
                continue
            for q in range(min(len(rest), p + _LINE_WORDS), p + 1, -1):
                line = " ".join(rest[p:q])
                if beside(p, q) and out.keys().isdisjoint(range(p, q)) and sd.line_key(line) and shapes.get(sd.line_shape(line), 0.0) >= SHAPE_PART:
                    grown.update(dict.fromkeys(range(p, q), "running"))
                    break
            if bare and beside(p, p + 1) and (label := sd.page_label(rest[p])) and label[0] in ("0", "r"):
                grown.setdefault(p, "page_no")
        if grown.keys() <= out.keys():
            break
        out = grown | out
    return out


def _rest(lines: list[str], gone: set[int], text: str, known: list[tuple[str, str, str, str]], shapes: dict[str, float]) -> tuple[list[str], set[str], int, int]:
    """(the body tokens of a text behind its cut markdown, kinds of the running lines and labels among them, how many of the first tokens are a broken word at the markdown's end, how many tokens the markdown has before the rest)."""
    tokens, rows = text.split(), [x.split() for x in lines]
    full = [i for i, r in enumerate(rows) if r]
    head = [t for r in rows for t in r]
    same = next((k for k, (a, b) in enumerate(zip(head, tokens, strict=False)) if a != b), len(head))
    # the markdown's last line may be the first part of one
    last = full[-1] if full else -1
    start = min(same, len(head) - (0 if not full or (last in gone and same == len(head)) else len(rows[last])))
    tail = next((rows[i][-1] for i in reversed(full) if i != last and i not in gone), "")
    rest = tokens[start:]
    taken = _lines_in(rest, known, shapes)
    stream = [t for k, t in enumerate(rest) if k not in taken]
    broken = [tail] if tail and tail[-1] in sd.HYPHENS else []
    return broken + stream, set(taken.values()), len(broken), start


def _before_rest(lines: list[str], gone: set[int], start: int) -> tuple[list[str], list[int]]:
    """(the lines of a cut markdown with its first `start` tokens, the body lines among them)."""
    before: list[str] = []
    for line in lines:
        words = line.split()
        if len(words) > start:
            before.append(" ".join(words[:start]))
            break
        before.append(line)
        start -= len(words)
    return before, _body(before, gone)


def _with_rest(reader: sd.Reader, lines: list[str], gone: set[int], rest: list[str], broken: int, start: int) -> list[str]:
    """The paragraphs of an attempt whose text runs on past its markdown: those of the markdown's lines before the rest, and the rest, whose lines nothing shows, as what continues the last or one of its own."""
    before, body = _before_rest(lines, gone, start)
    stream = rest[broken:]
    _, fixed, glued = reader.read(before, body, stream[0] if stream else "")
    paras = _joined(fixed, sd.paragraphs([x if i not in gone else "" for i, x in enumerate(before)]), {i: k for k, i in enumerate(body)})
    stream = stream[glued:]
    words: list[str] = list(stream)
    for k, size, edge in reader.decode(stream, _rest_ends(stream)):
        words[k : k + size] = [edge.text, *[""] * (size - 1)]
    more = sd.join_lines(filter(None, words)).strip()
    last = before[body[-1]].rstrip() if body else ""
    goes_on = glued or (bool(last) and last[-1] not in ".。!?！？:|" and more[:1].lower() == more[:1])
    if more and paras and goes_on:
        return [*paras[:-1], sd.join_lines([paras[-1], more])]
    return [*paras, more] if more else paras


def _rest_ends(stream: list[str]) -> list[int]:
    """Where a stream without lines may have had a line's end: behind every mark of a hyphen."""
    return [k for k, t in enumerate(stream) if t[-1] in sd.HYPHENS and len(t) > 2]


def _stream_kinds(reader: sd.Reader, stream: list[str]) -> set[str]:
    """Kinds of noise in a stream of body tokens without lines."""
    kinds: set[str] = set()
    for k, _, edge in reader.decode(stream, _rest_ends(stream)):
        kinds |= {"hyphen"} if edge.hyphen else set()
        # a hyphen within a token may be a line's end that was put in: what is misread there is not sure
        if any(edge.misread) and (edge.hyphen or not any(c in sd.HYPHENS for c in stream[k])):
            kinds.add("misread")
    return kinds


def _rests(attempts: DataFrame, frequent: _Packed, shapes: _Packed) -> DataFrame:
    """(doc_id, page_no, rest, rest_kinds, rest_forms, rest_broken, rest_start) of the attempts whose text runs on past the markdown, its lines found with those that any attempt of the document shows."""
    rests = attempts.where("more").select("doc_id", "page_no", "markdown", "text", "running", "labels")
    seen = attempts.select("doc_id", F.explode("known").alias("line")).join(rests.select("doc_id").distinct(), "doc_id", "left_semi")
    rests = rests.join(seen.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("known")), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, make = _reader(frequent), _floats(shapes)
        for batch in batches:
            rows = []
            for md, tx, running, labels, known in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                lines_known = [(x["kind"], x["line"], x["prev"], x["following"]) for x in known or ()]
                lines, out = (md or "").split("\n"), {*running, *labels}
                stream, kinds, broken, start = _rest(lines, out, tx, lines_known, make)
                forms = reader.asks(stream, _rest_ends(stream))
                before, body = _before_rest(lines, out, start)
                if body and len(stream) > broken and (end := before[body[-1]].split()[-1])[-1] in sd.HYPHENS:
                    forms |= reader.asks_divided(end, stream[broken])
                rows.append((stream, sorted(kinds), sorted(forms), broken, start))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds_of = (_WORDS, _WORDS, _WORDS, pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True))], names=["doc_id", "page_no", "rest", "rest_kinds", "rest_forms", "rest_broken", "rest_start"])

    return rests.select("doc_id", "page_no", "markdown", "text", "running", "labels", "known").mapInArrow(run, "doc_id string, page_no int, rest array<string>, rest_kinds array<string>, rest_forms array<string>, rest_broken int, rest_start int")


def read_all(scan_pages: DataFrame, candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """The reading of every page and attempt; the base of noise and paragraphs."""
    pages = scan_pages.select("doc_id", F.col("page_no").cast("int").alias("page_no"), "extracted_text").where(F.col("doc_id").isNotNull() & F.col("page_no").isNotNull())
    words = stored(word_counts(documents), "words")
    total = max(1, words.agg(F.sum("n")).first()[0] or 0)
    frequent = _pack(words.where(F.col("n") >= sd.FREQUENT * total).withColumn("part", F.col("n") / total), ("word", "part"))
    page_keys, shapes = running_keys(stored(_edges(pages), "edges"))
    make = _pack(shapes, ("shape", "part"))
    split = stored(_split_pages(pages.distinct().join(page_keys, ["doc_id", "page_no"], "left"), frequent, make), "pages")
    beside = stored(_neighbours(split, frequent), "neighbours")
    attempts = stored(_split_attempts(candidates, frequent, make), "attempts")
    rests = stored(_rests(attempts, frequent, make), "rests")
    asks = lambda df, tab, forms="forms": df.select(F.lit(tab).alias("tab"), "doc_id", "page_no", F.explode(forms).alias("form"))
    asked = asks(split, "scan_pages").unionByName(asks(beside, "scan_pages")).unionByName(asks(attempts, "candidates")).unionByName(asks(rests, "candidates", "rest_forms"))
    found = _found(asked, stored(readings(asked, words, total), "readings"))
    of = lambda tab: found.where(F.col("tab") == tab).drop("tab")
    read = _read_pages(split.join(beside.drop("forms"), ["doc_id", "page_no"], "left").join(of("scan_pages"), ["doc_id", "page_no"], "left"), frequent)
    tried = attempts.drop("forms", "known").join(rests.drop("rest_forms").dropDuplicates(["doc_id", "page_no"]), ["doc_id", "page_no"], "left")
    return read.unionByName(_read_attempts(tried.withColumn("rest", F.when(F.col("more"), F.col("rest"))).join(of("candidates"), ["doc_id", "page_no"], "left"), frequent))


def noisy_lines(read: DataFrame) -> DataFrame:
    """(tab, rec_key, fld, line_no, noise) of read_all's rows, each once; repeated rows of the input are one record. Null, empty and blank values have no noise."""
    each = read.select("tab", "rec_key", "fld", F.explode(F.arrays_zip("lines", "kinds")).alias("x"))
    return each.select("tab", "rec_key", "fld", F.col("x.lines").alias("line_no"), F.col("x.kinds").alias("noise")).distinct()


def repaired(read: DataFrame) -> DataFrame:
    """(tab, rec_key, para_no, text): paragraphs of every scanned document (rec_key doc_id, pages joined) and attempt (rec_key doc_id:cand_seq), numbered from 1. Where an attempt's text runs on past its markdown, so do its paragraphs.

    A paragraph that is open at a page's end is continued by the next page's first. Blank pages have none.
    """
    once = stored(read.where("fld <> 'text'").select("tab", "doc_id", "page_no", "rec_key", "paragraphs", "goes_on", "glued", "place").distinct(), "read")
    attempts = once.where("tab = 'candidates'").select("tab", "rec_key", F.posexplode("paragraphs").alias("i", "text")).select("tab", "rec_key", (F.col("i") + 1).cast("long").alias("para_no"), "text")
    pages = once.where(F.col("tab") == "scan_pages").where(F.size("paragraphs") > 0)
    # the page with text before
    before = pages.groupBy("doc_id", "place").agg(F.max(F.struct("goes_on", "glued")).alias("last")).select("doc_id", (F.col("place") + 1).alias("place"), F.col("last.goes_on").alias("open"), F.col("last.glued").alias("had"))
    parts = pages.join(before, ["doc_id", "place"], "left").select("doc_id", "page_no", "open", "had", F.posexplode("paragraphs").alias("i", "text"))
    # the first word of a page was put with its other part on the page before
    parts = parts.withColumn("text", F.when((F.col("i") == 0) & F.coalesce("had", F.lit(False)), F.regexp_replace("text", r"^\S+\s*", "")).otherwise(F.col("text")))
    # a paragraph that goes on starts none
    starts = parts.withColumn("one", F.when((F.col("i") == 0) & F.coalesce("open", F.lit(False)) & (F.coalesce("had", F.lit(False)) | (F.lower(F.substring("text", 1, 1)) == F.substring("text", 1, 1))), 0).otherwise(1))
    placed, _ = running_sums(starts.select("doc_id", "page_no", "i", "text", "one"), ["doc_id"], ["page_no", "i"], "one", "paragraphs", bucket_count(once))
    numbered = placed.withColumn("para_no", F.greatest(F.col("below") + F.col("one"), F.lit(1)))
    whole = numbered.groupBy("doc_id", "para_no").agg(F.array_sort(F.collect_list(F.struct("page_no", "i", "text"))).alias("parts"))
    scans = whole.select(F.lit("scan_pages").alias("tab"), F.col("doc_id").alias("rec_key"), F.col("para_no").cast("long"), F.trim(F.array_join(F.transform("parts", lambda p: p["text"]), " ")).alias("text")).where("text <> ''")
    return scans.unionByName(attempts)
