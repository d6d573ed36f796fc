"""Problem 1: values cut off by field limits or broken transfers.

Length hazards: for each (table, field, source or engine) and each measure of length - characters, bytes, characters
without a trailing mark - the hazard at L is the share of the values that reach L and end there. Window functions give the
hazard of single lengths and of short windows below L (limits that step back to a word's end) and that of the lengths
around; a Poisson tail bound tests one against the other, and Benjamini-Hochberg keeps the share of false lengths below
FDR. Each verdict names its rule:

length      the value ends incompletely at a significant length - there weak signs of an open end suffice;
other_form  the attempt's other form (markdown or text) goes on where this one ends;
transfer    at no significant length: broken transfers cut anywhere, so a strong sign is asked - a cut mark, half a
            character, prose or a row without end, a last line whose shape occurs nowhere else;
copy        an equal copy of a cut value.

What ends complete is learnt from all texts: a last line counts as an end if its shape occurs as a whole line elsewhere.
At lengths where nine in ten values are in excess of the expected, only frequent shapes count as natural.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperstream.llm.common import stored

#: Share of falsely significant lengths.
FDR = 1e-3
#: Lengths on either side against which a length is tested.
NEIGHBOURS = 40
#: Window widths: exact limits, and limits moved back to the end of a word.
WIDTHS = (1, 12)
#: A significant length holds at least so many values, and at least so many times the expected number.
LEAST_COUNT, LEAST_RATIO = 5, 4.0
#: Shapes of last lines: a whole line of this shape, not continued by the next one, within this part of all values (INNER_LEAST at least), or this part of all ends (END_LEAST), make it a natural end.
INNER_SHARE, INNER_LEAST, END_SHARE, END_LEAST = 1e-5, 2, 5e-4, 5
#: Hot shapes are spread over so many tasks.
SALTS = 16
#: A cut mark is shorter than this.
MARK_CHARS = 80
#: A last line beyond either counts as prose: it must end with a sentence end.
SHORT_WORDS, SHORT_CHARS = 6, 60
#: A text of at least this many characters with fewer than one sentence end in as many has no usable sentence ends.
PROSE_CHARS = 600

#: The rules of verdicts.
RULES = ("length", "other_form", "transfer", "copy")

# What is put at the end of a value to mark that it was cut; ends of sentences, rows and rules; page numbers.
_MARK = re.compile(r"((?<!\.)\.\.\.|…|\s?\[(?:cut|truncated|continued|more|\+\d+ (?:more )?(?:chars?|bytes?))\])$")
_TERMINAL = re.compile(r"[.。!！?？|:;；_\-=*)\]”\"»]$")
_PAGE = re.compile(r"^[\W\d]*([ivxlc]+|\d+)[\W\d]*$")
#: Half a character, or a hyphen behind the part of a word.
_BROKEN = re.compile(r"(\ufffd|[^\W\d_A-Z]-)$")
_SENTENCE_END = re.compile(r"[.。！？?!]\s")
_NAME = re.compile(r"\b[A-ZÀ-Þ]\w*[a-zß-ÿ]\w*")
_CODE = re.compile(r"\b[A-Z]{2,}-\d+")
_RULE = re.compile(r"([_.\-=*])\1{2,}")
_DIGITS = re.compile(r"\d+")


def shape(line: str) -> str:
    """A short line with its names, codes, numbers and rules replaced: 'Net Pay: $1,204.50' -> 'X X: $0,0.0'. Single words stay as they are."""
    line = " ".join(line.split())
    if " " in line:
        line = _NAME.sub("X", line)
    return _RULE.sub("~", _DIGITS.sub("0", _CODE.sub("A-0", line)))


def _is_short(line: str) -> bool:
    return len(line) <= SHORT_CHARS and line.count(" ") < SHORT_WORDS


FEATURES = T.StructType([
    *(T.StructField(c, T.StringType()) for c in ("tab", "rec_key", "fld", "hfld", "grp")),
    *(T.StructField(c, T.IntegerType()) for c in ("chars", "bytes", "body")),
    T.StructField("hash", T.BinaryType()),
    *(T.StructField(c, T.BooleanType()) for c in ("longer", "bracket", "marked", "attached", "broken", "terminal", "page", "unbroken")),
    T.StructField("shape", T.StringType()), T.StructField("inner", T.LongType()),
])


def _digest(v: str) -> tuple:
    """chars, bytes, body, hash, and the signs of the end of one value."""
    end = v.rstrip()
    line = end[max(end.rfind("\n"), end.rfind("\r")) + 1 :].strip()
    found = _MARK.search(end[-MARK_CHARS:])
    mark = found.group(1) if found else ""
    raw = v.encode("utf-8", "replace")
    terminal, short = bool(_TERMINAL.search(end[-1:])), _is_short(line)
    # dots set off by a space are leaders or a phrase of the form, not put there by a cut
    before = end[-len(mark) - 1 : -len(mark)] if mark else ""
    # only the end of a prose line asks whether the text has sentence ends at all
    unbroken = not terminal and not short and len(end) >= PROSE_CHARS and len(_SENTENCE_END.findall(end)) * PROSE_CHARS < len(end)
    return (
        len(v), len(raw), len(v) - len(mark), hashlib.blake2b(raw, digest_size=16).digest(),
        mark.lstrip().startswith("["), bool(mark), bool(before) and not before.isspace() and before not in ".…", bool(_BROKEN.search(end[-2:])),
        terminal, short and bool(_PAGE.search(line)), unbroken, shape(line) if short else None,
    )


def _features(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """One pass over the texts: a narrow row of all that the verdict needs per non-blank value, and per task the number of values in which each short line's shape occurs, lines that the next one continues left out.

    `longer`: the attempt's other form goes on where this one ends. A text that is just its markdown in one line is
    judged as that markdown (hfld). Rows of shapes have only shape and inner.
    """

    def lines_of(v: str, counts: Counter, shapes: dict[str, str | None]) -> None:
        lines, own = v.rstrip().split("\n"), set()
        for line, following in zip(lines, lines[1:], strict=False):
            if 0 < len(line) <= SHORT_CHARS and not following[:1].islower():
                if line not in shapes:
                    if len(shapes) > 200_000:  # the worker's memory; what is left out is made again
                        shapes.clear()
                    whole = line.strip()
                    shapes[line] = shape(whole) if whole and not _TERMINAL.search(whole) and _is_short(whole) else None
                own.add(shapes[line])
        own.discard(None)
        counts.update(own)

    def run(batches: Iterator[pa.RecordBatch], tab: str) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        shapes: dict[str, str | None] = {}
        for batch in batches:
            rows = []
            for key, grp, *forms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tab == "documents":
                    if forms[0] and not forms[0].isspace():
                        rows.append((tab, key, "text", "text", grp, False, _digest(forms[0])))
                        lines_of(forms[0], counts, shapes)
                    continue
                md, tx = (x or "" for x in forms)
                m, t = " ".join(md.split()), " ".join(tx.split())
                m_body, t_body = _MARK.sub("", m).rstrip(), _MARK.sub("", t).rstrip()
                of_md = _digest(md) if m else None
                if of_md:
                    rows.append((tab, key, "markdown", "markdown", grp, bool(m_body) and len(t_body) > len(m_body) + 1 and t.startswith(m_body), of_md))
                    lines_of(md, counts, shapes)
                if t and m == t:
                    rows.append((tab, key, "text", "markdown", grp, False, of_md))
                elif t:
                    rows.append((tab, key, "text", "text", grp, bool(t_body) and len(m_body) > len(t_body) + 1 and m.startswith(t_body), _digest(tx)))
            yield _to_batch([(r[0], r[1], r[2], r[3], r[4], *r[6][:4], r[5], *r[6][4:], None) for r in rows])
        yield _to_batch([(None,) * 17 + (s, n) for s, n in counts.items()])

    d = documents.select(F.col("doc_id").cast("string"), F.col("source"), "text")
    c = candidates.select(F.concat_ws(":", "doc_id", F.col("cand_seq").cast("string")), F.lower(F.trim("engine")), "markdown", "text")
    return d.mapInArrow(lambda b: run(b, "documents"), FEATURES).unionByName(c.mapInArrow(lambda b: run(b, "candidates"), FEATURES))


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "integer": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in FEATURES]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.typeName()]) for c, f in zip(columns, FEATURES, strict=True)], names=FEATURES.names)


GROUP = ["tab", "hfld", "grp"]


def _length_counts(values: DataFrame) -> DataFrame:
    units = F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("long").alias("len")) for u in ("chars", "bytes", "body")])).alias("u")
    # a text that equals its markdown is one value
    own = values.where(F.col("fld") == F.col("hfld")).select(*GROUP, units).select(*GROUP, "u.*")
    return own.groupBy(*GROUP, "unit", "len").agg(F.count(F.lit(1)).alias("cnt"))


def hazards(counts: DataFrame) -> DataFrame:
    """(tab, hfld, grp, unit, len, width, count, at_risk, expected, p) of (tab, hfld, grp, unit, len, cnt): one test per length that occurs and window width.

    The windows run over distinct lengths, whose number is bounded by the longest text and not by the rows.
    """
    by = Window.partitionBy(*GROUP, "unit").orderBy("len")
    total = lambda lo, hi: F.coalesce(F.sum("cnt").over(by.rangeBetween(lo, hi)), F.lit(0))
    whole = F.sum("cnt").over(Window.partitionBy(*GROUP, "unit"))
    at_least = lambda x: whole - total(Window.unboundedPreceding, x - 1)  # noqa: E731 - values as long as len + x, by a running sum
    tests = None
    for w in WIDTHS:
        at = counts.select(
            *GROUP, "unit", "len", F.lit(w).alias("width"), total(-(w - 1), 0).alias("count"), at_least(-(w - 1)).alias("at_risk"),
            total(-(w - 1) - NEIGHBOURS, -w).alias("before"), total(1, NEIGHBOURS).alias("after"),
            at_least(-(w - 1) - NEIGHBOURS).alias("risk_before"), at_least(1).alias("risk_after"),
        )
        hazard = (F.col("before") + F.col("after") + 0.5) / (NEIGHBOURS * (F.col("risk_before") + F.col("risk_after")))
        at = at.withColumn("expected", F.col("at_risk") * w * hazard)
        tests = at if tests is None else tests.unionByName(at)
    k, mu = F.col("count").cast("double"), F.col("expected")
    # Chernoff's bound of the Poisson tail
    p = F.when(k > mu, F.exp(-(k * F.log(k / mu) - k + mu))).otherwise(1.0)
    return tests.select(*GROUP, "unit", "len", "width", "count", "at_risk", "expected", p.alias("p"))


def significant_lengths(counts: DataFrame, fdr: float = FDR) -> DataFrame:
    """(tab, hfld, grp, unit, len, sure): lengths kept by Benjamini-Hochberg; sure: nine in ten values there are in excess of the expected.

    The step-up threshold is found by counting: of k tests left those with p <= fdr * k / m stay, until all do. That is
    the largest k of Benjamini-Hochberg, without ranking the tests in one place.
    """
    counts = stored(counts, "length_counts")
    m = counts.count() * len(WIDTHS)
    low = stored(hazards(counts).where(F.col("p") <= fdr), "low_p")
    left, k = low.count(), -1
    while left != k:
        k = left
        left = low.where(F.col("p") <= fdr * k / m).count() if k else 0
    kept = low.where((F.col("p") <= F.lit(fdr * k / m if m else 0.0)) & (F.col("count") >= LEAST_COUNT) & (F.col("count") >= LEAST_RATIO * F.col("expected")))
    kept = kept.withColumn("sure", F.col("count") - F.col("expected") >= 0.9 * F.col("count"))
    each = kept.select(*GROUP, "unit", F.explode(F.sequence(F.col("len") - F.col("width") + 1, F.col("len"))).alias("len"), ((F.col("width") == 1) & F.col("sure")).alias("sure"))
    return each.groupBy(*GROUP, "unit", "len").agg(F.max("sure").alias("sure"))


def judged(documents: DataFrame, candidates: DataFrame, fdr: float = FDR) -> DataFrame:
    """(tab, rec_key, fld, grp, rule): every non-blank value once, with the rule by which it is cut, or null."""
    seen = stored(_features(documents, candidates), "ends")
    feats = seen.where(F.col("tab").isNotNull()).drop("inner").distinct()
    lengths = stored(significant_lengths(_length_counts(feats), fdr), "lengths")
    for unit in ("chars", "bytes", "body"):
        at = lengths.where(F.col("unit") == unit).select(*[F.col(g).alias(f"_{g}") for g in GROUP], F.col("len").cast("int").alias("_len"), F.col("sure").alias(f"sure_{unit}"))
        same = (F.col(unit) == F.col("_len")) & F.col("tab").eqNullSafe(F.col("_tab")) & F.col("hfld").eqNullSafe(F.col("_hfld")) & F.col("grp").eqNullSafe(F.col("_grp"))
        feats = feats.join(at, same, "left").drop("_tab", "_hfld", "_grp", "_len")
    flags = [F.col(f"sure_{u}") for u in ("chars", "bytes", "body")]
    feats = feats.withColumns({"at_limit": F.greatest(*[f.isNotNull() for f in flags]), "sure": F.coalesce(F.greatest(*flags), F.lit(False))})
    feats = stored(feats.drop("sure_chars", "sure_bytes", "sure_body", "chars", "bytes", "body"), "at_limits")
    n = feats.count()
    ends = feats.where(F.col("shape").isNotNull() & ~F.col("at_limit")).groupBy("shape").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(END_LEAST, n * END_SHARE))
    inner = seen.where(F.col("tab").isNull()).groupBy("shape").agg(F.sum("inner").alias("n")).where(F.col("n") >= max(INNER_LEAST, n * INNER_SHARE))
    natural = ends.select("shape", F.lit(True).alias("often")).unionByName(inner.select("shape", (F.col("n") >= max(END_LEAST, n * END_SHARE)).alias("often"))).groupBy("shape").agg(F.max("often").alias("often"))
    natural = natural.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # values without a short last line have no shape and need no join; the others are salted, as one shape may be that of many
    salted = feats.where(F.col("shape").isNotNull()).withColumn("salt", F.pmod(F.xxhash64("rec_key"), F.lit(SALTS)).cast("int")).join(natural, ["shape", "salt"], "left").drop("salt")
    feats = salted.unionByName(feats.where(F.col("shape").isNull()).withColumn("often", F.lit(None).cast("boolean")))
    feats = feats.withColumns({"natural": F.col("often").isNotNull(), "often": F.coalesce("often", F.lit(False))})
    one_form = (F.col("tab") == "documents") | (F.col("hfld") == "markdown")  # has its own lines
    names_only = F.coalesce(F.col("shape").rlike(r"^X( X)*$") | ~F.col("shape").contains(" "), F.lit(False))
    open_end = ~F.col("terminal") & ~F.col("natural") & ~F.col("page")
    at_sure = F.col("sure") & ~F.col("terminal") & (names_only | (~F.col("often") & ~F.col("page")))
    by_length = F.col("at_limit") & ((F.col("marked") & ~(F.col("natural") & ~F.col("attached"))) | (~F.col("marked") & (open_end | at_sure)))
    by_transfer = F.col("bracket") | (F.col("attached") & ~F.col("natural")) | F.col("broken") | (one_form & ~F.col("marked") & open_end & ~F.col("unbroken"))
    verdict = feats.withColumn("rule", F.when(by_length, "length").when(F.col("longer"), "other_form").when(by_transfer, "transfer"))
    verdict = stored(verdict.select("tab", "rec_key", "fld", "grp", "hash", "rule"), "verdicts")
    copies = verdict.where(F.col("rule").isNotNull()).select("hash").distinct().withColumn("copied", F.lit("copy"))
    # the rules by their order in the alphabet: what a value shows itself goes before that it is a copy
    return verdict.join(copies, "hash", "left").groupBy("tab", "rec_key", "fld", "grp").agg(F.max(F.coalesce("rule", "copied")).alias("rule"))


def cut_values(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """(tab, rec_key, fld): the cut values of documents.text and candidates.markdown and .text, once each.

    Null, empty and blank values are never cases. A null source or engine is a group of its own. Repeated rows are one
    record. Extra columns are never read.
    """
    return judged(documents, candidates).where(F.col("rule").isNotNull()).select("tab", "rec_key", "fld").distinct()


def cut_shares(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """(tab, fld, grp, n_values, n_cut, cut_share, n_length, n_other_form, n_transfer, n_copy) per documents.source and candidates.engine: how often each truncates, and by which rule; blank values don't count."""
    by_rule = [F.count_if(F.col("rule") == r).alias(f"n_{r}") for r in RULES]
    return judged(documents, candidates).groupBy("tab", "fld", "grp").agg(
        F.count(F.lit(1)).alias("n_values"), F.count("rule").alias("n_cut"), F.round(F.count("rule") / F.count(F.lit(1)), 6).alias("cut_share"), *by_rule
    )


def limits(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """(tab, hfld, grp, unit, len, sure): the significant lengths themselves."""
    return significant_lengths(_length_counts(_features(documents, candidates).where(F.col("tab").isNotNull()).drop("inner").distinct()))
