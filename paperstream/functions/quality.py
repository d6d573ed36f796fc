"""Measures of a text's quality, structure, tables and figures as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperstream.functions import patterns as P
from paperstream.functions import text as T

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
#: Fixed value: the third mark that opens a heading, as the measure's definition has it.
HEADING_MARKS = ("#", "-", "â€¢")


def _raw(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _count_if(parts: Column, test) -> Column:  # noqa: ANN001
    return F.size(F.filter(parts, test))


def _pipes(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit("")))


def _tabs(x: Column) -> Column:
    return F.size(F.split(x, "\t"))


def chars(c: Column | str) -> Column:
    return F.length(F.regexp_replace(_raw(c), r"(?U)^\s+|\s+$", ""))


def digit_count(c: Column | str) -> Column:
    return F.length(_raw(c)) - F.length(F.regexp_replace(_raw(c), r"(?U)\p{Nd}", ""))


def marker_hits(c: Column, markers: tuple[str, ...]) -> Column:
    return reduce(Column.__add__, [F.contains(c, F.lit(m)).cast("int") for m in markers])


def table_rows(c: Column | str) -> Column:
    """Lines with two pipes or three tabbed cells."""
    return _count_if(F.split(_raw(c), _BREAK), lambda x: (_pipes(x) >= 2) | (_tabs(x) >= 3))


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def numeric_fidelity(c: Column | str, profile: str = "gateway") -> Column:
    """How dense in figures and finance words, three decimals."""
    dense, marks, markers = (0.6, 0.4, P.GATEWAY_MARKERS) if profile == "gateway" else (0.4, 0.6, P.TOOL_MARKERS)
    density = F.least(F.lit(1.0), digit_count(c) / F.greatest(F.lit(1), F.length(_raw(c))) * 15.0)
    bonus = F.least(F.lit(1.0), marker_hits(F.lower(_raw(c)), markers) / 6.0)
    return F.bround(_unit(density * dense + bonus * marks), 3)


def _headings(c: Column | str) -> Column:
    upper = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    opens = lambda x: reduce(Column.__or__, [x.startswith(m) for m in HEADING_MARKS])
    return _count_if(F.slice(T.stripped_lines(c), 1, 80), lambda x: x.endswith(":") | opens(x) | upper(x))


def structure(c: Column | str, profile: str = "gateway") -> Column:
    """How much of lines, headings and tables, three decimals; 0 for blank texts."""
    n, rows = F.size(T.stripped_lines(c)), table_rows(c)
    many, heads, tables = F.least(F.lit(1.0), n / 80.0), F.least(F.lit(1.0), _headings(c) / 12.0), F.least(F.lit(1.0), rows / 8.0)
    if profile == "gateway":
        score = many * 0.35 + heads * 0.35 + tables * 0.30
    else:
        score = many * 0.2 + heads * 0.15 + tables * 0.5 + F.when(rows >= 6, 0.15).when(rows >= 3, 0.08).otherwise(0.0)
    return F.when(n == 0, 0.0).otherwise(F.bround(_unit(score), 3))


def quality(c: Column | str, confidence: Column, profile: str = "gateway", consistency: Column | None = None) -> Column:
    """struct(score, chars, confidence, structure_score, numeric_fidelity_score, table_rows); without a confidence 0.65 counts."""
    size = F.least(F.lit(1.0), chars(c) / 1600.0)
    conf = F.when(confidence.isNull(), 0.65).otherwise(_unit(confidence))
    s, n = structure(c, profile), numeric_fidelity(c, profile)
    if profile == "gateway":
        score = size * 0.35 + s * 0.35 + n * 0.20 + conf * 0.10
    else:
        checked = finance_checks(c)["score"] if consistency is None else consistency
        score = size * 0.30 + s * 0.30 + n * 0.20 + checked * 0.10 + conf * 0.10
    return F.struct(F.bround(_unit(score), 3).alias("score"), chars(c).alias("chars"), confidence.alias("confidence"), s.alias("structure_score"), n.alias("numeric_fidelity_score"), table_rows(c).alias("table_rows"))


def blocks(c: Column | str, most: int = 300) -> Column:
    """array<struct<id, text>> of the first non-blank lines: the feature's own limit."""
    return F.transform(F.slice(T.stripped_lines(c), 1, most), lambda x, i: F.struct(i.alias("id"), x.alias("text")))


def table_cells(c: Column | str, most: int = 120) -> Column:
    """array<struct<raw, cells>> of piped or tabbed rows."""
    rows = F.filter(T.stripped_lines(c), lambda x: (_pipes(x) >= 2) | (_tabs(x) >= 3))
    cells = lambda x: F.filter(F.transform(F.split(x, F.when(_pipes(x) >= 2, r"\|").otherwise("\t")), lambda y: F.trim(y)), lambda y: y != "")
    return F.slice(F.transform(rows, lambda x: F.struct(x.alias("raw"), cells(x).alias("cells"))), 1, most)


def markdown_rows(c: Column | str, most: int = 32, piped_only: bool = False) -> Column:
    """array<array<string>>: cells of piped rows (rules left out), tabbed rows and rows parted by double spaces."""
    part = lambda x, by: F.filter(F.transform(F.split(x, by), lambda y: F.trim(y)), lambda y: y != "")
    none = F.array().cast("array<string>")

    def row(x: Column) -> Column:
        piped = part(x, r"\|")
        rule = F.forall(piped, lambda y: y.rlike("^[-:]+$"))
        out = F.when(_pipes(x) >= 2, F.when(rule, none).otherwise(piped))
        if piped_only:
            return out.otherwise(none)
        tabbed, spaced = part(x, "\t"), part(x, "  ")
        return out.when(x.contains("\t") & (F.size(tabbed) >= 2), tabbed).when(F.size(spaced) >= 2, spaced).otherwise(none)

    return F.slice(F.filter(F.transform(T.stripped_lines(c), row), lambda r: F.size(r) > 0), 1, most)


def cell_density(cells: Column) -> Column:
    return _count_if(cells, lambda x: F.trim(x) != "")


def prefer_cell(primary: Column, fallback: Column) -> Column:
    """The better of two readings of one cell."""
    a, b = F.trim(F.coalesce(primary, F.lit(""))), F.trim(F.coalesce(fallback, F.lit("")))
    letters = lambda x: F.lower(F.regexp_replace(x, r"(?U)[^\p{L}\p{N}]", ""))
    better = (
        a.rlike(r"[|`\[\]]")
        | ((F.length(a) <= 2) & (F.length(b) >= 4))
        | ((F.length(b) >= F.length(a) + 4) & F.contains(F.lower(b), F.lower(a)))
        | ((letters(a) != "") & F.startswith(letters(b), letters(a)) & (F.length(letters(b)) > F.length(letters(a))))
        | ((F.length(b) > F.length(a) * 2) & b.rlike(r"\d"))
        | (a.rlike(r"\d") & b.rlike(r"^\d+$") & ~a.rlike(r"^\d+$"))
    )
    return F.when(b == "", a).when(a == "", b).when(better, b).otherwise(a)


def merged_rows(detected: Column, from_text: Column) -> Column:
    """array<array<string>>: two readings of a table, row by row and cell by cell; rows without any text are dropped."""
    width = F.greatest(F.coalesce(F.array_max(F.transform(detected, F.size)), F.lit(0)), F.coalesce(F.array_max(F.transform(from_text, F.size)), F.lit(0)), F.lit(1))
    height = F.greatest(F.size(detected), F.size(from_text), F.lit(1))
    cell = lambda t, i, j: F.get(F.get(t, i), j)
    rows = F.transform(F.sequence(F.lit(0), height - 1), lambda i: F.transform(F.sequence(F.lit(0), width - 1), lambda j: prefer_cell(cell(detected, i, j), cell(from_text, i, j))))
    return F.filter(rows, lambda r: F.exists(r, lambda x: x != ""))


def axis_boxes(low: Column, high: Column, count: Column) -> Column:
    """array<struct<lo, hi>>: a stretch cut into equal parts of length 1 at least, the last ending at `high`."""
    n = F.greatest(count, F.lit(1))
    step = F.greatest(F.lit(1.0), (high - low) / n)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((low + step * i).alias("lo"), F.when(i == n - 1, high).otherwise(low + step * (i + 1)).alias("hi")))


def numeric_tokens(c: Column | str) -> Column:
    clean = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)(?<=\d)[,\s]+(?=\d{3}(?:\D|$))", ""), r"[$,%()]", ""))
    return F.filter(F.transform(F.regexp_extract_all(_raw(c), F.lit(f"(?U){P.NUMERIC_TOKEN}"), F.lit(0)), clean), lambda t: t.rlike(r"\d"))


def numeric_consensus(own: Column, peers: Column) -> Column:
    """The share of own tokens that any peer has; own: tokens, peers: array of token arrays."""
    seen = F.flatten(peers)
    return F.when((F.size(own) > 0) & (F.size(peers) > 0), F.size(F.filter(own, lambda t: F.array_contains(seen, t))) / F.size(own)).otherwise(0.0)


def table_likeness(c: Column | str) -> Column:
    rows = table_rows(c)
    pseudo = _count_if(F.split(_raw(c), _BREAK), lambda x: F.concat(F.lit(" "), F.trim(x), F.lit(" ")).rlike(r"(?iU)\s[|1il]\s+[^|]+?\s[|1il]\s+"))
    cells = F.regexp_count(_raw(c), F.lit(r"(?iU)\s[|1il]\s"))
    return F.when(rows > 0, F.least(F.lit(1.0), rows / 4.0)).when(pseudo > 0, F.least(F.lit(0.75), pseudo / 4.0)).otherwise(F.least(F.lit(0.65), cells / 12.0))


def confusion_penalty(c: Column | str) -> Column:
    raw = F.lower(_raw(c))
    each = lambda mark: (F.length(raw) - F.length(F.replace(raw, F.lit(mark), F.lit("")))) / len(mark)
    return reduce(Column.__add__, [*(each(m) * 4.0 for m in P.CONFUSED_WORDS), *(F.regexp_count(raw, F.lit(p)) * w for p, w in P.CONFUSED_FORMS)])


def finance_tokens(c: Column | str) -> Column:
    return F.least(F.lit(24.0), reduce(Column.__add__, [F.regexp_count(_raw(c), F.lit(p)) * w for p, w in P.CLEAN_FORMS]))


def finance_checks(c: Column | str) -> Column:
    """struct(score, issues, hints): percents that make a whole, a balance sheet that balances, sections and totals."""
    raw, rows = _raw(c), T.stripped_lines(c)
    percents = F.transform(F.slice(F.regexp_extract_all(raw, F.lit(r"(-?\d+(?:\.\d+)?)\s*%"), F.lit(1)), 1, 12), lambda x: x.cast("double"))
    total = F.aggregate(percents, F.lit(0.0), lambda a, x: a + x)
    enough = F.size(percents) >= 3
    has = lambda word: F.contains(F.lower(raw), F.lit(word))
    amount = lambda head: F.nullif(F.replace(F.regexp_extract(raw, rf"(?i){head}\s*[:=]?\s*\$?(-?\d+(?:,\d{{3}})*(?:\.\d+)?)", 1), F.lit(","), F.lit("")), F.lit("")).cast("double")
    a, li, e = amount("assets?"), amount("liabil(?:ity|ities)"), amount("equity")
    stated = a.isNotNull() & li.isNotNull() & e.isNotNull()
    balanced = F.abs(a - (li + e)) <= F.greatest(F.lit(1.0), F.abs(a) * 0.02)
    figures = F.flatten(F.transform(table_cells(c), lambda r: F.flatten(F.transform(r["cells"], lambda x: F.regexp_extract_all(x, F.lit(r"-?\d+(?:,\d{3})*(?:\.\d+)?"), F.lit(0))))))
    seen = F.transform(
        F.filter(F.slice(rows, 1, 400), lambda x: x.rlike(r"(?i)(assets|liabilities|equity|total)\s*[:=]\s*-?\d")),
        lambda x: F.concat(F.lit("value_seen:"), F.lower(F.regexp_extract(x, r"(?i)(assets|liabilities|equity|total)\s*[:=]\s*-?\d", 1))),
    )
    if_ = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    issues = F.concat(if_(enough & (total > 120), "percent_group_exceeds_120"), if_(stated & ~balanced, "balance_sheet_not_balanced"))
    hints = F.concat(
        if_(enough & total.between(95, 105), "percent_group_balanced"), seen, if_(has("assets") & (has("liabil") | has("equity")), "balance_sheet_sections_detected"),
        if_(F.size(figures) >= 3, "table_numeric_values_detected"), if_(stated & balanced, "balance_sheet_balanced"), if_(has("total") & (F.size(figures) > 0), "table_totals_detected"),
    )
    return F.struct(F.bround(F.greatest(F.lit(0.0), 1.0 - F.size(issues) * 0.2), 3).alias("score"), issues.alias("issues"), F.slice(hints, 1, 16).alias("hints"))


def is_receipt(texts: Column) -> Column:
    """Whether two of the receipt markers occur in the joined texts."""
    return marker_hits(F.lower(texts), P.RECEIPT_MARKERS) >= 2


def is_template(c: Column | str) -> Column:
    """Whether a text is generic report boilerplate rather than a reading of the page."""
    return marker_hits(F.lower(F.trim(_raw(c))), P.TEMPLATE_MARKERS) >= 4
