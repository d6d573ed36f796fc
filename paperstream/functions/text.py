"""Normalisers as Column expressions: white space, keys, numbers, dates, identifiers, receipts and consensus values."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperstream.functions import patterns as P

_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def _col(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def squeeze(c: Column | str) -> Column:
    """White-space runs become one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def key(c: Column | str) -> Column:
    """Lower-case letters and digits of ASCII in words."""
    return F.trim(F.regexp_replace(F.lower(squeeze(c)), "[^a-z0-9]+", " "))


def ocr_key(c: Column | str) -> Column:
    """Key without spaces in which 0, q and o, 1, | and l are equal."""
    return F.regexp_replace(F.translate(F.lower(squeeze(c)), "0q1|", "ooll"), "[^a-z0-9]+", "")


def digits(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\D+", "")


def identifier_letters(c: Column | str) -> Column:
    return F.regexp_replace(F.translate(F.lower(_col(c)), "0q1|l", "ooiii"), "[^a-z]+", "")


def confusable(c: Column | str) -> Column:
    return F.translate(F.lower(_col(c)), "105", "los")


def lines(c: Column | str) -> Column:
    """Non-empty lines, white space squeezed, in order."""
    return F.filter(F.transform(F.split(_col(c), _LINE_BREAK), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))), lambda x: x != "")


def raw_lines(c: Column | str) -> Column:
    """The lines of a text as they are, blank ones included."""
    return F.split(_col(c), _LINE_BREAK)


def stripped_lines(c: Column | str) -> Column:
    """Non-blank lines with the white space at their ends cut off."""
    return F.filter(F.transform(F.split(_col(c), _LINE_BREAK), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


def _thousands(c: Column) -> Column:
    """OCR's '<' between thousands and '-' before cents repaired."""
    return F.regexp_replace(F.regexp_replace(c, r"(?<=\d)<(?=\d{3}(?:\D|$))", ","), r"(?<=\d)-(?=\d{2}(?:\D|$))", ".")


def number_text(c: Column | str) -> Column:
    """Canonical decimal text of the first amount; empty if there is none. Parentheses negate; percent signs are dropped."""

    def read(token: Column) -> Column:
        bare = F.regexp_replace(_thousands(token), r"\$|USD|RM|MYR|[, ()%]", "")
        value = F.when(bare.rlike(r"(?U)^\s*-?\d+(\.\d+)?\s*$"), F.regexp_replace(bare, r"(?U)\s+", "")).otherwise(None).cast("double")
        return F.when(token.startswith("(") & token.endswith(")"), -value).otherwise(value)

    def write(value: Column) -> Column:
        whole = F.abs(value - F.rint(value)) < 0.000001
        return F.when(whole, F.rint(value).cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(F.format_string("%.4f", value), r"\.?0+$", ""))

    value = let(F.regexp_extract(F.trim(_col(c)), f"(?iU){P.MONEY}", 0), read)
    return F.coalesce(let(value, lambda v: F.when(v.isNotNull(), write(v))), F.lit(""))


def number_value(c: Column | str) -> Column:
    """The first number as a double, leniently read; null if there is none."""
    raw = _thousands(F.replace(F.trim(_col(c)), F.lit(";"), F.lit(",")))
    token = F.regexp_extract(raw, f"(?U){P.LOOSE_NUMBER}", 0)
    negative = token.startswith("(") & token.endswith(")")
    bare = _thousands(F.regexp_replace(token, r"(?U)\s+[1ilI|](?:\s+[1ilI|])*$", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?U)(?<=\d)[,\s]+(?=\d{3}(?:\D|$))", ""), r"[$,%() ]", "")
    value = F.when(bare.rlike(r"^-?\d+(\.\d+)?$"), bare).otherwise(None).cast("double")
    return F.when(negative, -value).otherwise(value)


def _iso(year: Column, month: Column, day: Column) -> Column:
    good = year.between(1900, 2099) & month.between(1, 12) & day.between(1, 31)
    return F.when(good, F.format_string("%04d-%02d-%02d", year, month, day))


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found).otherwise(None).cast("int")


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The groups of a pattern as whole numbers, null where it isn't found; the pattern runs once."""
    whole = let(F.regexp_extract(text, pattern, 0), lambda found: F.when(found != "", F.array(*[F.regexp_extract(found, pattern, i) for i in range(1, n + 1)])))
    return F.transform(whole, lambda x: x.try_cast("int"))


def _month_date(text: Column) -> Column:
    pattern = f"(?iU){P.MONTH_DATE}"
    month = F.create_map(*[F.lit(x) for i, m in enumerate(P.MONTH_NAMES) for x in (m[:3], i + 1)])
    found = F.regexp_extract(text, pattern, 0)
    name = lambda x: F.lower(F.substring(x, 1, 3))
    return let(found, lambda x: F.when(x != "", _iso(_part(x, pattern, 3), F.try_element_at(month, name(x)), _part(x, pattern, 2))))


def _us_date(clean: Column) -> Column:
    def read(g: Column) -> Column:
        a, b, y = F.get(g, 0), F.get(g, 1), F.get(g, 2)
        year = F.when(y < 100, y + 2000).otherwise(y)
        return F.when(a.between(1, 12) & b.between(1, 31), _iso(year, a, b)).otherwise(_iso(year, b, a))

    return let(_groups(clean, r"(?U)\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})\b", 3), read)


def date_text(c: Column | str) -> Column:
    """YYYY-MM-DD of the first date: month names, then ISO, then month/day/year (day/month/year where only that is possible). Ranges are checked, the calendar isn't: February 31 passes."""
    raw = F.trim(_col(c))
    clean = F.translate(raw, "OoIl|", "00111")
    iso = let(_groups(clean, r"(?U)\b((?:19|20)\d{2})[-/.](\d{1,2})[-/.](\d{1,2})\b", 3), lambda g: _iso(F.get(g, 0), F.get(g, 1), F.get(g, 2)))
    return F.coalesce(_month_date(raw), iso, _month_date(clean), _us_date(clean), F.lit(""))


def truth_date(c: Column | str) -> Column:
    """date_text, or else the squashed lower-case text."""
    rest = F.regexp_replace(F.translate(F.lower(squeeze(c)), "/.", "--"), "[^0-9a-z-]+", "")
    return let(date_text(c), lambda d: F.when(d != "", d).otherwise(rest))


def by_kind(c: Column | str, kind: Column) -> Column:
    k = F.lower(F.trim(F.coalesce(kind, F.lit("text"))))
    return F.when(k.isin(*P.NUMERIC_KINDS), number_text(c)).when(k == "date", date_text(c)).otherwise(key(c))


def label_pattern(alias: Column, table: str) -> Column:
    """patterns.bounded_alias of a Column of labels."""
    space, letters = P.ALIAS_TABLES[table]
    known = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    plain = lambda ch: F.when(ch.rlike(r"^[A-Za-z0-9_]$|^[^\x00-\x7f]$"), ch).otherwise(F.concat(F.lit("\\"), ch))
    one = lambda ch: F.when(ch.rlike(r"^(?U)\s$"), F.lit(space)).otherwise(F.coalesce(F.try_element_at(known, F.lower(ch)), plain(ch)))
    return F.concat(F.lit("(?<![A-Za-z0-9])"), F.array_join(F.transform(F.filter(F.split(alias, ""), lambda ch: ch != ""), one), ""), F.lit("(?![A-Za-z0-9])"))


def receipt_key(c: Column | str) -> Column:
    """Upper-case key with the spellings of a private limited company made one."""
    s = F.replace(F.upper(_col(c)), F.lit("$B"), F.lit(" SB "))
    for pattern, to in P.RECEIPT_SPELLINGS:
        s = F.regexp_replace(s, pattern, to)
    return F.trim(s)


def receipt_date(c: Column | str) -> Column:
    """DD/MM/YYYY, day first, misread digits repaired; empty unless in 2010..2035. Years after 2035 keep their last digit only."""
    clean = F.translate(F.trim(_col(c)), *P.RECEIPT_DATE_READ)
    year_first = F.transform(F.array(F.lit(2), F.lit(1), F.lit(0)), lambda i: F.get(_groups(clean, P.RECEIPT_YEAR_FIRST, 3), i))
    day_first = let(_groups(clean, P.RECEIPT_DAY_FIRST, 3), lambda g: F.array(F.get(g, 0), F.get(g, 1), F.when(F.get(g, 2) < 100, F.get(g, 2) + 2000).otherwise(F.get(g, 2))))

    def write(g: Column) -> Column:
        day, month, y = F.get(g, 0), F.get(g, 1), F.get(g, 2)
        year = F.when((y > 2035) & (y <= 2099), 2010 + y % 10).otherwise(y)
        return F.when(day.between(1, 31) & month.between(1, 12) & year.between(2010, 2035), F.format_string("%02d/%02d/%04d", day, month, year))

    return F.coalesce(let(F.when(clean.rlike(P.RECEIPT_DAY_FIRST), day_first).otherwise(year_first), write), F.lit(""))


def receipt_date_variants(c: Column | str) -> Column:
    """The five printed forms of a receipt's date; empty array without one."""

    def forms(d: Column) -> Column:
        day, month, year = F.get(d, 0), F.get(d, 1), F.get(d, 2)
        plain = F.concat_ws("/", day.try_cast("int").cast("string"), month.try_cast("int").cast("string"), year)
        all_ = F.array(F.concat_ws("/", d), F.concat_ws("-", d), F.concat_ws(".", d), plain, F.concat_ws("/", day, month, F.substring(year, 3, 2)))
        return F.when(F.size(d) == 3, F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))

    return let(F.split(receipt_date(c), "/"), forms)


def receipt_line(c: Column | str) -> Column:
    return squeeze(F.translate(_col(c), "\t|\\_", "    "))


def receipt_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.upper(_col(c)), F.lit(r"[A-Z0-9$./&'-]+"), F.lit(0))


def cents(c: Column | str) -> Column:
    """The first number with two decimals, thousands' commas dropped; empty without one."""
    found = F.regexp_extract(F.replace(_col(c), F.lit(","), F.lit("")), r"\d+(?:\.\d+)?", 0)
    return F.when(found != "", F.format_string("%.2f", F.when(found != "", found).otherwise(None).cast("double"))).otherwise("")


def consensus_value(c: Column | str) -> Column:
    """A value without the marks and strokes OCR leaves around it."""
    s = F.regexp_replace(squeeze(c), r"^(?:[:=\-|{}\[\]()]+|[1ilI|])\s+", "")
    s = F.regexp_replace(s, r"\s+(?:[1ilI|]|[:=\-|{}\[\]()]+)(?:\s+(?:[1ilI|]|[:=\-|{}\[\]()]+))*$", "")
    return F.btrim(F.regexp_replace(s, r"(?<=\d)[,\s]+(?=\d{3}(?:\D|$))", ","), F.lit(" :|={}[]()"))


def consensus_key(c: Column | str, field: Column) -> Column:
    """What makes two values of a field the same: identifiers by text, else an ISO-like date, else a number, else text."""
    raw = F.replace(consensus_value(c), F.lit(";"), F.lit(","))
    text = F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " "))
    date = F.regexp_extract(raw, r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", 0)
    number = F.regexp_extract(raw, r"\(?-?\$?\d(?:[\d,\s]*\d)?(?:\.\d+)?%?\)?", 0)
    bare = F.regexp_replace(F.regexp_replace(number, r"(?<=\d)[,\s]+(?=\d{3}(?:\D|$))", ""), r"[$,%() ]", "")
    named = F.lower(F.trim(F.coalesce(field, F.lit("")))).isin("invoice_number", "account")
    return F.when(named, text).when(date != "", F.replace(date, F.lit("/"), F.lit("-"))).when(number != "", bare).otherwise(text)


def consensus_display(c: Column | str, field: Column) -> Column:
    raw = F.replace(consensus_value(c), F.lit(";"), F.lit(","))
    all_of = lambda pattern: F.regexp_extract_all(raw, F.lit(pattern), F.lit(0))
    money, percent, date = all_of(r"\$\d{1,3}(?:[,\s]\d{3})*(?:\.\d+)?"), all_of(r"\b\d+(?:\.\d+)?%"), all_of(r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b")
    last = field.isin("market_value", "total", "tax_due", "amount_due", "payment_due")
    picked = F.when(last, F.try_element_at(money, F.lit(-1))).otherwise(F.get(money, 0))
    return (
        F.when((F.size(date) > 0) & (field == "due_date"), F.replace(F.get(date, 0), F.lit("/"), F.lit("-")))
        .when((F.size(percent) > 0) & field.isin("margin", "interest_rate"), F.get(percent, 0))
        .when(F.size(money) > 0, F.regexp_replace(picked, r"(?<=\d)[,\s]+(?=\d{3}(?:\D|$))", ","))
        .otherwise(raw)
    )


def shortened(c: Column | str, limit: int) -> Column:
    """Squeezed text of at most `limit` characters, the last three of a longer one dots."""
    s = squeeze(c)
    return F.when(F.length(s) > limit, F.concat(F.rtrim(F.substring(s, 1, max(0, limit - 3))), F.lit("..."))).otherwise(s)


def repaired_tables(c: Column | str) -> Column:
    """Rows of a table that lie on one line put on lines of their own."""
    fix = lambda x: F.when((F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 8) & x.contains(" | | "), F.regexp_replace(x, r"\|\s+\|(?=\s*(?:---|[:\-]|[A-Za-z0-9$%#(]))", "|\n|")).otherwise(x)
    return F.array_join(F.transform(F.split(_col(c), _LINE_BREAK), lambda x: fix(F.trim(x))), "\n")


def repaired_blocks(c: Column | str) -> Column:
    """Headings, bullets and fences that lie within a line put on lines of their own."""
    s = _col(c)
    for pattern, to in ((r"```\s+```", "```\n\n```"), (r"(?<!\n)(#{2,6}\s)", "\n$1"), (r"\s+(#{2,6}\s)", "\n$1"), (r"\s+-\s+\*\*", "\n- **"), (r"\s+-\s+", "\n- "), (r"```\s*(#{2,6}\s)", "```\n$1")):
        s = F.regexp_replace(s, pattern, to)
    return s


def unit_confidence(c: Column | str) -> Column:
    """A confidence in 0..1, four decimals; values above 1 are percents, unreadable ones 0."""
    v = F.coalesce(_col(c).try_cast("double"), F.lit(0.0))
    v = F.when(v > 1, v / 100).otherwise(v)
    return F.round(F.greatest(F.lit(0.0), F.least(v, F.lit(1.0))), 4)


def milliseconds(c: Column | str) -> Column:
    return F.round(F.greatest(F.coalesce(_col(c).try_cast("double"), F.lit(0.0)), F.lit(0.0)), 2)


def safe_name(c: Column | str) -> Column:
    """A text as a file name: everything but letters, digits, dot, underscore and hyphen becomes one hyphen."""
    return F.btrim(F.regexp_replace(_col(c), r"[^A-Za-z0-9._-]+", "-"), F.lit("-"))


def attempt_text(markdown: Column | str = "markdown", text: Column | str = "text") -> Column:
    """An attempt's text: its markdown, else its plain text, else empty."""
    return F.coalesce(F.nullif(_col(markdown), F.lit("")), _col(text))


#: Talk of a model about itself rather than of the page.
CHATTER = ("please note", "to perform ocr", "i can only provide guidance", "without the actual document image", "since you haven't attached")


def markdown_layout(c: Column | str, limit: int = 4000) -> Column:
    """A model's markdown set right: line ends, chatter cut off (fenced blocks kept instead, if there are any), rows and blocks on lines of their own, one blank line at most, `limit` characters with dots at the end: the feature's own limit."""
    raw = F.replace(F.replace(_col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    low = F.lower(raw)
    fenced = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"(?is)```(?:markdown)?\s*(.*?)```"), F.lit(1)), lambda b: F.btrim(b, F.lit(" \n\t"))), lambda b: b != "")
    talks = reduce(Column.__or__, [F.contains(low, F.lit(m)) for m in CHATTER])
    at = reduce(lambda acc, m: acc.when(F.instr(low, m) > 1, F.instr(low, m)), CHATTER[1:], F.when(F.instr(low, CHATTER[0]) > 1, F.instr(low, CHATTER[0])))
    kept = F.when(talks & (F.size(fenced) > 0), F.array_join(fenced, "\n\n")).when(at.isNotNull(), F.rtrim(F.substring(raw, F.lit(1), at - 1))).otherwise(raw)
    flat = repaired_blocks(repaired_tables(F.regexp_replace(kept, r"[ \t]+(?=\n|$)", "")))
    out = F.btrim(F.regexp_replace(flat, r"\n{3,}", "\n\n"), F.lit(" \n\t"))
    return let(out, lambda x: F.when(F.length(x) > limit, F.concat(F.rtrim(F.substring(x, 1, limit - 3)), F.lit("..."))).otherwise(x))


def anchor_terms(stem: Column | str, stop: tuple[str, ...] = ()) -> Column:
    """Words of three letters or more of a file's name."""
    words = F.filter(F.split(F.lower(_col(stem)), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    return F.array_except(words, F.array(*map(F.lit, stop)).cast("array<string>")) if stop else words


def anchor_hits(text: Column | str, terms: Column) -> Column:
    low = F.lower(_col(text))
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))
