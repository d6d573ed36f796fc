"""Field candidates: what texts offer for each field of a specification, deduplicated and ranked."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperstream.functions import plain

#: Ranked candidates of one field that the feature keeps.
TOP = 8

# The common fields with their labels and kinds.
COMMON_FIELDS = (
    ("invoice_number", ("invoice number", "invoice"), "text"), ("subtotal", ("subtotal",), "money"), ("tax", ("tax",), "money"),
    ("total", ("total", "amount due", "payment due"), "money"), ("assets", ("assets",), "money"), ("liabilities", ("liabilities",), "money"),
    ("equity", ("equity",), "money"), ("opening_balance", ("opening balance",), "money"), ("deposits", ("deposits",), "money"),
    ("closing_balance", ("closing balance",), "money"), ("cash", ("cash",), "money"), ("market_value", ("market value",), "money"),
    ("gross_pay", ("gross pay",), "money"), ("deductions", ("deductions",), "money"), ("net_pay", ("net pay",), "money"),
    ("agi", ("adjusted gross income",), "money"), ("taxable_income", ("taxable income",), "money"), ("tax_due", ("tax due",), "money"),
    ("account", ("account",), "text"), ("due_date", ("due date", "date"), "date"), ("revenue", ("revenue",), "money"), ("cost", ("cost",), "money"),
    ("margin", ("margin",), "percent"), ("principal", ("principal",), "money"), ("interest_rate", ("interest rate",), "percent"),
)

#: Type of a column of specifications: one struct per field asked of the row's text.
SPEC = "array<struct<name:string,aliases:array<string>,type:string>>"
_ROWS = "field string, kind string, aliases array<string>, value string, normalized_value string, source_line string, line_index int, confidence double, reason string, gen_seq int"


def common_specs() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, a)).alias("aliases"), F.lit(k).alias("type")) for n, a, k in COMMON_FIELDS])


#: Rows and characters of a batch that goes back to the JVM, and texts read at once: a text offers hundreds of rows, each with its line.
ROWS_AT_ONCE, CHARS_AT_ONCE, TEXTS_AT_ONCE = 10_000, 8 << 20, 256


def offered(df: DataFrame, ids: list[str], text: str = "text", specs: str = "specs") -> DataFrame:
    """(ids, field, kind, aliases, value, ..., gen_seq): every candidate in reading order, one Arrow pass, no shuffle.

    specs is a column of SPEC; a spec without aliases uses its name. Null or empty texts and specs give no row.
    """

    return _rows(df, ids, text, specs, _every, "")


def _every(lines: list[str], wanted: list[plain.Spec]) -> Iterator[tuple]:
    found = ((spec, x) for spec in wanted for x in plain.candidates(lines, *spec))
    return ((spec, (n,), x) for n, (spec, x) in enumerate(found))


def _best(df: DataFrame, ids: list[str], text: str, specs: str, top: int) -> DataFrame:
    """The columns of offered, and `rank`: the candidates of each text that `ranked` leaves of it."""

    def best(lines: list[str], wanted: list[plain.Spec]) -> Iterator[tuple]:
        return ((spec, (n, rank), found) for spec, rank, n, found in plain.best_candidates(lines, wanted, top))

    return _rows(df, ids, text, specs, best, ", rank int")


_TYPES = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.int32(), pa.int32()]


def _rows(df: DataFrame, ids: list[str], text: str, specs: str, of: Callable[[list[str], list[plain.Spec]], Iterator[tuple]], more: str) -> DataFrame:
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in ids)
    names = [x.split()[0] for x in (_ROWS + more).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
                yield from _offers(batch.slice(start, TEXTS_AT_ONCE), ids, names, of)

    return df.select(*ids, F.col(text), F.col(specs)).mapInArrow(run, f"{kinds}, {_ROWS}{more}")


def _offers(batch: pa.RecordBatch, ids: list[str], names: list[str], of: Callable[[list[str], list[plain.Spec]], Iterator[tuple]]) -> Iterator[pa.RecordBatch]:
    """The rows of a batch (ids, text, specs), handed on in batches of bounded size."""
    at: list[int] = []
    rows: list[tuple] = []
    chars = 0

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        kept = [batch.column(j).take(pa.array(at, pa.int64())) for j in range(len(ids))]
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=False))], names=[*ids, *names])

    for i, (value, asked) in enumerate(zip(batch.column(len(ids)).to_pylist(), batch.column(len(ids) + 1).to_pylist(), strict=True)):
        if not value or not asked:
            continue
        wanted = [(x["name"] or "", tuple(a for a in x["aliases"] or [] if a) or (x["name"] or "",), (x["type"] or "text").lower().strip()) for x in asked]
        for (name, aliases, kind), number, found in of(plain.read_lines(value), wanted):
            at.append(i)
            rows.append((name, kind, aliases, *found, *number))
            chars += len(found[0]) + len(found[1]) + len(found[2])
            if len(rows) >= ROWS_AT_ONCE or chars >= CHARS_AT_ONCE:
                yield out()
                at, rows, chars = [], [], 0
    yield out()


def ranked(rows: DataFrame, keys: list[str], top: int = TOP, *, field: str = "field", value: str = "value", norm: str = "normalized_value", confidence: str = "confidence", line: str = "line_index", seq: str = "gen_seq") -> DataFrame:
    """The rows that stay, with `rank` from 1: of equal normalised values the surest (first offered on ties), then the `top` surest by line and value.

    A null normalised value is a value of its own; null and NaN confidences rank last. Equal values are reduced by an
    aggregate and the rest by a limited window, both of which start before their shuffle: of a group of any size only
    distinct values, and then `top` rows a task, are sent on. Rows must not hold maps.
    """
    sure = F.coalesce(F.when(F.isnan(confidence), None).otherwise(-F.col(confidence).cast("double")), F.lit(float("inf")))
    by = [*keys, field, norm]
    rest = [c for c in rows.columns if c not in by]
    first = F.struct(sure.alias("_sure"), F.coalesce(F.col(seq).cast("long"), F.lit(2**62)).alias("_seq"), *rest)
    once = rows.groupBy(*by).agg(F.min(first).alias("_x")).select(*by, F.col("_x._sure").alias("_sure"), *[F.col(f"_x.{c}").alias(c) for c in rest])
    best = Window.partitionBy(*keys, field).orderBy("_sure", F.col(line).asc_nulls_last(), F.col(value).asc_nulls_last(), F.col(seq).asc_nulls_last())
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(*rows.columns, "rank")


def field_candidates(df: DataFrame, ids: list[str], text: str = "text", specs: str = "specs", top: int = TOP) -> DataFrame:
    """offered and ranked: the table of field candidates.

    Where one text has the ids, alone or in repeated rows, its candidates are ranked where they are found and only the
    `top` of a field leave the task. Those of different texts with the same ids are ranked together.
    """
    said = F.xxhash64(text, specs)
    texts = df.groupBy(*ids).agg(F.min(said).alias("_least"), F.max(said).alias("_most"), F.first(text).alias(text), F.first(specs).alias(specs))
    own = _best(texts.where("_least = _most"), ids, text, specs, top)
    several = texts.where("_least <> _most").select(*[F.col(c).alias(f"_{c}") for c in ids])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ids])
    shared = ranked(offered(df.join(several, same, "left_semi"), ids, text, specs), ids, top)
    return own.unionByName(shared).withColumn("confidence", F.round("confidence", 3))
