"""Business documents with known truth, rendered from order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def amount(c: Column) -> Column:
    return F.format_number(c, 2)


def order_documents(orders: DataFrame) -> DataFrame:
    """(o_orderkey, o_orderpriority, o_totalprice, text): an invoice header per order."""
    text = F.concat(F.lit("Invoice: INV "), F.col("o_orderkey").cast("string"), F.lit("\nDate: "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\nTotal: $"), amount(F.col("o_totalprice")))
    return orders.select("o_orderkey", "o_orderpriority", "o_totalprice", text.alias("text"))


def misread(text: Column, key: Column) -> Column:
    """Deterministic OCR noise by key: letters for digits in a third of the documents, lost cents in a seventh."""
    noisy = F.when(key % 3 == 0, F.translate(text, "01", "Ol")).otherwise(text)
    return F.when(key % 7 == 0, F.regexp_replace(noisy, r"\.[0-9Ol]{2}$", "")).otherwise(noisy)
