import random

import pytest
from pyspark.sql import functions as F

from paperstream.functions import patterns as P
from paperstream.functions import plain
from paperstream.functions import text as T


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("USD $1,382.40", "1382.4"), ("(1,382.40)", "-1382.4"), ("$5<320.25", "5320.25"), ("$5,320-25", "5320.25"), ("12 345", "12345"), ("usd 5", ""), ("n/a", ""), (None, ""), ("7.5%", "7.5"), ("0.00001", "0"), ("-0", "0")])
def test_numbers(spark, raw, want):
    assert one(spark, T.number_text("v"), raw) == want == plain.number_text(raw)


@pytest.mark.parametrize(("raw", "want"), [("05/15/26", "2026-05-15"), ("July 8, 2011", "2011-07-08"), ("25/12/2024", "2024-12-25"), ("2024-02-31", "2024-02-31"), ("2O24-O1-l5", "2024-01-15"), ("13/13/2024", ""), ("", ""), (None, "")])
def test_dates(spark, raw, want):
    assert one(spark, T.date_text("v"), raw) == want == plain.date_text(raw)


def test_receipt_dates(spark):
    for raw, want in (("O1/O2/2O18", "01/02/2018"), ("os/oz/2018", "05/02/2018"), ("2019-3-7", "07/03/2019"), ("40/01/2018", ""), (None, "")):
        assert one(spark, T.receipt_date("v"), raw) == want
    assert set(one(spark, T.receipt_date_variants("v"), "3/4/2018")) == {"03/04/2018", "03-04-2018", "03.04.2018", "3/4/2018", "03/04/18"}
    assert one(spark, T.receipt_date_variants("v"), "x") == []


def test_columns_and_plain_functions_agree(spark):
    rng = random.Random(3)
    pieces = ["$", "RM", "USD ", "1", "23", ",", ".", "-", "<", "(", ")", "%", "/", " ", "O", "l", "|", "May ", "Sept 4, 2020", "2024", "x", "é", " "]
    values = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.number_text("v").alias("n"), T.date_text("v").alias("d"), T.key("v").alias("k"), T.ocr_key("v").alias("o"), T.number_value("v").alias("x"), T.truth_date("v").alias("t")).collect()
    for r in rows:
        assert (r.n, r.d, r.k, r.o, r.x, r.t) == (plain.number_text(r.v), plain.date_text(r.v), plain.key(r.v), plain.ocr_key(r.v), plain.number_value(r.v), plain.truth_date(r.v)), r.v


def test_consensus_values(spark):
    value = lambda v, f: tuple(spark.createDataFrame([(v, f)], "v string, f string").select(T.consensus_value("v"), T.consensus_key("v", F.col("f")), T.consensus_display("v", F.col("f"))).first())
    assert value("1 1 $1,280.00 1", "subtotal")[1:] == ("11280.00", "$1,280.00") or value("| $1,280.00 |", "subtotal") == ("$1,280.00", "1280.00", "$1,280.00")
    assert value("INV 2048", "invoice_number")[1] == "inv 2048" and value("due 2024/03/01", "due_date")[1:] == ("2024-03-01", "2024-03-01")
    assert value("$10.00 of $20.00", "total")[2] == "$20.00" and value("$10.00 of $20.00", "tax")[2] == "$10.00" and value("12.5%", "margin")[2] == "12.5%"


def test_layout_repair(spark):
    assert one(spark, T.repaired_blocks("v"), "a ## B - c") == "a\n## B\n- c"
    assert one(spark, T.repaired_tables("v"), "| a | b | | c | d | | e | f |").count("\n") == 2
    assert one(spark, T.shortened("v", 8), "abcdef ghij") == "abcde..." and one(spark, T.shortened("v", 80), " a \n b ") == "a b"
    assert one(spark, T.unit_confidence("v"), "87.5") == 0.875 and one(spark, T.unit_confidence("v"), "x") == 0.0 and one(spark, T.milliseconds("v"), "-3") == 0.0
    assert one(spark, T.receipt_key("v"), "Petron Bkt S/B sdn bho") == "PETRON BKT SB SDN BHD" and one(spark, T.safe_name("v"), "a b/c.pdf") == "a-b-c.pdf"


def test_alias_tables():
    assert P.alias_regex("Oil v", "evidence") == "[o0qQ][li1|][li1|]\\s*[vV]" and P.alias_regex("Oil v", "truth").endswith("v") and "\\s+" in P.alias_regex("a b", "consensus") and P.alias_regex("o", "ranker") == "[o0]"
