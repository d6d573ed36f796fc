from pyspark.sql import functions as F

from paperstream.functions import quality as Q


def one(spark, expr, value="", **more):
    names = ["v", *more]
    return spark.createDataFrame([(value, *more.values())], ", ".join(f"{n} {'string' if isinstance(x, str) or x is None else 'double'}" for n, x in zip(names, (value, *more.values()), strict=True))).select(expr.alias("x")).first().x


TABLE = "Heading:\n| a | b |\n|---|---|\n| 1 | 2 |\nx\ty\tz\n\n- item"


def test_counts(spark):
    assert one(spark, Q.table_rows("v"), TABLE) == 4 and one(spark, Q.chars("v"), "  ab \n") == 2 and one(spark, Q.digit_count("v"), "a1b22") == 3
    assert [b.text for b in one(spark, Q.blocks("v"), TABLE)][:2] == ["Heading:", "| a | b |"]
    assert one(spark, Q.table_cells("v"), TABLE)[0].cells == ["a", "b"] and one(spark, Q.markdown_rows("v"), TABLE) == [["a", "b"], ["1", "2"], ["x", "y", "z"]]
    assert one(spark, Q.table_rows("v"), None) == 0 and one(spark, Q.structure("v"), None) == 0.0


def test_measures_by_hand(spark):
    text = "Margin 12%\nRisk 5"
    density, marks = min(1, 3 / len(text) * 15), 3 / 6
    assert one(spark, Q.numeric_fidelity("v"), text) == round(0.6 * density + 0.4 * marks, 3)
    assert one(spark, Q.numeric_fidelity("v", "tool"), text) == round(0.4 * density + 0.6 * marks, 3)
    assert one(spark, Q.structure("v"), TABLE) == round(0.35 * 6 / 80 + 0.35 * 2 / 12 + 0.30 * 4 / 8, 3)
    q = one(spark, Q.quality("v", F.lit(None).cast("double")), text)
    assert q.chars == len(text) and q.confidence is None and abs(q.score - (0.35 * len(text) / 1600 + 0.35 * q.structure_score + 0.2 * q.numeric_fidelity_score + 0.1 * 0.65)) < 0.001


def test_cells_and_boxes(spark):
    c = lambda a, b: one(spark, Q.prefer_cell(F.col("v"), F.col("w")), a, w=b)
    assert [c("ab", ""), c("", "x"), c("a|", "ab"), c("ab", "abcdef"), c("Total 5", "5"), c("same", "other")] == ["ab", "x", "ab", "abcdef", "5", "same"]
    rows = spark.sql("SELECT array(array('a','')) AS p, array(array('','b','c'), array('','','')) AS q").select(Q.merged_rows(F.col("p"), F.col("q")).alias("x")).first().x
    assert rows == [["a", "b", "c"]]
    assert [(b.lo, b.hi) for b in spark.range(1).select(Q.axis_boxes(F.lit(0.0), F.lit(10.0), F.lit(3)).alias("x")).first().x] == [(0.0, 10 / 3), (10 / 3, 20 / 3), (20 / 3, 10.0)]


def test_finance(spark):
    good = one(spark, Q.finance_checks("v"), "Assets: $100\nLiabilities: $60\nEquity: $40\n50% 30% 20%")
    assert good.score == 1.0 and {"balance_sheet_balanced", "percent_group_balanced", "balance_sheet_sections_detected"} <= set(good.hints)
    bad = one(spark, Q.finance_checks("v"), "Assets: $900\nLiabilities: $60\nEquity: $40\n90% 80% 70%")
    assert bad.issues == ["percent_group_exceeds_120", "balance_sheet_not_balanced"] and bad.score == 0.6
    assert one(spark, Q.numeric_tokens("v"), "$1,280.00 and (5) of 7%") == ["1280.00", "5", "7"]
    assert one(spark, Q.confusion_penalty("v"), "Tota1: $1.49") == 4.75 and one(spark, Q.finance_tokens("v"), "$1.00 2024-01-01 5% ") == 13.0
    assert one(spark, Q.is_receipt(F.col("v")), "RECEIPT no gst") and not one(spark, Q.is_template("v"), "net profit")
    assert one(spark, Q.table_likeness("v"), "a | b | c") == 0.25


def test_merged_tables_use_all_attempts_and_rows(spark, tmp_path):
    from paperstream.plans.queries import merged_tables

    table = lambda rows: "\n".join(f"| {a} | {b} |" for a, b in rows)
    rows = [("1", 0, table([("a", "b")])), ("1", 1, None), ("1", 2, table([("a", "b"), ("c", "d")])), ("1", 3, table([("a", "b"), ("c", "defgh")])), ("2", 1, table([(f"k{i}", f"v{i}") for i in range(50)])), ("3", 0, "none")]
    spark.createDataFrame(rows + rows[:1], "doc_id string, cand_seq int, markdown string").write.parquet(f"{tmp_path}/candidates.parquet")
    got = {(r.doc_id, r.row_no): r.cells for r in merged_tables(spark, str(tmp_path)).collect()}
    assert len(got) == 52 and got["1", 0] == ["a", "b"] and got["1", 1] == ["c", "defgh"] and got["2", 49] == ["k49", "v49"]
