from pyspark.sql import functions as F

from paperstream.functions import plain
from paperstream.operators import consensus, fields, ranker, truth

CASES = "id string, label string, category string, required_tokens array<string>, expected_table_rows int, expected_fields array<struct<name:string,aliases:array<string>,expected:string,type:string,tolerance:double>>, sample_text string, extra string"
INVOICE = "Invoice: INV 2048\nDate: 03/04/2024\nSubtotal: $1,280.00\nTax: $102.40\nTotal: $1,382.40"


def cases(spark):
    f = lambda n, e, k, *a: (n, list(a) or None, e, k, None)
    rows = [
        ("a", "A", "c", ["Invoice", "T0tal"], None, [f("total", "1382.40", "money", "Total"), f("invoice_number", "INV 2048", "text", "Invoice"), f("date", "2024-03-04", "date", "Date")], INVOICE, "x"),
        ("b", None, None, ["Absent", " "], 4, [f("total", "1396.00", "money", "Total"), f("tax", "7", "money", "Levy")], INVOICE, "x"),
        ("c", "C", "c", None, 2, None, None, "x"),
    ]
    return spark.createDataFrame(rows, CASES)


def test_case_scores(spark):
    got = {r.id: r for r in truth.case_scores(cases(spark).withColumn("text", F.col("sample_text")), ["id"]).collect()}
    assert (got["a"].score, got["a"].field_hits, got["a"].token_score) == (100, 3, 100)
    # 0.75 for a total 1 % off, none for the wrong tax; three label-amount rows of four
    assert got["b"].field_score == 38 and got["b"].missing_tokens == ["Absent"] and got["b"].table_score == 75 and got["b"].failure_buckets == ["numeric_candidate_wrong", "numeric_candidate_wrong"]
    assert (got["c"].field_score, got["c"].token_score, got["c"].table_score) == (100, 100, 0)
    assert truth.case_scores(cases(spark).where("false").withColumn("text", F.col("sample_text")), ["id"]).count() == 0


def test_matching():
    assert [plain.partial(x, "100", 0) for x in ("100", "100.05", "101", "103", "110", "x")] == [1.0, 1.0, 0.75, 0.40, 0.0, 0.0]
    assert plain.matches("INV-2O48", "INV 2048", "text", 0) and plain.matches("total 5.00 1 1", "5", "money", 0) and not plain.matches("INV 99", "INV 2048", "text", 0)
    assert plain.matches("1/2/2024", "2024-01-02", "date", 0) and truth.bucket(False, [], "5", "money") == "field_not_found" and truth.bucket(False, ["5"], "5.00", "money") == "candidate_found_but_not_selected"


def test_readiness_and_totals(spark):
    row = spark.range(1).select(truth.readiness(F.lit(98), F.lit(120), F.lit(0)).alias("a"), truth.readiness(F.lit(98), F.lit(120), F.lit(1)).alias("b"), truth.readiness(F.lit(85), F.lit(5), F.lit(1)).alias("c"), truth.readiness(F.lit(10), F.lit(5), F.lit(1)).alias("d")).first()
    assert tuple(row) == ("paper_strong", "technical_report_ready", "engineering_progress", "not_ready")
    acc = {r.field: r.accuracy for r in truth.field_accuracy(truth.field_scores(cases(spark).withColumn("text", F.col("sample_text")), ["id"])).collect()}
    assert acc["total"] == 50.0 and acc["tax"] == 0.0


def test_expansion_scores_itself(spark):
    out = truth.expanded(cases(spark).where("id = 'a'"), [("baseline", "Base"), ("noisy", "Noisy")])
    assert [r.id for r in out.orderBy("ordinal").collect()] == ["a_baseline", "a_noisy"]
    assert {r.score for r in truth.case_scores(out.withColumn("text", F.col("sample_text")), ["id"]).collect()} == {100}


def test_candidates_rank_and_rules(spark):
    df = spark.createDataFrame([(1, INVOICE), (2, None), (3, ""), (4, "x" * 50000)], "doc_id long, text string").withColumn("specs", fields.common_specs())
    rows = fields.field_candidates(df, ["doc_id"]).collect()
    best = {r.field: r.normalized_value for r in rows if r["rank"] == 1}
    assert best["total"] == "1382.4" and best["subtotal"] == "1280" and best["invoice_number"] == "inv 2048" and best["due_date"] == "2024-03-04"
    assert {r.doc_id for r in rows} == {1} and max(r["rank"] for r in rows) <= 8


def test_ranking_keeps_the_first_of_equal_values(spark):
    rows = [("d", "f", "v1", "n", 3, 0.5, 0), ("d", "f", "v2", "n", 1, 0.5, 1), ("d", "f", "v3", None, 1, 0.9, 2), ("d", "f", "v4", "m", None, float("nan"), 3), ("d", "f", "v5", "m", 2, None, 4)]
    df = spark.createDataFrame(rows, "doc_id string, field string, value string, normalized_value string, line_index int, confidence double, gen_seq int")
    assert [r.gen_seq for r in fields.ranked(df, ["doc_id"]).orderBy("rank").collect()] == [2, 0, 3]


def test_candidates_of_a_text_are_ranked_where_they_are_found(spark):
    """The same rows as ranking all that is offered, for texts of one id, repeated rows, ids of several texts and null ids."""
    busy = "\n".join(f"Total: ${i % 7}.{i % 90:02d} tax {i} Total {i}.00 Subtotal ${i}.50 due 2024-01-{i % 28 + 1:02d} amount due {i}%" for i in range(60))
    rows = [(1, INVOICE), (1, INVOICE), (2, busy), (3, INVOICE), (3, busy), (None, busy), (None, "Total: $5.00"), (4, "Total $5 $5.00 $5,0 5.00\n" * 9), (5, None), (6, "Account: A-1\nAccount A-1\naccount balance"), (7, "$1 | " * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("specs", fields.common_specs())
    got = fields.field_candidates(df, ["doc_id"])
    want = fields.ranked(fields.offered(df, ["doc_id"]), ["doc_id"]).withColumn("confidence", F.round("confidence", 3))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.collect()))


def test_what_texts_offer_is_handed_on_in_batches_of_bounded_size():
    """Texts offer some hundred rows each, all with their line; a task must not hold those of a whole Arrow batch."""
    import pyarrow as pa

    specs = [{"name": n, "aliases": list(a), "type": k} for n, a, k in fields.COMMON_FIELDS]
    many, long = "\n".join(f"Total: ${i}.00 tax {i}" for i in range(300)), "$1.00 x " * 3000
    for texts in ([many] * 20, [long]):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([specs] * len(texts))], names=["doc_id", "text", "specs"])
        out = list(fields._offers(batch, ["doc_id"], [x.split()[0] for x in fields._ROWS.split(", ")], fields._every))
        assert sum(b.num_rows for b in out) > 40_000 and max(b.num_rows for b in out) <= fields.ROWS_AT_ONCE and max(b.nbytes for b in out) < 4 * fields.CHARS_AT_ONCE


ATTEMPTS = "doc_id string, cand_seq int, ok boolean, engine string, preprocess string, markdown string, text string, confidence double, latency_ms double, selection_score double, quality struct<score:double,numeric_fidelity_score:double,structure_score:double>"


def attempts(spark, *texts, engines=("tesseract", "rapidocr", "tesseract")):
    rows = [("d", i, True, engines[i % 3], "p", t, t, 0.8, 5.0, 90.0 - i, (0.5, 0.5, 0.5)) for i, t in enumerate(texts)]
    rows += [("d", 99, False, "x", "p", None, None, None, None, None, None), rows[0]]
    return spark.createDataFrame(rows, ATTEMPTS)


def test_consensus(spark):
    a = attempts(spark, "Invoice: INV 2048 Subtotal: $1,280.00 Tax: $102.40 Total: $1,382.40", "Invoice: INV 2048 Subtotal: $1,280.00 Tax: $102.40 Tota1: $1,382.40", "Invoice: INV 2648 Subtotal: $1,280.20 Tax: $102.40 Total: $1,382.49")
    got = {r.field: r for r in consensus.field_consensus(a).collect()}
    assert got["invoice_number"].normalized_value == "inv 2048" and got["subtotal"].normalized_value == "1280.00" and got["total"].normalized_value == "1382.40"
    assert got["total"].confidence > 0.5 and got["total"].evidence_reasons and got["tax"].support == 3
    text = consensus.with_appendix(spark.createDataFrame([("d", "Body"), ("e", None)], "doc_id string, markdown string"), consensus.field_consensus(a))
    out = {r.doc_id: r.markdown for r in text.collect()}
    assert "Field consensus:" in out["d"] and "Subtotal: $1,280.00" in out["d"] and out["e"] == ""
    again = consensus.with_appendix(text, consensus.field_consensus(a)).where("doc_id = 'd'").first().markdown
    assert again == out["d"]


def test_dense_lines(spark):
    a = attempts(spark, "Tax summary Adjusted Gross Income: $84,500 Taxable Income: $70,200 Tax Due: $9,180", "Taxsummary AdjustedGross Income:$84,500 TaxableIncome:$70,200 TaxDue:$9,180")
    got = {r.field: r for r in consensus.field_consensus(a).collect()}
    assert (got["agi"].normalized_value, got["taxable_income"].normalized_value, got["tax_due"].normalized_value) == ("84500", "70200", "9180")


def test_receipts(spark):
    a = attempts(spark, "PETRON BKT LANJAN $B ALSERKAM ENTERPRISE\nTAX INVOICE\nDate: O1/O2/2O18\nTotal RM inc GST: 4.90", "PETRON BKT LANJAN SB\nDATE : 01/02/2018\nTOTAL 4.90")
    got = {r.field: r for r in consensus.receipt_fields(a).collect()}
    assert got["company"].value == "PETRON BKT LANJAN SB" and got["date"].value == "01/02/2018" and got["total"].value == "4.90" and got["date"].support == 2
    b = attempts(spark, "PERNIAGAAN ZHENG HUI\nNO.S9 JALAN PERMAS 916\nBANDAR BARU PERMAS JAYA\n81750 JOHOR BAHRU\nTEL: 07-386 7524")
    assert "81750 JOHOR BAHRU" in {r.field: r.value for r in consensus.receipt_fields(b).collect()}["address"]
    r = spark.createDataFrame([("a", ("PETRON SB", "01/02/2018", "5 JALAN LANJAN", "4.90")), ("b", ("X CO", "01/02/2018", None, "1.00")), ("c", None)], "id string, expected struct<company:string,date:string,address:string,total:string>")
    t = spark.createDataFrame([("a", "PETRON S/B\n5 JALAN LANJAN\n1/2/2018 4.90"), ("b", None)], "id string, text string")
    assert {x.id: x.score for x in consensus.receipt_scores(r, t).collect()} == {"a": 100, "b": 25}


def test_votes_and_selection(spark):
    v = consensus.line_vote(attempts(spark, "a\nb\nx", "a\nb", "b\ny")).first()
    assert v.text.split("\n") == ["b", "a"] and v.n_attempts == 4
    good, bad = "Invoice: INV 2048\nSubtotal: $1,280.00\nTotal: $1,382.40", "Invoice: INV 2648\nSubtotal: $1,280.20\nTota1: $1,382.49"
    s = {r.cand_seq: r for r in consensus.rescored(attempts(spark, good, good, bad)).collect()}
    assert s[0].total > s[2].total and s[2].components.penalty > s[0].components.penalty and s[99].total == -1.0
    best = consensus.best_attempt(consensus.rescored(attempts(spark, good, good, bad, engines=("t", "t", "t"))))
    assert best.first().cand_seq == 0
    later = consensus.best_attempt(consensus.rescored(attempts(spark, good, good, bad, engines=("t", "t", "t"))), later_wins=True)
    assert later.first().cand_seq == 1
    merged = spark.sql("SELECT array(struct('b' AS old, 'B' AS new), struct('zz' AS old, 'N' AS new)) AS f").select(consensus.merged_fragments(F.lit("a b b"), F.col("f")).alias("t")).first().t
    assert merged == "a B b\nN"


def test_ranker_learns_the_right_candidate(spark):
    df = spark.createDataFrame([(i, f"Total: {i}.00\nReference {i}7 $9{i}.00 extra") for i in range(10, 40)], "doc_id long, text string").withColumn("specs", F.expr("array(struct('total' AS name, array('total') AS aliases, 'money' AS type))"))
    rows = fields.field_candidates(df, ["doc_id"]).withColumn("expected_norm", F.col("doc_id").cast("string"))
    w = ranker.train(rows, ["doc_id"])
    out = ranker.accuracy(ranker.reranked(rows, ["doc_id"], w), ["doc_id"]).first()
    assert out.records == 30 and out.accuracy == 1.0
    assert ranker.train(rows.where("false"), ["doc_id"]) == dict(ranker.P.RANKER_WEIGHTS)


def test_stated_label_patterns_are_those_built(spark):
    labels = [a for _, aliases, _ in fields.COMMON_FIELDS for a in aliases] + ["Levy no. 7", "", "tarikh_é"]
    rows = spark.createDataFrame([(a,) for a in labels], "a string").select(ranker._pattern(F.col("a")).alias("x"), ranker.T.label_pattern(F.col("a"), "ranker").alias("y")).collect()
    assert len(rows) == len(labels) and all(r.x == r.y for r in rows)
