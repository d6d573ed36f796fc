"""Escalation, route times, queues, manifests and stored models."""

import pytest
from pyspark.sql import functions as F

from paperstream.operators import grade, ranker, routing, truth

FIELDS = "array<struct<field:string,matched:boolean,failure_bucket:string>>"


def test_fallback_escalation(spark):
    rows = [
        (None, 1, "tesseract", "rotated", [], True, "score_below_threshold:0"), (80, 2, "Tesseract ", " Rotated", [("Total", False, "x"), ("Total", False, "x"), ("tax", False, "field_not_found"), ("due", False, "x"), ("subtotal", True, "matched")], True, "high_value_field_failure:tax,total"),
        (80, 3, "tesseract", "low_contrast", [("total", False, "x")], False, "score_and_fields_acceptable"), (10, 4, "native_pdf_text", "rotated", [], False, "engine_not_escalatable"), (10, 5, "rapidocr", None, None, False, "variant_not_hard_image"),
        (75, 6, "local_image_best", "blurred", [("due", None, None)], False, "score_and_fields_acceptable"),
    ]
    df = spark.createDataFrame(rows, f"score int, k int, engine string, variant string, fields {FIELDS}, escalate boolean, reason string")
    got = df.select("k", "escalate", "reason", grade.fallback_escalation(F.col("score"), F.col("fields"), F.col("variant"), F.col("engine")).alias("e")).collect()
    assert all((r.e.escalate, r.e.reason) == (r.escalate, r.reason) for r in got), got


def test_route_latency(spark):
    part = "struct<model_load_overhead_ms:double,preprocessing_overhead_ms:double,ocr_engine_time_ms:double,fallback_or_chaining_overhead_ms:double,residual_overhead_ms:double>"
    rows = [("a", 0, "Primary", 100.0, (10.0, 5.0, 60.0, 0.0, 3.0)), ("a", 1, "primary", 40.0, None), ("a", 2, "fallback", 0.0, (1.0, 2.0, 3.0, 4.0, 5.0)), ("a", 3, None, float("nan"), None), ("b", 0, "fallback", -5.0, None)]
    df = spark.createDataFrame(rows, f"doc_id string, cand_seq int, role string, latency_ms double, latency_breakdown {part}")
    totals = spark.createDataFrame([("a", 200.0)], "doc_id string, total_ms double")
    got = {r.doc_id: tuple(r)[1:] for r in routing.route_latency(df, totals).collect()}
    assert got == {"a": (10.0, 5.0, 60.0, 25.0 + 40.0 + 15.0, 45.0), "b": (0.0,) * 5}
    assert {r.doc_id: r.residual_overhead_ms for r in routing.route_latency(df).collect()} == {"a": 0.0, "b": 0.0}
    merged = {r.doc_id: tuple(r)[1:] for r in routing.merged_latency(df, ["doc_id"]).collect()}
    assert merged["a"] == (11.0, 7.0, 63.0, 4.0, 8.0) and df.select(routing.latency_total(F.col("latency_breakdown")).alias("t")).first().t == 78.0
    assert routing.route_latency(df.where("false")).count() == 0


def test_queue_counts_and_means(spark):
    schema = "position int, id string, run_dir string, broad_variants string, focus_variants string, include_heavy boolean"
    runs = spark.createDataFrame([(1, "a", "d", "v", "f", True), (2, " a", None, "v", "", None)], schema)
    assert {tuple(r) for r in grade.queue_errors(runs).collect()} == {("a", "duplicate_run"), ("a", "missing_run_dir"), ("a", "missing_focus_variants"), ("", "too_few_runs")}
    assert [tuple(r) for r in grade.queue_errors(runs.where("false")).collect()] == [("", "too_few_runs")]
    assert tuple(grade.run_counts(spark.createDataFrame([(True,), (None,), (False,)], "ok boolean"), F.col("ok")).first()) == (3, 1, 2)
    assert tuple(grade.mean_of_runs(spark.createDataFrame([(90,), (95,)], "score_avg int")).first()) == (2, 92)
    assert tuple(grade.mean_of_runs(spark.createDataFrame([], "score_avg int")).first()) == (0, 0)


def test_models_are_stored_and_configured(spark, tmp_path):
    path = f"{tmp_path}/model.json"
    ranker.save_model(spark, {"b": 0.5, "a": 1.0}, path, {"records": 3})
    assert ranker.load_model(spark, path) == {"a": 1.0, "b": 0.5} and ranker.configured_model(spark) is None
    spark.conf.set(ranker.MODEL_SETTING, path)
    try:
        assert ranker.configured_model(spark)["a"] == 1.0
    finally:
        spark.conf.unset(ranker.MODEL_SETTING)
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        ranker.load_model(spark, f"{tmp_path}/bad.json")
    df = spark.createDataFrame([(["x", None, "y"],), (None,), ([],)], "n array<string>")
    assert [r[0] for r in df.select(ranker.positive_index(F.col("n"), F.lit("y"))).collect()] == [2, -1, -1]


def test_a_manifest_that_does_not_score_itself_is_not_written(spark, tmp_path):
    schema = "id string, label string, category string, required_tokens array<string>, expected_table_rows int, expected_fields array<struct<name:string,aliases:array<string>,expected:string,type:string,tolerance:double>>, sample_text string"
    good = ("c", "C", "invoice", ["Total"], None, [("total", ["Total"], "5.00", "money", 0.0)], "Total: $5.00")
    made = truth.write_release_manifest(spark.createDataFrame([good], schema), [("a", "A"), ("b", "B")], f"{tmp_path}/m")
    assert made == {"case_count": 2, "self_score": 100} and spark.read.json(f"{tmp_path}/m").count() == 2
    with pytest.raises(ValueError):
        truth.write_release_manifest(spark.createDataFrame([good[:6] + ("nothing",)], schema), [("a", "A")], f"{tmp_path}/n")
    assert not (tmp_path / "n").exists()
    cases = truth.expanded(spark.createDataFrame([good, ("d", *good[1:])], schema), [("a", "A"), ("b", "B")])
    ids = lambda **k: [r.id for r in truth.selected_cases(cases, **k).orderBy("ordinal").collect()]
    assert ids(ids=["c"]) == ["c_a", "c_b"] and ids(ids=["d_b", " "]) == ["d_b"] and ids(limit=3) == ["c_a", "c_b", "d_a"] and len(ids()) == 4
