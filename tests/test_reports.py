import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperstream.operators import geometry, grade, routing, slo
from paperstream.sources import engines, files
from paperstream.streaming import lanes

STEPS = "engine string, mode string, score_avg int, below_75_cases long, latency_avg_ms double"


def test_release_grade_views(spark):
    steps = spark.createDataFrame([("native_pdf_text", "gateway_native_pdf_text", 100, 0, 400.0), ("x", "gateway_image_local_image_preprocessed_best_rotated", 95, 0, 9000.0), ("tesseract", "gateway_image_tesseract", 78, 12, 1200.0)], STEPS)
    got = {r["view"]: r for r in grade.release_grade(steps, 120, 12).collect()}
    assert got["production"].grade == 100 and got["production"].passes and got["all"].grade < 97 and got["fallback"].worst_score_avg == 78
    assert got["all"].latency_p95_ms == pytest.approx(1200 + 0.9 * 7800) and not {r["view"]: r for r in grade.release_grade(steps, 120, 12, pending=1).collect()}["production"].grade == 100


def test_summary_comparison_audit(spark):
    rows = spark.createDataFrame([("a", 100, 5.0), ("a", 61, None), ("b", None, 40.0)], "engine string, score int, latency_ms double")
    got = {r.engine: r for r in grade.step_summary(rows, ["engine"]).collect()}
    assert (got["a"].score_avg, got["a"].perfect_cases, got["a"].below_75_cases, got["a"].latency_max_ms) == (80, 1, 1, 5.0)  # 80.5 goes to even
    e = spark.createDataFrame([("own", 90, 3), ("x", 85, 3), ("y", 85, 3), ("z", 99, 0)], "engine string, score_avg int, scored_case_count int")
    assert tuple(grade.compared(e, "own").first()) == ("own", "x", 5, "comparable")
    f = spark.sql("SELECT 'c1' AS id, 1L AS doc_id, 50 AS score, array('total') AS m, 4 AS want, 1 AS have, 40000.0D AS ms UNION ALL SELECT 'c1', 2L, 40, array(), null, 1, 1.0D UNION ALL SELECT 'c2', 3L, 90, array(), null, 1, 1.0D")
    f = f.withColumn("findings", grade.findings(F.col("score"), F.col("m"), F.col("want"), F.col("have"), F.col("ms")))
    assert f.first().findings == ["below_75", "field_miss:total", "table_row_gap:1/4", "latency_gt_30s"]
    assert [r.doc_id for r in grade.weakest(f).collect()] == [2] and {r.reason: r.n for r in grade.reason_counts(f).collect()}["below_75"] == 2
    assert {r.reason for r in grade.recommendations(grade.reason_counts(f)).collect()} == {"below_75", "field_miss", "table_row_gap", "latency_gt_30s"}


def test_gates(spark):
    esc = grade.escalation(F.lit(90), F.array(F.lit("x")), F.lit(None).cast("int"), F.lit(1), F.lit("ROTATED"), F.lit(True))
    x = spark.range(1).select(esc.alias("e")).first().e
    assert x.reasons == ["field_miss", "degraded_input"] and x.action == "route_to_hard_document_lane"
    assert grade.training_gate(spark.createDataFrame([(3.0,), (-1.0,)], "delta double")).first().decision == "consider"
    assert tuple(grade.promotion(spark.createDataFrame([("a", True), ("b", None)], "name string, ok boolean")).first()) == (1, 0, 1, False)
    assert [tuple(r) for r in grade.duplicate_ids(spark.createDataFrame([("a",), ("a ",), ("b",), (None,)], "id string")).orderBy("id").collect()] == [("", 1), ("a", 2)]
    t = spark.createDataFrame([("f", "ok\npassword = x")], "path string, text string")
    assert [tuple(r) for r in grade.leaks(t, [("secret", "password")]).collect()] == [("f", "secret", 2)]


def test_routing(spark):
    chains = {(r.route_mode, r.doc_class): r.chain for r in routing.engine_chains(spark).collect()}
    assert chains["quality_first", "digital_pdf"][:2] == ["native_pdf_text", "gb10_paddleocr_vl"] and chains["balanced", "photo"] == ["local_image_best", "gb10_qwen_ocr", "rapidocr", "tesseract"]
    q = spark.createDataFrame([("photo", "balanced", "Mineru"), (None, None, None), ("odd", "x", "auto")], "doc_class string, route_mode string, forced_engine string")
    got = [r.chain for r in routing.chain_of(q).collect()]
    assert got[0][0] == "mineru2_5" and got[1][0] == "local_image_best" == got[2][0]
    c = spark.createDataFrame([("scan of a statement", ".pdf"), ("invoice", ".PDF"), ("", ".pdf"), ("faxed", ".pdf"), (None, ".png")], "g string, s string").select(routing.doc_class(F.col("g"), F.col("s")).alias("c"))
    assert [r.c for r in c.collect()] == ["scanned_pdf", "table_dense", "digital_pdf", "handwritten", "photo"]
    a = spark.createDataFrame([("d", 0, False, 5.0), ("d", 1, True, 4.0), ("d", 2, False, 9.0), ("e", 0, False, 1.0)], "doc_id string, cand_seq int, accepts boolean, total double")
    assert {r.doc_id: (r.cand_seq, r.n_ran) for r in routing.routed(a).collect()} == {"d": (0, 2), "e": (0, 1)}
    assert spark.sql("SELECT array('AUTO', 'olmocr', 'olmocr2', '') AS n").select(routing.usable_engines(F.col("n")).alias("n")).first().n == ["olmocr2"]
    f = spark.range(1).select(routing.fast_accept(F.lit(0.4), F.lit(0.6), F.lit(120), F.lit(0.01), F.lit(True), F.lit(False)).alias("f")).first().f
    assert not f.accept and f.reason == "layout_heavy_structure_below_threshold"


def test_geometry(spark):
    box = lambda x, y, w, h: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    r = spark.range(1).select(geometry.iou(box(0, 0, 10, 10), box(5, 0, 10, 10)).alias("i"), geometry.within(box(4, 4, 2, 2), box(0, 0, 10, 10)).alias("w"), geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("z")).first()
    assert r.i == pytest.approx(1 / 3) and r.w and r.z == 0
    c = spark.createDataFrame([("d", 1, 1, 10, 100, 12, 12)], "doc_id string, page int, control_id int, x int, y int, w int, h int")
    w = spark.createDataFrame([("d", 1, 30, 100, 12, "Yes"), ("d", 1, 60, 101, 12, "please"), ("d", 1, 900, 100, 12, "far"), ("d", 1, 30, 200, 12, "below")], "doc_id string, page int, x int, y int, h int, text string")
    assert geometry.control_labels(c, w).first().label == "Yes please"


def events(spark):
    t = lambda h: dt.datetime(2026, 1, 1) + dt.timedelta(hours=h)
    rows = [(i, "Tess" if i % 2 else "tess", t(i), i % 5 != 0, float(i), i % 10 == 0, False) for i in range(60)]
    rows += [rows[3], (90, None, t(1), None, float("nan"), None, None)]
    return spark.createDataFrame(rows, "event_seq long, engine string, ts timestamp, ok boolean, latency_ms double, fallback_used boolean, timed_out boolean")


def test_service_levels(spark):
    e = slo.lane_events(events(spark))
    day = {(r.engine, r.window_start.day): r for r in slo.window_slo(e).collect()}
    first = day["tess", 1]
    assert (first["count"], first.p95_latency_ms, first.success_rate) == (24, 22.0, round(19 / 24, 4)) and day[None, 1].p95_latency_ms == 0.0
    n = {r.event_seq: r.n for r in slo.trailing_counts(e, 24).where("engine = 'tess'").collect()}
    assert n == {i: min(i, 24) + 1 for i in range(60)}
    ready = slo.readiness(slo.window_slo(e), {"tess": 10.0}).where("engine = 'tess'").orderBy("window_start").collect()
    assert ready[0].reason == "p95_latency" and not ready[0].ready


def test_trailing_counts_are_running_sums(spark):
    """Against every pair of events, with ties, ends of the hours, and times unknown; no frame slides, as Spark sums such a frame anew for each event."""
    at = lambda s: dt.datetime(1969, 12, 31) + dt.timedelta(seconds=s)
    rows = [(i, (None, "a", "b")[i % 3], at(i * 7919 % 300 * 1800), i % 4 != 0) for i in range(400)] + [(400, "a", None, False), (401, "a", None, True)]
    e = spark.createDataFrame(rows, "event_seq long, engine string, ts timestamp, ok boolean")
    known, day = [r for r in rows if r[2]], dt.timedelta(hours=24)
    near = lambda r: [x for x in known if x[1] == r[1] and r[2] - day <= x[2] <= r[2]]
    out = slo.trailing_counts(e, 24)
    assert {tuple(r) for r in out.collect()} == {(r[0], r[1], len(near(r)), sum(not x[3] for x in near(r))) for r in known}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "specifiedwindowframe(RangeFrame, -" not in plan


def test_streams_equal_batches(spark, tmp_path):
    slo.lane_events(events(spark)).coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(slo.lane_events(events(spark)).schema).parquet(str(tmp_path / "e"))
    q = lanes.streaming_slo(stream, slide=None).writeStream.format("memory").queryName("slo_t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("slo_t").collect()} == {tuple(r) for r in slo.window_slo(slo.lane_events(events(spark))).collect()}


def test_fingerprints(spark, tmp_path):
    t = lambda n: dt.datetime(2026, 1, n)
    rows = [("k", "1 2 3 4", t(1)), ("k", "1 2 3 4", t(2)), ("k", "1 2", t(3)), ("j", None, t(1)), ("k", "1 3", t(4))]
    df = spark.createDataFrame(rows, "source_key string, text string, updated_at timestamp")
    batch = {(r.source_key, r.updated_at.day): tuple(r)[2:] for r in lanes.batch_drift(df, "source_key", "text", "updated_at").collect()}
    assert batch["k", 1] == (4, True, False, 0.0, "none") and batch["k", 3] == (2, False, True, 0.5, "high") and batch["k", 4][2:] == (True, 0.0, "low") and batch["k", 2][2] is False
    df.coalesce(1).write.parquet(str(tmp_path / "d"))
    q = lanes.fingerprint_drift(spark.readStream.schema(df.schema).parquet(str(tmp_path / "d"))).writeStream.format("memory").queryName("fp_t").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.source_key, r.updated_at.day): tuple(r)[2:] for r in spark.table("fp_t").collect()} == batch
    assert [r.source_key for r in lanes.remaining(df.select("source_key").distinct(), df.where("source_key = 'k'"), ["source_key"]).collect()] == ["j"]


def test_files(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"name": "n", "cases": [{"id": "b", "expected_fields": [{"name": "x", "type": "money"}]}, {"id": "a"}]}')
    assert [(r.position, r.id) for r in files.manifest(spark, str(tmp_path / "m.json")).orderBy("position").collect()] == [(0, "b"), (1, "a")]
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "r.jsonl"), "a int").collect()) == [1, 2]
    assert files.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    files.write_json_lines(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["a", "b"]
    (tmp_path / "runs").mkdir()
    for n in ("one", "run_summary"):
        (tmp_path / "runs" / f"{n}.json").write_text('{"mode": "m"}')
    assert files.result_files(spark, str(tmp_path / "runs"), "mode string").count() == 1
    b = files.binary_documents(spark, str(tmp_path / "runs"))
    assert len(files.folder_hash(b).first().hash) == 24
    rows = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "id int, artifact_path string")
    art = spark.createDataFrame([("p", "", "md", "t"), ("q", None, None, None)], "path string, extracted_text string, markdown string, text string")
    assert [r.text for r in files.artifact_text(rows, art).orderBy("id").collect()] == ["md", "", ""]
    names = spark.createDataFrame([("x.pdf", None, "i"), (None, "http://h/a/b.pdf", "i"), (None, None, "i")], "n string, u string, i string").select(files.case_file(F.col("n"), F.col("u"), F.col("i")).alias("f"))
    assert [r.f for r in names.collect()] == ["x.pdf", "b.pdf", "i.pdf"]
    files.write_report(str(tmp_path / "r.md"), [{"a": 1, "b": None}], "T")
    assert "| 1 |  |" in (tmp_path / "r.md").read_text()


def test_engines(spark):
    def broken(data, options):
        raise ValueError("no")

    d = spark.createDataFrame([("a", b"hello"), ("b", b"")], "doc_id string, content binary")
    got = {(r.doc_id, r.engine): r for r in engines.attempts(d, {"plain": engines.local_text, "broken": broken}).collect()}
    assert got["a", "plain"].ok and got["a", "plain"].text == "hello" and not got["b", "plain"].ok and got["a", "broken"].error == "ValueError: no" and got["a", "broken"].cand_seq == 1
    pages = spark.createDataFrame([("a", 2, "two", 0.5, 1.0, True), ("a", 1, "one", 1.0, 2.0, False)], "doc_id string, page_no int, text string, confidence double, latency_ms double, ok boolean")
    assert tuple(engines.joined_pages(pages).first()) == ("a", "one\ntwo", 0.75, 3.0, True)
    fetched = {r.id: r.ok for r in files.fetched(spark.createDataFrame([("a", "u"), ("b", "bad")], "id string, url string"), lambda u: u.encode() if u == "u" else 1 / 0).collect()}
    assert fetched == {"a": True, "b": False}


def test_goals_and_contents(spark):
    row = spark.createDataFrame([("Read the multi-column table", "formal", "Gross pay: 1\nNet pay: 2 deductions opening balance")], "g string, h string, t string").select(
        routing.asks(F.col("g"), "layout").alias("a"), routing.asks(F.col("h"), "layout").alias("b"), routing.first_engine(F.col("g"), F.lit(".pdf")).alias("e"), routing.heavy_plan(F.lit("blurry fax"), F.lit(".png")).alias("p"),
        routing.content_class(F.col("t")).alias("c"), routing.content_class(F.lit("x")).alias("d"), routing.is_vision_model(F.lit("Qwen-VL")).alias("v"), routing.layout_heavy(F.lit("Photo")).alias("l"),
        routing.cleanup_gate(F.lit("rewrite this OCR"), F.lit(False), F.lit(True), F.lit(0.1), F.lit(0.1), F.lit(0.1), F.lit(10), F.lit("digital_pdf")).alias("g"),
    ).first()
    assert row.a and not row.b and row.e.engine == "rapidocr" and (row.p.primary, row.p.cleanup) == ("gb10_got_ocr2", "gb10_qwen_ocr") and (row.c, row.d) == ("payroll", "photo") and row.v and not row.l and row.g.run


def test_model_markdown(spark):
    from paperstream.functions import text as T

    values = ["# A\r\nrow  \n\n\n\nend", "Text here.\nPlease note that I am a model", "Please note: ```markdown\n| a |\n```", "x" * 90, None]
    got = [r.m for r in spark.createDataFrame([(v,) for v in values], "v string").select(T.markdown_layout("v", 50).alias("m")).collect()]
    assert got == ["# A\nrow\n\nend", "Text here.", "| a |", "x" * 47 + "...", ""]
    r = spark.range(1).select(T.anchor_terms(F.lit("Q3_Annual-report.v2"), ("report",)).alias("t"), T.anchor_hits(F.lit("the ANNUAL sum"), T.anchor_terms(F.lit("annual q3 sums"))).alias("n")).first()
    assert r.t == ["annual"] and r.n == 1
