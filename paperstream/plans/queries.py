"""Queries of the core operators; each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperstream.functions import quality as Q
from paperstream.functions import text as T
from paperstream.operators import consensus, fields, grade, ranker, routing, slo, truth
from paperstream.plans import render
from paperstream.sources import files
from paperstream.sources.tables import table, texts
from paperstream.session import shared_folder
from paperstream.streaming import lanes

Query = Callable[[SparkSession, str], DataFrame]

#: No limit: a slice of so many holds any array.
EVERY = 2**31 - 1


def order_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Field extraction accuracy by order priority: invoices rendered, misread, read again and held against the orders."""
    docs = render.order_documents(table(spark, d, "orders"))
    docs = docs.withColumn("text", render.misread(F.col("text"), F.col("o_orderkey")))
    lines = docs.select("o_orderkey", "o_orderpriority", "o_totalprice", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").startswith("Total:"))
    got = lines.select("o_orderpriority", T.number_text(F.regexp_extract("line", r"Total:\s*(.*)$", 1)).alias("got"), T.number_text(F.format_number("o_totalprice", 2)).alias("want"))
    return got.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("got") == F.col("want")).alias("hits"), F.bround(F.avg((F.col("got") == F.col("want")).cast("int")) * 100, 2).alias("accuracy"))


def value_keys(spark: SparkSession, d: str) -> DataFrame:
    """The normal forms of every distinct candidate value."""
    v = table(spark, d, "field_candidates").select("value").where("value is not null").distinct()
    return v.select("value", T.squeeze("value").alias("squeezed"), T.key("value").alias("text_key"), T.ocr_key("value").alias("ocr_key"), T.digits("value").alias("digits"), T.identifier_letters("value").alias("letters"), T.confusable("value").alias("confusable"))


def number_texts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "field_candidates").select("value").where("value is not null").distinct()
    return v.select("value", T.number_text("value").alias("number_text"))


def date_texts(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "field_candidates").select("value").where("value is not null").distinct()
    return v.select("value", T.date_text("value").alias("date_text"), T.receipt_date("value").alias("receipt_date"), F.size(T.receipt_date_variants("value")).alias("n_forms"))


def consensus_keys(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "field_candidates").select("field", "value").where("value is not null").distinct()
    return v.select("field", "value", T.consensus_value("value").alias("clean"), T.consensus_key("value", F.col("field")).alias("value_key"), T.consensus_display("value", F.col("field")).alias("shown"))


def text_quality(spark: SparkSession, d: str) -> DataFrame:
    x = texts(spark, d, "documents")
    q = Q.quality("text", F.lit(None).cast("double"))
    return x.select("doc_id", q.alias("q")).select("doc_id", "q.chars", "q.table_rows", F.col("q.numeric_fidelity_score").alias("numeric"), F.col("q.structure_score").alias("structure"))


def text_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", Q.chars("text").alias("chars"), F.size(T.stripped_lines("text")).alias("lines"), Q.table_rows("text").alias("table_rows"), Q.digit_count("text").alias("digits"))


def tool_quality(spark: SparkSession, d: str) -> DataFrame:
    x = texts(spark, d, "candidates").dropDuplicates(["doc_id", "cand_seq"]).withColumn("t", T.attempt_text())
    return x.select("doc_id", "cand_seq", Q.quality("t", F.col("confidence"), "tool").alias("q"), Q.finance_checks("t").alias("checks")).select("doc_id", "cand_seq", "q.*", F.col("checks.issues").alias("issues"), F.col("checks.hints").alias("hints"))


def recovered_tables(spark: SparkSession, d: str) -> DataFrame:
    x = texts(spark, d, "documents").select("doc_id", F.posexplode(Q.table_cells("text")).alias("row_no", "r"))
    return x.select("doc_id", "row_no", "r.raw", F.size("r.cells").alias("n_cells"), F.array_join("r.cells", "¦").alias("cells"))


def text_blocks(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, "documents").select("doc_id", F.explode(Q.blocks("text")).alias("b")).select("doc_id", "b.id", "b.text")


def merged_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables of all attempts of every document put together cell by cell, in order of cand_seq; every row of every attempt counts."""
    a = texts(spark, d, "candidates").dropDuplicates(["doc_id", "cand_seq"]).select("doc_id", "cand_seq", Q.markdown_rows("markdown", most=EVERY).alias("rows"))
    a = a.where(F.size("rows") > 0).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cand_seq", "rows"))).alias("readings"))
    merged = F.aggregate("readings", F.array().cast("array<array<string>>"), lambda done, x: Q.merged_rows(done, x["rows"]))
    return a.select("doc_id", F.posexplode(merged).alias("row_no", "cells"))


def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "field_candidates").select("doc_id", "field", "value", "normalized_value", "line_index", "confidence", "gen_seq").distinct()
    return fields.ranked(rows, ["doc_id"]).select("doc_id", "field", "rank", "gen_seq")


def document_fields(spark: SparkSession, d: str) -> DataFrame:
    """Field candidates of the common fields generated from the documents' own texts."""
    x = texts(spark, d, "documents").select("doc_id", "text").withColumn("specs", fields.common_specs())
    return fields.field_candidates(x, ["doc_id"]).drop("aliases")


def learned_ranking(spark: SparkSession, d: str) -> DataFrame:
    x = texts(spark, d, "documents").select("doc_id", "text").withColumn("specs", fields.common_specs())
    return ranker.reranked(fields.field_candidates(x, ["doc_id"]), ["doc_id"]).select("doc_id", "field", "rank", "value", "learned_score")


def field_consensus(spark: SparkSession, d: str) -> DataFrame:
    return consensus.field_consensus(texts(spark, d, "candidates"))


def receipt_fields(spark: SparkSession, d: str) -> DataFrame:
    return consensus.receipt_fields(texts(spark, d, "candidates"))


def receipt_scores(spark: SparkSession, d: str) -> DataFrame:
    """Receipts scored against the text their own candidates show."""
    seen = table(spark, d, "field_candidates").select(F.col("doc_id").alias("id"), "value").where("value is not null").distinct()
    receipts = table(spark, d, "receipt_cases").distinct()
    texts = seen.join(receipts.select("id"), "id", "left_semi").groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("value")), "\n").alias("text"))
    return consensus.receipt_scores(receipts, texts)


def line_votes(spark: SparkSession, d: str) -> DataFrame:
    return consensus.line_vote(texts(spark, d, "candidates")).select("doc_id", "n_attempts", "text")


def rescored_attempts(spark: SparkSession, d: str) -> DataFrame:
    return consensus.rescored(texts(spark, d, "candidates")).select("doc_id", "cand_seq", "components", "total")


def best_attempts(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "candidates").select("doc_id", "cand_seq", "engine", F.coalesce("selection_score", F.lit(0.0)).alias("total")).distinct()
    return consensus.best_attempt(a)


def routed_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Where each document's route ends: the first usable attempt of high confidence, else the best of all."""
    a = table(spark, d, "candidates").dropDuplicates(["doc_id", "cand_seq"])
    accepts = routing.usable(F.col("ok"), T.attempt_text(), F.col("confidence")) & (routing.confidence_tier(F.col("confidence")) == "high")
    a = a.select("doc_id", "cand_seq", "engine", F.coalesce(accepts, F.lit(False)).alias("accepts"), F.coalesce("selection_score", F.lit(0.0)).alias("total"))
    return routing.routed(a).select("doc_id", "cand_seq", "engine", "n_ran")


def canonical_results(spark: SparkSession, d: str) -> DataFrame:
    a = consensus.once(texts(spark, d, "candidates"))
    return routing.results(a, routed_attempts(spark, d)).select("doc_id", "ok", "engine", "tier", "content_class", "quality.chars", F.size("blocks").alias("n_blocks"), F.size("table_rows").alias("n_rows"), F.size("attempts").alias("n_attempts"))


def content_classes(spark: SparkSession, d: str) -> DataFrame:
    x = texts(spark, d, "documents").select(routing.content_class(F.col("text")).alias("content_class"))
    return x.groupBy("content_class").agg(F.count(F.lit(1)).alias("n"))


def markdown_layouts(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, "candidates").select("doc_id", "cand_seq", T.markdown_layout("markdown").alias("layout")).distinct()


def latency_parts(spark: SparkSession, d: str) -> DataFrame:
    return routing.latency_parts(table(spark, d, "candidates"))


def engine_chains(spark: SparkSession, d: str) -> DataFrame:
    return routing.engine_chains(spark).select("route_mode", "doc_class", F.array_join("chain", ",").alias("chain"))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d, "documents").where("case_id is not null").select("doc_id", F.col("case_id").alias("id"), "text")
    return docs.join(table(spark, d, "manifest_cases"), "id")


def case_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a case scored against it."""
    return truth.case_scores(_cases(spark, d), ["doc_id", "id"])


def field_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return truth.field_accuracy(truth.field_scores(_cases(spark, d), ["doc_id", "id"]))


def failure_records(spark: SparkSession, d: str) -> DataFrame:
    return grade.failure_records(truth.field_scores(_cases(spark, d), ["doc_id", "id"])).select("doc_id", "id", "field", "kind", "expected", "top_value", "partial_score", "failure_bucket")


def token_recall(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("doc_id", truth.token_score("text", "required_tokens").alias("t")).select("doc_id", "t.score", F.size("t.missing").alias("n_missing"))


def case_table_rows(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("doc_id", "expected_table_rows", truth.table_row_count("text").alias("actual_table_rows"))


def expanded_manifest(spark: SparkSession, d: str) -> DataFrame:
    return truth.expanded(table(spark, d, "manifest_cases"), VARIANTS).select("id", "label", "source_case_id", "release_variant", "ordinal", F.size("required_tokens").alias("n_tokens"), "sample_text")


def _attempt_scores(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "candidates").select("doc_id", "cand_seq", F.lower(F.trim("engine")).alias("engine"), "quality.score", "latency_ms").distinct()
    return c.withColumn("latency_ms", F.when(F.isnan("latency_ms"), None).otherwise(F.col("latency_ms")))


def step_summary(spark: SparkSession, d: str) -> DataFrame:
    return grade.step_summary(_attempt_scores(spark, d), ["engine"])


def release_grade(spark: SparkSession, d: str) -> DataFrame:
    steps = grade.step_summary(_attempt_scores(spark, d).where("engine is not null"), ["engine"]).withColumn("mode", F.col("engine"))
    cases = table(spark, d, "manifest_cases").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("k")).first()
    return grade.release_grade(steps, cases["n"], cases["k"]).drop("gates")


def engine_comparison(spark: SparkSession, d: str) -> DataFrame:
    steps = grade.step_summary(_attempt_scores(spark, d).where("engine is not null"), ["engine"])
    return grade.compared(steps.withColumn("scored_case_count", F.col("case_count")), "tesseract")


def _audited(spark: SparkSession, d: str) -> DataFrame:
    s = truth.case_scores(_cases(spark, d), ["doc_id", "id"]).join(table(spark, d, "manifest_cases").select("id", "expected_table_rows"), "id")
    return s.withColumn("findings", grade.findings(F.col("score"), F.col("missing_tokens"), F.col("expected_table_rows"), F.col("actual_table_rows"), F.lit(None).cast("double")))


def audit_reasons(spark: SparkSession, d: str) -> DataFrame:
    return grade.reason_counts(_audited(spark, d))


def weakest_cases(spark: SparkSession, d: str) -> DataFrame:
    return grade.weakest(_audited(spark, d)).select("id", "doc_id", "score", "findings")


def escalations(spark: SparkSession, d: str) -> DataFrame:
    x = truth.case_scores(_cases(spark, d), ["doc_id", "id"]).join(table(spark, d, "manifest_cases").select("id", "expected_table_rows", "release_variant"), "id")
    e = grade.escalation(F.col("score"), F.col("failure_buckets"), F.col("expected_table_rows"), F.col("actual_table_rows"), F.col("release_variant"), F.lit(False))
    return x.select("doc_id", "id", e.alias("e")).select("doc_id", "id", "e.*")


def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return grade.duplicate_ids(table(spark, d, "receipt_cases"))


LEAKS = [("home_path", r"/(home|Users)/[a-z]+"), ("secret", r"(?i)(api[_-]?key|password)\s*[:=]"), ("control_token", r"<\|[a-z_]+\|>")]


def leak_scan(spark: SparkSession, d: str) -> DataFrame:
    return grade.leaks(texts(spark, d, "documents").withColumn("path", F.col("doc_id")), LEAKS).withColumnRenamed("path", "doc_id")


def lane_slo(spark: SparkSession, d: str) -> DataFrame:
    return slo.window_slo(slo.lane_events(table(spark, d, "lane_events")))


def lane_readiness(spark: SparkSession, d: str) -> DataFrame:
    return slo.readiness(lane_slo(spark, d), {"native_pdf_text": 8000.0, "olmocr2": 120000.0}).select("engine", "window_start", "ready", "reason")


def lane_trailing(spark: SparkSession, d: str) -> DataFrame:
    return slo.trailing_counts(slo.lane_events(table(spark, d, "lane_events")))


def streaming_slo(spark: SparkSession, d: str) -> DataFrame:
    """The daily service levels by a stream run to its end over the event files, in complete mode."""
    import uuid

    path = f"{d}/lane_events.parquet"
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    events = spark.readStream.schema(schema).parquet(path if folder else f"{path}*")  # a stream reads folders or patterns
    e = events.select(F.lower(F.trim("engine")).alias("engine"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce(F.nanvl("latency_ms", F.lit(0.0)), F.lit(0.0)).alias("latency_ms"), F.coalesce("fallback_used", F.lit(False)).alias("fallback_used"), F.coalesce("timed_out", F.lit(False)).alias("timed_out"))
    return lanes.run_to_end(lanes.streaming_slo(e, slide=None), f"{shared_folder(spark).rstrip('/')}/paperstream/slo-{uuid.uuid4().hex}")


def source_drift(spark: SparkSession, d: str) -> DataFrame:
    """Each document of a case against the one received before it."""
    docs = table(spark, d, "documents").where("case_id is not null and received_at is not null").withColumn("received_at", F.col("received_at").cast("timestamp"))
    return lanes.batch_drift(docs, "case_id", "text", "received_at")


def unread_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents without an attempt: what a resumed run has left to do."""
    done = table(spark, d, "candidates").select(F.col("doc_id").try_cast("long").alias("doc_id"))
    return lanes.remaining(table(spark, d, "documents").select("doc_id"), done, ["doc_id"])


def artifact_texts(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "scan_pages").distinct()
    kept = pages.select(F.col("artifact_path").alias("path"), "extracted_text", F.lit(None).cast("string").alias("markdown"), F.lit(None).cast("string").alias("text"))
    return files.artifact_text(pages.select("doc_id", "page_no", "artifact_path"), kept).select("doc_id", "page_no", F.length("text").alias("n_chars"))


def fallback_escalations(spark: SparkSession, d: str) -> DataFrame:
    """Attempts at documents with a case, by their own quality score: which go on to preprocessing. Labels of hard variants are brought to the lanes' names."""
    a = table(spark, d, "candidates").select(F.col("doc_id").try_cast("long").alias("doc_id"), "cand_seq", "engine", F.floor(F.col("quality.score") * 100).alias("score")).distinct()
    of = table(spark, d, "documents").select("doc_id", F.col("case_id").alias("id")).join(table(spark, d, "manifest_cases").select("id", "release_variant"), "id")
    variant = F.when(F.col("release_variant") == "noisy", "noisy_scan").otherwise(F.col("release_variant"))
    e = grade.fallback_escalation(F.col("score"), F.lit(None).cast("array<struct<field:string,matched:boolean,failure_bucket:string>>"), variant, F.col("engine"))
    return a.join(of, "doc_id").select("doc_id", "cand_seq", e.alias("e")).select("doc_id", "cand_seq", "e.*")


def route_latencies(spark: SparkSession, d: str) -> DataFrame:
    """The five parts of each document's time: the first attempt is the primary one; reading without preprocessing is all the engine's time, else a tenth is preprocessing."""
    a = table(spark, d, "candidates").select("doc_id", "cand_seq", "preprocess", "latency_ms").distinct()
    ms, direct = F.col("latency_ms"), F.coalesce(F.col("preprocess") == "direct", F.lit(True))
    shares = {"preprocessing_overhead_ms": F.when(direct, 0.0).otherwise(ms * 0.1), "ocr_engine_time_ms": F.when(direct, ms).otherwise(ms * 0.8)}
    parts = F.struct(*[shares.get(p, F.lit(0.0)).alias(p) for p in (*routing.MEASURED, routing.RESIDUAL)])
    a = a.select("doc_id", "cand_seq", F.when(F.col("cand_seq") == 0, "primary").otherwise("fallback").alias("role"), "latency_ms", parts.alias("latency_breakdown"))
    return routing.route_latency(a)


def merged_latencies(spark: SparkSession, d: str) -> DataFrame:
    """Breakdowns summed by engine."""
    a = table(spark, d, "candidates").select("doc_id", "cand_seq", F.lower(F.trim("engine")).alias("engine"), "latency_ms").distinct()
    zero = [F.lit(0.0).alias(p) for p in ("model_load_overhead_ms", "preprocessing_overhead_ms")]
    parts = F.struct(*zero, F.col("latency_ms").alias("ocr_engine_time_ms"), F.when(F.col("cand_seq") > 0, F.col("latency_ms")).otherwise(0.0).alias("fallback_or_chaining_overhead_ms"), F.lit(0.0).alias("residual_overhead_ms"))
    return routing.merged_latency(a.withColumn("latency_breakdown", parts), ["engine"])


VARIANTS = [("baseline", "Baseline document"), ("dense", "Dense layout"), ("rotated", "Rotated scan target"), ("noisy", "Noisy scan target"), ("small_text", "Small text target"), ("table_first", "Table-first target")]


def selected_cases(spark: SparkSession, d: str) -> DataFrame:
    """Of the expanded manifest all variants of one case, and one variant of another."""
    ids = ["annual_dividend_broad", "approved_supplier_broad_noisy"]
    return truth.selected_cases(truth.expanded(table(spark, d, "manifest_cases"), VARIANTS), ids).select("id", "source_case_id", "ordinal")


def positive_indexes(spark: SparkSession, d: str) -> DataFrame:
    """Where, among the ranked values of a receipt's field, the receipt's own value stands."""
    rows = table(spark, d, "field_candidates").select("doc_id", "field", "value", "normalized_value", "line_index", "confidence", "gen_seq").distinct()
    norms = fields.ranked(rows, ["doc_id"]).groupBy("doc_id", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("normalized_value", F.lit("")).alias("norm")))), lambda x: x["norm"]).alias("norms"))
    want = table(spark, d, "receipt_cases").where(F.col("expected.total").isNotNull()).groupBy(F.col("id").alias("doc_id")).agg(F.min("expected.total").alias("expected"))
    return norms.where("field = 'total'").join(want, "doc_id").select("doc_id", ranker.positive_index(F.col("norms"), F.col("expected")).alias("positive_index"))


def attempt_counts(spark: SparkSession, d: str) -> DataFrame:
    return grade.run_counts(table(spark, d, "candidates").select("doc_id", "cand_seq", "ok").distinct(), F.col("ok"))


def run_means(spark: SparkSession, d: str) -> DataFrame:
    """The mean of the engines' whole score averages."""
    return grade.mean_of_runs(step_summary(spark, d))


def queue_errors(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as a queue: cases as runs, their label as folder, their variant as variants, heavy where rows of a table are expected."""
    m = table(spark, d, "manifest_cases")
    runs = m.select(F.dense_rank().over(Window.orderBy("id")).alias("position"), "id", F.col("label").alias("run_dir"), F.col("release_variant").alias("broad_variants"), F.col("category").alias("focus_variants"), (F.col("expected_table_rows") > 0).alias("include_heavy"))
    return grade.queue_errors(runs)


QUERIES: tuple[Query, ...] = (
    order_accuracy, value_keys, number_texts, date_texts, consensus_keys, text_quality, text_counts, tool_quality, recovered_tables, text_blocks, merged_tables, ranked_candidates, document_fields, learned_ranking,
    field_consensus, receipt_fields, receipt_scores, line_votes, rescored_attempts, best_attempts, routed_attempts, canonical_results, content_classes, markdown_layouts, latency_parts, engine_chains, case_scores, field_accuracy, failure_records, token_recall, case_table_rows,
    expanded_manifest, step_summary, release_grade, engine_comparison, audit_reasons, weakest_cases, escalations, duplicate_ids, leak_scan, lane_slo, lane_readiness, lane_trailing, streaming_slo, source_drift, unread_documents, artifact_texts,
    fallback_escalations, route_latencies, merged_latencies, selected_cases, positive_indexes, attempt_counts, run_means, queue_errors,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}
