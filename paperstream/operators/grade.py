"""Reports over scored runs: step summaries, audits, engine comparison, release gates, failure records and promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds and points of the release gates, and the lanes of the production route.
THRESHOLDS = {"target_grade": 97, "min_cases": 100, "min_categories": 10, "min_best_avg": 95, "min_worst_avg": 92, "max_below_75": 0, "max_latency_avg_ms": 15000, "max_latency_p95_ms": 30000}
POINTS = {"release_corpus_size": 15, "document_breadth": 10, "best_pipeline_quality": 25, "worst_pipeline_floor": 20, "no_bad_cases": 10, "latency_average": 10, "latency_p95": 5, "queue_complete": 5}
PRODUCTION = ("native_pdf_text", "local_image_preprocessed_best", "local_image_best")
HIGH_LATENCY_MS = 30000.0


def step_summary(results: DataFrame, by: list[str], score: str = "score", latency: str = "latency_ms") -> DataFrame:
    """(by, case_count, score_avg, perfect_cases, below_75_cases, latency_avg_ms, latency_max_ms); null scores count as 0, null latencies not at all."""
    s = F.coalesce(F.col(score), F.lit(0))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("case_count"), F.bround(F.avg(s), 0).cast("int").alias("score_avg"), F.count_if(s >= 100).alias("perfect_cases"), F.count_if(s < 75).alias("below_75_cases"),
        F.round(F.coalesce(F.avg(latency), F.lit(0.0)), 2).alias("latency_avg_ms"), F.round(F.coalesce(F.max(latency), F.lit(0.0)), 2).alias("latency_max_ms"),
    )


def lane_of_step(engine: Column, mode: Column) -> Column:
    """The lane a step ran, from its mode's name, else its engine."""
    m = F.coalesce(F.nullif(mode, F.lit("")), engine, F.lit(""))
    out = reduce(lambda acc, lane: acc.when(F.contains(m, F.lit(lane)), lane), ("local_image_best", "native_pdf_text"), F.when(F.contains(m, F.lit("local_image_preprocessed_best")), "local_image_preprocessed_best"))
    return out.otherwise(F.trim(F.coalesce(engine, F.lit(""))))


def release_grade(steps: DataFrame, case_count: int, category_count: int, pending: int = 0, thresholds: dict | None = None) -> DataFrame:
    """One row per view (all, production, fallback): the eight gates and the grade of a release.

    steps: engine, mode, score_avg, below_75_cases, latency_avg_ms, one row per pipeline step. Latency figures are of the
    steps' averages, zero ones left out; p95 is interpolated. A view without steps fails what needs one.
    """
    t = THRESHOLDS | (thresholds or {})
    lane = lane_of_step(F.col("engine"), F.col("mode"))
    views = F.explode(F.array_compact(F.array(F.lit("all"), F.when(lane.isin(*PRODUCTION), "production").otherwise("fallback")))).alias("view")
    rows = steps.select("*", views).withColumn("_ms", F.when(F.col("latency_avg_ms") > 0, F.col("latency_avg_ms")))
    m = rows.groupBy("view").agg(
        F.max("score_avg").alias("best_score_avg"), F.min("score_avg").alias("worst_score_avg"), F.sum("below_75_cases").alias("below_75_cases"), F.count("_ms").alias("_n"),
        F.round(F.coalesce(F.avg("_ms"), F.lit(0.0)), 2).alias("latency_avg_ms"), F.round(F.coalesce(F.percentile("_ms", 0.95), F.lit(0.0)), 2).alias("latency_p95_ms"),
        F.round(F.coalesce(F.percentile("_ms", 0.5), F.lit(0.0)), 2).alias("latency_median_ms"), F.count(F.lit(1)).alias("step_count"),
    )
    ok = {
        "release_corpus_size": F.lit(case_count >= t["min_cases"]), "document_breadth": F.lit(category_count >= t["min_categories"]),
        "best_pipeline_quality": F.col("best_score_avg") >= t["min_best_avg"], "worst_pipeline_floor": F.col("worst_score_avg") >= t["min_worst_avg"], "no_bad_cases": F.col("below_75_cases") <= t["max_below_75"],
        "latency_average": (F.col("_n") > 0) & (F.col("latency_avg_ms") <= t["max_latency_avg_ms"]), "latency_p95": (F.col("_n") > 0) & (F.col("latency_p95_ms") <= t["max_latency_p95_ms"]), "queue_complete": F.lit(pending == 0),
    }
    gates = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(POINTS[k]).alias("points"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in ok.items()])
    out = m.withColumn("gates", gates).withColumn("grade", F.aggregate("gates", F.lit(0), lambda a, g: a + F.when(g["ok"], g["points"]).otherwise(0)))
    return out.withColumn("passes", F.col("grade") >= t["target_grade"]).drop("_n")


def compared(engines: DataFrame, own: str) -> DataFrame:
    """One row: best engine, best other engine, the lead of `own` over it and the verdict. engines: engine, score_avg, scored_case_count; ties go to the first name."""
    scored = engines.where(F.col("scored_case_count") > 0)
    pick = lambda test: F.max(F.when(test, F.struct("score_avg", F.col("_order"), "engine")))
    # names in reverse order, so that the greatest struct holds the first name; the table has a row per engine
    s = scored.withColumn("_order", F.row_number().over(Window.orderBy(F.desc("engine"))))
    one = s.agg(pick(F.lit(True)).alias("b"), pick(F.col("engine") != own).alias("o"), pick(F.col("engine") == own).alias("m"))
    delta = F.col("m.score_avg") - F.col("o.score_avg")
    verdict = F.when(F.col("m").isNull() | (F.col("m").isNotNull() & F.col("o").isNull() & F.lit(False)), "no_scored_baseline").when(F.col("o").isNull(), "scored_no_baseline_available").when(delta >= 10, "leads").when(delta >= 0, "comparable").otherwise("baseline_leads")
    return one.select(F.coalesce("b.engine", F.lit("")).alias("best_engine"), F.coalesce("o.engine", F.lit("")).alias("best_baseline"), delta.alias("delta"), verdict.alias("verdict"))


def findings(score: Column, missed: Column, expected_rows: Column, actual_rows: Column, latency: Column) -> Column:
    """array of tags of what is wrong with a scored case."""
    gap = expected_rows.isNotNull() & (F.coalesce(actual_rows, F.lit(0)) < expected_rows)
    tags = F.array(
        F.when(score < 75, "below_75"), F.when(F.size(missed) > 0, F.concat(F.lit("field_miss:"), F.array_join(missed, ","))),
        F.when(gap, F.concat(F.lit("table_row_gap:"), F.coalesce(actual_rows, F.lit(0)).cast("string"), F.lit("/"), expected_rows.cast("string"))), F.when(latency > HIGH_LATENCY_MS, "latency_gt_30s"),
    )
    return F.array_compact(tags)


def reason_counts(found: DataFrame, column: str = "findings") -> DataFrame:
    """(reason, n): findings counted by what stands before their colon."""
    return found.select(F.explode(column).alias("f")).groupBy(F.split_part("f", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def weakest(found: DataFrame, top: int = 25, key: str = "id", score: str = "score", order: str = "doc_id") -> DataFrame:
    """The `top` cases of lowest score, each by its lowest row (the first by `order` on ties); cases without findings are left out."""
    first = Window.partitionBy(key).orderBy(F.asc(score), F.asc(order))
    low = found.where(F.size("findings") > 0).withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")
    return low.orderBy(F.asc(score), F.asc(key)).limit(top)


# What to do about the commonest reasons.
ADVICE = {"field_miss": "reread fields by consensus and crops", "table_row_gap": "detect rows and columns before rereading pages", "below_75": "route to the hard-document lane", "latency_gt_30s": "gate heavy lanes by crops"}


def recommendations(counts: DataFrame) -> DataFrame:
    """(reason, n, advice) of the reasons that have one."""
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return counts.withColumn("advice", F.try_element_at(advice, F.col("reason"))).where("advice is not null and n > 0")


def failure_records(field_scores: DataFrame) -> DataFrame:
    """Fields not fully matched: what a ranker is trained from."""
    return field_scores.where(~F.col("matched") | (F.col("partial_score") < 1))


def escalation(score: Column, missed_fields: Column, expected_rows: Column, actual_rows: Column, variant: Column, gpu_ready: Column, low: int = 85) -> Column:
    """struct(should_escalate, reasons, action): whether a result goes to the hard-document lane, and whether that can help."""
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(score, F.lit(0)) < low, "low_confidence"), F.when(F.size(missed_fields) > 0, "field_miss"),
        F.when(F.coalesce(expected_rows, F.lit(0)) > F.coalesce(actual_rows, F.lit(0)), "table_row_gap"), F.when(F.lower(F.coalesce(variant, F.lit(""))).isin("noisy_scan", "rotated", "hard", "degraded"), "degraded_input"),
    ))
    needed = F.size(reasons) > 0
    action = F.when(~needed, "keep_lane").when(gpu_ready, "route_to_hard_document_lane").otherwise("record_gap_and_use_best_preprocessing")
    return F.struct(needed.alias("should_escalate"), reasons.alias("reasons"), action.alias("action"), (~needed | gpu_ready).alias("recoverable"))


def training_gate(deltas: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row (delta, decision): the least delta of all rows, and whether training of the reader itself is to be considered."""
    d = deltas.agg(F.min("delta").alias("delta"))
    return d.withColumn("decision", F.when(F.col("delta") >= threshold, "defer").otherwise("consider"))


def promotion(gates: DataFrame) -> DataFrame:
    """One row (passed, failed, missing, promote) of gates (name, ok; null ok: missing)."""
    return gates.agg(F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(F.col("ok").isNull()).alias("missing"), F.coalesce(F.every(F.coalesce("ok", F.lit(False))), F.lit(False)).alias("promote"))


def duplicate_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    """(key, n) of keys that occur more than once or are blank."""
    k = F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))
    return rows.groupBy(k.alias(key)).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col(key) == ""))


def leaks(texts: DataFrame, rules: list[tuple[str, str]], path: str = "path", text: str = "text") -> DataFrame:
    """(path, rule, line_no) of lines that break a rule (name, pattern)."""
    lines = texts.select(path, F.posexplode(F.split(text, r"\r\n|\n")).alias("i", "line"))
    hits = F.explode(F.array_compact(F.array(*[F.when(F.col("line").rlike(p), n) for n, p in rules]))).alias("rule")
    return lines.select(path, hits, (F.col("i") + 1).alias("line_no"))


# What the fallback of image lanes looks at.
FALLBACK_ENGINES = ("tesseract", "rapidocr", "local_image_best")
HARD_VARIANTS = ("rotated", "noisy_scan", "blurred", "small_text", "low_contrast")
FIELD_VARIANTS = ("rotated", "noisy_scan", "blurred", "small_text")
HIGH_VALUE_FIELDS = ("amount_due", "balance_due", "subtotal", "total", "invoice_number", "po_number", "account_number", "net_amount")
GRAVE_BUCKETS = ("field_not_found", "numeric_candidate_wrong", "text_candidate_wrong")
FALLBACK_SCORE = 75


def _lower(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def high_value_failures(fields: Column) -> Column:
    """Of array<struct<field, matched, failure_bucket>> the fields that failed and are of high value or failed gravely."""
    grave = lambda f: _lower(f["field"]).isin(*HIGH_VALUE_FIELDS) | F.coalesce(F.trim(f["failure_bucket"]).isin(*GRAVE_BUCKETS), F.lit(False))
    return F.filter(F.coalesce(fields, F.array().cast("array<struct<field:string,matched:boolean,failure_bucket:string>>")), lambda f: ~F.coalesce(f["matched"], F.lit(False)) & grave(f))


def fallback_escalation(score: Column, fields: Column, variant: Column, engine: Column, least: int = FALLBACK_SCORE) -> Column:
    """struct(escalate, reason): whether an image attempt goes on to preprocessing. The score is held against ground truth, so this is for benchmarks only."""
    s, lane, kind, failed = F.coalesce(score.cast("int"), F.lit(0)), _lower(engine), _lower(variant), high_value_failures(fields)
    names = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(failed, lambda f: _lower(f["field"])), lambda n: n != ""))), ",")
    reason = (
        F.when(~lane.isin(*FALLBACK_ENGINES), "engine_not_escalatable").when(~kind.isin(*HARD_VARIANTS), "variant_not_hard_image").when(s < least, F.concat(F.lit("score_below_threshold:"), s.cast("string")))
        .when((F.size(failed) > 0) & kind.isin(*FIELD_VARIANTS), F.concat(F.lit("high_value_field_failure:"), names)).otherwise("score_and_fields_acceptable")
    )
    return F.struct(reason.rlike("^(score_below|high_value)").alias("escalate"), reason.alias("reason"))


def run_counts(results: DataFrame, ok: Column) -> DataFrame:
    """One row (total, passed, failed); an unknown outcome failed."""
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce(ok, F.lit(False))).alias("passed"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("failed"))


def mean_of_runs(runs: DataFrame) -> DataFrame:
    """One row (runs, score_avg): the mean of whole run averages, each run with equal weight; 0 without any."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.bround(F.avg(F.coalesce("score_avg", F.lit(0))), 0), F.lit(0)).cast("int").alias("score_avg"))


#: Runs a queue has at least.
LEAST_RUNS = 3


def queue_errors(runs: DataFrame) -> DataFrame:
    """(run, error) of a queue of runs (position from 1, id, run_dir, broad_variants, focus_variants, include_heavy): too few runs, and missing or repeated parts."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    by = Window.partitionBy(text("id")).orderBy("position")
    name = F.when(text("id") == "", F.col("position").cast("string")).otherwise(text("id"))
    checks = {"missing_id": text("id") == "", "duplicate_run": F.row_number().over(by) > 1, "missing_run_dir": text("run_dir") == "", "missing_broad_variants": text("broad_variants") == "", "missing_focus_variants": F.coalesce("include_heavy", F.lit(True)) & (text("focus_variants") == "")}
    flagged = runs.select("position", name.alias("run"), F.array_compact(F.array(*[F.when(test, error) for error, test in checks.items()])).alias("errors"))
    few = runs.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < LEAST_RUNS).select(F.lit("").alias("run"), F.lit("too_few_runs").alias("error"))
    return flagged.select("run", F.explode("errors").alias("error")).unionByName(few)
