"""Engines as tables: registry, chains by document class, document classes, first accepted attempt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Engines with class, priority in it, document classes and other names.
ALL_CLASSES = ("digital_pdf", "table_dense", "scanned_pdf", "handwritten", "chart_or_figure", "forms_or_checkboxes", "photo")
ENGINES = (
    ("native_pdf_text", "native_text", 10, ("digital_pdf", "table_dense"), ("native_text", "pdf_native_text")),
    ("local_image_best", "image_router", 10, ("photo",), ("image_router", "local_image_router")),
    ("local_image_preprocessed_best", "image_preprocessor", 10, ("photo", "scanned_pdf", "handwritten"), ("image_preprocessor", "local_image_preprocessor")),
    ("rapidocr", "compat_fallback", 10, ALL_CLASSES, ("compat_rapidocr", "rapidocr_local")),
    ("tesseract", "compat_fallback", 20, ALL_CLASSES, ("compat_tesseract", "tesseract_local")),
    ("gb10_qwen_ocr", "semantic_cleanup", 10, ALL_CLASSES, ("semantic_cleanup", "vision_cleanup", "remote_vision_cleanup")),
    ("gb10_got_ocr2", "dense_scan", 10, ("forms_or_checkboxes", "scanned_pdf", "handwritten", "photo"), ("dense_scan_vision", "dense_scan", "got_ocr2")),
    ("gb10_paddleocr_vl", "layout", 10, ("digital_pdf", "table_dense", "chart_or_figure"), ("layout_vision", "table_layout_vision", "paddleocr_vl")),
    ("mineru2_5", "structure_parser", 10, ("digital_pdf", "table_dense", "scanned_pdf", "handwritten"), ("structure_parser", "mineru")),
    ("olmocr2", "linearization", 10, ("digital_pdf", "table_dense"), ("linearization", "olmocr")),
)
# Engine classes by route and document class, in order.
PLANS = {
    "quality_first": {
        "forms_or_checkboxes": ("semantic_cleanup", "dense_scan", "compat_fallback"),
        "chart_or_figure": ("semantic_cleanup", "layout", "compat_fallback"),
        "digital_pdf": ("native_text", "layout", "structure_parser", "linearization", "semantic_cleanup", "compat_fallback"),
        "table_dense": ("native_text", "layout", "structure_parser", "linearization", "semantic_cleanup", "compat_fallback"),
        "scanned_pdf": ("dense_scan", "structure_parser", "semantic_cleanup", "compat_fallback"),
        "handwritten": ("dense_scan", "structure_parser", "semantic_cleanup", "compat_fallback"),
        "photo": ("image_router", "semantic_cleanup", "dense_scan", "compat_fallback"),
    },
    "balanced": {
        "forms_or_checkboxes": ("semantic_cleanup", "compat_fallback"),
        "chart_or_figure": ("semantic_cleanup", "compat_fallback"),
        "digital_pdf": ("native_text", "layout", "semantic_cleanup", "compat_fallback"),
        "table_dense": ("native_text", "layout", "semantic_cleanup", "compat_fallback"),
        "scanned_pdf": ("dense_scan", "semantic_cleanup", "compat_fallback"),
        "handwritten": ("dense_scan", "semantic_cleanup", "compat_fallback"),
        "photo": ("image_router", "semantic_cleanup", "compat_fallback"),
    },
}
# Words of a goal that tell the document's class.
DENSE_TERMS = ("handwriting", "blurry", "tiny text", "dense scan", "fax", "low quality")
TABLE_TERMS = ("table", "layout", "statement", "invoice", "form", "multi-column", "earnings")
SCAN_TERMS = ("scan", "scanned", "photograph", "warped", "skew")


def registry(spark: SparkSession) -> DataFrame:
    """(engine, engine_class, priority, doc_classes, aliases), ten rows."""
    return spark.createDataFrame([(n, c, p, list(d), list(a)) for n, c, p, d, a in ENGINES], "engine string, engine_class string, priority int, doc_classes array<string>, aliases array<string>")


def plans(spark: SparkSession) -> DataFrame:
    """(route_mode, doc_class, position, engine_class)."""
    rows = [(mode, doc, i, c) for mode, by in PLANS.items() for doc, classes in by.items() for i, c in enumerate(classes)]
    return spark.createDataFrame(rows, "route_mode string, doc_class string, position int, engine_class string")


def engine_name(c: Column | str) -> Column:
    """The engine's own name for any of its names; unknown names stay, in lower case."""
    low = F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    names = F.create_map(*[F.lit(x) for n, _, _, _, aliases in ENGINES for a in aliases for x in (a, n)])
    return F.coalesce(F.try_element_at(names, low), low)


def engine_chains(spark: SparkSession) -> DataFrame:
    """(route_mode, doc_class, chain): engines in the order of their classes in the plan, then priority, then name, where they support the class."""
    both = plans(spark).join(F.broadcast(registry(spark)), "engine_class").where(F.array_contains("doc_classes", F.col("doc_class")))
    order = F.struct("position", "priority", "engine")
    return both.groupBy("route_mode", "doc_class").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["engine"])).alias("chain"))


def chain_of(requests: DataFrame, doc_class: str = "doc_class", route_mode: str = "route_mode", forced: str = "forced_engine") -> DataFrame:
    """requests with `chain`: a forced engine first, then the plan's. Unknown classes are photos, unknown routes quality_first."""
    spark = requests.sparkSession
    doc = F.lower(F.trim(F.coalesce(F.col(doc_class), F.lit("photo"))))
    keyed = requests.withColumns({"_doc": F.when(doc.isin(*ALL_CLASSES), doc).otherwise("photo"), "_mode": F.when(F.lower(F.trim(route_mode)) == "balanced", "balanced").otherwise("quality_first")})
    first = engine_name(forced)
    joined = keyed.join(F.broadcast(engine_chains(spark).withColumnsRenamed({"route_mode": "_mode", "doc_class": "_doc", "chain": "_chain"})), ["_mode", "_doc"], "left")
    own = F.when((first != "") & ~first.isin("auto", "gb10_auto"), F.array(first)).otherwise(F.array().cast("array<string>"))
    return joined.withColumn("chain", F.array_distinct(F.concat(own, "_chain"))).drop("_doc", "_mode", "_chain")


def usable_engines(names: Column, optional: Column | None = None) -> Column:
    """Own names in order, once each, without blanks and automatic ones, without those of `optional`."""
    own = F.array_distinct(F.filter(F.transform(names, engine_name), lambda n: (n != "") & ~n.isin("auto", "gb10_auto")))
    return own if optional is None else F.array_except(own, optional)


def _any(c: Column, terms: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(c, F.lit(t)) for t in terms])


def doc_class(goal: Column, suffix: Column, layout: Column | None = None, more_table: tuple[str, ...] = (), more_scan: tuple[str, ...] = ()) -> Column:
    """The document class from a detected layout class, the goal's words and the file's suffix."""
    g, s = F.lower(F.coalesce(goal, F.lit(""))), F.lower(F.coalesce(suffix, F.lit("")))
    seen = F.lower(F.trim(F.coalesce(layout, F.lit("")))) if layout is not None else F.lit("")
    return (
        F.when(seen.isin("forms_or_checkboxes", "chart_or_figure", "handwritten", "table_dense"), seen).when(_any(g, DENSE_TERMS), "handwritten")
        .when(s == ".pdf", F.when(_any(g, (*SCAN_TERMS, *more_scan)), "scanned_pdf").when(_any(g, (*TABLE_TERMS, *more_table)), "table_dense").otherwise("digital_pdf")).otherwise("photo")
    )


def usable(ok: Column, text: Column, confidence: Column) -> Column:
    """An attempt that can be handed on: good, 40 characters, confidence 0.45 (an unknown one passes)."""
    return F.coalesce(ok, F.lit(False)) & (F.length(F.trim(F.coalesce(text, F.lit("")))) >= 40) & F.coalesce(confidence >= 0.45, F.lit(True))


def confidence_tier(c: Column) -> Column:
    return F.when(c >= 0.72, "high").when(c >= 0.45, "medium").otherwise("low")


def fast_accept(score: Column, numeric: Column, chars: Column, structure: Column, layout_heavy: Column, wants_layout: Column) -> Column:
    """struct(accept, reason): whether an attempt is good enough to stop at."""
    reason = (
        F.when(wants_layout, "explicit_layout_or_cleanup_request").when(score < 0.34, "score_below_threshold").when(numeric < 0.50, "numeric_fidelity_below_threshold")
        .when(chars < 100, "chars_below_threshold").when(structure >= 0.08, "structure_threshold_met").when(~layout_heavy, "non_layout_heavy_doc_class").otherwise("layout_heavy_structure_below_threshold")
    )
    return F.struct(reason.isin("structure_threshold_met", "non_layout_heavy_doc_class").alias("accept"), reason.alias("reason"))


def routed(attempts: DataFrame, score: str = "total") -> DataFrame:
    """The attempt each document ends with: attempts run in order of cand_seq until one is accepted (column `accepts`); of those that ran, the highest score, the earlier on ties."""
    ran = Window.partitionBy("doc_id").orderBy("cand_seq").rowsBetween(Window.unboundedPreceding, -1)
    live = attempts.withColumn("_done", F.coalesce(F.max(F.col("accepts").cast("int")).over(ran), F.lit(0))).where("_done = 0")
    best = Window.partitionBy("doc_id").orderBy(F.desc(score), F.asc("cand_seq"))
    return live.withColumn("n_ran", F.count(F.lit(1)).over(Window.partitionBy("doc_id"))).withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k", "_done")


def latency_parts(attempts: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, primary_ms, fallback_ms, total_ms): the first attempt's time and that of the others; negative and unreadable times count 0."""
    ms = F.round(F.greatest(F.coalesce(F.when(F.isnan("latency_ms"), None).otherwise(F.col("latency_ms")), F.lit(0.0)), F.lit(0.0)), 2)
    # whole hundredths, so that sums don't depend on order
    whole = F.round(ms * 100).cast("long")
    first = F.row_number().over(Window.partitionBy(by).orderBy("cand_seq")) == 1
    rows = attempts.dropDuplicates([by, "cand_seq"]).withColumns({"_ms": whole, "_first": first})
    part = lambda test: F.coalesce(F.sum(F.when(test, F.col("_ms"))), F.lit(0)) / 100.0
    return rows.groupBy(by).agg(part(F.col("_first")).alias("primary_ms"), part(~F.col("_first")).alias("fallback_ms"), part(F.lit(True)).alias("total_ms"))


# The parts of a time that are measured; what is left of the total is residual.
MEASURED = ("model_load_overhead_ms", "preprocessing_overhead_ms", "ocr_engine_time_ms", "fallback_or_chaining_overhead_ms")
CHAINING, RESIDUAL = MEASURED[3], "residual_overhead_ms"


def _hundredths(ms: Column) -> Column:
    """Milliseconds as whole hundredths, so that sums don't depend on order; negative and unreadable ones are 0."""
    return F.round(F.greatest(F.coalesce(F.when(F.isnan(ms), None).otherwise(ms), F.lit(0.0)), F.lit(0.0)) * 100).cast("long")


def latency_total(breakdown: Column) -> Column:
    """The sum of a breakdown's five parts."""
    return sum((_hundredths(breakdown[p]) for p in (*MEASURED, RESIDUAL)), F.lit(0)) / 100.0


def merged_latency(rows: DataFrame, by: list[str], breakdown: str = "latency_breakdown") -> DataFrame:
    """(by, the five parts): breakdowns summed part by part."""
    return rows.groupBy(*by).agg(*[(F.sum(_hundredths(F.col(f"{breakdown}.{p}"))) / 100.0).alias(p) for p in (*MEASURED, RESIDUAL)])


def route_latency(attempts: DataFrame, totals: DataFrame | None = None, by: str = "doc_id") -> DataFrame:
    """(by, the five parts) of each document's route; attempts: cand_seq, role, latency_ms, latency_breakdown (a struct of the five parts).

    The first primary attempt is taken apart, what it took beyond its parts is chaining; of every other attempt all of
    its time is chaining - its parts' sum where it has no time. Residual is what `totals` (by, total_ms; without it the sum
    of all times) has beyond that, and never negative.
    """
    primary = F.lower(F.trim(F.coalesce("role", F.lit("")))) == "primary"
    first = Window.partitionBy(by, primary).orderBy("cand_seq")
    parts = {p: _hundredths(F.col(f"latency_breakdown.{p}")) for p in (*MEASURED, RESIDUAL)}
    ms = _hundredths(F.col("latency_ms"))
    rows = attempts.withColumn("_main", primary & (F.row_number().over(first) == 1)).withColumns({"_ms": ms, **{f"_{p}": c for p, c in parts.items()}})
    known = sum((F.col(f"_{p}") for p in MEASURED), F.lit(0))
    every = known + F.col(f"_{RESIDUAL}")
    chaining = F.when(F.col("_main"), F.col(f"_{CHAINING}") + F.greatest(F.lit(0), F.col("_ms") - known)).otherwise(F.when(F.col("_ms") > 0, F.col("_ms")).otherwise(every))
    sums = [F.sum(F.when(F.col("_main"), F.col(f"_{p}")).otherwise(0)).alias(p) for p in MEASURED[:3]]
    out = rows.groupBy(by).agg(*sums, F.sum(chaining).alias(CHAINING), F.sum("_ms").alias("_whole"))
    if totals is not None:
        out = out.join(totals.select(by, _hundredths(F.col("total_ms")).alias("_given")), by, "left").withColumn("_whole", F.coalesce("_given", F.lit(0)))
    left = F.greatest(F.lit(0), F.col("_whole") - sum((F.col(p) for p in MEASURED), F.lit(0)))
    return out.withColumn(RESIDUAL, left).select(by, *[(F.col(p) / 100.0).alias(p) for p in (*MEASURED, RESIDUAL)])


# --- what a goal asks for, and what a text is

# Words and phrases of goals.
GOALS = {
    "layout": ("table", "form", "layout", "handwriting", "checkbox", "signature", "multi column", "invoice", "receipt", "diagram", "stamp", "statement", "brokerage statement", "earnings report"),
    "dense_scan": ("handwriting", "tiny text", "dense scan", "fax", "stamp", "blurry", "low quality scan", "annotated", "math", "equation"),
    "cleanup": ("trading strategy", "stock trading", "day trading", "preserve headings", "preserve bullets", "markdown", "chart", "multi column", "rewrite this ocr", "cleanup the ocr", "reformat the ocr"),
    "keep_layout": ("table", "layout", "multi column", "markdown", "preserve headings", "preserve bullets", "rewrite this ocr", "cleanup the ocr", "reformat the ocr", "semantic rewrite", "semantic cleanup"),
}
LAYOUT_HEAVY = tuple(c for c in ALL_CLASSES if c != "photo")
VISION_NAMES = ("vl", "vision", "llava", "minicpm-v", "got-ocr", "ocr")
# Words that show what a text is, by class, in the order that decides equal counts.
CONTENT = (
    ("banking", ("opening balance", "closing balance", "deposits", "withdrawals", "account number")), ("brokerage", ("shares", "market value", "symbol", "portfolio", "unrealized", "cost basis")),
    ("invoice", ("invoice number", "amount due", "purchase order", "line item", "subtotal")), ("payroll", ("gross pay", "net pay", "deductions", "pay period", "federal tax", "fica")),
    ("tax", ("taxable income", "adjusted gross", "filing status", "tax due", "refund amount")), ("statement", ("previous balance", "new charges", "minimum payment", "payment due date", "statement date")),
    ("loan", ("principal balance", "interest rate", "monthly payment", "remaining term", "origination")), ("table_dense", ("| ---", "|---|", "---+---", ":---:", "-----")),
)
FINANCE_SIGNS = ("$", "balance", "total", "invoice", "account", "payment")


def asks(goal: Column, what: str) -> Column:
    """Whether a goal has a word or phrase of GOALS[what], as whole words."""
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(goal, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))
    return _any(words, tuple(f" {t} " for t in GOALS[what]))


def layout_heavy(doc_class: Column) -> Column:
    return F.coalesce(F.lower(F.trim(doc_class)).isin(*LAYOUT_HEAVY), F.lit(False))


def is_vision_model(name: Column) -> Column:
    return _any(F.lower(F.trim(F.coalesce(name, F.lit("")))), VISION_NAMES)


def first_engine(goal: Column, suffix: Column) -> Column:
    """struct(engine, reason) of the light lane that a request starts with."""
    wants = asks(goal, "layout")
    image = F.coalesce(F.lower(suffix).isin(".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff"), F.lit(False))
    return F.struct(F.when(wants, "rapidocr").otherwise("tesseract").alias("engine"), F.when(wants, "goal_requires_layout_or_handwriting").when(image, "image_text_default").otherwise("default").alias("reason"))


def heavy_plan(goal: Column, suffix: Column) -> Column:
    """struct(primary, cleanup, reason) of the heavy lanes."""
    dense, document = asks(goal, "dense_scan"), (F.coalesce(F.lower(suffix) == ".pdf", F.lit(False))) | asks(goal, "layout")
    primary = F.when(dense, "gb10_got_ocr2").when(document, "gb10_paddleocr_vl").otherwise("gb10_qwen_ocr")
    reason = F.when(dense, "dense_scan_or_handwriting").when(document, "document_layout_primary").otherwise("vision_ocr_primary")
    return F.struct(primary.alias("primary"), F.when(dense | document, "gb10_qwen_ocr").otherwise("").alias("cleanup"), reason.alias("reason"))


def cleanup_gate(goal: Column, balanced: Column, ready: Column, score: Column, structure: Column, numeric: Column, chars: Column, doc_class: Column) -> Column:
    """struct(run, reason): whether rewriting a text can still gain anything."""
    visual = F.coalesce(doc_class.isin("photo", "scanned_pdf", "handwritten"), F.lit(False))
    explicit = _any(F.lower(F.coalesce(goal, F.lit(""))), ("markdown", "preserve headings", "preserve bullets", "multi-column"))
    reason = (
        F.when(~ready, "lane_disabled").when(balanced, "balanced_route").when(~asks(goal, "cleanup"), "goal_not_cleanup_specific")
        .when((score >= 0.45) & (structure >= 0.18) & (chars >= 120), "already_good_enough").when((score >= 0.34) & (structure >= 0.08) & (numeric >= 0.50) & (chars >= 100), "no_measurable_gain_expected")
        .when(visual & ~explicit, "visual_doc_without_explicit_cleanup_request").otherwise("cleanup_candidate")
    )
    return F.struct((reason == "cleanup_candidate").alias("run"), reason.alias("reason"))


def content_class(text: Column) -> Column:
    """What a text is, by the class with most of its words present, the earlier class on equal counts; short texts and texts without any sign are photos."""
    raw = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    count = lambda terms: reduce(Column.__add__, [F.contains(raw, F.lit(t)).cast("int") for t in terms])
    best = F.array_max(F.array(*[F.struct(count(terms).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, terms) in enumerate(CONTENT)]))
    pipes = F.size(F.filter(F.split(raw, "\n"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 3))
    return F.when(F.length(raw) < 20, "photo").when(pipes >= 4, "table_dense").when(best["n"] > 0, best["name"]).when(count(FINANCE_SIGNS) >= 3, "table_dense").otherwise("photo")


def results(attempts: DataFrame, routed_: DataFrame) -> DataFrame:
    """One canonical result per document: the attempt its route ended with, its text, blocks, tables, quality and class, and the log of all its attempts."""
    from paperstream.functions import quality as Q
    from paperstream.functions import text as T

    log = F.array_sort(F.collect_list(F.struct("cand_seq", "engine", "preprocess", "ok", "confidence", "latency_ms")))
    logs = attempts.groupBy("doc_id").agg(log.alias("attempts"))
    won = attempts.join(routed_.select("doc_id", "cand_seq", "n_ran"), ["doc_id", "cand_seq"], "left_semi").withColumn("markdown", F.trim(T.attempt_text()))
    return won.join(logs, "doc_id").select(
        "doc_id", (F.coalesce("ok", F.lit(False)) & (F.col("markdown") != "")).alias("ok"), "engine", "preprocess", "confidence", confidence_tier(F.col("confidence")).alias("tier"), "markdown",
        Q.blocks("markdown").alias("blocks"), Q.table_cells("markdown").alias("table_rows"), Q.quality("markdown", F.col("confidence")).alias("quality"), content_class(F.col("markdown")).alias("content_class"), "attempts",
    )
