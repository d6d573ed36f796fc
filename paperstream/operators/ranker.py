"""The linear ranker of field candidates: features, scores, training and accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperstream.functions import patterns as P
from paperstream.functions import text as T
from paperstream.operators.fields import COMMON_FIELDS

#: Records a model is trained from: the classifier's documented, bounded sample.
TRAINING_RECORDS = 20_000


# Fields whose text is an identifier.
IDENTIFIERS = ("invoice_number", "account")
_FAR, _AT_ONCE = 1.0, 3


def _pattern(label: Column) -> Column:
    """The ranker's pattern of a label. Those of the common fields are stated; others are built character by character, row by row."""
    known = F.create_map(*[F.lit(x) for a in dict.fromkeys(a for _, aliases, _ in COMMON_FIELDS for a in aliases) for x in (a, P.bounded_alias(a, "ranker"))])
    return F.coalesce(F.try_element_at(known, label), T.label_pattern(label, "ranker"))


def _label_gaps() -> Column:
    """What stands between each label and the value's first place in its line; a label's last occurrence is the nearest. Empty array without any."""
    at = F.position(F.col("value"), F.col("source_line"))
    # one character of the value closes the text, so that a label can't end within a word
    before = F.substring("source_line", F.lit(1), at)
    pattern = lambda a: F.concat(F.lit("(?is)^.*"), _pattern(a), F.lit("(.*).$"))
    found = F.flatten(F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a != ""), lambda a: F.regexp_extract_all(before, pattern(a), F.lit(1))))
    return F.when((at > 0) & (F.col("value") != ""), found).otherwise(F.array().cast("array<string>"))


def with_features(rows: DataFrame) -> DataFrame:
    """Candidates (field, kind, aliases, value, source_line, confidence, reason) with a `features` map of name and number."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    clean = rows.withColumns({c: text(c) for c in ("value", "source_line", "reason", "field")}).withColumn("_gaps", _label_gaps())
    value, line, kind = F.col("value"), F.col("source_line"), F.coalesce("kind", F.lit("text"))
    far = lambda g: F.length(F.regexp_replace(g, r"(?U)^\s+|\s+$", ""))
    bare = lambda c: F.replace(T.key(c), F.lit(" "), F.lit(""))
    digit, identifier, percent = value.rlike(r"(?U)\d"), F.col("field").isin(*IDENTIFIERS), F.contains(value, F.lit("%"))
    dollar = F.contains(value, F.lit("$"))
    flags = {
        "immediate_after_field_alias": F.exists("_gaps", lambda g: far(g) <= _AT_ONCE), "labels_between_alias_and_value": F.exists("_gaps", lambda g: g.rlike(r"\b[A-Za-z][A-Za-z0-9 ]{2,35}\s*:")),
        "near_requested_label": F.contains("reason", F.lit("near requested label")), "label_context": F.contains("reason", F.lit("label/context")), "line_has_field_name": F.contains(bare("source_line"), bare("field")),
        "has_currency": dollar, "money_type_without_currency": kind.isin("money", "number") & ~dollar & ~percent, "identifier_text_has_digit": identifier & digit, "identifier_text_without_digit": identifier & ~digit,
        "has_percent": percent, "type_percent_match": (kind == "percent") & percent, "iso_date_value": value.rlike(r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}\s*$"), "line_is_table_like": F.length(F.regexp_replace(line, r"[^|]", "")) >= 2,
    }
    numbers = {
        "bias": F.lit(1.0), "candidate_confidence": F.coalesce("confidence", F.lit(0.0)),
        "value_near_field_alias": F.coalesce(F.array_max(F.transform("_gaps", lambda g: 1.0 / (_FAR + far(g)))), F.lit(0.0)),
    } | {k: f.cast("double") for k, f in flags.items()}
    features = F.create_map(*[x for k, c in numbers.items() for x in (F.lit(k), c)])
    return clean.withColumn("features", features).drop("_gaps")


def scored(rows: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """rows with `learned_score`: weights times features, six decimals; features without a weight count nothing."""
    w = weights or P.RANKER_WEIGHTS
    table = F.create_map(*[F.lit(x) for kv in w.items() for x in kv])
    dot = F.aggregate(F.map_entries("features"), F.lit(0.0), lambda a, e: a + F.coalesce(F.try_element_at(table, e["key"]), F.lit(0.0)) * e["value"])
    return rows.withColumn("learned_score", F.round(dot, 6))


def reranked(rows: DataFrame, keys: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Candidates by learned score, then confidence, line and value; `rank` is replaced."""
    by = Window.partitionBy(*keys, "field").orderBy(F.desc("learned_score"), F.desc("confidence"), "line_index", "value")
    return scored(with_features(rows), weights).withColumn("rank", F.row_number().over(by))


def train(rows: DataFrame, keys: list[str], expected: str = "expected_norm", epochs: int = 8, rate: float = 0.25) -> dict[str, float]:
    """Weights of a perceptron that puts the right candidate first.

    Updates depend on the order of records, so they run in one place over at most TRAINING_RECORDS records, the first by
    hash of their key: a bounded sample. Records need two candidates and a right one; without any, the initial weights return.
    """
    record = F.struct(*keys, "field")
    group = Window.partitionBy(*keys, "field")
    good = with_features(rows).withColumns({"_n": F.count(F.lit(1)).over(group), "_right": (F.col("normalized_value") == F.col(expected)).cast("int")}).withColumn("_hit", F.max("_right").over(group)).where("_n > 1 and _hit = 1")
    lists = good.groupBy(F.xxhash64(record).alias("id")).agg(F.collect_list(F.struct("rank", "_right", "features")).alias("c")).orderBy("id").limit(TRAINING_RECORDS)
    data = [[(r["_right"], r["features"]) for r in sorted(row["c"], key=lambda r: r["rank"])] for row in lists.collect()]
    w = dict(P.RANKER_WEIGHTS)
    dot = lambda f: sum(w.get(k, 0.0) * v for k, v in f.items())
    for _ in range(epochs):
        for cands in data:
            picked = max(range(len(cands)), key=lambda i: (dot(cands[i][1]), -i))
            right = next(i for i, c in enumerate(cands) if c[0])
            if picked != right:
                for k in {*cands[right][1], *cands[picked][1]}:
                    w[k] = round(w.get(k, 0.0) + rate * (cands[right][1].get(k, 0.0) - cands[picked][1].get(k, 0.0)), 6)
    return w


def accuracy(ranked: DataFrame, keys: list[str], expected: str = "expected_norm") -> DataFrame:
    """One row (records, correct, accuracy): how often the first of a record's candidates is the right one, over records that have a right one."""
    per = ranked.groupBy(*keys, "field").agg(F.max((F.col("normalized_value") == F.col(expected)).cast("int")).alias("possible"), F.max(F.when(F.col("rank") == 1, (F.col("normalized_value") == F.col(expected)).cast("int"))).alias("hit"))
    return per.where("possible = 1").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("hit"), F.lit(0)).alias("correct"), F.round(F.coalesce(F.avg("hit"), F.lit(0.0)), 4).alias("accuracy"))




def positive_index(norms: Column, expected: Column) -> Column:
    """The first place, from 0, of the right value among ranked normalised values; -1 if it isn't among them or unknown."""
    clean = F.transform(F.coalesce(norms, F.array().cast("array<string>")), lambda n: F.coalesce(n, F.lit("")))
    return F.coalesce(F.array_position(clean, expected).cast("int"), F.lit(0)) - 1


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def save_model(spark: SparkSession, weights: dict[str, float], path: str, training: dict | None = None) -> None:
    """Writes a model - a JSON object with its weights, sorted by name, and facts of its training - to any file system."""
    import json

    files, at = _hadoop(spark, path)
    out = files.create(at, True)
    out.write(bytearray(json.dumps({"model_type": "linear", "weights": dict(sorted(weights.items())), "training": training or {}}, indent=2).encode()))
    out.close()


def load_model(spark: SparkSession, path: str) -> dict[str, float]:
    """The weights of a saved model. A file that isn't there or holds no weights is an error."""
    import json

    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    weights = json.loads(rows[0][0]).get("weights") if rows else None
    if not isinstance(weights, dict):
        raise ValueError(f"{path} holds no model")
    return {k: float(v) for k, v in weights.items()}


#: The session setting that names the model in use.
MODEL_SETTING = "spark.paperstream.ranker.model"


def configured_model(spark: SparkSession) -> dict[str, float] | None:
    """The weights of the model the session's MODEL_SETTING names; None where it is unset."""
    path = spark.conf.get(MODEL_SETTING, None)
    return load_model(spark, path) if path else None
