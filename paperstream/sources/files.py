"""Files in and out: manifests, JSON Lines, result folders, artifacts, binary documents and reports."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE = "struct<id:string,label:string,category:string,required_tokens:array<string>,expected_table_rows:int,expected_fields:array<struct<name:string,aliases:array<string>,expected:string,type:string,tolerance:double>>,sample_text:string,source_case_id:string,release_variant:string>"
MANIFEST = f"name string, description string, cases array<{CASE}>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON manifest, in its order (`position`); a manifest that is no object raises, one without cases has none."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.select(F.posexplode("cases").alias("position", "c")).select("position", "c.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON Lines; blank and broken lines are dropped; a missing file has none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, _broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    names = [f.name for f in rows.schema if f.name != "_broken"]
    filled = F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull()
    return rows.where(F.col("_broken").isNull() & filled).select(*names)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One object a line, keys in order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def result_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows with `file` of all result objects below a folder; progress, summary, report and audit files and unreadable ones are left out."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(folder)
    name = F.lower(F.col("_metadata.file_name"))
    return rows.select("*", F.col("_metadata.file_path").alias("file")).where(~name.rlike("progress|summary|report|audit"))


def binary_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of whole files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)


def folder_hash(files: DataFrame) -> DataFrame:
    """One row: a hash of the paths, sizes and times of binary_documents, 24 hex digits, whatever their order."""
    each = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")), 256)
    # the digests' 60-bit heads are summed and mixed, so no task holds the list
    head = F.conv(F.substring(each, 1, 13), 16, 10).cast("decimal(38,0)")
    return files.agg(F.substring(F.sha2(F.concat_ws(":", F.coalesce(F.sum(head), F.lit(0)).cast("string"), F.count(F.lit(1)).cast("string")), 256), 1, 24).alias("hash"))


def artifact_text(rows: DataFrame, artifacts: DataFrame, path: str = "artifact_path") -> DataFrame:
    """rows with `text` from artifacts (path, extracted_text, markdown, text): the first of these that isn't empty, else empty."""
    some = F.coalesce(*[F.nullif(F.coalesce(f"a.{c}", F.lit("")), F.lit("")) for c in ("extracted_text", "markdown", "text")], F.lit(""))
    return rows.alias("r").join(artifacts.alias("a"), F.col(f"r.{path}") == F.col("a.path"), "left").select("r.*", some.alias("text"))


def case_file(name: Column, url: Column, key: Column) -> Column:
    """File name of a case: its own, else its URL's last part, else its id with .pdf."""
    base = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"([^/]+)$", 1)
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(base, F.lit("")), F.concat(key, F.lit(".pdf")))


def pdf_is_scanned(text: Column, pages: Column) -> Column:
    """Fewer than 40 characters a page: the document's own text is no use."""
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < pages * 40


def fetched(cases: DataFrame, fetch: Callable[[str], bytes], key: str = "id", url: str = "url") -> DataFrame:
    """(key, ok, error, content): a document per case by `fetch`, run on the executors; a failure is a row."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows.append((k, True, None, fetch(u)))
                except Exception as e:  # noqa: BLE001 - whatever a source raises becomes its case's status
                    rows.append((k, False, type(e).__name__, None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.string(), pa.binary()), strict=True)], names=[key, "ok", "error", "content"])

    return cases.select(F.col(key).cast("string"), F.col(url).cast("string")).mapInArrow(run, f"`{key}` string, ok boolean, error string, content binary")


def markdown_table(rows: list[dict], title: str) -> str:
    """A report's table of collected aggregates."""
    if not rows:
        return f"# {title}\n\nNo rows.\n"
    names = list(rows[0])
    body = ["| " + " | ".join(names) + " |", "|" + "-|" * len(names), *("| " + " | ".join("" if r[n] is None else str(r[n]) for n in names) + " |" for r in rows)]
    return f"# {title}\n\n" + "\n".join(body) + "\n"


def write_report(path: str, rows: list[dict], title: str) -> None:
    """Writes the report beside its target and moves it there, so that a reader never sees half of it. Errors are raised."""
    beside = f"{path}.part"
    with open(beside, "w", encoding="utf-8") as f:
        f.write(json.dumps(rows, indent=2, default=str) + "\n" if path.endswith(".json") else markdown_table(rows, title))
    os.replace(beside, path)
