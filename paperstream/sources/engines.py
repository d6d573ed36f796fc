"""The interface of pixel-level engines: anything that reads documents runs behind it, on executors, in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What an engine returns per document or page.
ATTEMPT = "ok boolean, engine string, preprocess string, markdown string, text string, confidence double, latency_ms double, error string"

Engine = Callable[[bytes, dict], dict]


def run_engine(documents: DataFrame, name: str, engine: Engine, *, key: str = "doc_id", content: str = "content", options: dict | None = None) -> DataFrame:
    """(key, ATTEMPT): one attempt of an engine at every document. An engine gets the content and options and returns any of markdown, text, confidence, preprocess; what it raises becomes the attempt's error."""
    kind = documents.schema[key].dataType.simpleString()
    types = (pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string())
    names = [c.split()[0] for c in ATTEMPT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                began = time.perf_counter()
                try:
                    out, error = engine(data, dict(options or {})), None
                except Exception as e:  # noqa: BLE001 - a lane's failure is a result
                    out, error = {}, f"{type(e).__name__}: {e}"[:500]
                text = out.get("text") or out.get("markdown") or ""
                rows.append((error is None and bool(text.strip()), name, out.get("preprocess"), out.get("markdown") or text, text, out.get("confidence"), round((time.perf_counter() - began) * 1000, 2), error))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[key, *names])

    return documents.select(F.col(key), F.col(content)).mapInArrow(run, f"`{key}` {kind}, {ATTEMPT}")


def attempts(documents: DataFrame, engines: dict[str, Engine], **kwargs) -> DataFrame:  # noqa: ANN003
    """All engines' attempts with cand_seq in the order given."""
    parts = [run_engine(documents, n, e, **kwargs).withColumn("cand_seq", F.lit(i)) for i, (n, e) in enumerate(engines.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def joined_pages(pages: DataFrame, key: str = "doc_id", page: str = "page_no") -> DataFrame:
    """Attempts at pages put together: texts in page order, mean confidence, summed time."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"]), "\n")
    return pages.groupBy(key).agg(text.alias("text"), F.round(F.avg("confidence"), 4).alias("confidence"), F.round(F.sum("latency_ms"), 2).alias("latency_ms"), F.max("ok").alias("ok"))


def local_text(data: bytes, options: dict) -> dict:
    """The engine for documents that are text already."""
    return {"text": data.decode(options.get("encoding", "utf-8"), "replace"), "confidence": 1.0}


def pdf_text(data: bytes, options: dict) -> dict:
    """A PDF's own text, where the optional PDF library is installed."""
    import fitz  # optional

    with fitz.open(stream=data, filetype="pdf") as doc:
        pages = [p.get_text() for p in list(doc)[: options.get("max_pages", 50)]]
    return {"text": "\n".join(pages), "preprocess": "direct", "confidence": 1.0}
