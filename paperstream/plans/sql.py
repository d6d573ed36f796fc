"""DuckDB SQL of the core queries that SQL can state over whole tables."""

from __future__ import annotations

from paperstream.plans.queries import LEAKS

_WS = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}|{_WS}$', '', 'g')"


def _lines(c: str) -> str:
    """Non-blank lines, ends cut off."""
    return f"list_filter(list_transform(string_split_regex(coalesce({c}, ''), '{_BREAK}'), lambda x: {_strip('x')}), lambda x: x <> '')"


_PIPES = "(length({0}) - length(replace({0}, '|', '')))"
_ROW = "({p} >= 2 OR len(string_split({x}, chr(9))) >= 3)"


def _is_row(x: str) -> str:
    return _ROW.format(p=_PIPES.format(x), x=x)


ORDER_ACCURACY = r"""
WITH d AS (
    SELECT o_orderpriority, o_orderkey, format('{:,.2f}', o_totalprice) AS t FROM orders
), n AS (
    SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN translate(t, '01', 'Ol') ELSE t END AS a FROM d
), m AS (
    SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN regexp_replace(a, '\.[0-9Ol]{2}$', '') ELSE a END AS b FROM n
), f AS (
    SELECT *, regexp_extract(b, '-?\d[\d,\s<]*(?:[.\-]\d{1,4})?', 0) AS tok FROM m
), g AS (
    SELECT o_orderpriority, rtrim(rtrim(regexp_replace(t, ',', '', 'g'), '0'), '.') AS want_raw, regexp_replace(tok, '[,\s]', '', 'g') AS got, replace(t, ',', '') AS want FROM f
)
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE try_cast(got AS DOUBLE) = CAST(want AS DOUBLE)) AS hits,
    round_even(avg(CASE WHEN try_cast(got AS DOUBLE) = CAST(want AS DOUBLE) THEN 1 ELSE 0 END) * 100, 2) AS accuracy
FROM g GROUP BY 1
"""

VALUE_KEYS = rf"""
SELECT DISTINCT value, {_squeeze('value')} AS squeezed, trim(regexp_replace(lower({_squeeze('value')}), '[^a-z0-9]+', ' ', 'g')) AS text_key,
    regexp_replace(translate(lower({_squeeze('value')}), '0q1|', 'ooll'), '[^a-z0-9]+', '', 'g') AS ocr_key, regexp_replace(value, '[^0-9]+', '', 'g') AS digits,
    regexp_replace(translate(lower(value), '0q1|l', 'ooiii'), '[^a-z]+', '', 'g') AS letters, translate(lower(value), '105', 'los') AS confusable
FROM field_candidates WHERE value IS NOT NULL
"""

NUMBER_TEXTS = r"""
WITH v AS (
    SELECT DISTINCT value FROM field_candidates WHERE value IS NOT NULL
), t AS (
    SELECT value, regexp_extract(trim(value), '(?i)(?:\$|USD|RM|MYR)?\s*\(?-?\d[\d,\s<]*(?:[.\-]\d{1,4})?%?\)?', 0) AS tok FROM v
), r AS (
    SELECT value, tok, regexp_replace(regexp_replace(tok, '(\d)<(\d{3})(\D|$)', '\1,\2\3', 'g'), '(\d)-(\d{2})(\D|$)', '\1.\2\3', 'g') AS fixed FROM t
), b AS (
    SELECT value, tok, regexp_replace(regexp_replace(fixed, '\$|USD|RM|MYR', '', 'g'), '[, ()%]', '', 'g') AS bare FROM r
), n AS (
    SELECT value, CASE WHEN regexp_full_match(bare, '-?\d+(\.\d+)?') THEN CAST(bare AS DOUBLE) * CASE WHEN starts_with(tok, '(') AND ends_with(tok, ')') THEN -1 ELSE 1 END END AS x FROM b
)
SELECT value, CASE WHEN x IS NULL THEN '' WHEN abs(x - round_even(x, 0)) < 0.000001 THEN CAST(CAST(round_even(x, 0) AS HUGEINT) AS VARCHAR) ELSE regexp_replace(printf('%.4f', x), '\.?0+$', '') END AS number_text FROM n
"""

TEXT_COUNTS = f"""
SELECT doc_id, length({_strip("coalesce(text, '')")}) AS chars, len({_lines('text')}) AS lines,
    len(list_filter(string_split_regex(coalesce(text, ''), '{_BREAK}'), lambda x: {_is_row('x')})) AS table_rows,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '\\p{{Nd}}', '', 'g')) AS digits
FROM documents
"""

RECOVERED_TABLES = f"""
WITH r AS (
    SELECT doc_id, list_filter({_lines('text')}, lambda x: {_is_row('x')})[1:120] AS rows FROM documents
), e AS (
    SELECT doc_id, unnest(rows) AS raw, generate_subscripts(rows, 1) - 1 AS row_no FROM r
), c AS (
    SELECT *, list_filter(list_transform(CASE WHEN {_PIPES.format('raw')} >= 2 THEN string_split(raw, '|') ELSE string_split(raw, chr(9)) END, lambda y: trim(y)), lambda y: y <> '') AS cells FROM e
)
SELECT doc_id, CAST(row_no AS INT) AS row_no, raw, len(cells) AS n_cells, array_to_string(cells, '¦') AS cells FROM c
"""

TEXT_BLOCKS = f"""
SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS id, unnest(l) AS text FROM (SELECT doc_id, {_lines('text')}[1:300] AS l FROM documents)
"""

RANKED_CANDIDATES = """
WITH c AS (
    SELECT DISTINCT doc_id, field, value, normalized_value, line_index, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence, gen_seq FROM field_candidates
), o AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, field, normalized_value ORDER BY confidence DESC NULLS LAST, gen_seq NULLS LAST) AS nth FROM c
), r AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC NULLS LAST, line_index NULLS LAST, value NULLS LAST, gen_seq NULLS LAST) AS rank FROM o WHERE nth = 1
)
SELECT doc_id, field, rank, gen_seq FROM r WHERE rank <= 8
"""

LINE_VOTES = f"""
WITH a AS (
    SELECT DISTINCT doc_id, cand_seq, coalesce(nullif(markdown, ''), text, '') AS t, greatest(0.2, coalesce(quality.score, 0.0)) AS w, coalesce(quality.score, 0.0) AS q FROM candidates
), n AS (
    SELECT doc_id, count(*) AS n_attempts, arg_max(t, (q, -cand_seq)) AS best FROM a GROUP BY 1
), l AS (
    SELECT doc_id, cand_seq, w, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
    FROM (SELECT *, list_filter(list_transform(string_split_regex(t, '{_BREAK}'), lambda x: {_squeeze('x')}), lambda x: x <> '') AS ls FROM a)
), v AS (
    SELECT doc_id, line, sum(CAST(round(w * 1e6) AS BIGINT)) AS w, count(DISTINCT cand_seq) AS sources, min((cand_seq, pos)) AS first FROM l GROUP BY 1, 2
), p AS (
    SELECT v.doc_id, string_agg(line, chr(10) ORDER BY v.w DESC, first, line) AS voted FROM v JOIN n USING (doc_id) WHERE sources >= CASE WHEN n_attempts >= 2 THEN 2 ELSE 1 END GROUP BY 1
)
SELECT n.doc_id, n_attempts, coalesce(voted, best) AS text FROM n LEFT JOIN p USING (doc_id)
"""

BEST_ATTEMPTS = """
SELECT doc_id, cand_seq, engine, total FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, cand_seq) AS k FROM (SELECT DISTINCT doc_id, cand_seq, engine, coalesce(selection_score, 0.0) AS total FROM candidates)
) WHERE k = 1
"""

ROUTED_ATTEMPTS = """
WITH a AS (
    SELECT DISTINCT doc_id, cand_seq, engine, coalesce(selection_score, 0.0) AS total,
        coalesce(coalesce(ok, false) AND length(trim(coalesce(nullif(markdown, ''), text, ''))) >= 40 AND coalesce(confidence >= 0.45, true) AND confidence >= 0.72, false) AS accepts
    FROM candidates
), r AS (
    SELECT *, coalesce(max(accepts::INT) OVER (PARTITION BY doc_id ORDER BY cand_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM a
), l AS (
    SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_ran, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, cand_seq) AS k FROM r WHERE done = 0
)
SELECT doc_id, cand_seq, engine, n_ran FROM l WHERE k = 1
"""

LATENCY_PARTS = """
WITH c AS (
    SELECT DISTINCT doc_id, cand_seq, CAST(round(round(greatest(coalesce(CASE WHEN isnan(latency_ms) THEN NULL ELSE latency_ms END, 0.0), 0.0), 2) * 100) AS BIGINT) AS ms FROM candidates
), f AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cand_seq) = 1 AS first FROM c
)
SELECT doc_id, coalesce(sum(ms) FILTER (WHERE first), 0) / 100.0 AS primary_ms, coalesce(sum(ms) FILTER (WHERE NOT first), 0) / 100.0 AS fallback_ms, sum(ms) / 100.0 AS total_ms FROM f GROUP BY 1
"""


# Written out, not taken from the operators: a wrong row there must show.
ENGINE_CHAINS = """
WITH e(engine, engine_class, priority, doc_class) AS (VALUES
    ('native_pdf_text', 'native_text', 10, 'digital_pdf'),
    ('native_pdf_text', 'native_text', 10, 'table_dense'),
    ('local_image_best', 'image_router', 10, 'photo'),
    ('local_image_preprocessed_best', 'image_preprocessor', 10, 'photo'),
    ('local_image_preprocessed_best', 'image_preprocessor', 10, 'scanned_pdf'),
    ('local_image_preprocessed_best', 'image_preprocessor', 10, 'handwritten'),
    ('rapidocr', 'compat_fallback', 10, 'digital_pdf'),
    ('rapidocr', 'compat_fallback', 10, 'table_dense'),
    ('rapidocr', 'compat_fallback', 10, 'scanned_pdf'),
    ('rapidocr', 'compat_fallback', 10, 'handwritten'),
    ('rapidocr', 'compat_fallback', 10, 'chart_or_figure'),
    ('rapidocr', 'compat_fallback', 10, 'forms_or_checkboxes'),
    ('rapidocr', 'compat_fallback', 10, 'photo'),
    ('tesseract', 'compat_fallback', 20, 'digital_pdf'),
    ('tesseract', 'compat_fallback', 20, 'table_dense'),
    ('tesseract', 'compat_fallback', 20, 'scanned_pdf'),
    ('tesseract', 'compat_fallback', 20, 'handwritten'),
    ('tesseract', 'compat_fallback', 20, 'chart_or_figure'),
    ('tesseract', 'compat_fallback', 20, 'forms_or_checkboxes'),
    ('tesseract', 'compat_fallback', 20, 'photo'),
    ('gb10_qwen_ocr', 'semantic_cleanup', 10, 'digital_pdf'),
    ('gb10_qwen_ocr', 'semantic_cleanup', 10, 'table_dense'),
    ('gb10_qwen_ocr', 'semantic_cleanup', 10, 'scanned_pdf'),
    ('gb10_qwen_ocr', 'semantic_cleanup', 10, 'handwritten'),
    ('gb10_qwen_ocr', 'semantic_cleanup', 10, 'chart_or_figure'),
    ('gb10_qwen_ocr', 'semantic_cleanup', 10, 'forms_or_checkboxes'),
    ('gb10_qwen_ocr', 'semantic_cleanup', 10, 'photo'),
    ('gb10_got_ocr2', 'dense_scan', 10, 'forms_or_checkboxes'),
    ('gb10_got_ocr2', 'dense_scan', 10, 'scanned_pdf'),
    ('gb10_got_ocr2', 'dense_scan', 10, 'handwritten'),
    ('gb10_got_ocr2', 'dense_scan', 10, 'photo'),
    ('gb10_paddleocr_vl', 'layout', 10, 'digital_pdf'),
    ('gb10_paddleocr_vl', 'layout', 10, 'table_dense'),
    ('gb10_paddleocr_vl', 'layout', 10, 'chart_or_figure'),
    ('mineru2_5', 'structure_parser', 10, 'digital_pdf'),
    ('mineru2_5', 'structure_parser', 10, 'table_dense'),
    ('mineru2_5', 'structure_parser', 10, 'scanned_pdf'),
    ('mineru2_5', 'structure_parser', 10, 'handwritten'),
    ('olmocr2', 'linearization', 10, 'digital_pdf'),
    ('olmocr2', 'linearization', 10, 'table_dense')
), p(route_mode, doc_class, position, engine_class) AS (VALUES
    ('quality_first', 'forms_or_checkboxes', 0, 'semantic_cleanup'),
    ('quality_first', 'forms_or_checkboxes', 1, 'dense_scan'),
    ('quality_first', 'forms_or_checkboxes', 2, 'compat_fallback'),
    ('quality_first', 'chart_or_figure', 0, 'semantic_cleanup'),
    ('quality_first', 'chart_or_figure', 1, 'layout'),
    ('quality_first', 'chart_or_figure', 2, 'compat_fallback'),
    ('quality_first', 'digital_pdf', 0, 'native_text'),
    ('quality_first', 'digital_pdf', 1, 'layout'),
    ('quality_first', 'digital_pdf', 2, 'structure_parser'),
    ('quality_first', 'digital_pdf', 3, 'linearization'),
    ('quality_first', 'digital_pdf', 4, 'semantic_cleanup'),
    ('quality_first', 'digital_pdf', 5, 'compat_fallback'),
    ('quality_first', 'table_dense', 0, 'native_text'),
    ('quality_first', 'table_dense', 1, 'layout'),
    ('quality_first', 'table_dense', 2, 'structure_parser'),
    ('quality_first', 'table_dense', 3, 'linearization'),
    ('quality_first', 'table_dense', 4, 'semantic_cleanup'),
    ('quality_first', 'table_dense', 5, 'compat_fallback'),
    ('quality_first', 'scanned_pdf', 0, 'dense_scan'),
    ('quality_first', 'scanned_pdf', 1, 'structure_parser'),
    ('quality_first', 'scanned_pdf', 2, 'semantic_cleanup'),
    ('quality_first', 'scanned_pdf', 3, 'compat_fallback'),
    ('quality_first', 'handwritten', 0, 'dense_scan'),
    ('quality_first', 'handwritten', 1, 'structure_parser'),
    ('quality_first', 'handwritten', 2, 'semantic_cleanup'),
    ('quality_first', 'handwritten', 3, 'compat_fallback'),
    ('quality_first', 'photo', 0, 'image_router'),
    ('quality_first', 'photo', 1, 'semantic_cleanup'),
    ('quality_first', 'photo', 2, 'dense_scan'),
    ('quality_first', 'photo', 3, 'compat_fallback'),
    ('balanced', 'forms_or_checkboxes', 0, 'semantic_cleanup'),
    ('balanced', 'forms_or_checkboxes', 1, 'compat_fallback'),
    ('balanced', 'chart_or_figure', 0, 'semantic_cleanup'),
    ('balanced', 'chart_or_figure', 1, 'compat_fallback'),
    ('balanced', 'digital_pdf', 0, 'native_text'),
    ('balanced', 'digital_pdf', 1, 'layout'),
    ('balanced', 'digital_pdf', 2, 'semantic_cleanup'),
    ('balanced', 'digital_pdf', 3, 'compat_fallback'),
    ('balanced', 'table_dense', 0, 'native_text'),
    ('balanced', 'table_dense', 1, 'layout'),
    ('balanced', 'table_dense', 2, 'semantic_cleanup'),
    ('balanced', 'table_dense', 3, 'compat_fallback'),
    ('balanced', 'scanned_pdf', 0, 'dense_scan'),
    ('balanced', 'scanned_pdf', 1, 'semantic_cleanup'),
    ('balanced', 'scanned_pdf', 2, 'compat_fallback'),
    ('balanced', 'handwritten', 0, 'dense_scan'),
    ('balanced', 'handwritten', 1, 'semantic_cleanup'),
    ('balanced', 'handwritten', 2, 'compat_fallback'),
    ('balanced', 'photo', 0, 'image_router'),
    ('balanced', 'photo', 1, 'semantic_cleanup'),
    ('balanced', 'photo', 2, 'compat_fallback')
)
SELECT route_mode, doc_class, string_agg(engine, ',' ORDER BY position, priority, engine) AS chain FROM p JOIN e USING (doc_class, engine_class) GROUP BY 1, 2
"""

_CASES = "(SELECT d.doc_id, d.text, m.* FROM documents d JOIN manifest_cases m ON d.case_id = m.id)"

TOKEN_RECALL = rf"""
WITH c AS (
    SELECT doc_id, lower(coalesce(text, '')) AS raw, list_filter(list_transform(coalesce(required_tokens, []), lambda t: {_squeeze("coalesce(t, '')")}), lambda t: t <> '') AS tokens FROM {_CASES}
), k AS (
    SELECT doc_id, raw, {_squeeze('raw')} AS flat, regexp_replace(raw, '[^a-z0-9]+', '', 'g') AS pressed, regexp_replace(translate({_squeeze('raw')}, '0q1|', 'ooll'), '[^a-z0-9]+', '', 'g') AS ocr, unnest(tokens) AS t FROM c
), h AS (
    SELECT doc_id, contains(raw, lower(t)) OR contains(flat, lower(t)) OR (regexp_replace(lower(t), '[^a-z0-9]+', '', 'g') <> '' AND contains(pressed, regexp_replace(lower(t), '[^a-z0-9]+', '', 'g')))
        OR (regexp_replace(translate(lower(t), '0q1|', 'ooll'), '[^a-z0-9]+', '', 'g') <> '' AND contains(ocr, regexp_replace(translate(lower(t), '0q1|', 'ooll'), '[^a-z0-9]+', '', 'g'))) AS hit FROM k
), s AS (
    SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE hit) AS hits FROM h GROUP BY 1
)
SELECT c.doc_id, CASE WHEN n IS NULL THEN 100 ELSE CAST(round_even(hits / n * 100.0, 0) AS INT) END AS score, CAST(coalesce(n - hits, 0) AS INT) AS n_missing FROM c LEFT JOIN s USING (doc_id)
"""

EXPANDED_MANIFEST = """
WITH b AS (
    SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM manifest_cases
), v(k, vid, vlabel) AS (
    VALUES (0, 'baseline', 'Baseline document'), (1, 'dense', 'Dense layout'), (2, 'rotated', 'Rotated scan target'), (3, 'noisy', 'Noisy scan target'), (4, 'small_text', 'Small text target'), (5, 'table_first', 'Table-first target')
), x AS (
    SELECT *, CAST(n * 6 + k + 1 AS INT) AS ordinal FROM b, v
)
SELECT concat_ws('_', id, vid) AS id, concat_ws(' - ', coalesce(label, id), vlabel) AS label, id AS source_case_id, vid AS release_variant, ordinal, len(coalesce(required_tokens, [])) + 1 AS n_tokens,
    trim(concat_ws(chr(10), coalesce(sample_text, ''), printf('Release Gate Ref: RG-%03d-%s', ordinal, upper(vid))), ' ' || chr(10)) AS sample_text
FROM x
"""

_SCORES = "(SELECT DISTINCT doc_id, cand_seq, lower(trim(engine)) AS engine, quality.score AS score, CASE WHEN isnan(latency_ms) THEN NULL ELSE latency_ms END AS latency_ms FROM candidates)"
STEP_SUMMARY = f"""
SELECT engine, count(*) AS case_count, CAST(round_even(avg(coalesce(score, 0)), 0) AS INT) AS score_avg, count(*) FILTER (WHERE coalesce(score, 0) >= 100) AS perfect_cases,
    count(*) FILTER (WHERE coalesce(score, 0) < 75) AS below_75_cases, round(coalesce(avg(latency_ms), 0), 2) AS latency_avg_ms, round(coalesce(max(latency_ms), 0), 2) AS latency_max_ms
FROM {_SCORES} GROUP BY 1
"""

RELEASE_GRADE = f"""
WITH s AS (
    SELECT * FROM ({STEP_SUMMARY}) WHERE engine IS NOT NULL
), c AS (
    SELECT count(*) AS n, count(DISTINCT category) AS k FROM manifest_cases
), v AS (
    SELECT 'all' AS view, * FROM s UNION ALL SELECT CASE WHEN engine IN ('native_pdf_text', 'local_image_preprocessed_best', 'local_image_best') THEN 'production' ELSE 'fallback' END, * FROM s
), m AS (
    SELECT view, max(score_avg) AS best_score_avg, min(score_avg) AS worst_score_avg, CAST(sum(below_75_cases) AS BIGINT) AS below_75_cases, count(*) FILTER (WHERE latency_avg_ms > 0) AS ms,
        round(coalesce(avg(latency_avg_ms) FILTER (WHERE latency_avg_ms > 0), 0), 2) AS latency_avg_ms, round(coalesce(quantile_cont(latency_avg_ms, 0.95) FILTER (WHERE latency_avg_ms > 0), 0), 2) AS latency_p95_ms,
        round(coalesce(quantile_cont(latency_avg_ms, 0.5) FILTER (WHERE latency_avg_ms > 0), 0), 2) AS latency_median_ms, count(*) AS step_count FROM v GROUP BY 1
), g AS (
    SELECT m.*, (CASE WHEN n >= 100 THEN 15 ELSE 0 END) + (CASE WHEN k >= 10 THEN 10 ELSE 0 END) + (CASE WHEN best_score_avg >= 95 THEN 25 ELSE 0 END) + (CASE WHEN worst_score_avg >= 92 THEN 20 ELSE 0 END)
        + (CASE WHEN below_75_cases <= 0 THEN 10 ELSE 0 END) + (CASE WHEN ms > 0 AND latency_avg_ms <= 15000 THEN 10 ELSE 0 END) + (CASE WHEN ms > 0 AND latency_p95_ms <= 30000 THEN 5 ELSE 0 END) + 5 AS grade FROM m, c
)
SELECT view, best_score_avg, worst_score_avg, below_75_cases, latency_avg_ms, latency_p95_ms, latency_median_ms, step_count, grade, grade >= 97 AS passes FROM g
"""

DUPLICATE_IDS = """
SELECT trim(coalesce(id, '')) AS id, count(*) AS n FROM receipt_cases GROUP BY 1 HAVING count(*) > 1 OR trim(coalesce(id, '')) = ''
"""

LEAK_SCAN = "WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n') AS ls FROM documents)) " + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS rule, CAST(line_no AS INT) AS line_no FROM l WHERE regexp_matches(line, '{p}')" for n, p in LEAKS
)

_EVENTS = "(SELECT DISTINCT event_seq, lower(trim(engine)) AS engine, ts, coalesce(ok, false) AS ok, coalesce(CASE WHEN isnan(latency_ms) THEN NULL ELSE latency_ms END, 0.0) AS latency_ms, coalesce(fallback_used, false) AS fallback_used, coalesce(timed_out, false) AS timed_out FROM lane_events)"


def _slo(source: str) -> str:
    return f"""
SELECT engine, date_trunc('day', ts) AS window_start, count(*) AS count, round(avg(ok::INT), 4) AS success_rate, round(avg(timed_out::INT), 4) AS timeout_rate, round(avg(fallback_used::INT), 4) AS fallback_rate,
    round(quantile_disc(latency_ms, 0.95), 2) AS p95_latency_ms
FROM {source} WHERE ts IS NOT NULL GROUP BY 1, 2
"""


LANE_SLO = _slo(_EVENTS)
STREAMING_SLO = _slo("(SELECT lower(trim(engine)) AS engine, ts, coalesce(ok, false) AS ok, coalesce(CASE WHEN isnan(latency_ms) THEN NULL ELSE latency_ms END, 0.0) AS latency_ms, coalesce(fallback_used, false) AS fallback_used, coalesce(timed_out, false) AS timed_out FROM lane_events)")
LANE_READINESS = f"""
SELECT engine, window_start, reason = 'ok' AS ready, reason FROM (
    SELECT *, CASE WHEN timeout_rate >= 0.05 THEN 'timeout_rate' WHEN fallback_rate >= 0.20 THEN 'fallback_rate'
        WHEN p95_latency_ms > CASE engine WHEN 'native_pdf_text' THEN 8000.0 WHEN 'olmocr2' THEN 120000.0 ELSE 30000.0 END THEN 'p95_latency' ELSE 'ok' END AS reason FROM ({LANE_SLO})
)
"""
LANE_TRAILING = f"""
SELECT event_seq, engine, count(*) OVER w AS n, CAST(sum((NOT ok)::INT) OVER w AS BIGINT) AS failures FROM {_EVENTS} WHERE ts IS NOT NULL
WINDOW w AS (PARTITION BY engine ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)
"""

SOURCE_DRIFT = r"""
WITH p AS (
    SELECT case_id AS source_key, received_at AS updated_at, regexp_extract_all(coalesce(text, ''), '-?\d+(?:\.\d+)?') AS tokens, sha256(coalesce(text, '')) AS content_hash FROM documents WHERE case_id IS NOT NULL AND received_at IS NOT NULL
), h AS (
    SELECT *, len(tokens) AS numeric_count, CASE WHEN len(tokens) > 0 THEN sha256(array_to_string(tokens, '|')) ELSE '' END AS token_hash FROM p
), b AS (
    SELECT *, lag(numeric_count) OVER w AS n0, lag(token_hash) OVER w AS t0, lag(content_hash) OVER w AS c0 FROM h WINDOW w AS (PARTITION BY source_key ORDER BY updated_at, content_hash)
), c AS (
    SELECT *, abs(numeric_count - n0) / greatest(1, n0) AS change FROM b
)
SELECT source_key, updated_at, CAST(numeric_count AS INT) AS numeric_count, n0 IS NULL AS first_seen, n0 IS NOT NULL AND (token_hash <> t0 OR content_hash <> c0) AS changed,
    CASE WHEN n0 IS NULL THEN 0.0 ELSE round(change, 3) END AS change_pct, CASE WHEN n0 IS NULL THEN 'none' WHEN change >= 0.35 THEN 'high' WHEN change >= 0.15 THEN 'medium' ELSE 'low' END AS risk_band FROM c
"""

_MONTH = r"(?i)\b(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+(\d{1,2}),?\s+((?:19|20)\d{2})\b"


def _ymd(y: str, m: str, d: str) -> str:
    return f"CASE WHEN {y} BETWEEN 1900 AND 2099 AND {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', {y}, {m}, {d}) END"


def _named(c: str) -> str:
    part = lambda i: f"try_cast(regexp_extract({c}, '{_MONTH}', {i}) AS INT)"
    month = f"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(left(regexp_extract({c}, '{_MONTH}', 1), 3)))"
    return _ymd(part(3), month, part(2))


_FIRST, _LAST = r"(\d{1,2})\s*[/-]\s*(\d{1,2})\s*[/-]?\s*((?:20)?\d{2,4})", r"(\d{4})\s*[/-]\s*(\d{1,2})\s*[/-]\s*(\d{1,2})"
DATE_TEXTS = rf"""
WITH v AS (
    SELECT DISTINCT value, trim(value) AS raw, translate(trim(value), 'OoIl|', '00111') AS clean, translate(trim(value), 'OoQDIl|SsBeZz', '0000111558222') AS r
    FROM field_candidates WHERE value IS NOT NULL
), p AS (
    SELECT *, regexp_extract(clean, '\b((?:19|20)\d{{2}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})\b', ['y', 'm', 'd']) AS i, regexp_extract(clean, '\b(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}})\b', ['a', 'b', 'y']) AS u,
        regexp_matches(r, '{_FIRST}') AS f, regexp_extract(r, '{_FIRST}', ['d', 'm', 'y']) AS x, regexp_extract(r, '{_LAST}', ['y', 'm', 'd']) AS z FROM v
), n AS (
    SELECT *, try_cast(i.y AS INT) AS iy, try_cast(i.m AS INT) AS im, try_cast(i.d AS INT) AS id, try_cast(u.a AS INT) AS a, try_cast(u.b AS INT) AS b, try_cast(u.y AS INT) + CASE WHEN try_cast(u.y AS INT) < 100 THEN 2000 ELSE 0 END AS y,
        try_cast(CASE WHEN f THEN x.d ELSE z.d END AS INT) AS rd, try_cast(CASE WHEN f THEN x.m ELSE z.m END AS INT) AS rm, try_cast(CASE WHEN f THEN x.y ELSE z.y END AS INT) AS ry FROM p
), k AS (
    SELECT *, CASE WHEN f AND ry < 100 THEN ry + 2000 ELSE ry END AS ry1 FROM n
), q AS (
    SELECT *, CASE WHEN ry1 > 2035 AND ry1 <= 2099 THEN 2010 + ry1 % 10 ELSE ry1 END AS ry2 FROM k
), o AS (
    SELECT value, coalesce({_named('raw')}, {_ymd('iy', 'im', 'id')}, {_named('clean')}, CASE WHEN a BETWEEN 1 AND 12 AND b BETWEEN 1 AND 31 THEN {_ymd('y', 'a', 'b')} ELSE {_ymd('y', 'b', 'a')} END, '') AS date_text,
        CASE WHEN rd BETWEEN 1 AND 31 AND rm BETWEEN 1 AND 12 AND ry2 BETWEEN 2010 AND 2035 THEN printf('%02d/%02d/%04d', rd, rm, ry2) ELSE '' END AS receipt_date FROM q
)
SELECT value, date_text, receipt_date, CASE WHEN receipt_date = '' THEN 0 WHEN starts_with(receipt_date, '0') OR substr(receipt_date, 4, 1) = '0' THEN 5 ELSE 4 END AS n_forms FROM o
"""

ENGINE_COMPARISON = f"""
WITH s AS (
    SELECT * FROM ({STEP_SUMMARY}) WHERE engine IS NOT NULL AND case_count > 0
), r AS (
    SELECT (SELECT engine FROM s ORDER BY score_avg DESC, engine LIMIT 1) AS best_engine, (SELECT engine FROM s WHERE engine <> 'tesseract' ORDER BY score_avg DESC, engine LIMIT 1) AS best_baseline,
        (SELECT score_avg FROM s WHERE engine = 'tesseract') - (SELECT max(score_avg) FROM s WHERE engine <> 'tesseract') AS delta
)
SELECT best_engine, best_baseline, delta, CASE WHEN delta >= 10 THEN 'leads' WHEN delta >= 0 THEN 'comparable' ELSE 'baseline_leads' END AS verdict FROM r
"""

TEXT_QUALITY = f"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS t, {_lines('text')} AS ls, len(list_filter(string_split_regex(coalesce(text, ''), '{_BREAK}'), lambda x: {_is_row('x')})) AS rows FROM documents
), m AS (
    SELECT *, length(t) - length(regexp_replace(t, '\\p{{Nd}}', '', 'g')) AS dg,
        {" + ".join(f"contains(lower(t), '{k}')::INT" for k in ("$", "%", "margin", "risk", "position", "entry", "exit", "stop", "rule"))} AS hits,
        len(list_filter(ls[1:80], lambda x: ends_with(x, ':') OR starts_with(x, '#') OR starts_with(x, '-') OR starts_with(x, 'â€¢') OR (upper(x) = x AND lower(x) <> x))) AS heads FROM t
)
SELECT doc_id, length({_strip('t')}) AS chars, rows AS table_rows,
    round_even(least(1.0, least(1.0, dg::DOUBLE / greatest(1, length(t)) * 15.0) * 0.6::DOUBLE + least(1.0, hits / 6.0::DOUBLE) * 0.4::DOUBLE), 3) AS numeric,
    CASE WHEN len(ls) = 0 THEN 0.0 ELSE round_even(least(1.0, least(1.0, len(ls) / 80.0::DOUBLE) * 0.35::DOUBLE + least(1.0, heads / 12.0::DOUBLE) * 0.35::DOUBLE + least(1.0, rows / 8.0::DOUBLE) * 0.30::DOUBLE), 3) END AS structure
FROM m
"""

_MARKS = r"[:=\-|{}\[\]()]+"
CONSENSUS_KEYS = rf"""
WITH v AS (
    SELECT DISTINCT field, value, regexp_replace(regexp_replace({_squeeze('value')}, '^(?:{_MARKS}|[1ilI|])\s+', ''), '\s+(?:[1ilI|]|{_MARKS})(?:\s+(?:[1ilI|]|{_MARKS}))*$', '') AS s FROM field_candidates WHERE value IS NOT NULL
), c AS (
    SELECT field, value, trim(regexp_replace(regexp_replace(s, '(\d)[,\s]+(\d{{3}})(\D|$)', '\1,\2\3', 'g'), '(\d)[,\s]+(\d{{3}})(\D|$)', '\1,\2\3', 'g'), ' :|={{}}[]()') AS clean FROM v
), k AS (
    SELECT *, replace(clean, ';', ',') AS raw, trim(regexp_replace(lower(replace(clean, ';', ',')), '[^a-z0-9]+', ' ', 'g')) AS txt, regexp_extract(replace(clean, ';', ','), '\b\d{{4}}[-/]\d{{1,2}}[-/]\d{{1,2}}\b', 0) AS dt,
        regexp_extract(replace(clean, ';', ','), '\(?-?\$?\d(?:[\d,\s]*\d)?(?:\.\d+)?%?\)?', 0) AS num, regexp_extract_all(replace(clean, ';', ','), '\$\d{{1,3}}(?:[,\s]\d{{3}})*(?:\.\d+)?') AS money FROM c
)
SELECT field, value, clean,
    CASE WHEN lower(trim(coalesce(field, ''))) IN ('invoice_number', 'account') THEN txt WHEN dt <> '' THEN replace(dt, '/', '-') WHEN num <> '' THEN regexp_replace(num, '[$,%() ]', '', 'g') ELSE txt END AS value_key,
    CASE WHEN dt <> '' AND field = 'due_date' THEN replace(dt, '/', '-') WHEN len(money) > 0 THEN CASE WHEN field IN ('market_value', 'total', 'tax_due', 'amount_due', 'payment_due') THEN money[-1] ELSE money[1] END ELSE raw END AS shown
FROM k
"""


_RAW = "lower(trim(coalesce(text, '')))"
# Written out, not taken from the operators: words by class, and signs of money.
_CLASS_WORDS = {
    "banking": ("opening balance", "closing balance", "deposits", "withdrawals", "account number"),
    "brokerage": ("shares", "market value", "symbol", "portfolio", "unrealized", "cost basis"),
    "invoice": ("invoice number", "amount due", "purchase order", "line item", "subtotal"),
    "payroll": ("gross pay", "net pay", "deductions", "pay period", "federal tax", "fica"),
    "tax": ("taxable income", "adjusted gross", "filing status", "tax due", "refund amount"),
    "statement": ("previous balance", "new charges", "minimum payment", "payment due date", "statement date"),
    "loan": ("principal balance", "interest rate", "monthly payment", "remaining term", "origination"),
    "table_dense": ("| ---", "|---|", "---+---", ":---:", "-----"),
}
_MONEY_SIGNS = ("$", "balance", "total", "invoice", "account", "payment")
_COUNTS = ", ".join("(" + " + ".join(f"contains(raw, '{t}')::INT" for t in terms) + f") AS {name}" for name, terms in _CLASS_WORDS.items())
_BEST = "greatest(" + ", ".join(_CLASS_WORDS) + ")"
CONTENT_CLASSES = f"""
WITH r AS (
    SELECT {_RAW} AS raw FROM documents
), c AS (
    SELECT raw, {_COUNTS}, len(list_filter(string_split(raw, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 3)) AS pipes, {" + ".join(f"contains(raw, '{t}')::INT" for t in _MONEY_SIGNS)} AS signs FROM r
), k AS (
    SELECT CASE WHEN length(raw) < 20 THEN 'photo' WHEN pipes >= 4 THEN 'table_dense' WHEN {_BEST} > 0 THEN CASE {" ".join(f"WHEN {n} = {_BEST} THEN '{n}'" for n in _CLASS_WORDS)} END WHEN signs >= 3 THEN 'table_dense' ELSE 'photo' END AS content_class FROM c
)
SELECT content_class, count(*) AS n FROM k GROUP BY 1
"""

UNREAD_DOCUMENTS = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT try_cast(doc_id AS BIGINT) FROM candidates WHERE try_cast(doc_id AS BIGINT) IS NOT NULL)"
ARTIFACT_TEXTS = "WITH p AS (SELECT DISTINCT * FROM scan_pages) SELECT r.doc_id, r.page_no, length(coalesce(a.extracted_text, '')) AS n_chars FROM p r LEFT JOIN p a ON r.artifact_path = a.artifact_path"

FALLBACK_ESCALATIONS = """
WITH a AS (
    SELECT DISTINCT try_cast(doc_id AS BIGINT) AS doc_id, cand_seq, lower(trim(coalesce(engine, ''))) AS engine, coalesce(CAST(floor(quality.score * 100) AS INT), 0) AS score FROM candidates
), v AS (
    SELECT d.doc_id, CASE WHEN m.release_variant = 'noisy' THEN 'noisy_scan' ELSE coalesce(m.release_variant, '') END AS variant FROM documents d JOIN manifest_cases m ON d.case_id = m.id
), r AS (
    SELECT a.doc_id, cand_seq, CASE WHEN engine NOT IN ('tesseract', 'rapidocr', 'local_image_best') THEN 'engine_not_escalatable'
        WHEN variant NOT IN ('rotated', 'noisy_scan', 'blurred', 'small_text', 'low_contrast') THEN 'variant_not_hard_image' WHEN score < 75 THEN 'score_below_threshold:' || score ELSE 'score_and_fields_acceptable' END AS reason
    FROM a JOIN v ON a.doc_id = v.doc_id
)
SELECT doc_id, cand_seq, starts_with(reason, 'score_below') AS escalate, reason FROM r
"""
_H = "CAST(round(greatest(coalesce(CASE WHEN isnan({0}) THEN NULL ELSE {0} END, 0.0), 0.0) * 100) AS BIGINT)"
ROUTE_LATENCIES = f"""
WITH a AS (
    SELECT DISTINCT doc_id, cand_seq, coalesce(preprocess = 'direct', true) AS direct, latency_ms AS ms FROM candidates
), p AS (
    SELECT *, {_H.format("ms")} AS whole, CASE WHEN direct THEN 0 ELSE {_H.format("(ms * 0.1::DOUBLE)")} END AS pre, CASE WHEN direct THEN {_H.format("ms")} ELSE {_H.format("(ms * 0.8::DOUBLE)")} END AS eng FROM a
), s AS (
    SELECT doc_id, sum(CASE WHEN cand_seq = 0 THEN pre ELSE 0 END) AS pre, sum(CASE WHEN cand_seq = 0 THEN eng ELSE 0 END) AS eng,
        sum(CASE WHEN cand_seq = 0 THEN greatest(0, whole - pre - eng) WHEN whole > 0 THEN whole ELSE pre + eng END) AS chain, sum(whole) AS whole
    FROM p GROUP BY 1
)
SELECT doc_id, 0.0::DOUBLE AS model_load_overhead_ms, pre / 100.0::DOUBLE AS preprocessing_overhead_ms, eng / 100.0::DOUBLE AS ocr_engine_time_ms, chain / 100.0::DOUBLE AS fallback_or_chaining_overhead_ms,
    greatest(0, whole - pre - eng - chain) / 100.0::DOUBLE AS residual_overhead_ms
FROM s
"""
MERGED_LATENCIES = f"""
WITH a AS (
    SELECT DISTINCT doc_id, cand_seq, lower(trim(engine)) AS engine, latency_ms AS ms FROM candidates
)
SELECT engine, 0.0::DOUBLE AS model_load_overhead_ms, 0.0::DOUBLE AS preprocessing_overhead_ms, sum({_H.format("ms")}) / 100.0::DOUBLE AS ocr_engine_time_ms,
    sum(CASE WHEN cand_seq > 0 THEN {_H.format("ms")} ELSE 0 END) / 100.0::DOUBLE AS fallback_or_chaining_overhead_ms, 0.0::DOUBLE AS residual_overhead_ms
FROM a GROUP BY 1
"""
SELECTED_CASES = f"SELECT id, source_case_id, ordinal FROM ({EXPANDED_MANIFEST}) WHERE 'annual_dividend_broad' IN (id, source_case_id) OR 'approved_supplier_broad_noisy' IN (id, source_case_id)"
POSITIVE_INDEXES = f"""
WITH {RANKED_CANDIDATES.strip().removeprefix("WITH").rpartition("SELECT")[0]}
, k AS (
    SELECT doc_id, list(coalesce(normalized_value, '') ORDER BY rank) AS norms FROM r WHERE rank <= 8 AND field = 'total' GROUP BY 1
), w AS (
    SELECT id AS doc_id, min(expected.total) AS expected FROM receipt_cases WHERE expected.total IS NOT NULL GROUP BY 1
)
SELECT doc_id, CAST(coalesce(list_position(norms, expected), 0) - 1 AS INT) AS positive_index FROM k JOIN w USING (doc_id)
"""
ATTEMPT_COUNTS = "SELECT count(*) AS total, count_if(coalesce(ok, false)) AS passed, count_if(NOT coalesce(ok, false)) AS failed FROM (SELECT DISTINCT doc_id, cand_seq, ok FROM candidates)"
RUN_MEANS = f"SELECT count(*) AS runs, CAST(coalesce(round_even(avg(coalesce(score_avg, 0)), 0), 0) AS INT) AS score_avg FROM ({STEP_SUMMARY})"
QUEUE_ERRORS = """
WITH q AS (
    SELECT row_number() OVER (ORDER BY id) AS n, trim(coalesce(id, '')) AS k, trim(coalesce(label, '')) AS dir, trim(coalesce(release_variant, '')) AS broad, trim(coalesce(category, '')) AS focus, coalesce(expected_table_rows > 0, true) AS heavy FROM manifest_cases
), x AS (
    SELECT CASE WHEN k = '' THEN n::VARCHAR ELSE k END AS run, k, row_number() OVER (PARTITION BY k ORDER BY n) AS nth, dir, broad, focus, heavy FROM q
)
SELECT run, 'missing_id' AS error FROM x WHERE k = '' UNION ALL SELECT run, 'duplicate_run' FROM x WHERE nth > 1 UNION ALL SELECT run, 'missing_run_dir' FROM x WHERE dir = ''
UNION ALL SELECT run, 'missing_broad_variants' FROM x WHERE broad = '' UNION ALL SELECT run, 'missing_focus_variants' FROM x WHERE heavy AND focus = ''
UNION ALL SELECT '', 'too_few_runs' FROM (SELECT count(*) AS c FROM q) WHERE c < 3
"""
CASE_TABLE_ROWS = rf"""
WITH l AS (
    SELECT doc_id, expected_table_rows, unnest(CASE WHEN len(ls) = 0 THEN [NULL] ELSE ls END) AS x FROM (SELECT doc_id, expected_table_rows, {_lines("text")} AS ls FROM {_CASES})
), m AS (
    -- a stroke between blanks is a bar; twice, as two of them may share a blank
    SELECT *, regexp_replace(regexp_replace(x, '([\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}])[1ilI|]([\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}])', '\1|\2', 'g'), '([\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}])[1ilI|]([\s\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}])', '\1|\2', 'g') AS y FROM l
), n AS (
    SELECT doc_id, expected_table_rows, CASE WHEN x IS NULL THEN 0
        WHEN {_PIPES.format("x")} >= 2 THEN CASE WHEN regexp_matches(x, '\|\s*-+\s*\|') THEN 0 ELSE greatest(1, {_PIPES.format("x")} // 3) END
        WHEN {_PIPES.format("y")} >= 3 THEN greatest(1, {_PIPES.format("y")} // 3)
        WHEN contains(x, chr(9)) THEN 1 WHEN regexp_matches(x, '^[A-Z][A-Za-z &/()]{{2,35}}(\s*:\s*|\s{{2,}})\$?-?[\d,]+(\.\d+)?(\s|$)') THEN 1 ELSE 0 END AS c
    FROM m
)
SELECT doc_id, expected_table_rows, CAST(sum(c) AS INT) AS actual_table_rows FROM n GROUP BY ALL
"""

CANONICAL_RESULTS = f"""
WITH once AS (
    SELECT DISTINCT doc_id, cand_seq, engine, ok, confidence, trim(coalesce(nullif(markdown, ''), text, '')) AS md FROM candidates
), routed AS ({ROUTED_ATTEMPTS}
), n AS (
    SELECT doc_id, count(*) AS n_attempts FROM once GROUP BY 1
), w AS (
    SELECT o.*, {_lines("md")} AS ls, lower(md) AS raw FROM once o SEMI JOIN routed r ON o.doc_id = r.doc_id AND o.cand_seq = r.cand_seq
), c AS (
    SELECT *, {_COUNTS}, len(list_filter(string_split(raw, chr(10)), lambda x: length(x) - length(replace(x, '|', '')) >= 3)) AS pipes, {" + ".join(f"contains(raw, '{t}')::INT" for t in _MONEY_SIGNS)} AS signs FROM w
)
SELECT doc_id, coalesce(ok, false) AND md <> '' AS ok, engine, CASE WHEN confidence >= 0.72 THEN 'high' WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS tier,
    CASE WHEN length(raw) < 20 THEN 'photo' WHEN pipes >= 4 THEN 'table_dense' WHEN {_BEST} > 0 THEN CASE {" ".join(f"WHEN {n} = {_BEST} THEN '{n}'" for n in _CLASS_WORDS)} END WHEN signs >= 3 THEN 'table_dense' ELSE 'photo' END AS content_class,
    length({_strip("md")}) AS chars, least(len(ls), 300) AS n_blocks, least(len(list_filter(ls, lambda x: {_is_row("x")})), 120) AS n_rows, n_attempts
FROM c JOIN n USING (doc_id)
"""


def _receipt_key(c: str) -> str:
    s = f"replace(upper(coalesce({c}, '')), '$B', ' SB ')"
    for pattern, to in ((r"\bS\s*/\s*B\b", " SB "), (r"\bS\.?\s*B\.?\b", " SB "), (r"\bSDN\s+(?:EHD|BHO|BND|GHD|8HD|BHD)\b", " SDN BHD "), ("[^A-Z0-9]+", " ")):
        s = f"regexp_replace({s}, '{pattern}', '{to}', 'g')"
    return f"trim({s})"


def _cents(c: str) -> str:
    found = rf"regexp_extract(replace({c}, ',', ''), '\d+(?:\.\d+)?', 0)"
    return f"CASE WHEN {found} <> '' THEN printf('%.2f', CAST(nullif({found}, '') AS DOUBLE)) ELSE '' END"


def _receipt_date(c: str) -> str:
    """DD/MM/YYYY of a date as OCR may have read it, or ''."""
    clean = f"translate(trim({c}), 'OoQDIl|SsBeZz', '0000111558222')"
    part = lambda form, g: f"try_cast(regexp_extract({clean}, '{form}', {g}) AS INT)"
    first = f"regexp_matches({clean}, '{_FIRST}')"
    day, month = (f"CASE WHEN {first} THEN {part(_FIRST, g)} ELSE {part(_LAST, h)} END" for g, h in ((1, 3), (2, 2)))
    short = f"(CASE WHEN {first} THEN {part(_FIRST, 3)} + CASE WHEN {part(_FIRST, 3)} < 100 THEN 2000 ELSE 0 END ELSE {part(_LAST, 1)} END)"
    year = f"(CASE WHEN {short} > 2035 AND {short} <= 2099 THEN 2010 + {short} % 10 ELSE {short} END)"
    return f"CASE WHEN ({day}) BETWEEN 1 AND 31 AND ({month}) BETWEEN 1 AND 12 AND {year} BETWEEN 2010 AND 2035 THEN printf('%02d/%02d/%04d', {day}, {month}, {year}) ELSE '' END"


_READ_DATE = r"[0-9OoQDISsl|B]{1,2}\s*[/-]\s*[0-9OoQDISsl|Be]{1,2}\s*[/-]?\s*(?:20)?[0-9OoQDISsl|B]{2,4}"
RECEIPT_SCORES = rf"""
WITH r AS (
    SELECT DISTINCT * FROM receipt_cases
), t AS (
    SELECT doc_id AS id, string_agg(value, chr(10) ORDER BY value) AS text FROM (SELECT DISTINCT doc_id, value FROM field_candidates WHERE value IS NOT NULL AND doc_id IN (SELECT id FROM r)) GROUP BY 1
), e AS (
    SELECT r.id, coalesce(t.text, '') AS text, {_receipt_key("expected.company")} AS want, {_receipt_key("coalesce(t.text, '')")} AS have, {_cents("coalesce(expected.total, '')")} AS amount, {_receipt_date("coalesce(expected.date, '')")} AS day, {_receipt_key("expected.address")} AS place
    FROM r LEFT JOIN t ON r.id = t.id WHERE expected IS NOT NULL
), w AS (
    SELECT *, list_distinct(list_filter(string_split(want, ' '), lambda x: x <> '')) AS ww, list_distinct(list_filter(string_split(have, ' '), lambda x: x <> '')) AS hw, list_filter(string_split(place, ' '), lambda x: length(x) > 1) AS pw,
        [day, replace(day, '/', '-'), replace(day, '/', '.'), ltrim(day[1:2], '0') || '/' || ltrim(day[4:5], '0') || '/' || day[7:10], day[1:6] || day[9:10]] AS forms FROM e
), f AS (
    SELECT id, want = '' OR (have <> '' AND (contains(have, want) OR contains(want, have) OR len(list_intersect(ww, hw)) / len(ww) >= 0.8)) AS company_ok,
        day = '' OR len(list_filter(forms, lambda x: contains(text, x))) > 0 OR len(list_filter(regexp_extract_all(text, '{_READ_DATE}'), lambda x: {_receipt_date("x")} = day)) > 0 AS date_ok,
        amount = '' OR len(list_filter(regexp_extract_all(text, '\d+(?:[,.]\d{{2}})'), lambda x: {_cents("x")} = amount)) > 0 AS total_ok,
        CASE WHEN len(pw) = 0 THEN 1.0 ELSE len(list_filter(pw, lambda x: list_contains(hw, x))) / len(pw) END AS covered
    FROM w
)
SELECT id, company_ok, date_ok, total_ok, round(covered, 4) AS address_coverage, covered >= 0.6 AS address_ok, CAST(round_even((company_ok::INT + date_ok::INT + total_ok::INT + (covered >= 0.6)::INT) / 4 * 100.0, 0) AS INT) AS score FROM f
"""


def oracle_sql() -> dict[str, str]:
    here = globals()
    names = ("order_accuracy", "value_keys", "number_texts", "date_texts", "consensus_keys", "text_quality", "engine_comparison", "content_classes", "text_counts", "recovered_tables", "text_blocks", "ranked_candidates", "line_votes", "best_attempts", "routed_attempts", "latency_parts", "engine_chains", "token_recall", "expanded_manifest", "step_summary", "release_grade", "duplicate_ids", "leak_scan", "lane_slo", "lane_readiness", "lane_trailing", "streaming_slo", "source_drift", "unread_documents", "artifact_texts", "fallback_escalations", "route_latencies", "merged_latencies", "selected_cases", "positive_indexes", "attempt_counts", "run_means", "queue_errors", "case_table_rows", "canonical_results", "receipt_scores")
    return {n: here[n.upper()] for n in names}
