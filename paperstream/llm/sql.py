"""DuckDB SQL of those pN_ queries that SQL can state over whole tables."""

from __future__ import annotations

from paperstream.llm.quantiles import PERCENTILES

P2_FOUND = """
SELECT doc_id, field, gen_seq FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY confidence DESC, line_index NULLS LAST, gen_seq) AS k
    FROM (SELECT DISTINCT doc_id, field, gen_seq, line_index, confidence FROM field_candidates WHERE confidence IS NOT NULL AND NOT isnan(confidence))
) WHERE k <= 3
"""

P4_PERCENTILES = f"""
WITH e AS (
    SELECT DISTINCT event_seq, lower(trim(engine)) AS engine, lower(trim(route)) AS route, CAST(ts AS DATE) AS day, latency_ms AS v FROM lane_events
), c AS (
    SELECT DISTINCT doc_id, cand_seq, lower(trim(engine)) AS engine, latency_ms AS v FROM candidates
), r AS (
    SELECT 'lane_events' AS tab, 'day' AS scope, engine, route, day, v FROM e
    UNION ALL SELECT 'lane_events', 'engine_route', engine, route, NULL, v FROM e
    UNION ALL SELECT 'lane_events', 'engine', engine, NULL, NULL, v FROM e
    UNION ALL SELECT 'candidates', 'engine', engine, NULL, NULL, v FROM c
), g AS (
    SELECT tab, scope, engine, route, day, count(*) AS n, quantile_cont(v, {list(PERCENTILES)}) AS q
    FROM r WHERE v > 0 AND NOT isnan(v) AND NOT isinf(v) GROUP BY ALL
)
SELECT tab, scope, engine, route, day, p, n, round(q[i], 6) AS percentile
FROM g, (SELECT unnest({list(PERCENTILES)})::DOUBLE AS p, unnest(range(1, {len(PERCENTILES) + 1})) AS i)
"""


#: What must hold of every mix: each listed source with a text keeps its share and its cap.
P7_KEPT = """
SELECT DISTINCT source, true AS share_kept, true AS repeats_kept FROM mix_targets
WHERE target_share > 0 AND max_repeats > 0 AND source IN (SELECT source FROM documents WHERE length(text) > 0)
"""

#: What must hold of every profile's pieces; a text of as many letters is longer than the limit in tokens.
P8_KEPT = """
SELECT profile, true AS limit_kept, true AS overlap_kept, true AS whole_kept FROM piece_limits
WHERE max_tokens > 0 AND (SELECT max(length(text)) FROM documents) > 8 * max_tokens
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p4_percentiles": P4_PERCENTILES, "p7_kept": P7_KEPT, "p8_kept": P8_KEPT}
