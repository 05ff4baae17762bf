"""Queries and SQL of operations analytics."""

from __future__ import annotations

from reqloom.operators import ops as o

QUERIES = {
    "metrics_filter_latest": o.metrics_recent,
    "metrics_summary_p95": o.metrics_summary,
    "metrics_p95_by_day": o.p95_by_day,
    "metrics_totals_24h": o.metric_totals,
    "latest_per_key": o.latest_per_key,
    "error_rate": o.error_rate,
    "json_tags": o.tags_map,
    "retention_keep": o.retention,
    "counter_delta": o.counters,
    "late_arrivals": o.late_arrivals,
    "job_state_latest": o.job_state_latest,
    "job_counts": o.job_counts,
    "log_line_numbers": o.job_log_lines,
    "feedback_latest_vote": o.feedback_votes,
    "feedback_recent": o.feedback_recent,
    "feedback_citations": o.feedback_citations,
    "duration_text": o.durations,
}

M = "m AS (SELECT DISTINCT id, ts, category, name, value, unit, tags FROM metrics WHERE value IS NOT NULL AND isfinite(value))"
J = "j AS (SELECT user_id AS job_id, event_id, ts, CASE event_type WHEN 'view' THEN 'submitted' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'submitted' END AS status FROM events)"
STATE = f"""{J}, st AS (SELECT job_id, coalesce(arg_min(status, {{'t': ts, 'e': event_id}}) FILTER (status IN ('completed', 'failed', 'cancelled')), arg_max(status, {{'t': ts, 'e': event_id}})) AS status,
  min(ts) FILTER (status = 'running') AS started_at, min(ts) FILTER (status IN ('completed', 'failed', 'cancelled')) AS completed_at, count(*) AS n_events FROM j GROUP BY 1)"""
FB = "(SELECT * FROM test_feedback QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
_P95 = "list_sort(list(value))[greatest(1, floor(count(*) * 0.95)::INT)]"

SQL = {
    "metrics_filter_latest": f"WITH {M} SELECT id, ts, name, value FROM m WHERE category = 'request' AND ts >= TIMESTAMP '2025-07-01' ORDER BY ts DESC, id DESC LIMIT 100",
    "metrics_summary_p95": f"WITH {M} SELECT category, name, count(*) AS n, round(avg(value), 4) AS mean, min(value) AS low, max(value) AS high, {_P95} AS p95, arg_max(unit, {{'t': ts, 'i': id}}) FILTER (unit IS NOT NULL) AS unit FROM m GROUP BY ALL",
    "metrics_p95_by_day": f"WITH {M} SELECT category, name, strftime(ts, '%Y-%m-%d') AS day, round({_P95}, 6) AS p95 FROM m GROUP BY ALL",
    "metrics_totals_24h": f"""WITH {M}, r AS (SELECT category, name, sum(value) AS s, count(*) AS n FROM m WHERE ts >= TIMESTAMP '2025-12-31' GROUP BY ALL)
      SELECT k.category, k.name, coalesce(n, 0) AS n, round(coalesce(s, 0), 4) AS total, round(coalesce(s / n, 0), 4) AS mean FROM (SELECT DISTINCT category, name FROM metrics) k LEFT JOIN r ON r.category = k.category AND r.name = k.name""",
    "latest_per_key": f"WITH {M} SELECT category, name, arg_max(value, {{'t': ts, 'i': id}}) AS value, max(ts) AS ts FROM m GROUP BY ALL",
    "error_rate": f"""WITH {M}, x AS (SELECT coalesce(json_extract_string(tags, '$.endpoint'), '') AS endpoint, try_cast(json_extract_string(tags, '$.status') AS INT) AS status FROM m WHERE category = 'request')
      SELECT endpoint, count(*) AS requests, count(*) FILTER (status >= 500) AS errors, round(count(*) FILTER (status >= 500) * 100.0 / count(*), 4) AS error_pct FROM x GROUP BY 1""",
    "json_tags": f"WITH {M}, k AS (SELECT tags, unnest(json_keys(tags)) AS tag FROM m) SELECT tag, json_extract_string(tags, '$.' || tag) AS val, count(*) AS n FROM k GROUP BY ALL",
    "retention_keep": f"WITH {M} SELECT category, count(*) FILTER (ts >= TIMESTAMP '2025-12-02') AS kept, count(*) FILTER (ts < TIMESTAMP '2025-12-02') AS deleted FROM m GROUP BY 1",
    "counter_delta": f"""WITH {M}, d AS (SELECT name, strftime(ts, '%Y-%m') AS month, value - lag(value) OVER (PARTITION BY name ORDER BY ts, id) AS delta FROM m WHERE category = 'resource')
      SELECT name, month, count(*) FILTER (delta > 0) AS rises, count(*) FILTER (delta < 0) AS falls, count(*) FILTER (delta IS NULL) AS firsts FROM d GROUP BY ALL""",
    "late_arrivals": """WITH m AS (SELECT id, category, ts, min(ingested_at) AS f FROM metrics GROUP BY ALL)
      SELECT category, count(*) AS n, count(*) FILTER (epoch_us(f) - epoch_us(ts) > 3600000000) AS late_hour, count(*) FILTER (epoch_us(f) - epoch_us(ts) > 86400000000) AS late_day FROM m GROUP BY 1""",
    "job_state_latest": f"WITH {STATE} SELECT * FROM st",
    "job_counts": f"""WITH {STATE}, n AS (SELECT * FROM st ORDER BY started_at DESC NULLS LAST, job_id DESC LIMIT 1000)
      SELECT {', '.join(f"count(*) FILTER (status = '{s}') AS {s}" for s in o.STATUSES)}, count(*) AS total FROM n""",
    "log_line_numbers": f"WITH {J} SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS line_number FROM j",
    "feedback_latest_vote": """WITH t AS (SELECT * FROM test_feedback QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)
      SELECT page_section, llm_model, count(*) FILTER (vote = 'up') AS up, count(*) FILTER (vote = 'down') AS down, count(*) FILTER (vote IS NULL OR vote NOT IN ('up', 'down')) AS open, round(avg(query_elapsed_ms), 3) AS mean_ms FROM t GROUP BY ALL""",
    "feedback_recent": f"SELECT page_section, rank, id, vote FROM (SELECT *, row_number() OVER (PARTITION BY page_section ORDER BY ts DESC, id DESC) AS rank FROM {FB}) WHERE rank <= 50",
    "feedback_citations": f"WITH c AS (SELECT unnest(from_json(citations_json, '[{{\"req_id\":\"VARCHAR\"}}]')) AS c FROM {FB} WHERE citations_json IS NOT NULL) SELECT c.req_id AS req_id, count(*) AS n FROM c GROUP BY 1",
    "duration_text": f"""WITH t AS (SELECT llm_model, coalesce(sum(query_elapsed_ms), 0)::BIGINT // 1000 AS s FROM {FB} GROUP BY 1)
      SELECT llm_model, printf('%dh %02dm %02ds', s // 3600, (s % 3600) // 60, s % 60) AS total FROM t""",
}
