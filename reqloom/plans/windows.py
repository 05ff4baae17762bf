"""Queries and SQL of event-time windows and star-schema capabilities."""

from __future__ import annotations

from reqloom.operators import windows as w
from reqloom.streaming import streams as st

QUERIES = {
    "tumbling_counts": w.tumbling_counts,
    "sliding_counts": w.sliding_counts,
    "session_counts": w.session_counts,
    "stream_tumbling_counts": st.stream_tumbling_counts,
    "stream_latest_per_key": st.stream_latest_per_key,
    "stream_session_counts": st.stream_session_counts,
    "stream_dedup_counts": st.stream_dedup_counts,
    "stream_sliding_counts": st.stream_sliding_counts,
    "stream_log_lines": st.stream_log_lines,
    "cube_counts": w.event_cube,
    "eav_pivot": w.event_pivot,
    "asof_previous_order": w.asof_orders,
    "pricing_summary": w.pricing_summary,
    "regional_revenue": w.regional_revenue,
    "top_parts_per_brand": w.top_parts,
    "customers_without_orders": w.customers_without_orders,
    "set_operations": w.set_operations,
    "price_top_tenth": w.price_ntile,
}

_TUMBLE = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
_SESSION = """WITH g AS (SELECT user_id, ts, coalesce((ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT, 1) AS brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
      SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, sid"""
SQL = {
    "tumbling_counts": _TUMBLE,
    "sliding_counts": """WITH x AS (SELECT time_bucket(INTERVAL 20 MINUTE, ts, TIMESTAMP '1970-01-01') - i * INTERVAL 20 MINUTE AS start, value FROM events, unnest([0, 1, 2]) AS t(i))
      SELECT start, count(*) AS n, round(max(value), 4) AS high FROM x GROUP BY 1""",
    "session_counts": _SESSION,
    "stream_tumbling_counts": _TUMBLE,
    "stream_latest_per_key": "SELECT event_type, arg_max(value, {'t': ts, 'e': event_id}) AS value, max(ts) AS ts FROM events GROUP BY 1",
    "stream_session_counts": _SESSION,
    "stream_sliding_counts": """SELECT time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n FROM events, unnest(range(0, 4)) AS t(i) GROUP BY ALL""",
    "stream_log_lines": "SELECT user_id AS job_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_number FROM events",
    "stream_dedup_counts": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "cube_counts": "SELECT event_type, month, count(*) AS n, round(avg(value), 6) AS mean, grouping_id(event_type, month) AS gid FROM (SELECT *, strftime(ts, '%Y-%m') AS month FROM events) GROUP BY CUBE (event_type, month)",
    "eav_pivot": f"SELECT user_id, {', '.join(f'''nullif(count(value) FILTER (event_type = '{t}'), 0) AS {t}''' for t in ('click', 'error', 'purchase', 'signup', 'view'))} FROM events GROUP BY 1",
    "asof_previous_order": "SELECT o_orderkey, lag(o_orderkey) OVER w AS prev_order, datediff('day', lag(o_orderdate) OVER w, o_orderdate) AS days FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "regional_revenue": """SELECT r_name, year(o_orderdate) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_custkey) AS customers
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "top_parts_per_brand": """WITH q AS (SELECT p_brand, p_partkey, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
      SELECT p_brand, rank, p_partkey, round(qty, 2) AS qty FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY qty DESC, p_partkey) AS rank FROM q) WHERE rank <= 3""",
    "customers_without_orders": "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) GROUP BY 1",
    "set_operations": """WITH c AS (SELECT DISTINCT c_nationkey AS k FROM customer), s AS (SELECT DISTINCT s_nationkey AS k FROM supplier)
      SELECT k, 'both' AS side FROM (FROM c INTERSECT FROM s) UNION ALL SELECT k, 'customer' FROM (FROM c EXCEPT FROM s) UNION ALL SELECT k, 'supplier' FROM (FROM s EXCEPT FROM c)""",
    "price_top_tenth": """WITH p AS (SELECT p_size, floor(p_retailprice)::INT AS b FROM part), c AS (SELECT quantile_disc(b, 0.9) AS cut FROM p) SELECT p_size, count(*) AS n, count(*) FILTER (b >= cut) AS dear FROM p, c GROUP BY 1""",
}
