"""Queries and SQL of the general data problems (references that point nowhere, hierarchies)."""

from __future__ import annotations

from reqloom.functions.keys import sql_canonical_key as ck
from reqloom.functions.keys import sql_spec_key as sk
from reqloom.functions.keys import sql_strip_space as ss
from reqloom.operators import hierarchy as h
from reqloom.operators import orphans as o

QUERIES = {
    "p1_found": o.p1_found,
    "p1_by_month": o.p1_by_month,
    "p6_found": h.p6_found,
    "p6_hierarchy": h.p6_hierarchy,
    "p6_intervals": h.p6_intervals,
    "p6_interval_check": h.p6_interval_check,
}

_REFS = f"""
refs AS (
  SELECT DISTINCT 'refs_internal' AS ref_table, ref_id, {ck('target_req_id')} AS k, recorded_at AS t FROM refs_internal
  UNION ALL SELECT DISTINCT 'refs_cross_plan', ref_id, {ck('target_plan_id')}, recorded_at FROM refs_cross_plan
  UNION ALL SELECT DISTINCT 'refs_standards', ref_id, {sk('spec')}, recorded_at FROM refs_standards
), parents AS (
  SELECT 'refs_internal' AS kind, {ck('req_id')} AS k, created_at AS s, deleted_at AS e FROM requirements
  UNION ALL SELECT 'refs_cross_plan', {ck('plan_id')}, loaded_at, withdrawn_at FROM plans
  UNION ALL SELECT 'refs_standards', {sk('spec')}, available_at, withdrawn_at FROM spec_catalog
), judged AS (
  SELECT r.ref_table, r.ref_id, r.t, count(p.k) AS n, coalesce(bool_or(p.s <= r.t AND (p.e IS NULL OR p.e > r.t)), false) AS alive,
         coalesce(bool_or(p.s <= r.t), false) AS begun
  FROM refs r LEFT JOIN parents p ON p.kind = r.ref_table AND p.k = r.k WHERE r.k IS NOT NULL GROUP BY ALL
), orphans AS (
  SELECT ref_table, ref_id, t, CASE WHEN n = 0 THEN 'missing' WHEN begun THEN 'deleted' ELSE 'late' END AS reason FROM judged WHERE NOT alive
)"""

_NODES = f"""
raw AS (
  SELECT DISTINCT 'requirement' AS hier, coalesce(plan_id, '') AS tree_key, req_id AS node_key, 'r/' || {ck('req_id')} AS id, 'r/' || {ck('parent_req_id')} AS pid FROM requirements
  UNION SELECT DISTINCT 'spec_section', spec_ingest_id::VARCHAR, number, 's/' || spec_ingest_id || '/' || number, 's/' || spec_ingest_id || '/' || {ss('parent_number')} FROM spec_sections
), nodes AS (
  SELECT hier, min(tree_key) AS tree_key, min(node_key) AS node_key, id, min(pid) AS pid FROM raw WHERE id IS NOT NULL GROUP BY hier, id
), tree AS (
  SELECT n.*, CASE WHEN p.id IS NULL THEN NULL ELSE n.pid END AS up, n.pid IS NOT NULL AND p.id IS NULL AS orphan
  FROM nodes n LEFT JOIN nodes p ON p.id = n.pid
), walk AS (
  SELECT id, node_key AS root_key, 0::BIGINT AS depth, node_key AS path, [id] AS ids FROM tree WHERE up IS NULL
  UNION ALL SELECT t.id, w.root_key, w.depth + 1, w.path || ' > ' || t.node_key, list_append(w.ids, t.id) FROM walk w JOIN tree t ON t.up = w.id
)"""

SQL = {
    "p1_found": f"WITH {_REFS} SELECT ref_table, ref_id, reason FROM orphans",
    "p1_by_month": f"""WITH {_REFS},
      total AS (SELECT ref_table, strftime(t, '%Y-%m') AS month, count(*) AS refs FROM refs WHERE k IS NOT NULL GROUP BY ALL),
      bad AS (SELECT ref_table, strftime(t, '%Y-%m') AS month, count(*) FILTER (reason = 'missing') AS missing, count(*) FILTER (reason = 'deleted') AS deleted,
              count(*) FILTER (reason = 'late') AS late FROM orphans GROUP BY ALL)
      SELECT t.ref_table, t.month, t.refs, coalesce(b.missing, 0) AS missing, coalesce(b.deleted, 0) AS deleted, coalesce(b.late, 0) AS late
      FROM total t LEFT JOIN bad b ON b.ref_table = t.ref_table AND b.month IS NOT DISTINCT FROM t.month""",
    "p6_found": f"""WITH RECURSIVE {_NODES},
      lost AS (SELECT * FROM tree WHERE id NOT IN (SELECT id FROM walk)),
      reach AS (SELECT id AS a, up AS b FROM lost UNION SELECT r.a, l.up FROM reach r JOIN lost l ON l.id = r.b)
      SELECT hier, tree_key, node_key, CASE WHEN EXISTS (SELECT 1 FROM reach WHERE a = lost.id AND b = lost.id) THEN 'cycle' ELSE 'into_cycle' END AS state FROM lost
      UNION ALL SELECT hier, tree_key, node_key, 'no_parent' FROM tree WHERE orphan
      UNION ALL SELECT t.hier, t.tree_key, t.node_key, 'deep' FROM tree t JOIN walk w ON w.id = t.id WHERE NOT t.orphan AND w.depth >= {h.DEEP}""",
    "p6_interval_check": f"""WITH RECURSIVE {_NODES} SELECT t.hier, min(t.tree_key) AS tree_key, w.root_key, count(*) AS n, true AS ok FROM walk w JOIN tree t ON t.id = w.id GROUP BY t.hier, w.ids[1], w.root_key""",
    "p6_hierarchy": f"""WITH RECURSIVE {_NODES}, below AS (SELECT unnest(ids) AS id, count(*) - 1 AS n FROM walk GROUP BY 1)
      SELECT t.hier, t.tree_key, t.node_key, w.root_key, w.depth, w.path, b.n AS n_descendants FROM walk w JOIN tree t ON t.id = w.id JOIN below b ON b.id = w.id""",
}
