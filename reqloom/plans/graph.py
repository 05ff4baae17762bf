"""Queries and SQL of the property graph."""

from __future__ import annotations

from reqloom.functions.keys import sql_canonical_key as ck
from reqloom.functions.keys import sql_spec_key as sk
from reqloom.operators import graph as g
from reqloom.operators.understanding import DEPENDS
from reqloom.plans.references import STD, release_sql
from reqloom.plans.understanding import FEATURES

QUERIES = {
    "graph_nodes": g.nodes,
    "graph_edges": g.edges,
    "graph_stats": g.graph_stats,
    "in_degree_top10": g.in_degree_top,
    "graph_degrees": g.degrees,
    "plan_pair_shared_standards": g.shared_standards,
    "bfs_depth2": g.bfs_depth2,
    "graph_components": g.graph_components,
    "shortest_hops": g.hops_from,
    "cross_plan_edges": g.cross_plan_edges,
    "release_discovery": g.release_discovery,
    "focus_subgraph": g.focus_subgraph,
}

_DEPENDS = ", ".join(f"('feature:{a}', 'feature:{b}')" for a, b in DEPENDS)
GRAPH = f"""{STD}, {FEATURES}, reqs AS (SELECT req_id, {', '.join(f"arg_min({c}, rec_id) FILTER ({c} IS NOT NULL OR true) AS {c}" for c in ('mno', 'release', 'plan_id'))}, min_by(struct_pack(p := parent_req_id), rec_id).p AS parent_req_id FROM requirements WHERE req_id IS NOT NULL GROUP BY 1),
  srefs AS (SELECT DISTINCT s.ref_id, r.source_req_id, r.plan_id, 'std:' || s.spec || ':' || rel || CASE WHEN rel > 0 AND nullif(r.spec_section, '') IS NOT NULL THEN ':' || r.spec_section ELSE '' END AS std, 'std:' || s.spec || ':' || rel AS std_spec
    FROM (SELECT *, {release_sql('spec_release')} AS rel FROM std) s JOIN refs_standards r ON r.ref_id = s.ref_id WHERE s.spec IS NOT NULL),
  p AS (SELECT DISTINCT mno, release, plan_id FROM plans),
  nodes AS (SELECT DISTINCT 'mno:' || mno AS id, 'MNO' AS node_type, NULL::VARCHAR AS plan_id FROM p UNION ALL SELECT DISTINCT 'release:' || mno || ':' || release, 'Release', NULL FROM p
    UNION ALL SELECT 'plan:' || mno || ':' || release || ':' || plan_id, 'Plan', plan_id FROM p UNION ALL SELECT 'req:' || req_id, 'Requirement', plan_id FROM reqs
    UNION ALL SELECT DISTINCT 'feature:' || feature_id, 'Feature', NULL FROM feats
    UNION ALL (SELECT id, 'Standard', NULL FROM (SELECT std AS id FROM srefs UNION SELECT std_spec FROM srefs UNION SELECT 'std:' || {sk('spec')} || ':0' FROM spec_catalog))),
  keyed AS (SELECT 'req:' || req_id AS id, {ck('req_id')} AS k, plan_id FROM reqs),
  tree AS (SELECT q.id AS src, 'req:' || c.req_id AS dst FROM reqs c JOIN keyed q ON q.k = {ck('c.parent_req_id')} AND q.plan_id = c.plan_id),
  raw AS (SELECT 'mno:' || mno AS src, 'release:' || mno || ':' || release AS dst, 'has_release' AS edge_type, 1 AS step FROM p
    UNION ALL SELECT 'release:' || mno || ':' || release, 'plan:' || mno || ':' || release || ':' || plan_id, 'contains_plan', 1 FROM p
    UNION ALL SELECT 'req:' || r.req_id, 'plan:' || p.mno || ':' || p.release || ':' || p.plan_id, 'belongs_to', 2 FROM reqs r JOIN p ON p.mno = r.mno AND p.release = r.release AND p.plan_id = r.plan_id
    UNION ALL SELECT src, dst, 'parent_of', 3 FROM tree
    UNION ALL SELECT a.id, b.id, 'depends_on', 4 FROM (SELECT DISTINCT {ck('source_req_id')} AS s, {ck('target_req_id')} AS t FROM refs_internal) i JOIN keyed a ON a.k = s JOIN keyed b ON b.k = t WHERE s <> t
      AND NOT EXISTS (SELECT 1 FROM tree x WHERE (x.src = a.id AND x.dst = b.id) OR (x.src = b.id AND x.dst = a.id))
    UNION ALL SELECT a.id, f.dst, 'depends_on', 5 FROM (SELECT DISTINCT {ck('source_req_id')} AS s, {ck('target_plan_id')} AS t FROM refs_cross_plan) i JOIN keyed a ON a.k = s
      JOIN (SELECT {ck('plan_id')} AS k, min('plan:' || mno || ':' || release || ':' || plan_id) AS dst FROM p GROUP BY 1) f ON f.k = t
    UNION ALL SELECT DISTINCT a.id, std, 'references_standard', 6 FROM srefs s JOIN keyed a ON a.k = {ck('s.source_req_id')}
    UNION ALL SELECT DISTINCT std_spec, std, 'parent_section', 7 FROM srefs WHERE std <> std_spec
    UNION ALL SELECT DISTINCT 'req:' || q.req_id, 'feature:' || feature_id, 'maps_to', 8 FROM reqs q JOIN feats ON feats.plan_id = q.plan_id
    UNION ALL SELECT a, b, 'feature_depends_on', 9 FROM (VALUES {_DEPENDS}) d(a, b) WHERE a IN (SELECT 'feature:' || feature_id FROM feats) AND b IN (SELECT 'feature:' || feature_id FROM feats)),
  edges AS (SELECT src, dst, arg_max(edge_type, step) AS edge_type FROM raw GROUP BY ALL)"""
_BOTH = "adj AS (SELECT DISTINCT src AS id, dst AS nxt FROM edges {w} UNION SELECT DISTINCT dst, src FROM edges {w})"
_DEP = "WHERE edge_type IN ('parent_of', 'depends_on')"

SQL = {
    "graph_nodes": f"WITH {GRAPH} SELECT * FROM nodes",
    "graph_edges": f"WITH {GRAPH} SELECT * FROM edges",
    "graph_stats": f"WITH {GRAPH} SELECT 'node' AS what, node_type AS kind, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', edge_type, count(*) FROM edges GROUP BY ALL",
    "in_degree_top10": f"WITH {GRAPH} SELECT dst, count(*) AS n FROM edges WHERE edge_type = 'references_standard' GROUP BY 1 ORDER BY n DESC, dst LIMIT 10",
    "graph_degrees": f"WITH {GRAPH} SELECT id, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1",
    "plan_pair_shared_standards": f"""WITH {GRAPH}, m AS (SELECT DISTINCT std, plan_id, source_req_id FROM srefs)
      SELECT a.plan_id AS plan_a, b.plan_id AS plan_b, count(*) AS req_pairs, count(DISTINCT a.std) AS standards FROM m a JOIN m b ON a.std = b.std AND a.plan_id < b.plan_id GROUP BY ALL""",
    "bfs_depth2": f"""WITH {GRAPH}, {_BOTH.replace('{w}', _DEP)}, seeds AS (SELECT 'req:' || req_id AS seed FROM requirements WHERE req_id IS NOT NULL GROUP BY req_id HAVING min(rec_id) % 100 = 0),
      s1 AS (SELECT seed, nxt AS id FROM seeds JOIN adj ON adj.id = seed), s2 AS (SELECT seed, nxt AS id FROM s1 JOIN adj ON adj.id = s1.id),
      u AS (SELECT seed, seed AS id, 0 AS depth FROM seeds UNION ALL SELECT seed, id, 1 FROM s1 UNION ALL SELECT seed, id, 2 FROM s2)
      SELECT seed, id, min(depth) AS depth, round(pow(0.7, min(depth) + 1), 6) AS score FROM u GROUP BY ALL""",
    "graph_components": f"""WITH RECURSIVE {GRAPH}, {_BOTH.replace('{w}', _DEP)},
      reach AS (SELECT id, id AS root FROM (SELECT DISTINCT id FROM adj) UNION SELECT b.nxt, r.root FROM reach r JOIN adj b ON b.id = r.id),
      comp AS (SELECT id, min(root) AS c FROM reach GROUP BY 1), sizes AS (SELECT c, count(*) AS size FROM comp GROUP BY 1)
      SELECT size, count(*) AS components FROM sizes GROUP BY 1""",
    "shortest_hops": f"""WITH RECURSIVE {GRAPH}, {_BOTH.replace('{w}', '')}, starts AS (SELECT min('plan:' || mno || ':' || release || ':' || plan_id) AS id FROM plans),
      walk AS (SELECT id, 0 AS hops, [id] AS level, [id] AS seen FROM starts
        UNION ALL SELECT NULL, hops + 1, nxt, list_concat(seen, nxt) FROM (SELECT w.hops, w.seen, list(DISTINCT b.nxt) AS nxt FROM walk w, unnest(w.level) AS t(x) JOIN adj b ON b.id = x WHERE NOT list_contains(w.seen, b.nxt) GROUP BY ALL))
      SELECT id, hops FROM (SELECT DISTINCT unnest(level) AS id, hops FROM walk) WHERE id LIKE 'plan:%'""",
    "cross_plan_edges": f"""WITH {GRAPH} SELECT a.plan_id AS from_plan, b.plan_id AS to_plan, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes b ON b.id = e.dst
      WHERE edge_type = 'depends_on' AND a.plan_id <> b.plan_id GROUP BY ALL""",
    "release_discovery": """WITH p AS (SELECT DISTINCT mno, release, split_part(release, '_', 1) AS y, instr('jan feb mar apr may jun jul aug sep oct nov dec', lower(split_part(release, '_', -1))) AS m FROM plans)
      SELECT mno, string_agg(release, ',' ORDER BY release DESC) AS by_text, string_agg(release, ',' ORDER BY y DESC, m DESC, release DESC) AS by_month FROM p GROUP BY 1""",
    "focus_subgraph": f"WITH {GRAPH}, ins AS (SELECT id FROM nodes WHERE plan_id = (SELECT min(plan_id) FROM nodes WHERE node_type = 'Requirement')) SELECT * FROM edges WHERE src IN (FROM ins) AND dst IN (FROM ins)",
}
