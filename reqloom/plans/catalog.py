"""Queries and SQL of extraction and catalogues."""

from __future__ import annotations

from reqloom.operators import catalog as c
from reqloom.plans.references import STD, release_sql
from reqloom.plans.structure import _DEPTH, _SECTIONS, REQS, SECS
from reqloom.plans.understanding import FEATURES, MONTH

QUERIES = {
    "cross_ref_extract": c.cross_refs,
    "spec_citations": c.spec_citations,
    "plan_release_map": c.plan_release_map,
    "spec_latest_version": c.latest_versions,
    "spec_version_candidates": c.version_candidates,
    "toc_build": c.tables_of_contents,
    "feature_edges": c.feature_edges,
    "plan_feature_ids": c.plan_features,
    "acronym_questions": c.acronym_questions,
    "stub_graph": c.stub_graph,
    "spec_ancestors": c.spec_ancestors,
    "busy_share_delta": c.busy_days,
    "profile_merge": c.profile_merge,
    "chunks_per_plan": c.chunks_per,
    "requirement_pair_compare": c.side_by_side,
    "priority_tally": c.priorities,
}

_B36 = "array_to_string(list_transform(string_split({v}, '.'), lambda p: substr('0123456789abcdefghijklmnopqrstuvwxyz', p::INT + 1, 1)), '')"
SQL = {
    "spec_citations": """WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, 'TS [0-9]{2}\\.[0-9]{3}(?: (?:clause|section|subclause) [0-9]+(?:\\.[0-9]+)*)?')) AS h FROM documents WHERE contains(text, 'TS ')),
      x AS (SELECT doc_id, regexp_extract(h, '([0-9]{2}\\.[0-9]{3})', 1) AS spec, regexp_extract(h, '(?:clause|section|subclause) ([0-9]+(?:\\.[0-9]+)*)$', 1) AS section FROM h)
      SELECT spec, section, count(*) AS n, count(DISTINCT doc_id) AS docs FROM x GROUP BY ALL""",
    "plan_release_map": """WITH p AS (SELECT plan_id, loaded_at, unnest(map_entries(referenced_standards_releases)) AS e FROM plans), g AS (SELECT plan_id, e.key AS spec, arg_max(e.value, {'a': loaded_at, 'b': e.value}) AS rel, count(DISTINCT e.value) AS n_releases FROM p GROUP BY ALL)
      SELECT plan_id, spec, coalesce(try_cast(nullif(regexp_extract(rel, '(?i)rel(?:ease)?[- ]?([0-9]+)', 1), '') AS INT), try_cast(trim(rel) AS INT), 0) AS release_num, n_releases FROM g""",
    "spec_latest_version": f"""WITH s AS (SELECT DISTINCT spec, release_num, version, spec_ingest_id, {_B36.replace('{v}', 'version')} AS code FROM spec_sections WHERE version IS NOT NULL)
      SELECT spec, release_num, arg_max(version, {{'a': code, 'b': spec_ingest_id}}) AS version, max(code) AS code, arg_max(spec_ingest_id, {{'a': code, 'b': spec_ingest_id}}) AS spec_ingest_id, count(*) AS n FROM s GROUP BY ALL""",
    "spec_version_candidates": f"""WITH {STD}, named AS (SELECT DISTINCT spec, {release_sql('spec_release')} AS release_num FROM std WHERE length(spec) >= 4),
      c AS (SELECT spec, release_num FROM named WHERE release_num BETWEEN 1 AND 21 UNION SELECT spec, 15 FROM spec_catalog WHERE spec IS NOT NULL)
      SELECT spec, release_num, 20 - m AS attempt, replace(spec, '.', '') || '-' || substr('0123456789abcdefghijklmnopqrstuvwxyz', release_num::INT + 1, 1) || substr('0123456789abcdefghijklmnopqrstuvwxyz', m::INT + 1, 1) || '0.zip' AS file
      FROM c, unnest(range(0, 21)) AS t(m)""",
    "toc_build": f"""WITH {_SECTIONS}, l AS (SELECT mno, release, plan_id, row_number() OVER (PARTITION BY mno, release, plan_id ORDER BY section_number) AS rn, repeat('  ', {_DEPTH} - 1) || section_number || ' ' || coalesce(title, '') AS line FROM sections)
      SELECT mno, release, plan_id, string_agg(CASE WHEN rn > 200 THEN '… (truncated)' ELSE line END, chr(10) ORDER BY rn) AS toc FROM l WHERE rn <= 201 GROUP BY ALL""",
    "feature_edges": f"""WITH {FEATURES}, q AS (SELECT DISTINCT plan_id, req_id FROM requirements WHERE req_id IS NOT NULL), e AS (SELECT req_id, feature_id, max(CASE WHEN is_primary THEN 'primary' ELSE 'referenced' END) AS mapping FROM q JOIN feats ON feats.plan_id = q.plan_id GROUP BY ALL)
      SELECT feature_id, mapping, count(*) AS n_reqs FROM e GROUP BY ALL""",
    "plan_feature_ids": f"WITH {FEATURES} SELECT plan_id, string_agg(feature_id, ',' ORDER BY CASE WHEN is_primary THEN 0 ELSE 1 END, feature_id) AS features FROM feats GROUP BY 1",
    "acronym_questions": f"""WITH q AS (SELECT DISTINCT id, lower(regexp_extract(question, '{c.ACRONYM}', 1)) AS term FROM test_feedback WHERE question IS NOT NULL)
      SELECT term, count(*) AS n FROM q WHERE term <> '' AND term IN (SELECT lower(string_split(title, ' ')[2]) FROM requirements WHERE string_split(title, ' ')[2] IS NOT NULL) GROUP BY 1""",
    "stub_graph": """WITH c AS (SELECT DISTINCT mno, release, plan_id FROM requirements)
      SELECT DISTINCT 'mno:' || mno AS src, 'release:' || mno || ':' || release AS dst, 'has_release' AS edge_type FROM c UNION SELECT 'release:' || mno || ':' || release, 'plan:' || mno || ':' || release || ':' || plan_id, 'contains_plan' FROM c""",
    "spec_ancestors": f"""WITH s AS (SELECT spec_ingest_id, number, coalesce(arg_min(title, sec_id), '') AS title FROM {SECS} WHERE number IS NOT NULL GROUP BY ALL),
      u AS (SELECT spec_ingest_id, number, i, array_to_string(list_slice(string_split(number, '.'), 1, i), '.') AS p FROM s, unnest(range(1, len(string_split(number, '.')) + 1)) AS t(i) WHERE regexp_full_match(number, '[0-9.]+'))
      SELECT u.spec_ingest_id, u.number, string_agg(s.title, ' / ' ORDER BY i) AS path FROM u JOIN s ON s.spec_ingest_id = u.spec_ingest_id AND s.number = u.p GROUP BY ALL""",
    "busy_share_delta": """WITH d AS (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (event_type = 'view') AS v FROM events GROUP BY 1), c AS (SELECT day, sum(n) OVER (ORDER BY day) AS total, sum(v) OVER (ORDER BY day) AS idle FROM d),
      x AS (SELECT day, total - lag(total) OVER (ORDER BY day) AS dt, idle - lag(idle) OVER (ORDER BY day) AS di FROM c) SELECT day, CASE WHEN dt IS NULL THEN NULL WHEN dt = 0 THEN 0.0 ELSE round((1 - di / dt) * 100, 1) END AS busy_pct FROM x""",
    "profile_merge": f"""WITH g AS (SELECT zone_type, count(*) FILTER (NOT created_at >= TIMESTAMP '2025-01-01') AS o, count(*) FILTER (created_at >= TIMESTAMP '2025-01-01') AS w FROM {REQS} WHERE zone_type IS NOT NULL GROUP BY 1)
      SELECT zone_type, o + w AS n, CASE WHEN o > 0 AND w > 0 THEN 'both' WHEN w > 0 THEN 'new' ELSE 'old' END AS origin FROM g""",
    "chunks_per_plan": """WITH r AS (SELECT req_id, arg_min(plan_id, rec_id) AS plan_id, arg_min(coalesce(zone_type, 'none'), rec_id) AS zone FROM requirements WHERE req_id IS NOT NULL GROUP BY 1)
      SELECT plan_id, zone, count(*) AS n, grouping_id(plan_id, zone) AS gid FROM r GROUP BY ROLLUP (plan_id, zone)""",
    "requirement_pair_compare": f"""WITH g AS (SELECT plan_id, section_number, arg_min(req_id, {{'a': {MONTH}, 'b': rec_id}}) AS first_req, arg_max(req_id, {{'a': {MONTH}, 'b': rec_id}}) AS last_req, arg_min(coalesce(text, ''), {{'a': {MONTH}, 'b': rec_id}}) AS a, arg_max(coalesce(text, ''), {{'a': {MONTH}, 'b': rec_id}}) AS b
        FROM requirements WHERE section_number IS NOT NULL GROUP BY ALL) SELECT plan_id, section_number, first_req, last_req, a = b AS same_text FROM g WHERE first_req <> last_req""",
    "priority_tally": f"SELECT CASE WHEN upper(trim(coalesce(priority, ''))) = '' THEN 'NONE' ELSE upper(trim(coalesce(priority, ''))) END AS priority, count(*) AS n FROM {REQS} GROUP BY 1",
}
