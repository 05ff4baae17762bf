"""Queries and SQL of section trees and chunks."""

from __future__ import annotations

from reqloom.operators import structure as s

QUERIES = {
    "parent_selfjoin": s.parent_links,
    "hierarchy_path": s.hierarchy_paths,
    "applicability_inherit": s.applicability,
    "table_row_explode": s.table_rows,
    "markdown_table": s.markdown_tables,
    "children_titles": s.children_titles,
    "chunk_text_build": s.chunk_texts,
    "glossary_chunks": s.glossary_chunks,
    "definitions_first_expand": s.definitions_expanded,
    "spec_parent_link": s.spec_parent_links,
    "section_neighbourhood": s.section_neighbourhood,
    "spec_text_share": s.spec_text_share,
    "section_depth_stats": s.section_depths,
    "confidence_audit": s.confidence_rubric,
    "zone_first_seen": s.zone_first_seen,
}


def once(name: str, key: str) -> str:
    return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY ingested_at) = 1)"


REQS, SECS = once("requirements", "rec_id"), once("spec_sections", "sec_id")
_SECTIONS = "sections AS (SELECT mno, release, plan_id, section_number, min(rec_id) AS rec_id, arg_min(req_id, rec_id) AS req_id, arg_min(title, rec_id) AS title, arg_min(coalesce(applicability, []), rec_id) AS applicability FROM requirements WHERE section_number IS NOT NULL GROUP BY ALL)"
_UP = "CASE WHEN contains({c}, '.') THEN regexp_replace({c}, '\\.[^.]+$', '') END"
_SAME = "p.mno = s.mno AND p.release = s.release AND p.plan_id = s.plan_id"
_LINE = "('| ' || array_to_string(list_transform({c}, lambda x: coalesce(x, '')), ' | ') || ' |')"


def _line(c: str) -> str:
    return _LINE.replace("{c}", c)


def markdown(t: str) -> str:
    """The SQL twin of text.markdown_table for a struct with headers and rows."""
    fit = f"list_transform({t}.rows, lambda r: list_slice(list_concat(r, list_transform({t}.headers, lambda h: '')), 1, len({t}.headers)))"
    return f"""CASE WHEN coalesce(len({t}.rows), 0) = 0 THEN NULL
      WHEN coalesce(len({t}.headers), 0) = 0 THEN array_to_string(list_transform({t}.rows, lambda r: {_line('r')}), chr(10))
      WHEN len(list_filter({t}.headers, lambda h: trim(coalesce(h, '')) <> '')) = 0 THEN array_to_string(list_transform({t}.rows, lambda r: '[Table: ' || array_to_string(list_transform(r, lambda x: coalesce(x, '')), ' | ') || ']'), chr(10))
      ELSE {_line(f'{t}.headers')} || chr(10) || {_line(f"list_transform({t}.headers, lambda h: '---')")} || chr(10) || array_to_string(list_transform({fit}, lambda r: {_line('r')}), chr(10)) END"""


def _expanded(c: str) -> str:
    for term, expansion in sorted(s.GLOSSARY, key=lambda x: -len(x[0])):
        c = f"regexp_replace({c}, '\\b{term}\\b', '{term} ({expansion})')"
    return c


_DEPTH = "len(string_split(section_number, '.'))"
_SPECUP = _UP.replace("{c}", "regexp_replace(number, '[A-Za-z]+$', '')")
_NEAR = f"""secs AS (SELECT DISTINCT spec_ingest_id, spec, number, {_UP.replace('{c}', 'number')} AS up FROM spec_sections WHERE number IS NOT NULL),
  cited AS (SELECT DISTINCT spec_ingest_id, number, up FROM secs JOIN (SELECT DISTINCT regexp_extract(spec, '[0-9]+\\.[0-9]+') AS rs, spec_section FROM refs_standards WHERE spec_section <> '') ON rs = spec AND spec_section = number),
  wanted AS (SELECT spec_ingest_id, up AS number FROM cited UNION SELECT spec_ingest_id, {_UP.replace('{c}', 'up')} FROM cited
    UNION SELECT s.spec_ingest_id, s.number FROM secs s JOIN cited c ON c.spec_ingest_id = s.spec_ingest_id AND s.up = c.number
    UNION SELECT s.spec_ingest_id, s.number FROM secs s JOIN cited c ON c.spec_ingest_id = s.spec_ingest_id AND s.up = c.up UNION SELECT spec_ingest_id, '3.1' FROM cited),
  near AS (SELECT spec_ingest_id, number, 'cited' AS role FROM cited
    UNION ALL SELECT w.spec_ingest_id, w.number, 'context' FROM wanted w WHERE EXISTS (SELECT 1 FROM secs s WHERE s.spec_ingest_id = w.spec_ingest_id AND s.number = w.number)
      AND NOT EXISTS (SELECT 1 FROM cited c WHERE c.spec_ingest_id = w.spec_ingest_id AND c.number = w.number))"""
_CONF = f"CASE WHEN section_number IS NULL OR trim(coalesce(title, '')) = '' OR {_DEPTH} >= 10 THEN 'LOW' WHEN length(trim(title)) > 120 OR {_DEPTH} >= 7 OR regexp_matches(trim(title), '[.!?]$') THEN 'MEDIUM' ELSE 'HIGH' END"

SQL = {
    "parent_selfjoin": f"""WITH {_SECTIONS}, s AS (SELECT *, {_UP.replace('{c}', 'section_number')} AS up FROM sections)
      SELECT s.rec_id, s.req_id, CASE WHEN p.req_id IS NOT NULL THEN s.up END AS parent_section, p.req_id AS parent_req_id,
        (SELECT count(*) FROM s c WHERE c.mno = s.mno AND c.release = s.release AND c.plan_id = s.plan_id AND c.up = s.section_number) AS n_children
      FROM s LEFT JOIN s p ON {_SAME} AND p.section_number = s.up""",
    "hierarchy_path": f"""WITH {_SECTIONS}, up AS (SELECT rec_id, mno, release, plan_id, i, array_to_string(list_slice(string_split(section_number, '.'), 1, i), '.') AS prefix FROM sections, unnest(range(1, {_DEPTH} + 1)) AS t(i))
      SELECT s.rec_id, string_agg(coalesce(nullif(trim(p.title), ''), p.section_number), ' > ' ORDER BY s.i) AS path FROM up s JOIN sections p ON {_SAME} AND p.section_number = s.prefix GROUP BY 1""",
    "applicability_inherit": f"""WITH {_SECTIONS}, up AS (SELECT rec_id, mno, release, plan_id, i, array_to_string(list_slice(string_split(section_number, '.'), 1, i), '.') AS prefix FROM sections, unnest(range(1, {_DEPTH} + 1)) AS t(i)),
      got AS (SELECT s.rec_id, arg_max(p.applicability, s.i) AS labels FROM up s JOIN sections p ON {_SAME} AND p.section_number = s.prefix AND len(p.applicability) > 0 GROUP BY 1)
      SELECT s.rec_id, coalesce(array_to_string(labels, ','), 'all') AS labels FROM sections s LEFT JOIN got USING (rec_id)""",
    "table_row_explode": f"""WITH t AS (SELECT rec_id, i - 1 AS table_no, tables[i] AS t FROM {REQS}, unnest(range(1, len(tables) + 1)) AS x(i)),
      r AS (SELECT rec_id, table_no, j - 1 AS row_no, t.headers AS h, t.rows[j] AS c FROM t, unnest(range(1, len(t.rows) + 1)) AS x(j))
      SELECT rec_id, table_no, row_no, array_to_string(list_filter(list_transform(range(1, greatest(len(h), len(c)) + 1), lambda k: CASE WHEN trim(coalesce(c[k], '')) <> '' THEN CASE WHEN trim(coalesce(h[k], '')) <> '' THEN trim(h[k]) || ': ' || trim(c[k]) ELSE trim(c[k]) END END), lambda x: x IS NOT NULL), '; ') AS row_text FROM r""",
    "markdown_table": f"WITH x AS (SELECT rec_id, i - 1 AS table_no, tables[i] AS t FROM {REQS}, unnest(range(1, len(tables) + 1)) AS x(i)) SELECT rec_id, table_no, {markdown('t')} AS markdown FROM x",
    "children_titles": f"""WITH r AS {REQS}, k AS (SELECT rec_id, plan_id, i, children[i] AS req_id FROM r, unnest(range(1, len(children) + 1)) AS x(i)), n AS (SELECT plan_id, req_id, arg_min(title, rec_id) AS title FROM r GROUP BY ALL)
      SELECT rec_id, string_agg(title, '; ' ORDER BY i) AS child_titles FROM k JOIN n ON n.plan_id = k.plan_id AND n.req_id = k.req_id GROUP BY 1""",
    "chunk_text_build": f"""WITH c AS (SELECT 'req:' || req_id AS chunk_id, rec_id, concat_ws(chr(10), '[MNO: ' || mno || ' | Release: ' || release || ' | Plan: ' || plan_id || ']', '[Section: ' || nullif(trim(section_number), '') || ']', '[Req ID: ' || req_id || ']',
        chr(10) || nullif(trim(title), ''), nullif(trim(text), ''), nullif(trim(array_to_string(list_filter(list_transform(tables, lambda t: {markdown('t')}), lambda x: x IS NOT NULL), chr(10))), '')) AS text FROM {REQS} WHERE req_id IS NOT NULL)
      SELECT chunk_id, arg_max(text, {{'a': length(text), 'b': -rec_id}}) AS text, count(*) AS n_versions FROM c GROUP BY 1""",
    "glossary_chunks": "SELECT 'glossary:specs:' || coalesce(nullif(trim(regexp_replace(spec, '[^A-Za-z0-9_-]', '_', 'g'), '_'), ''), 'term') AS chunk_id, '[Glossary]' || chr(10) || spec || ': ' || title AS text, spec AS acronym, title AS expansion FROM spec_catalog",
    "definitions_first_expand": f"SELECT rec_id, {_expanded('text')} AS text FROM {REQS} WHERE text IS NOT NULL",
    "spec_parent_link": f"""WITH s AS (SELECT sec_id, spec_ingest_id, number, CASE WHEN NOT starts_with(number, 'Annex') THEN {_SPECUP} END AS up FROM {SECS} WHERE number IS NOT NULL)
      SELECT sec_id, CASE WHEN EXISTS (SELECT 1 FROM s p WHERE p.spec_ingest_id = s.spec_ingest_id AND p.number = s.up) THEN up END AS parent FROM s""",
    "section_neighbourhood": f"WITH {_NEAR} SELECT * FROM near",
    "spec_text_share": f"""WITH {_NEAR}, n AS (SELECT spec_ingest_id, number, sum(coalesce(length(text), 0)) AS n FROM {SECS} GROUP BY ALL)
      SELECT n.spec_ingest_id, round(sum(CASE WHEN c.number IS NOT NULL THEN n.n ELSE 0 END) * 100.0 / nullif(sum(n.n), 0), 4) AS share_pct FROM n LEFT JOIN near c ON c.role = 'cited' AND c.spec_ingest_id = n.spec_ingest_id AND c.number = n.number GROUP BY 1""",
    "section_depth_stats": f"SELECT plan_id, count(*) AS n_reqs, count(DISTINCT section_number) AS n_sections, max({_DEPTH}) AS max_depth FROM {REQS} GROUP BY 1",
    "confidence_audit": f"""SELECT coalesce(plan_id, '(all)') AS plan_id, count(*) FILTER (c = 'HIGH') AS high, count(*) FILTER (c = 'MEDIUM') AS medium, count(*) FILTER (c = 'LOW') AS low, count(*) AS total, round(count(*) FILTER (c = 'HIGH') * 100.0 / count(*), 4) AS high_pct
      FROM (SELECT plan_id, {_CONF} AS c FROM {REQS}) GROUP BY ROLLUP (plan_id)""",
    "zone_first_seen": f"""WITH {_SECTIONS}, z AS (SELECT *, array_to_string(list_slice(string_split(section_number, '.'), 1, 2), '.') AS section, CASE WHEN regexp_matches(lower(coalesce(title, '')), 'timer|wait|retry') THEN 'timing' WHEN regexp_matches(lower(coalesce(title, '')), 'message|request|notice') THEN 'messaging'
        WHEN regexp_matches(lower(coalesce(title, '')), 'storage|cleanup|counter') THEN 'storage' ELSE 'content' END AS zone FROM sections WHERE {_DEPTH} >= 2)
      SELECT mno, release, plan_id, section, arg_min(zone, rec_id) AS zone, min(rec_id) AS rec_id FROM z GROUP BY ALL""",
}
