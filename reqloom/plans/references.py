"""Queries and SQL of reference resolution."""

from __future__ import annotations

from reqloom.functions.keys import SPACES
from reqloom.functions.keys import sql_canonical_key as ck
from reqloom.functions.keys import sql_spec_key as sk
from reqloom.operators import references as r

QUERIES = {
    "ref_resolve_internal": r.resolve_internal,
    "ref_resolve_cross_plan": r.resolve_cross_plan,
    "ref_resolve_standards": r.resolve_standards,
    "ref_status_summary": r.status_summary,
    "ref_broken_targets": r.broken_targets,
    "ref_by_source": r.refs_of_requirement,
    "ref_latest_per_source": r.latest_reference_per_source,
    "ref_release_asof": r.release_of_section,
    "std_ref_index": r.standards_index,
}

_REL = "coalesce(try_cast(coalesce(nullif(regexp_extract({c}, '(?i)rel(?:ease)?[- ]?([0-9]+)', 1), ''), nullif(regexp_extract({c}, '^\\s*([0-9]+)\\s*$', 1), '')) AS INTEGER), 0)"


def release_sql(c: str) -> str:
    return _REL.replace("{c}", c)


# the three forms of a section citation, white space of any script
_S, _S0 = SPACES, f"(?:{SPACES})?"
_WORD, _NUM, _SPEC = "(?:[Ss]ection|(?:[Ss]ub)?[Cc]lause|§)", "([0-9]+(?:[.][0-9]+)*)", "([0-9][0-9.]*[0-9])"
_CITED = [
    (f"TS{_S}{_SPEC}{_S0},?{_S0}{_WORD}{_S}{_NUM}", 1, 2),
    (f"{_WORD}{_S}{_NUM}{_S}of{_S}(?:3GPP{_S})?TS{_S}{_SPEC}", 2, 1),
    (f"TS{_S}{_SPEC}{_S0}[(]?{_S0}(?:reference{_S0})?[[][0-9]+[]]{_S0}[)]?{_S0},?{_S0}{_WORD}{_S}{_NUM}", 1, 2),
]

INTERNAL = f"""internal AS (
  WITH refs AS (SELECT DISTINCT ref_id, mno, release, plan_id, {ck('target_req_id')} AS k FROM refs_internal),
  reqs AS (SELECT DISTINCT mno, release, plan_id, rec_id, {ck('req_id')} AS k, section_number, title FROM requirements),
  here AS (SELECT mno, release, plan_id, k, arg_min({{'s': section_number, 't': title}}, rec_id) AS h FROM reqs WHERE k IS NOT NULL GROUP BY ALL),
  anyw AS (SELECT k, arg_max({{'p': plan_id, 's': section_number, 't': title}}, rec_id) AS a FROM reqs WHERE k IS NOT NULL GROUP BY ALL)
  SELECT ref_id, refs.plan_id, CASE WHEN h IS NOT NULL OR a IS NOT NULL THEN 'resolved' ELSE 'broken' END AS status, coalesce(h.s, a.s) AS target_section,
    CASE WHEN h IS NOT NULL THEN h.t WHEN a IS NOT NULL THEN '[actually in ' || a.p || '] ' || coalesce(a.t, '') END AS target_title
  FROM refs LEFT JOIN here ON here.mno = refs.mno AND here.release = refs.release AND here.plan_id = refs.plan_id AND here.k = refs.k LEFT JOIN anyw ON anyw.k = refs.k)"""
CROSS = f"""crossp AS (
  WITH refs AS (SELECT DISTINCT ref_id, plan_id, {ck('target_plan_id')} AS k FROM refs_cross_plan),
  p AS (SELECT DISTINCT {ck('plan_id')} AS k FROM plans), n AS (SELECT {ck('plan_id')} AS k, count(DISTINCT req_id) AS n FROM requirements WHERE req_id <> '' GROUP BY 1)
  SELECT ref_id, plan_id, CASE WHEN p.k IS NULL THEN 'unresolved' ELSE 'resolved' END AS status, CASE WHEN p.k IS NULL THEN 0 ELSE coalesce(n.n, 0) END AS n_targets
  FROM refs LEFT JOIN p ON p.k = refs.k LEFT JOIN n ON n.k = refs.k)"""
STD = f"""std AS (
  WITH refs AS (SELECT DISTINCT ref_id, mno, release, plan_id, {sk('spec')} AS k, nullif(spec_release, '') AS inl FROM refs_standards),
  p AS (SELECT mno, release, plan_id, arg_max(referenced_standards_releases, loaded_at) AS m FROM plans GROUP BY ALL),
  j AS (SELECT ref_id, refs.plan_id, k, inl, nullif(m[k], '') AS doc FROM refs LEFT JOIN p ON p.mno = refs.mno AND p.release = refs.release AND p.plan_id = refs.plan_id)
  SELECT ref_id, plan_id, k AS spec, coalesce(inl, doc, '') AS spec_release, CASE WHEN inl IS NOT NULL THEN 'inline' WHEN doc IS NOT NULL THEN 'doc_level' ELSE '' END AS release_source,
    CASE WHEN inl IS NULL AND doc IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM j)"""

SQL = {
    "ref_resolve_internal": f"WITH {INTERNAL} SELECT * FROM internal",
    "ref_resolve_cross_plan": f"WITH {CROSS} SELECT * FROM crossp",
    "ref_resolve_standards": f"WITH {STD} SELECT * FROM std",
    "ref_status_summary": f"""WITH {INTERNAL}, {CROSS}, {STD}, u AS (SELECT plan_id, 'internal' AS kind, status FROM internal UNION ALL SELECT plan_id, 'cross', status FROM crossp UNION ALL SELECT plan_id, 'std', status FROM std)
      SELECT plan_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}_total, count(*) FILTER (kind = '{k}' AND status = 'resolved') AS {k}_resolved, count(*) FILTER (kind = '{k}' AND status = '{b}') AS {k}_{b}" for k, b in (('internal', 'broken'), ('cross', 'unresolved'), ('std', 'unresolved')))}
      FROM u GROUP BY plan_id""",
    "ref_broken_targets": f"""WITH refs AS (SELECT DISTINCT ref_id, {ck('target_req_id')} AS target FROM refs_internal)
      SELECT target, count(*) AS n_refs FROM refs WHERE target IS NOT NULL AND target NOT IN (SELECT {ck('req_id')} FROM requirements WHERE {ck('req_id')} IS NOT NULL) GROUP BY 1""",
    "ref_by_source": f"""WITH u AS ({' UNION ALL '.join(f"SELECT DISTINCT ref_id, '{k}' AS kind, source_req_id FROM {k}" for k in ('refs_internal', 'refs_cross_plan', 'refs_standards'))})
      SELECT source_req_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ('refs_internal', 'refs_cross_plan', 'refs_standards'))} FROM u GROUP BY 1""",
    "ref_latest_per_source": "SELECT source_req_id, arg_max(ref_id, {'a': recorded_at, 'b': ref_id}) AS ref_id, max(recorded_at) AS recorded_at FROM refs_internal GROUP BY 1",
    "ref_release_asof": """WITH refs AS (SELECT DISTINCT ref_id, plan_id, recorded_at FROM refs_internal)
      SELECT ref_id, r.plan_id, arg_max(p.release, {'a': p.loaded_at, 'b': p.release}) AS plan_release FROM refs r LEFT JOIN plans p ON p.plan_id = r.plan_id AND p.loaded_at <= r.recorded_at GROUP BY ALL""",
    "std_ref_index": f"""WITH {STD}, refs AS (SELECT plan_id, spec, {release_sql('spec_release')} AS release_num, 1 AS manifest, NULL AS section FROM std WHERE length(spec) >= 4),
      cited AS (SELECT plan_id, spec, max(release_num) AS release_num FROM refs WHERE release_num > 0 GROUP BY ALL),
      reqs AS (SELECT DISTINCT rec_id, plan_id, text FROM requirements WHERE contains(text, 'TS')),
      found AS ({' UNION ALL '.join(f"SELECT plan_id, unnest(regexp_extract_all(text, '{p}', {i})) AS spec, unnest(regexp_extract_all(text, '{p}', {j})) AS section FROM reqs" for p, i, j in _CITED)}),
      u AS (SELECT * FROM refs UNION ALL SELECT f.plan_id, f.spec, coalesce(c.release_num, 0), 0, f.section FROM found f LEFT JOIN cited c ON c.plan_id = f.plan_id AND c.spec = f.spec WHERE length(f.spec) >= 4)
      SELECT spec, release_num, sum(manifest) AS ref_count, count(*) AS total_refs, coalesce(array_to_string(list_sort(list(DISTINCT section)), ','), '') AS sections,
        array_to_string(list_sort(list(DISTINCT plan_id)), ',') AS plans FROM u GROUP BY ALL""",
}
