"""Queries and SQL of question understanding, taxonomy and evaluation."""

from __future__ import annotations

from reqloom.operators import understanding as u

QUERIES = {
    "query_type_classify": u.classify,
    "query_policy": u.policy,
    "release_match": u.release_match,
    "citation_extract": u.citations,
    "keyword_features": u.feature_hits,
    "feature_consolidate": u.taxonomy,
    "feature_mno_coverage": u.mno_coverage,
    "taxonomy_diff": u.taxonomy_diff,
    "score_questions": u.score_questions,
    "category_rollup": u.category_rollup,
    "ab_compare": u.ab_compare,
    "verdicts": u.verdicts,
    "ab_runs": u.ab_runs,
    "target_checks": u.target_checks,
    "set_diff_report": u.set_diff,
}


def any_(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def hits(c: str, words: list[str]) -> str:
    return f"list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains({c}, w))"


Q = "q AS (SELECT * FROM test_feedback QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at) = 1)"
_NM = "(" + " + ".join(f"regexp_matches(c, '\\b({'|'.join(a)})\\b')::INT" for a in u.MNOS.values()) + ")"
_IDS = "list_transform(regexp_extract_all({c}, '[A-Z]{2}_REQ_[A-Z0-9]+_[0-9]+'), lambda x: trim(regexp_replace(x, '\\s+', '_', 'g'), '_'))"
_UNIQ = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"


def uniq(l: str) -> str:  # noqa: E741
    return _UNIQ.replace("{l}", l)


# the type of a question: c is its lower-case text, p the plans that it names
TYPE_CASE = f"""CASE WHEN {_NM} >= 2 OR (contains(c, 'compare') AND {_NM} >= 1) THEN 'cross_mno_comparison'
    WHEN regexp_matches(c, '{u.STANDARD}') AND {any_('c', u.COMPARE_WORDS)} THEN 'standards_comparison'
    WHEN len(regexp_extract_all(c, '20[0-9]{{2}}_[a-z]{{3}}')) >= 2 OR {any_('c', u.RELEASE_WORDS)} THEN 'release_diff'
    WHEN {any_('c', u.TRACE_WORDS)} THEN 'traceability' WHEN {any_('c', u.FEATURE_WORDS)} THEN 'feature_level'
    WHEN {any_('c', u.CROSS_WORDS + u.LIST_WORDS)} OR len(p) >= 2 THEN 'cross_doc' WHEN len(p) >= 1 THEN 'single_doc' ELSE 'general' END"""
TYPES = f"""{Q}, cq AS (SELECT id, question, lower(question) AS c, list_distinct(regexp_extract_all(question, '[A-Z]{{2}}_REQ_([A-Z]+)_[0-9]+', 1)) AS p FROM q WHERE question IS NOT NULL),
  typed AS (SELECT id, {TYPE_CASE} AS query_type,
    array_to_string({hits('c', u.CONCEPTS)}, ',') AS concepts, array_to_string({uniq("regexp_extract_all(question, '\\b[A-Z]{5}_[A-Z]{4}_[A-Z]{4}\\b')")}, ',') AS entities FROM cq)"""
MONTH = "{'y': split_part(release, '_', 1), 'm': instr('jan feb mar apr may jun jul aug sep oct nov dec', lower(split_part(release, '_', -1))), 'r': release}"
_LOW = "lower(concat_ws(' ', title, text))"
_FEATS = " UNION ALL ".join(f"SELECT plan_id, release, mno, '{f}' AS feature_id, '{n}' AS name, unnest({hits('low', kw)}) AS keyword FROM r" for f, n, kw in u.FEATURES)
FEATURES = f"""r AS (SELECT plan_id, release, mno, {_LOW} AS low FROM (SELECT * FROM requirements QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY ingested_at) = 1) WHERE text IS NOT NULL),
  fx AS ({_FEATS}), feats AS (SELECT plan_id, feature_id, name, array_to_string(list_sort(list(DISTINCT keyword)), ',') AS keywords, round(least(0.5 + 0.15 * count(DISTINCT keyword), 0.95), 4) AS confidence, count(DISTINCT keyword) >= 2 AS is_primary FROM fx GROUP BY ALL)"""
_SHARE = "CASE WHEN len({a}) = 0 THEN 1.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len({a}) END"
_PLANS = "list_distinct(list_transform({c}, lambda i: coalesce(string_split(i, '_')[3], '')))"
SCORES = f"""{Q}, x AS (SELECT id, page_section, llm_model, list_distinct(list_filter(coalesce(list_transform(from_json(citations_json, '[{{"req_id":"VARCHAR"}}]'), lambda c: c.req_id), []), lambda c: c IS NOT NULL)) AS e,
    list_distinct({_IDS.replace('{c}', "coalesce(answer, '')")}) AS f, contains(coalesce(answer, ''), '3GPP TS') AS std FROM q),
  bad AS (SELECT DISTINCT id FROM (SELECT id, unnest(f) AS r FROM x) WHERE r NOT IN (SELECT req_id FROM requirements WHERE req_id IS NOT NULL)),
  s0 AS (SELECT id, page_section, llm_model, {_SHARE.replace('{a}', _PLANS.replace('{c}', 'e')).replace('{b}', _PLANS.replace('{c}', 'f'))} AS completeness, {_SHARE.replace('{a}', 'e').replace('{b}', 'f')} AS accuracy,
    CASE WHEN len(f) = 0 THEN 0.0 WHEN len(list_intersect(e, f)) > 0 THEN 1.0 ELSE 0.5 END AS citation, CASE WHEN std THEN 1.0 ELSE 0.0 END AS standards, CASE WHEN id IN (SELECT id FROM bad) THEN 0.0 ELSE 1.0 END AS grounded FROM x),
  scores AS (SELECT *, round((0.30 * completeness + 0.25 * accuracy + 0.20 * citation + 0.15 * standards + 0.10 * grounded)::DOUBLE, 6) AS overall FROM s0)"""

SQL = {
    "query_type_classify": f"WITH {TYPES} SELECT * FROM typed",
    "query_policy": f"""WITH {TYPES} SELECT query_type, count(*) AS n, CASE WHEN query_type IN ('cross_doc', 'cross_mno_comparison', 'standards_comparison', 'feature_level') THEN 25 WHEN query_type IN ('traceability', 'release_diff') THEN 20 ELSE 10 END AS top_k,
      CASE WHEN query_type IN ('standards_comparison', 'traceability', 'single_doc') THEN 0.5 ELSE 0.0 END AS bm25_weight FROM typed GROUP BY 1""",
    "release_match": """WITH w AS (SELECT DISTINCT mno, coalesce(lower(release), 'latest') AS wish FROM documents WHERE mno IS NOT NULL), p AS (SELECT DISTINCT mno, release FROM plans),
      j AS (SELECT w.mno, wish, release, CASE WHEN wish IN ('latest', 'current') THEN 9 WHEN lower(release) = wish THEN 1 WHEN contains(lower(release), wish) THEN 2 WHEN len(list_filter(string_split(wish, '_'), lambda x: contains(lower(release), x))) > 0 THEN 3 ELSE 9 END AS rule,
        split_part(release, '_', 1) AS y, instr('jan feb mar apr may jun jul aug sep oct nov dec', lower(split_part(release, '_', -1))) AS m FROM w JOIN p ON p.mno = w.mno)
      SELECT mno, wish, release, rule FROM (SELECT *, row_number() OVER (PARTITION BY mno, wish ORDER BY rule, y DESC, m DESC, release DESC) AS rn FROM j) WHERE rn = 1""",
    "citation_extract": f"""WITH {Q} SELECT id, array_to_string({uniq(_IDS.replace('{c}', 'answer'))}, ',') AS req_ids, array_to_string({uniq("regexp_extract_all(answer, 'TS ([0-9]{2}\\.[0-9]{3})', 1)")}, ',') AS specs, length(answer) // 4 AS tokens FROM q WHERE answer IS NOT NULL""",
    "keyword_features": f"WITH {FEATURES} SELECT plan_id, feature_id, name, keywords, confidence, is_primary FROM feats",
    "feature_consolidate": f"""WITH {FEATURES}, k AS (SELECT feature_id, array_to_string(list_sort(list(DISTINCT keyword)), ',') AS keywords FROM fx GROUP BY 1)
      SELECT f.feature_id, min(name) AS name, coalesce(array_to_string(list_sort(list(DISTINCT plan_id) FILTER (is_primary)), ','), '') AS primary_in, coalesce(array_to_string(list_sort(list(DISTINCT plan_id) FILTER (NOT is_primary)), ','), '') AS referenced_in,
        any_value(k.keywords) AS keywords, count(*) FILTER (is_primary) AS n_primary FROM feats f JOIN k ON k.feature_id = f.feature_id GROUP BY 1""",
    "feature_mno_coverage": f"""WITH {FEATURES}, p AS (SELECT DISTINCT mno, plan_id FROM requirements), c AS (SELECT feature_id, mno, array_to_string(list_sort(list(DISTINCT p.plan_id)), ',') AS plans FROM feats f JOIN p ON p.plan_id = f.plan_id GROUP BY ALL)
      SELECT feature_id, array_to_string(list_sort(list(mno || '=' || plans)), ';') AS coverage FROM c GROUP BY 1""",
    "taxonomy_diff": f"""WITH {FEATURES}, e AS (SELECT arg_min(release, {MONTH}) AS lo, arg_max(release, {MONTH}) AS hi FROM fx), a AS (SELECT DISTINCT feature_id, keyword FROM fx, e WHERE release = lo), b AS (SELECT DISTINCT feature_id, keyword FROM fx, e WHERE release = hi)
      SELECT coalesce(a.feature_id, b.feature_id) AS feature_id, coalesce(a.keyword, b.keyword) AS keyword, CASE WHEN a.keyword IS NULL THEN 'added' WHEN b.keyword IS NULL THEN 'removed' ELSE 'kept' END AS change
      FROM a FULL JOIN b ON a.feature_id = b.feature_id AND a.keyword = b.keyword""",
    "score_questions": f"WITH {SCORES} SELECT * FROM scores",
    "category_rollup": f"WITH {SCORES} SELECT page_section, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('completeness', 'accuracy', 'citation', 'standards', 'grounded', 'overall'))}, grouping(page_section)::INT AS is_total FROM scores GROUP BY ROLLUP (page_section)",
    "ab_compare": f"WITH {SCORES} SELECT page_section, count(*) FILTER (completeness > accuracy) AS a_wins, count(*) FILTER (completeness < accuracy) AS b_wins, count(*) FILTER (completeness = accuracy) AS ties, round(avg(completeness - accuracy), 6) AS delta FROM scores GROUP BY 1",
    "ab_runs": f"""WITH a AS (WITH {SCORES} SELECT id, page_section, overall AS a FROM scores), b AS (WITH {SCORES.replace("coalesce(answer, '')", "coalesce(question, '')")} SELECT id, overall AS b FROM scores),
      j AS (SELECT page_section, a, b, a - b AS d FROM a JOIN b ON b.id = a.id)
      SELECT page_section, count(*) AS n, count(*) FILTER (d > 0) AS a_wins, count(*) FILTER (d < 0) AS b_wins, count(*) FILTER (d = 0) AS ties, round(avg(d), 6) AS delta, grouping(page_section)::INT AS is_total FROM j GROUP BY ROLLUP (page_section)""",
    "target_checks": f"""WITH {SCORES}, pl AS (SELECT id, len(list_distinct(list_transform(e, lambda i: coalesce(string_split(i, '_')[3], '')))) AS plans FROM x),
      m AS (SELECT llm_model, avg(completeness) FILTER (plans >= 2) AS completeness, avg(accuracy) AS accuracy, avg(citation) AS citation, avg(standards) AS standards, avg(grounded) AS grounded FROM scores s LEFT JOIN pl ON pl.id = s.id GROUP BY 1),
      t AS (UNPIVOT m ON completeness, accuracy, citation, standards, grounded INTO NAME target VALUE mean)
      SELECT m.llm_model, k.target, round(t.mean, 6) AS mean, k.wanted, CASE WHEN k.wanted = 1.0 THEN t.mean >= 1.0 ELSE t.mean > k.wanted END AS met FROM m CROSS JOIN (VALUES ('completeness', 0.8::DOUBLE), ('accuracy', 0.9), ('citation', 1.0), ('standards', 0.8), ('grounded', 1.0)) k(target, wanted)
      LEFT JOIN t ON t.llm_model IS NOT DISTINCT FROM m.llm_model AND t.target = k.target""",
    "verdicts": f"WITH {SCORES} SELECT llm_model, count(*) FILTER (overall >= 0.6) AS pass, count(*) FILTER (overall >= 0.3 AND overall < 0.6) AS warn, count(*) FILTER (overall < 0.3) AS fail FROM scores GROUP BY 1",
    "set_diff_report": f"""WITH r AS (SELECT plan_id, release, section_number, coalesce(arg_min(title, rec_id), '') AS title FROM requirements WHERE section_number IS NOT NULL GROUP BY ALL), e AS (SELECT plan_id, arg_min(release, {MONTH}) AS lo, arg_max(release, {MONTH}) AS hi FROM r GROUP BY 1),
      a AS (SELECT r.* FROM r JOIN e ON e.plan_id = r.plan_id AND r.release = lo AND lo <> hi), b AS (SELECT r.* FROM r JOIN e ON e.plan_id = r.plan_id AND r.release = hi AND lo <> hi),
      j AS (SELECT coalesce(a.plan_id, b.plan_id) AS plan_id, a.title AS o, b.title AS n FROM a FULL JOIN b ON a.plan_id = b.plan_id AND a.section_number = b.section_number)
      SELECT plan_id, count(*) FILTER (o IS NULL) AS added, count(*) FILTER (n IS NULL) AS removed, count(*) FILTER (o <> n) AS changed, count(*) FILTER (o = n) AS kept FROM j GROUP BY 1""",
}
