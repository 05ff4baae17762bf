"""Queries and SQL of answering questions."""

from __future__ import annotations

from reqloom.functions.keys import sql_spec_key as sk
from reqloom.operators import query as q
from reqloom.operators import understanding as u
from reqloom.operators.catalog import ACRONYM
from reqloom.plans.graph import GRAPH
from reqloom.plans.retrieval import _COS, tok
from reqloom.plans.understanding import TYPE_CASE, any_, hits, uniq

QUERIES = {
    "query_intents": q.query_intents,
    "query_scopes": q.query_scopes,
    "graph_seeds": q.query_seeds,
    "graph_scope": q.query_graph_scope,
    "scoped_dense": q.scoped_dense,
    "scoped_bm25": q.scoped_bm25,
    "query_retrieve": q.query_retrieve,
    "context_full": q.context_full,
    "citation_recovery": q.citation_recovery,
    "query_pipeline": q.query_pipeline,
}

_FIRST = ", ".join(f"min_by(struct_pack(v := {c}), rec_id).v AS {c}" for c in ("mno", "release", "plan_id", "title", "text", "section_number"))
_MNOS = "[" + ", ".join(f"CASE WHEN regexp_matches(low, '\\b({'|'.join(a)})\\b') THEN '{m}' END" for m, a in u.MNOS.items()) + "]"
_FEATS = "[" + ", ".join(f"CASE WHEN {any_('low', kw)} THEN '{f}' END" for f, _, kw in u.FEATURES) + "]"
_IDS = "list_transform(regexp_extract_all({c}, '[A-Z]{2}_REQ_[A-Z0-9]+_[0-9]+'), lambda x: trim(regexp_replace(x, '\\s+', '_', 'g'), '_'))"


def month(c: str) -> str:
    return f"{{'y': split_part({c}, '_', 1), 'm': instr('jan feb mar apr may jun jul aug sep oct nov dec', lower(split_part({c}, '_', -1))), 'r': {c}}}"


INTENTS = f"""qr AS (SELECT req_id, min(rec_id) AS chunk_id, {_FIRST} FROM requirements WHERE req_id IS NOT NULL GROUP BY 1),
  forms AS (SELECT chunk_id AS qid, coalesce(title, req_id) AS t, coalesce(plan_id, '') AS p, lower(coalesce(mno, '')) AS m, coalesce(release, '') AS r, req_id AS i FROM qr WHERE chunk_id % 100 = 0),
  asked AS (SELECT qid, CASE (qid // 100) % 7 WHEN 0 THEN 'What is ' || i || ' of ' || m || ' ' || r || '?' WHEN 1 THEN 'What does the ' || p || ' plan of ' || m || ' ' || r || ' say about ' || t || '?'
    WHEN 2 THEN 'Compare ' || m || ' on ' || t WHEN 3 THEN 'Everything about ' || t WHEN 4 THEN 'Which requirements mention ' || t || ' in 3GPP TS 24.301?' WHEN 5 THEN t ELSE 'What is ' || split_part(t, ' ', 1) || '?' END AS question FROM forms),
  known AS (SELECT DISTINCT plan_id, lower(plan_id) AS w FROM plans),
  named AS (SELECT qid, list_sort(list(DISTINCT plan_id)) AS plan_ids FROM (SELECT qid, unnest({tok('question')}) AS w FROM asked) x JOIN known ON known.w = x.w GROUP BY 1),
  i0 AS (SELECT a.qid, question, lower(question) AS low, coalesce(plan_ids, []) AS plan_ids FROM asked a LEFT JOIN named n ON n.qid = a.qid),
  i1 AS (SELECT *, low AS c, plan_ids AS p, list_concat({uniq(_IDS.replace('{c}', 'question'))}, list_transform({uniq("regexp_extract_all(low, '\\bt3[0-9]{3}\\b')")}, lambda x: upper(x))) AS entities, {hits('low', u.CONCEPTS)} AS concepts,
    list_filter({_MNOS}, lambda x: x IS NOT NULL) AS mnos, {uniq("list_concat(regexp_extract_all(low, '20[0-9]{2}_[a-z]{3}'), regexp_extract_all(low, 'latest|current'))")} AS releases,
    {uniq("regexp_extract_all(low, '3gpp\\s+ts\\s+([0-9][0-9.]*[0-9])', 1)")} AS standards, list_filter({_FEATS}, lambda x: x IS NOT NULL) AS features FROM i0),
  i2 AS (SELECT *, {TYPE_CASE} AS query_type FROM i1),
  intents AS (SELECT qid, question, entities, concepts, mnos, releases, standards, features, plan_ids, query_type, CASE WHEN query_type IN ('single_doc', 'release_diff') THEN 1 ELSE 2 END AS depth,
    CASE query_type WHEN 'single_doc' THEN ['depends_on', 'parent_of', 'references_standard'] WHEN 'cross_doc' THEN ['depends_on', 'parent_of', 'references_standard', 'shared_standard'] WHEN 'cross_mno_comparison' THEN ['maps_to', 'references_standard']
      WHEN 'feature_level' THEN ['maps_to', 'depends_on', 'references_standard'] WHEN 'standards_comparison' THEN ['references_standard', 'parent_section'] ELSE ['depends_on', 'parent_of', 'references_standard', 'shared_standard', 'maps_to'] END AS edge_types,
    CASE WHEN query_type IN ('cross_doc', 'cross_mno_comparison', 'standards_comparison', 'feature_level') THEN 25 WHEN query_type IN ('traceability', 'release_diff') THEN 20 ELSE 10 END AS k,
    CASE WHEN query_type IN ('standards_comparison', 'traceability', 'single_doc') THEN 0.5 ELSE 0.0 END AS weight, query_type NOT IN ('single_doc', 'general') AS reranks FROM i2)"""
SCOPES = f"""{INTENTS}, rel AS (SELECT DISTINCT mno, release FROM plans WHERE mno IS NOT NULL AND release IS NOT NULL), latest AS (SELECT mno, arg_max(release, {month('release')}) AS latest FROM rel GROUP BY 1),
  wn AS (SELECT qid, x.mno, wish, latest FROM (SELECT qid, unnest(mnos) AS mno, releases[1] AS wish FROM intents) x JOIN latest ON latest.mno = x.mno),
  wm AS (SELECT qid, wn.mno, release, CASE WHEN wish IN ('latest', 'current') THEN 9 WHEN lower(release) = wish THEN 1 WHEN contains(lower(release), wish) THEN 2 WHEN len(list_filter(string_split(lower(release), '_'), lambda x: contains(wish, x))) > 0 THEN 3 ELSE 9 END AS rule
    FROM wn JOIN rel ON rel.mno = wn.mno WHERE wish IS NOT NULL),
  met AS (SELECT qid, mno, release FROM (SELECT *, row_number() OVER (PARTITION BY qid, mno ORDER BY rule, {month('release')} DESC) AS rn FROM wm WHERE rule < 9) WHERE rn = 1),
  own AS (SELECT wn.qid, wn.mno, coalesce(met.release, latest) AS release FROM wn LEFT JOIN met ON met.qid = wn.qid AND met.mno = wn.mno),
  scopes AS (SELECT * FROM own UNION ALL SELECT i.qid, l.mno, l.latest FROM intents i, latest l WHERE i.qid NOT IN (SELECT qid FROM own))"""
_IN = "JOIN scopes s ON s.qid = {a}.qid AND s.mno = {r}.mno AND s.release = {r}.release"
SEEDS = f"""{GRAPH}, {SCOPES},
  s1 AS (SELECT DISTINCT x.qid, 'req:' || r.req_id AS id, 1.0::DOUBLE AS score, 'entity' AS source FROM (SELECT qid, unnest(entities) AS e FROM intents) x JOIN qr r ON r.req_id = x.e {_IN.replace('{a}', 'x').replace('{r}', 'r')}),
  s2 AS (SELECT DISTINCT x.qid, 'req:' || r.req_id AS id, 0.8::DOUBLE AS score, 'feature' AS source FROM (SELECT qid, unnest(features) AS f FROM intents WHERE qid NOT IN (SELECT qid FROM s1)) x JOIN feats ON feats.feature_id = x.f JOIN qr r ON r.plan_id = feats.plan_id {_IN.replace('{a}', 'x').replace('{r}', 'r')}),
  s3 AS (SELECT DISTINCT x.qid, 'req:' || r.req_id AS id, 0.6::DOUBLE AS score, 'plan' AS source FROM (SELECT qid, unnest(plan_ids) AS f FROM intents WHERE qid NOT IN (SELECT qid FROM s1 UNION SELECT qid FROM s2)) x JOIN qr r ON r.plan_id = x.f {_IN.replace('{a}', 'x').replace('{r}', 'r')}),
  lows AS (SELECT *, lower(concat_ws(' ', title, text)) AS low FROM qr),
  have AS (SELECT req_id, mno, release, unnest(list_distinct(list_concat({hits('low', u.CONCEPTS)}, list_filter({tok('low')}, lambda w: regexp_full_match(w, 't3[0-9]{{3}}'))))) AS term FROM lows),
  want AS (SELECT qid, unnest(list_distinct(list_concat(concepts, list_transform(entities, lambda x: lower(x))))) AS term FROM intents WHERE len(concepts) > 0 AND qid NOT IN (SELECT qid FROM s1 UNION SELECT qid FROM s2 UNION SELECT qid FROM s3)),
  s4 AS (SELECT w.qid, 'req:' || h.req_id AS id, round(0.3 + 0.2 * least(count(*), 3), 4)::DOUBLE AS score, 'title_search' AS source FROM want w JOIN have h ON h.term = w.term {_IN.replace('{a}', 'w').replace('{r}', 'h')} GROUP BY w.qid, h.req_id),
  seeds AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)"""


def level(n: int, old: str) -> str:
    return f"""t{n} AS (SELECT DISTINCT f.qid, a.nxt AS id FROM {old} f JOIN intents i ON i.qid = f.qid JOIN qadj a ON a.id = f.id WHERE i.depth >= {n} AND list_contains(i.edge_types, a.edge_type)
    UNION SELECT DISTINCT f.qid, m.id FROM {old} f JOIN intents i ON i.qid = f.qid JOIN stdm x ON x.id = f.id JOIN stdm m ON m.std = x.std AND m.plan_id <> x.plan_id WHERE i.depth >= {n} AND list_contains(i.edge_types, 'shared_standard')),
  l{n} AS (SELECT t.qid, t.id, {n} AS depth, {round(0.7**n, 6)}::DOUBLE AS score FROM t{n} t LEFT JOIN qr r ON 'req:' || r.req_id = t.id LEFT JOIN scopes s ON s.qid = t.qid AND s.mno = r.mno AND s.release = r.release
    WHERE (NOT starts_with(t.id, 'req:') OR s.qid IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM l0 z WHERE z.qid = t.qid AND z.id = t.id) {'AND NOT EXISTS (SELECT 1 FROM l1 z WHERE z.qid = t.qid AND z.id = t.id)' if n == 2 else ''})"""


SCOPE = f"""{SEEDS}, qadj AS (SELECT src AS id, dst AS nxt, edge_type FROM edges UNION ALL SELECT dst, src, edge_type FROM edges),
  stdm AS (SELECT e.src AS id, e.dst AS std, r.plan_id FROM edges e JOIN qr r ON 'req:' || r.req_id = e.src WHERE edge_type = 'references_standard'),
  l0 AS (SELECT qid, id, 0 AS depth, score FROM seeds), {level(1, 'l0')}, {level(2, 'l1')},
  cand AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2)"""
RETRIEVE = f"""{SCOPE}, pop AS (SELECT c.qid, r.chunk_id, true AS scoped FROM cand c JOIN qr r ON 'req:' || r.req_id = c.id
    UNION ALL SELECT s.qid, r.chunk_id, false FROM scopes s JOIN qr r ON r.mno = s.mno AND r.release = s.release WHERE s.qid NOT IN (SELECT qid FROM cand WHERE starts_with(id, 'req:'))),
  dd AS (SELECT p.qid, p.chunk_id, scoped, round({_COS}, 6) AS distance FROM pop p JOIN embeddings a ON a.vec_id = p.qid JOIN embeddings b ON b.vec_id = p.chunk_id),
  dense AS (SELECT d.*, row_number() OVER (PARTITION BY d.qid ORDER BY distance, chunk_id) AS rank FROM dd d),
  fans AS (SELECT qid, k, weight, reranks, question, k * CASE WHEN reranks THEN 2 ELSE 1 END AS keep, k * CASE WHEN reranks THEN 2 ELSE 1 END * CASE WHEN weight > 0 THEN 3 ELSE 1 END AS fan FROM intents),
  densek AS (SELECT d.* FROM dense d JOIN fans f ON f.qid = d.qid WHERE rank <= fan),
  toks AS (SELECT chunk_id, {tok("concat_ws(' ', title, text)")} AS ts FROM qr),
  post AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term, len(ts) AS dl FROM toks) GROUP BY ALL),
  stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
  idf AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM post, stats GROUP BY term, n),
  hy AS (SELECT * FROM fans WHERE weight > 0 AND len({tok('question')}) > 0),
  qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tok('question')}) AS term FROM hy) GROUP BY ALL),
  tw AS (SELECT qid, qt.term, qtf, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf) ELSE raw END AS idf FROM qt JOIN idf ON idf.term = qt.term),
  bm AS (SELECT qid, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN tw ON tw.term = post.term, stats GROUP BY ALL),
  gate AS (SELECT qid, chunk_id FROM pop WHERE scoped UNION ALL SELECT qid, chunk_id FROM densek WHERE NOT scoped),
  sparse0 AS (SELECT g.qid, g.chunk_id, round(coalesce(score, 0.0), 6) AS score, fan FROM gate g JOIN hy ON hy.qid = g.qid LEFT JOIN bm ON bm.qid = g.qid AND bm.chunk_id = g.chunk_id),
  sparse AS (SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM sparse0) WHERE rank <= fan),
  fu AS (SELECT qid, chunk_id, rank, 0 AS l, 1.0::DOUBLE / (60 + rank) AS x FROM densek UNION ALL SELECT qid, chunk_id, rank, 1, 0.5::DOUBLE / (60 + rank) FROM sparse),
  ff AS (SELECT qid, chunk_id, round(sum(x), 9) AS fused, min({{'l': l, 'r': rank}}) AS seen FROM fu GROUP BY ALL),
  fr AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, seen) AS rank FROM ff),
  fd AS (SELECT fr.qid, fr.chunk_id, fr.rank, coalesce(d.distance, 0.0) AS distance, f.k, f.reranks, f.question FROM fr JOIN fans f ON f.qid = fr.qid AND fr.rank <= f.keep LEFT JOIN densek d ON d.qid = fr.qid AND d.chunk_id = fr.chunk_id),
  rr AS (SELECT fd.*, r.req_id, r.plan_id, CASE WHEN reranks THEN floor(len(list_intersect(list_distinct({tok('question')}), {tok("concat_ws(' ', title, text)")})) * 10 / greatest(len(list_distinct({tok('question')})), 1)) ELSE 0 END AS pair FROM fd JOIN qr r ON r.chunk_id = fd.chunk_id),
  rk AS (SELECT * EXCLUDE rank, row_number() OVER (PARTITION BY qid ORDER BY pair DESC, rank) AS rank FROM rr),
  rc AS (SELECT *, row_number() OVER (PARTITION BY qid, plan_id ORDER BY rank) = 1 AS first FROM rk WHERE NOT reranks OR rank <= k),
  rp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first DESC, rank) AS pick FROM rc),
  ro AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, rank) AS pos FROM rp WHERE first OR pick <= k),
  gw AS (SELECT lower(split_part(title, ' ', 1)) AS word, min('glossary:specs:' || trim(regexp_replace(spec, '[^A-Za-z0-9_-]', '_', 'g'), '_')) AS chunk FROM spec_catalog WHERE title IS NOT NULL GROUP BY 1),
  ru AS (SELECT qid, k, chunk_id, 'req:' || req_id AS chunk, false AS pinned, distance, pos FROM ro
    UNION ALL SELECT qid, k, NULL, chunk, true, 1.0, 0 FROM (SELECT qid, k, lower(regexp_extract(question, '{ACRONYM}', 1)) AS word FROM fans) a JOIN gw ON gw.word = a.word WHERE a.word <> ''),
  retrieved AS (SELECT qid, chunk_id, chunk, pinned, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos) AS rank FROM ru) WHERE rank <= k)"""
ENRICHED = f"""{RETRIEVE}, par AS (SELECT dst AS id, min(src) AS up FROM edges WHERE edge_type = 'parent_of' GROUP BY 1),
  ups AS (SELECT id, CASE WHEN nullif(r.text, '') IS NOT NULL THEN coalesce(r.title, '') || ': ' || r.text ELSE nullif(r.title, '') END AS parent FROM par JOIN qr r ON 'req:' || r.req_id = par.up),
  deps AS (SELECT src AS id, list_sort(list(substr(dst, 5))) AS related FROM edges WHERE edge_type = 'depends_on' AND starts_with(dst, 'req:') GROUP BY 1),
  sect AS (SELECT 'std:' || {sk('spec')} || ':' || coalesce(release_num, 0) || ':' || number AS std, {sk('spec')} AS spec, number AS section, coalesce(release_num, 0) AS rel, min_by(struct_pack(v := title), sec_id).v AS title, min_by(struct_pack(v := text), sec_id).v AS text
    FROM spec_sections WHERE text IS NOT NULL AND trim(text) <> '' AND number IS NOT NULL GROUP BY 1, 2, 3, 4),
  stx AS (SELECT src AS id, list({{'std': std, 'spec': spec, 'section': section, 'rel': rel, 'title': title, 'text': left(text, 1500)}} ORDER BY std) AS standards FROM edges JOIN sect ON std = dst WHERE edge_type = 'references_standard' GROUP BY 1),
  enr AS (SELECT t.qid, t.chunk_id, t.rank, t.distance, r.*, ups.parent, coalesce(deps.related, []) AS related, coalesce(stx.standards, []) AS standards FROM retrieved t JOIN (SELECT * EXCLUDE chunk_id, chunk_id AS cid FROM qr) r ON r.cid = t.chunk_id
    LEFT JOIN ups ON ups.id = t.chunk LEFT JOIN deps ON deps.id = t.chunk LEFT JOIN stx ON stx.id = t.chunk WHERE NOT pinned)"""
CONTEXT = f"""{ENRICHED}, bits AS (SELECT qid, rank, req_id, concat_ws(chr(10), '--- Requirement ' || rank || ' ---', 'Source: ' || concat_ws(' | ', mno, release, plan_id, section_number), 'Requirement ID: ' || req_id, 'Parent: ' || left(parent, 500), nullif(title, ''), nullif(text, ''),
    nullif(array_to_string(list_transform(standards, lambda s: concat_ws(chr(10), '[Standard ' || s.spec || ' section ' || s.section || ' release ' || s.rel || ']', nullif(s.title, ''), s.text)), chr(10)), ''),
    CASE WHEN len(related) > 0 THEN 'Depends on: ' || array_to_string(related[1:5], ', ') END, 'Distance in millionths: ' || round(distance * 1000000)::BIGINT) AS t FROM enr),
  wholes AS (SELECT b.qid, concat_ws(chr(10) || chr(10), 'Question: ' || any_value(i.question), string_agg(t, chr(10) || chr(10) ORDER BY rank),
    'Cite these requirement IDs for every claim: ' || array_to_string(list(req_id ORDER BY rank)[1:20], ', ') || CASE WHEN count(*) > 20 THEN ' ...' ELSE '' END) AS w FROM bits b JOIN intents i ON i.qid = b.qid GROUP BY 1),
  contexts AS (SELECT qid, CASE WHEN length(w) > 30000 THEN left(w, 30000) || chr(10) || chr(10) || '[Context truncated]' ELSE w END AS context FROM wholes)"""
ANSWERS = f"""{CONTEXT}, ent AS (SELECT qid, coalesce(plan_id, 'unknown') AS plan, rank, '- ' || req_id || ' (' || coalesce(section_number, '?') || '): ' || left(coalesce(nullif(trim(title), ''), split_part(trim(text), chr(10), 1), ''), 100)
      || coalesce(array_to_string(list_transform(standards[1:2], lambda s: chr(10) || '  see TS ' || s.spec || ', section ' || s.section), ''), '') AS entry FROM enr),
  entn AS (SELECT *, min(rank) OVER (PARTITION BY qid, plan) AS seen, count(*) OVER (PARTITION BY qid, plan) AS n, row_number() OVER (PARTITION BY qid, plan ORDER BY rank) AS nth FROM ent),
  perp AS (SELECT qid, seen, '## ' || plan || ' (' || n || ')' || chr(10) || string_agg(entry, chr(10) ORDER BY rank) AS b FROM entn WHERE nth <= 5 GROUP BY qid, plan, seen, n),
  answers AS (SELECT i.qid, coalesce(string_agg(b, chr(10) || chr(10) ORDER BY seen), '{q.NOT_FOUND}') AS answer FROM intents i LEFT JOIN perp p ON p.qid = i.qid GROUP BY 1)"""


def _texts(*cols: str) -> str:
    return ", ".join(f"array_to_string({c}, ',') AS {c}" for c in cols)


SQL = {
    "query_intents": f"WITH {INTENTS} SELECT qid, question, query_type, depth, k, weight, reranks, {_texts('entities', 'concepts', 'mnos', 'releases', 'standards', 'features', 'plan_ids')} FROM intents",
    "query_scopes": f"WITH {SCOPES} SELECT * FROM scopes",
    "graph_seeds": f"WITH {SEEDS} SELECT * FROM seeds",
    "graph_scope": f"WITH {SCOPE} SELECT * FROM cand",
    "scoped_dense": f"WITH {RETRIEVE} SELECT qid, chunk_id, scoped, distance, rank FROM densek",
    "scoped_bm25": f"WITH {RETRIEVE} SELECT * FROM sparse",
    "query_retrieve": f"WITH {RETRIEVE} SELECT * FROM retrieved",
    "context_full": f"WITH {CONTEXT} SELECT * FROM contexts",
    "citation_recovery": f"""WITH {ENRICHED}, cited AS (SELECT qid, {uniq(_IDS.replace('{c}', 'question'))} AS ids, {uniq("regexp_extract_all(question, '3GPP\\s+TS\\s+([0-9][0-9.]*[0-9])', 1)")} AS specs FROM intents),
      ci AS (SELECT qid, list(req_id ORDER BY rank) AS ids FROM enr GROUP BY 1), cs AS (SELECT qid, list_sort(list(DISTINCT s.spec || ':' || s.section)) AS stds FROM (SELECT qid, unnest(standards) AS s FROM enr) GROUP BY 1)
      SELECT c.qid, array_to_string(list_concat(c.ids, specs), ',') AS cited, CASE WHEN len(c.ids) < 2 THEN array_to_string(list_concat(list_filter(coalesce(ci.ids, []), lambda x: NOT list_contains(c.ids, x)), coalesce(stds, [])), ',') ELSE '' END AS recovered
      FROM cited c LEFT JOIN ci ON ci.qid = c.qid LEFT JOIN cs ON cs.qid = c.qid""",
    "query_pipeline": f"""WITH {ANSWERS} SELECT i.qid, query_type, (SELECT count(*) FROM cand c WHERE c.qid = i.qid) AS candidates, (SELECT count(*) FROM retrieved r WHERE r.qid = i.qid) AS retrieved,
      coalesce(length(context) // 4, 0) AS context_tokens, answer FROM intents i LEFT JOIN contexts x ON x.qid = i.qid JOIN answers a ON a.qid = i.qid""",
}
