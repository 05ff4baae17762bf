"""Queries and SQL of search."""

from __future__ import annotations

from reqloom.operators import retrieval as r
from reqloom.plans.graph import GRAPH

QUERIES = {
    "tokenize": r.tokens,
    "bm25_topk": r.bm25_topk,
    "cosine_topk": r.cosine_topk,
    "l2_topk": r.l2_topk,
    "ip_topk": r.ip_topk,
    "filtered_topk": r.filtered_topk,
    "rrf_fuse": r.fused,
    "diversity_min1": r.diverse,
    "hybrid_retrieve": r.hybrid,
    "threshold_not_found": r.threshold,
    "rerank_stable": r.rerank_stable,
    "context_assemble": r.context,
    "context_enrich": r.enrich,
    "chunk_fingerprint": r.fingerprint,
    "label_centroids": r.similar_labels,
}

_TOK = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9_.\\-]+'), lambda x: length(x) >= 2)"


def tok(c: str) -> str:
    return _TOK.replace("{c}", c)


CHUNKS = f"""chunks AS (SELECT req_id, min(rec_id) AS chunk_id, arg_min(plan_id, rec_id) AS plan_id, concat_ws(' ', min_by(struct_pack(t := title), rec_id).t, min_by(struct_pack(t := text), rec_id).t) AS text, min_by(struct_pack(t := title), rec_id).t AS title FROM requirements WHERE req_id IS NOT NULL GROUP BY 1),
  toks AS (SELECT chunk_id, {tok('text')} AS ts FROM chunks),
  post AS (SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term, len(ts) AS dl FROM toks) GROUP BY ALL)"""


def bm25(questions: str) -> str:
    return f"""questions AS ({questions}),
  stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
  idf AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM post, stats GROUP BY term, n),
  qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tok('question')}) AS term FROM questions) GROUP BY ALL),
  w AS (SELECT qid, qt.term, qtf, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf) ELSE raw END AS idf FROM qt JOIN idf ON idf.term = qt.term),
  bm0 AS (SELECT qid, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM post JOIN w ON w.term = post.term, stats GROUP BY ALL),
  bm AS (SELECT q.qid, c.chunk_id, coalesce(score, 0.0) AS score FROM questions q CROSS JOIN (SELECT chunk_id FROM chunks) c LEFT JOIN bm0 ON bm0.qid = q.qid AND bm0.chunk_id = c.chunk_id WHERE len({tok('q.question')}) > 0)"""


FEEDBACK = "SELECT DISTINCT id AS qid, question FROM test_feedback WHERE id % 100 = 0"
PAIRED = "SELECT chunk_id AS qid, title AS question FROM chunks WHERE chunk_id % 100 = 0"
_DOT = "list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE))"
_NA = "sqrt(list_sum(list_transform({v}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"
_L2 = "sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)))"
_COS = f"1 - {_DOT} / ({_NA.replace('{v}', 'a')} * {_NA.replace('{v}', 'b')})"


def knn(distance: str, k: int, where: str = "a.vec_id % 100 = 0") -> str:
    return f"""SELECT qid, vec_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM
      (SELECT a.vec_id AS qid, b.vec_id, round({distance}, 6) AS distance FROM embeddings a, embeddings b WHERE {where})) WHERE rank <= {k}"""


LISTS = f"""{CHUNKS}, {bm25(PAIRED)}, dense AS ({knn(_COS, 30, 'a.vec_id IN (SELECT qid FROM questions)')}),
  sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 30),
  u AS (SELECT qid, vec_id AS chunk_id, rank, 0 AS l, 1.0::DOUBLE / (60 + rank) AS s FROM dense UNION ALL SELECT qid, chunk_id, rank, 1, 0.5::DOUBLE / (60 + rank) FROM sparse),
  f AS (SELECT qid, chunk_id, round(sum(s), 9) AS fused, min({{'l': l, 'r': rank}}) AS seen FROM u GROUP BY ALL),
  fused AS (SELECT qid, chunk_id, fused, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, seen) AS rank FROM f) WHERE rank <= 20),
  c AS (SELECT qid, chunk_id, plan_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM fused JOIN chunks USING (chunk_id)),
  p1 AS (SELECT *, row_number() OVER (PARTITION BY qid, plan_id ORDER BY rank) = 1 AS first FROM c),
  p2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first DESC, rank) AS pick FROM p1),
  diverse AS (SELECT qid, chunk_id, plan_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM p2 WHERE pick <= 10)"""

SQL = {
    "tokenize": f"WITH {CHUNKS} SELECT term, count(*) AS df, sum(tf) AS cf FROM post GROUP BY 1",
    "bm25_topk": f"WITH {CHUNKS}, {bm25(FEEDBACK)} SELECT qid, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM bm) WHERE rank <= 10",
    "cosine_topk": knn(_COS, 10),
    "l2_topk": knn(_L2, 10),
    "ip_topk": knn(f"1 - {_DOT}", 10),
    "filtered_topk": knn(_COS, 10, "a.vec_id % 100 = 0 AND a.label = b.label"),
    "rrf_fuse": f"WITH {LISTS} SELECT qid, chunk_id, fused, rank FROM fused",
    "diversity_min1": f"WITH {LISTS} SELECT * FROM diverse",
    "hybrid_retrieve": f"""WITH {LISTS}, words AS (SELECT lower(split_part(title, ' ', 1)) AS word, min('glossary:specs:' || trim(regexp_replace(spec, '[^A-Za-z0-9_-]', '_', 'g'), '_')) AS chunk FROM spec_catalog WHERE title IS NOT NULL GROUP BY 1),
      pins AS (SELECT qid, min(chunk) AS chunk FROM questions JOIN words ON word = lower(split_part(question, ' ', 1)) GROUP BY 1),
      u2 AS (SELECT qid, chunk, 0 AS rank, true AS pinned FROM pins UNION ALL SELECT qid, 'req:' || chunk_id, rank, false FROM diverse)
      SELECT qid, chunk, pinned, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS final_rank FROM u2) WHERE final_rank <= 10""",
    "threshold_not_found": f"""WITH h AS ({knn(_COS, 5)}), ok AS (SELECT * FROM h WHERE distance <= 0.5 AND qid <> vec_id)
      SELECT q.vec_id AS qid, ok.vec_id, distance, CASE WHEN ok.vec_id IS NULL THEN 'not_found' ELSE 'found' END AS outcome FROM (SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0) q LEFT JOIN ok ON ok.qid = q.vec_id""",
    "rerank_stable": f"""WITH {LISTS}, t AS (SELECT s.qid, s.chunk_id, s.rank AS prior_rank, list_distinct({tok('question')}) AS qs, {tok('text')} AS ts FROM sparse s JOIN questions q ON q.qid = s.qid JOIN chunks ch ON ch.chunk_id = s.chunk_id),
      sc AS (SELECT qid, chunk_id, prior_rank, floor(len(list_intersect(qs, ts)) * 10 / greatest(len(qs), 1))::BIGINT AS pair_score FROM t)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pair_score DESC, prior_rank) AS rank FROM sc) WHERE rank <= 10""",
    "context_assemble": f"""WITH {LISTS}, g AS (SELECT qid, string_agg('[' || rank || '] ' || req_id || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS w FROM diverse JOIN chunks USING (chunk_id) GROUP BY 1)
      SELECT qid, CASE WHEN length(w) > 30000 THEN left(w, 30000) || chr(10) || chr(10) || '[Context truncated]' ELSE w END AS context FROM g""",
    "context_enrich": f"""WITH {GRAPH}, {LISTS}, par AS (SELECT dst AS id, min(src) AS up FROM edges WHERE edge_type = 'parent_of' GROUP BY 1), st AS (SELECT src AS id, count(*) AS n FROM edges WHERE edge_type = 'references_standard' GROUP BY 1),
      de AS (SELECT src AS id, count(*) AS n FROM edges WHERE edge_type = 'depends_on' GROUP BY 1)
      SELECT qid, d.chunk_id, rank, t.title AS parent_title, coalesce(st.n, 0) AS n_standards, coalesce(de.n, 0) AS n_depends FROM diverse d JOIN chunks ch ON ch.chunk_id = d.chunk_id
      LEFT JOIN par ON par.id = 'req:' || ch.req_id LEFT JOIN chunks t ON 'req:' || t.req_id = par.up LEFT JOIN st ON st.id = 'req:' || ch.req_id LEFT JOIN de ON de.id = 'req:' || ch.req_id""",
    "chunk_fingerprint": f"""WITH {CHUNKS}, b AS (SELECT plan_id, chunk_id, chunk_id // 10000 AS block FROM chunks),
      h AS (SELECT plan_id, block, count(*) AS n, sha256(string_agg(lpad(chunk_id::VARCHAR, 12, '0'), chr(10) ORDER BY chunk_id)) AS h FROM b GROUP BY ALL)
      SELECT plan_id, sum(n) AS n_chunks, left(sha256(string_agg(h, chr(10) ORDER BY block)), 16) AS fingerprint FROM h GROUP BY 1""",
    "label_centroids": """WITH v AS (SELECT label, i, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i)), m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL), al AS (SELECT i, avg(x) AS y FROM v GROUP BY 1)
      SELECT label, round(1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 6) AS distance FROM m JOIN al ON al.i = m.i GROUP BY 1""",
}
