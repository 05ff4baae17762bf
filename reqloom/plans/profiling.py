"""Queries and SQL of elections and reports."""

from __future__ import annotations

from reqloom.operators import profiling as o
from reqloom.plans.blocks import NORM
from reqloom.plans.layout import PAGES
from reqloom.plans.references import INTERNAL, SQL as REFERENCES
from reqloom.plans.retrieval import tok

QUERIES = {
    "toc_pages": o.toc_pages,
    "metadata_election": o.metadata_election,
    "phrase_election": o.phrase_election,
    "reference_forms": o.reference_forms,
    "glossary_index": o.glossary_index,
    "std_index_sorted": o.sorted_index,
    "review_rows": o.review_rows,
}

_TRIES = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, {i} AS pattern, regexp_extract(head, '{p}', 1) AS value FROM heads" for k, ps in o.METADATA.items() for i, p in enumerate(ps))
SQL = {
    "toc_pages": f"WITH {PAGES} SELECT doc_id, page, count(*) AS n, count(*) FILTER (regexp_matches(text, '[0-9]+\\.?$')) AS hits FROM pg WHERE type IN ('paragraph', 'list') GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (regexp_matches(text, '[0-9]+\\.?$')) / count(*) >= 0.7",
    "metadata_election": f"""WITH {PAGES}, heads AS (SELECT doc_id, string_agg(text, ' ' ORDER BY idx) AS head FROM pg WHERE page = 1 GROUP BY 1), tries AS ({_TRIES}),
      per AS (SELECT kind, pattern, arg_min(value, doc_id) AS value, count(*) AS docs FROM tries WHERE value <> '' GROUP BY ALL)
      SELECT kind, pattern, value, docs FROM per p WHERE pattern = (SELECT min(pattern) FROM per x WHERE x.kind = p.kind)""",
    "phrase_election": f"""WITH {PAGES}, w AS (SELECT *, lead(type, 1) OVER (PARTITION BY doc_id ORDER BY idx) AS n1, lead(type, 2) OVER (PARTITION BY doc_id ORDER BY idx) AS n2 FROM b),
      h AS (SELECT lower(trim({NORM.replace('{c}', 'text')})) AS phrase, count(*) AS n FROM w WHERE type = 'heading' AND (n1 = 'table' OR (n1 <> 'paragraph' AND n2 = 'table')) GROUP BY 1)
      SELECT phrase, n, phrase = (SELECT phrase FROM h ORDER BY n DESC, phrase LIMIT 1) AS elected FROM h""",
    "reference_forms": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS form, coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS matches FROM documents" for n, p in o.CROSS_REFERENCES) + ") WHERE matches > 0",
    "glossary_index": f"""WITH g AS (SELECT lower(split_part(title, ' ', 1)) AS word, min('glossary:specs:' || trim(regexp_replace(spec, '[^A-Za-z0-9_-]', '_', 'g'), '_')) AS chunk FROM spec_catalog WHERE title IS NOT NULL GROUP BY 1),
      t AS (SELECT DISTINCT rec_id, unnest({tok('title')}) AS word FROM requirements WHERE title IS NOT NULL), n AS (SELECT word, count(*) AS titles FROM t GROUP BY 1)
      SELECT g.word, chunk, coalesce(titles, 0) AS titles FROM g LEFT JOIN n ON n.word = g.word""",
    "std_index_sorted": f"WITH i AS ({REFERENCES['std_ref_index']}) SELECT spec, row_number() OVER (PARTITION BY spec ORDER BY release_num) AS position, release_num, ref_count FROM i",
    "review_rows": f"""WITH {INTERNAL}, r AS (SELECT DISTINCT ref_id, source_req_id, target_req_id, status AS said FROM refs_internal WHERE source_req_id IS NOT NULL),
      j AS (SELECT r.*, i.target_title, CASE WHEN said = 'broken' AND i.status = 'resolved' THEN 'false_broken' WHEN said = 'resolved' AND i.status = 'broken' THEN 'wrong_target' END AS correction FROM r JOIN internal i ON i.ref_id = r.ref_id),
      k AS (SELECT *, row_number() OVER (PARTITION BY source_req_id ORDER BY (correction = 'false_broken')::INT DESC, ref_id DESC) AS rn, count(*) OVER (PARTITION BY source_req_id) AS n FROM j WHERE correction IS NOT NULL),
      t AS (SELECT req_id, left(min_by(struct_pack(v := text), rec_id).v, 200) AS preview FROM requirements WHERE req_id IS NOT NULL GROUP BY 1)
      SELECT source_req_id, ref_id, target_req_id, target_title, correction, n, preview FROM k LEFT JOIN t ON t.req_id = source_req_id WHERE rn = 1""",
}
