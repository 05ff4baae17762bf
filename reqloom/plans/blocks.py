"""Queries and SQL of ordered document blocks."""

from __future__ import annotations

from reqloom.functions.plugins import embedding_column
from reqloom.operators import blocks as b
from reqloom.operators.parser import parse_documents
from reqloom.operators.retrieval import chunks



def embedded(spark, base):
    """Every chunk with its hashed embedding (the plug-in's default)."""
    c = chunks(spark, base)
    return c.select("chunk_id", embedding_column()("text").alias("embedding"))


QUERIES = {
    "stateful_parse": parse_documents,
    "udf_embed": embedded,
    "block_explode": b.reindexed,
    "block_type_cube": b.type_counts,
    "block_type_filter": b.table_blocks,
    "repeated_line_antijoin": b.repeated_lines,
    "toc_page_ratio": b.toc_ratio,
    "sessionize_sections": b.sections,
    "first_section_wins": b.first_section_wins,
    "gaps_islands_ranges": b.ranges,
    "range_spans": b.spans,
    "interval_annotate": b.annotated,
    "revision_history_consume": b.consumed_after_heading,
    "req_id_assignment": b.req_id_of_section,
    "surrounding_text": b.surrounding,
    "size_runs": b.size_runs,
    "heading_continuation": b.continuation,
    "page_counter": b.paragraphs_page,
    "strike_cascade": b.strike_cascade,
    "strike_majority": b.struck_majority,
    "profile_body_mode": b.body_size,
    "profile_heading_clusters": b.heading_clusters,
    "pattern_election": b.pattern_election,
    "profile_counts": b.profile_counts,
}

BLOCKS = f"""b0 AS (SELECT doc_id, source, i - 1 AS idx, trim(replace(string_split(text, chr(10))[i], chr(13), '')) AS text FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS t(i) WHERE text IS NOT NULL),
  b AS (SELECT *, CASE WHEN starts_with(text, '|') THEN 'table' WHEN regexp_matches(text, '{b.HEADING}') THEN 'heading' WHEN regexp_matches(text, '{b.LIST_ITEM}') THEN 'list' ELSE 'paragraph' END AS type FROM b0 WHERE text <> '')"""
DENSE = f"{BLOCKS}, d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS dense FROM b)"
NORM = "regexp_replace({c}, '[0-9]+', '#', 'g')"
SECT = f"""{BLOCKS}, sb AS (SELECT *, sum((type = 'heading')::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS section FROM b),
  sec AS (SELECT doc_id, section, arg_min(text, idx) AS title, count(*) FILTER (type = 'table') AS tables, coalesce(string_agg(text, chr(10) ORDER BY idx) FILTER (type <> 'heading'), '') AS body FROM sb WHERE section > 0 GROUP BY ALL)"""
RANGES = f"""{DENSE}, isl AS (SELECT doc_id, type, dense, dense - row_number() OVER (PARTITION BY doc_id, type ORDER BY dense) AS g FROM d WHERE type <> 'paragraph'),
  ranges AS (SELECT doc_id, type, min(dense) AS start, max(dense) AS "end", count(*) AS n FROM isl GROUP BY doc_id, type, g)"""
ONCE = "(SELECT * FROM requirements QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY ingested_at) = 1)"

SQL = {
    "block_explode": f"WITH {DENSE} SELECT doc_id, idx, dense, type, length(text) AS chars FROM d",
    "block_type_cube": f"WITH {BLOCKS} SELECT source, type, count(*) AS n, sum(length(text)) AS chars, grouping_id(source, type) AS gid FROM b GROUP BY CUBE (source, type)",
    "block_type_filter": f"WITH {BLOCKS} SELECT doc_id, idx, len(string_split(text, '|')) AS cells FROM b WHERE type = 'table'",
    "repeated_line_antijoin": f"""WITH {BLOCKS}, n AS (SELECT *, {NORM.replace('{c}', 'text')} AS norm FROM b), docs AS (SELECT source, count(DISTINCT doc_id) AS docs FROM n GROUP BY 1),
      rep AS (SELECT n.source, norm FROM n JOIN docs ON docs.source = n.source GROUP BY n.source, norm, docs HAVING count(DISTINCT doc_id) >= greatest(2.0, 0.02 * docs))
      SELECT source, count(*) AS blocks, count(DISTINCT doc_id) AS docs FROM n WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.source = n.source AND rep.norm = n.norm) GROUP BY 1""",
    "toc_page_ratio": f"WITH {BLOCKS}, g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (regexp_matches(text, '[0-9]+\\.?$')) AS hits FROM b WHERE type IN ('paragraph', 'list') GROUP BY 1) SELECT * FROM g WHERE n >= 2 AND hits / n >= 0.3",
    "sessionize_sections": f"WITH {SECT} SELECT * FROM sec",
    "first_section_wins": f"WITH {SECT} SELECT doc_id, {NORM.replace('{c}', 'title')} AS key, min(section) AS section, count(*) AS merged, sum(tables) AS tables FROM sec GROUP BY ALL",
    "gaps_islands_ranges": f"WITH {RANGES} SELECT * FROM ranges",
    "range_spans": f'WITH {RANGES} SELECT doc_id, type, min(start) AS start, max("end") AS "end", count(*) AS n_ranges FROM ranges GROUP BY ALL',
    "interval_annotate": f"""WITH {RANGES} SELECT d.doc_id, d.dense, r.start AS range_start FROM d LEFT JOIN ranges r ON r.type = 'table' AND r.doc_id = d.doc_id AND d.dense BETWEEN r.start AND r."end" """,
    "revision_history_consume": f"""WITH {DENSE}, m AS (SELECT doc_id, last_value(CASE WHEN type = 'heading' AND starts_with(text, 'CR-') THEN 'open' WHEN type = 'paragraph' THEN 'close' END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY dense) AS state FROM d)
      SELECT doc_id, count(*) AS dropped FROM m WHERE state = 'open' GROUP BY 1""",
    "req_id_assignment": f"""WITH {SECT}, ids AS (SELECT doc_id, idx, section, regexp_extract(text, '{b.REQ_LINE}') AS rid FROM sb WHERE regexp_matches(text, '{b.REQ_LINE}')),
      own AS (SELECT doc_id, section, arg_min(rid, idx) AS rid FROM ids WHERE section > 0 GROUP BY ALL), pend AS (SELECT doc_id, arg_max(rid, idx) AS pending FROM ids WHERE section = 0 GROUP BY 1),
      f AS (SELECT DISTINCT sb.doc_id, section, pending FROM sb JOIN pend ON pend.doc_id = sb.doc_id WHERE section = 1)
      SELECT coalesce(own.doc_id, f.doc_id) AS doc_id, coalesce(own.section, f.section) AS section, coalesce(rid, pending) AS rid FROM own FULL JOIN f ON f.doc_id = own.doc_id AND f.section = own.section""",
    "surrounding_text": f"""WITH {BLOCKS}, w AS (SELECT *, lag(type) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM b), first AS (SELECT doc_id, idx FROM w WHERE type = 'table' AND (prev IS NULL OR prev <> 'table')),
      t AS (SELECT f.doc_id, f.idx, b.idx AS bi, left(b.text, 200) AS text, row_number() OVER (PARTITION BY f.doc_id, f.idx ORDER BY b.idx DESC) AS rn FROM first f LEFT JOIN b ON b.doc_id = f.doc_id AND b.idx < f.idx AND b.type <> 'table')
      SELECT doc_id, idx, coalesce(string_agg(text, chr(10) ORDER BY bi), '') AS around FROM t WHERE rn <= 2 GROUP BY ALL""",
    "size_runs": f"""WITH {BLOCKS}, j AS (SELECT doc_id, idx, coalesce((abs(length(text) - lag(length(text)) OVER (PARTITION BY doc_id ORDER BY idx)) > 200)::INT, 0) AS jump FROM b), r AS (SELECT doc_id, idx, sum(jump) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM j)
      SELECT doc_id, run, count(*) AS n, min(idx) AS first_idx FROM r GROUP BY ALL""",
    "heading_continuation": f"""WITH {BLOCKS}, w AS (SELECT doc_id, idx, type, coalesce(max((type = 'table')::INT) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen, lag(type) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM b)
      SELECT doc_id, idx, coalesce(seen AND prev = 'heading', false) AS continues FROM w WHERE type = 'heading'""",
    "page_counter": f"""WITH {BLOCKS}, p AS (SELECT doc_id, idx, text, 1 + sum((text = '')::INT) OVER (PARTITION BY doc_id ORDER BY idx) AS page FROM b0) SELECT doc_id, page, count(*) AS blocks FROM p WHERE text <> '' GROUP BY ALL""",
    "strike_cascade": f"""WITH r AS {ONCE}, s AS (SELECT DISTINCT mno, release, plan_id, section_number AS p FROM r WHERE deleted_at IS NOT NULL AND section_number IS NOT NULL)
      SELECT r.rec_id, min(len(string_split(s.p, '.'))) AS struck_depth FROM r JOIN s ON s.mno = r.mno AND s.release = r.release AND s.plan_id = r.plan_id AND (r.section_number = s.p OR starts_with(r.section_number, s.p || '.')) GROUP BY 1""",
    "strike_majority": f"""WITH g AS (SELECT plan_id, sum(CASE WHEN deleted_at IS NOT NULL THEN coalesce(length(text), 0) ELSE 0 END) AS struck, sum(coalesce(length(text), 0)) AS total FROM {ONCE} GROUP BY 1) SELECT *, struck * 2 > total AS is_struck FROM g""",
    "profile_body_mode": f"""WITH {BLOCKS}, c AS (SELECT source, (round(length(text) / 20) * 20)::INT AS size, count(*) AS n, min(doc_id * 100000 + idx) AS f FROM b WHERE type = 'paragraph' GROUP BY ALL)
      SELECT source, arg_max(size, {{'n': n, 'f': -f}}) AS size, max(n) AS n FROM c GROUP BY 1""",
    "profile_heading_clusters": f"""WITH {BLOCKS}, h AS (SELECT source, split_part({NORM.replace('{c}', 'text')}, ' ', 1) AS shape, doc_id, idx, left(text, 80) AS sample FROM b WHERE type = 'heading'), r AS (SELECT *, row_number() OVER (PARTITION BY source, shape ORDER BY doc_id, idx) AS rn FROM h)
      SELECT source, shape, count(*) AS n, string_agg(sample, ' / ' ORDER BY rn) FILTER (rn <= 5) AS samples FROM r GROUP BY ALL HAVING count(*) >= 3""",
    "pattern_election": "WITH c AS (" + " UNION ALL ".join(f"SELECT {i} AS ord, '{n}' AS pattern, coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS matches FROM documents" for i, (n, p) in enumerate(b.CANDIDATES)) + ") SELECT pattern, matches, ord = (SELECT arg_max(ord, {'m': matches, 'o': -ord}) FROM c) AS elected FROM c",
    "profile_counts": f"""WITH {BLOCKS} SELECT source, count(*) FILTER (regexp_matches(text, '^[0-9]+(\\.[0-9]+)*\\s')) AS numbered, sum(len(regexp_extract_all(text, '{b.REQ_LINE}'))) AS ids, max(length(text)) AS longest, count(DISTINCT length(text)) AS sizes, count(*) FILTER (type = 'heading') AS headings FROM b GROUP BY 1""",
}
