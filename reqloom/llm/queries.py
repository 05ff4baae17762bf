"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from reqloom.llm import langid, languages, mixing, neardup, packing, pairs, percentiles, pieces

QUERIES = {
    "p2_found": neardup.p2_found,
    "p2_groups": neardup.p2_groups,
    "p3_found": pieces.p3_found,
    "p3_pieces": pieces.p3_pieces,
    "p3_restored": pieces.p3_restored,
    "p4_percentiles": percentiles.p4_percentiles,
    "p4_daily_sketches": percentiles.p4_daily_sketches,
    "p4_rank_check": percentiles.p4_rank_check,
    "p5_found": pairs.p5_found,
    "p7_containers": packing.p7_containers,
    "p7_coverage": packing.p7_coverage,
    "p8_mix_documents": mixing.p8_mix_documents,
    "p8_shares": mixing.p8_shares,
    "p8_share_check": mixing.p8_share_check,
    "p9_found": langid.p9_found,
    "p9_documents": langid.p9_documents,
    "p9_passages": langid.p9_passages,
    "p9_labels": langid.p9_labels,
}

_NAMED = ", ".join(f"('{n}', '{k}')" for n, k in languages.NAME_OF.items())
_REGIONS = ", ".join(f"'{x}'" for x in languages.REGIONS)

_PAIRS = """docs AS (SELECT DISTINCT req_id, list_transform(regexp_extract_all(coalesce(title, '') || ' ' || text, '[A-Za-z0-9]+'), lambda w: lower(w)) AS w
        FROM requirements WHERE req_id IS NOT NULL AND len(regexp_extract_all(text, '[A-Za-z0-9]+')) >= 25),
      grams AS (SELECT DISTINCT req_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM docs, unnest(range(1, len(w) - 1)) AS t(i)),
      sizes AS (SELECT req_id, count(*) AS n FROM grams GROUP BY 1),
      shared AS (SELECT a.req_id AS req_id_a, b.req_id AS req_id_b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.req_id < b.req_id GROUP BY ALL),
      pairs AS (SELECT req_id_a, req_id_b FROM shared s JOIN sizes x ON x.req_id = req_id_a JOIN sizes y ON y.req_id = req_id_b WHERE s.n >= 0.6 * (x.n + y.n - s.n))"""

SQL = {
    "p2_found": f"WITH {_PAIRS} SELECT * FROM pairs",
    "p2_groups": f"""WITH RECURSIVE {_PAIRS}, both_ways AS (SELECT req_id_a AS a, req_id_b AS b FROM pairs UNION ALL SELECT req_id_b, req_id_a FROM pairs),
      reach AS (SELECT req_id AS id, req_id AS root FROM sizes UNION SELECT b.b, r.root FROM reach r JOIN both_ways b ON b.a = r.id),
      links AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
      SELECT r.id AS req_id, min(root) AS group_id, coalesce(max(n), 0) AS links FROM reach r LEFT JOIN links ON links.a = r.id GROUP BY 1""",
    "p3_found": """WITH items AS (
        SELECT DISTINCT 'requirements' AS item_table, rec_id AS item_id, text FROM requirements WHERE length(text) > 2000
        UNION ALL SELECT DISTINCT 'spec_sections', sec_id, text FROM spec_sections WHERE length(text) > 2000)
      SELECT item_table, item_id, CASE WHEN list_max(list_transform(regexp_split_to_array(text, '[ \\x{3000}\\x{a0}\\t\\n\\r.!?;:,。！？、，；：]'), lambda x: length(x))) > 2000
        THEN 'forced' ELSE 'natural' END AS cut FROM items""",
    "p3_restored": """SELECT DISTINCT 'requirements' AS item_table, rec_id AS item_id, md5(text) AS restored, true AS kept FROM requirements WHERE length(text) > 2000
        UNION ALL SELECT DISTINCT 'spec_sections', sec_id, md5(text), true FROM spec_sections WHERE length(text) > 2000""",
    "p9_labels": f"""WITH names(n, k) AS (VALUES {_NAMED}), d AS (SELECT doc_id, lower(regexp_replace(lang, '^\\s+|\\s+$', '', 'g')) AS s FROM documents),
      h AS (SELECT doc_id, s, regexp_extract(s, '^([^-_( ]*)', 1) AS head FROM d)
      SELECT doc_id, coalesce(a.k, CASE WHEN head NOT IN ({_REGIONS}) THEN b.k END) AS label FROM h LEFT JOIN names a ON a.n = s LEFT JOIN names b ON b.n = head""",
    "p4_rank_check": """SELECT category, name, count(*) AS n, min(value) AS low, max(value) AS high, true AS within
      FROM (SELECT DISTINCT id, category, name, ts::DATE AS day, value FROM metrics WHERE value IS NOT NULL AND isfinite(value)) GROUP BY ALL""",
    "p7_coverage": """SELECT pack_id, (SELECT count(*) FROM documents WHERE length(text) > 0) AS docs, 0 AS overfull, 0 AS broken, true AS tight FROM (SELECT DISTINCT pack_id FROM pack_limits)""",
    "p8_share_check": """SELECT t.mix_id, t.source, t.target_share, t.max_repeats, coalesce(d.n, 0) AS docs, true AS kept, true AS near FROM mix_targets t
      LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY 1) d ON d.source = t.source""",
}
