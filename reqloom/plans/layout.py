"""Queries and SQL of page geometry, scalar text functions and the vector store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.functions import text as tx
from reqloom.operators import layout as y
from reqloom.operators.patterns import once
from reqloom.operators.retrieval import chunks, vectors
from reqloom.plans.blocks import BLOCKS
from reqloom.plans.retrieval import _COS, CHUNKS
from reqloom.sources.tables import Scratch, table
from reqloom.sources.vectorstore import VectorStore


def scalar_texts(spark: SparkSession, base: str) -> DataFrame:
    """Labels, slugs, notes and stripped headers of every requirement."""
    r = once(table(spark, base, "requirements"), "rec_id")
    labels = tx.applicability_labels(F.coalesce(F.array_join(F.concat("applicability", F.transform("applicability", lambda x: F.upper(x))), " and "), F.lit("")))
    headed = F.concat(F.lit("[a: "), F.coalesce("plan_id", F.lit("")), F.lit("]\n[b] c\n"), F.coalesce("title", F.lit("")))
    return r.select("rec_id", F.array_join(labels, "|").alias("labels"), tx.feature_slug(F.col("title")).alias("slug"), tx.truncate_note(F.col("title"), 12).alias("note"), tx.strip_headers(headed).alias("stripped"))


def spec_numbers(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "spec_catalog").select("spec", tx.clean_spec_number(F.concat(F.lit(" 3GPP TS "), "spec", F.lit(". "))).alias("a"), tx.clean_spec_number(F.concat(F.lit("TS "), "spec")).alias("b"))


def unit_vectors(spark: SparkSession, base: str) -> DataFrame:
    """The first component and the length of every vector after normalising twice its double."""
    v = vectors(spark, base).select("vec_id", tx.l2_normalize(F.transform("embedding", lambda x: x * 2)).alias("u"))
    return v.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(tx.norm(F.col("u")), 6).alias("length"))


def _store(spark: SparkSession, base: str) -> VectorStore:
    """A store of every chunk that has a vector."""
    c = chunks(spark, base).join(vectors(spark, base).select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")
    s = VectorStore(spark, f"{Scratch(spark).root}/store")
    s.build(c.withColumn("id", F.concat(F.lit("req:"), "req_id")), ["mno", "release", "plan_id", "req_id"])
    return s


def store_scan(spark: SparkSession, base: str) -> DataFrame:
    """What the store holds, by metadata."""
    m = F.col("metadata")
    return _store(spark, base).get_all().groupBy(m["mno"].alias("mno"), m["release"].alias("release")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def store_query(spark: SparkSession, base: str) -> DataFrame:
    """The five nearest chunks of two operators for every vector with an id divisible by 100."""
    asked = vectors(spark, base).where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    return _store(spark, base).query(asked, 5, {"$or": [{"mno": "NVA"}, {"$and": [{"mno": "OKT"}, {"release": {"$ne": "2024_jun"}}]}]})


QUERIES = {
    "layout_margins": y.kept_in_margins,
    "layout_boilerplate": y.kept_boilerplate,
    "layout_headers_footers": y.headers_footers,
    "layout_running_lines": y.kept_running,
    "layout_table_text": y.kept_table_text,
    "layout_struck": y.struck_blocks,
    "layout_struck_characters": y.struck_characters,
    "layout_reading_order": y.ordered,
    "scalar_texts": scalar_texts,
    "spec_numbers": spec_numbers,
    "unit_vectors": unit_vectors,
    "vector_store_scan": store_scan,
    "vector_store_query": store_query,
}

PAGES = f"""{BLOCKS}, pg AS (SELECT doc_id, idx, idx // 12 + 1 AS page, type, text, 72.0 AS x0, (idx % 12) * 66.0 + 20 AS y0, least(540.0, 72.0 + 4.0 * length(text)) AS x1, (idx % 12) * 66.0 + 32 AS y1 FROM b),
  edge AS (SELECT *, regexp_replace(trim(text), '[0-9]+', '#', 'g') AS norm FROM pg WHERE page <= 20 AND (y1 < 65 OR y0 > 742)),
  npg AS (SELECT doc_id, count(DISTINCT page) AS pages FROM pg WHERE page <= 20 GROUP BY 1),
  run AS (SELECT e.doc_id, norm, sum((y1 < 65)::INT) AS above, count(*) AS n FROM edge e JOIN npg ON npg.doc_id = e.doc_id GROUP BY e.doc_id, norm, pages HAVING count(DISTINCT page) >= 0.6 * pages),
  strokes AS (SELECT doc_id, page, x0, x0 + (x1 - x0) * CASE WHEN (doc_id * 31 + idx) % 17 = 1 THEN 0.25 ELSE 0.6 END AS x1, (y0 + y1) / 2 AS y FROM pg WHERE (doc_id * 31 + idx) % 17 IN (0, 1)),
  lines AS (SELECT * FROM strokes WHERE x1 - x0 >= 5)"""
_BOILER = "(?i)^\\s*page \\d+ of \\d+\\s*$|confidential|proprietary"
_LAB = "list_filter(list_transform(regexp_split_to_array({c}, '(?i)[,;|]|\\band\\b|\\bor\\b'), lambda x: trim(x)), lambda x: x <> '')"

SQL = {
    "layout_margins": f"WITH {PAGES} SELECT doc_id, count(*) AS n, min(idx) AS first_idx FROM pg WHERE NOT (y1 < 65 OR y0 > 742) GROUP BY 1",
    "layout_boilerplate": f"WITH {PAGES} SELECT doc_id, count(*) AS n, sum(length(text)) AS chars FROM pg WHERE (x1 - x0) * (y1 - y0) >= 10 AND NOT regexp_matches(text, '{_BOILER}') GROUP BY 1",
    "layout_headers_footers": f"WITH {PAGES} SELECT doc_id, norm, CASE WHEN above * 2 >= n THEN 'header' ELSE 'footer' END AS side FROM run",
    "layout_running_lines": f"WITH {PAGES} SELECT doc_id, count(*) AS n FROM pg WHERE NOT ((y1 < 65 OR y0 > 742) AND EXISTS (SELECT 1 FROM run WHERE run.doc_id = pg.doc_id AND run.norm = regexp_replace(trim(text), '[0-9]+', '#', 'g'))) GROUP BY 1",
    "layout_table_text": f"""WITH {PAGES}, tb AS (SELECT doc_id, page, min(x0) AS a0, min(y0) AS b0, max(x1) AS a1, max(y1) AS b1 FROM pg WHERE type = 'table' GROUP BY ALL)
      SELECT doc_id, count(*) AS n, sum(idx) AS idxs FROM pg WHERE type <> 'table' AND NOT EXISTS (SELECT 1 FROM tb WHERE tb.doc_id = pg.doc_id AND tb.page = pg.page
        AND greatest(0, least(x1, a1) - greatest(x0, a0)) * greatest(0, least(y1, b1) - greatest(y0, b0)) > 0.5 * (x1 - x0) * (y1 - y0)) GROUP BY 1""",
    "layout_struck": f"""WITH {PAGES}, sp AS (SELECT doc_id, count(*) AS spans FROM pg WHERE EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = pg.doc_id AND l.page = pg.page AND abs((pg.y0 + pg.y1) / 2 - l.y) <= greatest(2, 0.4 * (pg.y1 - pg.y0))
        AND least(pg.x1, l.x1) - greatest(pg.x0, l.x0) >= 0.5 * (pg.x1 - pg.x0)) GROUP BY 1),
      rw AS (SELECT doc_id, count(*) AS rows FROM pg WHERE type = 'table' AND EXISTS (SELECT 1 FROM lines l WHERE l.doc_id = pg.doc_id AND l.page = pg.page AND l.y > pg.y0 + 1.5 AND l.y < pg.y1 - 1.5 AND l.x1 > pg.x0 AND l.x0 < pg.x1) GROUP BY 1)
      SELECT coalesce(sp.doc_id, rw.doc_id) AS doc_id, coalesce(spans, 0) AS spans, coalesce(rows, 0) AS rows FROM sp FULL JOIN rw ON rw.doc_id = sp.doc_id""",
    "layout_struck_characters": f"WITH {PAGES} SELECT doc_id, page AS idx, sum(CASE WHEN idx % 3 <> 1 AND doc_id % 2 = 0 THEN length(text) ELSE 0 END) * 2 > sum(length(text)) AS struck FROM pg GROUP BY ALL",
    "layout_reading_order": f"WITH {PAGES} SELECT doc_id, idx AS was, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS idx FROM pg",
    "scalar_texts": f"""WITH r AS (SELECT * FROM requirements QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY ingested_at) = 1),
      x AS (SELECT *, {_LAB.replace('{c}', "coalesce(array_to_string(list_concat(applicability, list_transform(applicability, lambda x: upper(x))), ' and '), '')")} AS ls FROM r)
      SELECT rec_id, coalesce(array_to_string(list_filter(ls, lambda v, i: list_position(list_transform(ls, lambda z: lower(z)), lower(v)) = i), '|'), '') AS labels, regexp_replace(upper(title), '[^A-Z0-9_]', '_', 'g') AS slug,
        CASE WHEN length(title) <= 12 THEN title ELSE regexp_replace(left(title, 12), '\\s+\\S*$', '') || '…' END AS note, coalesce(title, '') AS stripped FROM x""",
    "spec_numbers": "SELECT spec, regexp_replace(trim(spec), '[.]+$', '') AS a, regexp_replace(trim(spec), '[.]+$', '') AS b FROM spec_catalog",
    "unit_vectors": """SELECT vec_id, round(embedding[1]::DOUBLE / n, 6) AS first, 1.0 AS length FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings WHERE embedding IS NOT NULL)""",
    "vector_store_scan": f"WITH {CHUNKS}, k AS (SELECT c.*, m.mno, m.release FROM chunks c JOIN embeddings e ON e.vec_id = c.chunk_id JOIN (SELECT req_id, arg_min(mno, rec_id) AS mno, arg_min(release, rec_id) AS release FROM requirements GROUP BY 1) m ON m.req_id = c.req_id) SELECT mno, release, count(*) AS n, sum(length(text)) AS chars FROM k GROUP BY ALL",
    "vector_store_query": f"""WITH k AS (SELECT req_id, min(rec_id) AS chunk_id, arg_min(mno, rec_id) AS mno, arg_min(release, rec_id) AS release FROM requirements WHERE req_id IS NOT NULL GROUP BY 1),
      d AS (SELECT a.vec_id AS qid, 'req:' || req_id AS id, round({_COS}, 6) AS distance FROM embeddings a, embeddings b JOIN k ON k.chunk_id = b.vec_id WHERE a.vec_id % 100 = 0 AND (mno = 'NVA' OR (mno = 'OKT' AND release <> '2024_jun')))
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM d) WHERE rank <= 5""",
}
