"""Elections over a document family, and the small reports around references and terms.

An election counts over all documents with partial aggregation and picks by an explicit order (pattern first, then document),
so the result does not depend on how rows are laid out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions import text as tx
from reqloom.operators.blocks import blocks, doc_window, normal_line
from reqloom.operators.layout import pages
from reqloom.operators.patterns import once
from reqloom.operators.references import resolve_internal, standards_index
from reqloom.operators.retrieval import glossary_words
from reqloom.sources.tables import table

# What a plan's first page may say, with candidate patterns in order of preference.
METADATA = {
    "change": [r"CR-([0-9]+)", r"Change ([0-9]+)"],
    "release": [r"Release:? +(20[0-9]{2}_[a-z]{3})", r"\\| *(20[0-9]{2}_[a-z]{3})", r"(20[0-9]{2}_[a-z]{3})"],
    "version": [r"Version:? +([0-9]+[.][0-9.]*[0-9])", r"from build ([0-9]+)"],
}
# Forms of cross-references that a family may use.
CROSS_REFERENCES = [("standard_section", r"3GPP TS [0-9]{2}[.][0-9]{3} clause [0-9.]+"), ("standard", r"TS [0-9]{2}[.][0-9]{3}"), ("requirement", r"[A-Z]{2}_REQ_[A-Z]+_[0-9]+"), ("see_section", r"see section [0-9.]+"), ("issue", r"#[0-9]+")]
TOC_SHARE, PREVIEW = 0.7, 200


def toc_pages(spark: SparkSession, base: str) -> DataFrame:
    """Pages with two or more paragraphs of which at least 70 % end in a number, as entries of a table of contents do."""
    p = pages(spark, base).where("type in ('paragraph', 'list')")
    g = p.groupBy("doc_id", "page").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(r"[0-9]+\.?$")).alias("hits"))
    return g.where((F.col("n") >= 2) & (F.col("hits") / F.col("n") >= TOC_SHARE))


def metadata_election(spark: SparkSession, base: str) -> DataFrame:
    """For each kind of metadata the pattern elected: the first one that any first page matches; with the value on the first
    document that matches it, and on how many documents it does. Kinds that nothing matches have no row."""
    lines = pages(spark, base).where("page = 1")
    first = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), " ").alias("head"))  # one page
    tries = [F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("pattern"), F.regexp_extract("head", p, 1).alias("value")) for kind, ps in METADATA.items() for i, p in enumerate(ps)]
    hits = first.select("doc_id", F.explode(F.array(*tries)).alias("t")).select("doc_id", "t.*").where("value <> ''")
    per = hits.groupBy("kind", "pattern").agg(F.min_by("value", "doc_id").alias("value"), F.count("*").alias("docs"))
    return per.groupBy("kind").agg(F.min_by(F.struct("pattern", "value", "docs"), "pattern").alias("b")).select("kind", "b.*")


def phrase_election(spark: SparkSession, base: str) -> DataFrame:
    """Normalised headings that are followed by a table within two blocks (one block that is no paragraph may lie between),
    with how often, and the most frequent one elected (ties: the first by text)."""
    w = doc_window()
    b = blocks(spark, base).withColumn("next", F.lead("type", 1).over(w)).withColumn("after", F.lead("type", 2).over(w))
    near = (F.col("next") == "table") | ((F.col("next") != "paragraph") & (F.col("after") == "table"))
    h = b.where((F.col("type") == "heading") & near).groupBy(F.lower(F.trim(normal_line(F.col("text")))).alias("phrase")).agg(F.count("*").alias("n"))
    best = h.agg(F.min_by("phrase", F.struct(-F.col("n"), "phrase")).alias("best"))
    return h.crossJoin(F.broadcast(best)).select("phrase", "n", (F.col("phrase") == F.col("best")).alias("elected"))  # one row


def reference_forms(spark: SparkSession, base: str) -> DataFrame:
    """The forms of cross-references that occur at all, with their number."""
    d = table(spark, base, "documents").where("text is not null")
    g = d.agg(*[F.sum(F.regexp_count("text", F.lit(p))).alias(n) for n, p in CROSS_REFERENCES])
    rows = F.array(*[F.struct(F.lit(n).alias("form"), F.coalesce(F.col(n), F.lit(0)).alias("matches")) for n, _ in CROSS_REFERENCES])
    return g.select(F.explode(rows).alias("r")).select("r.*").where("matches > 0")


def glossary_index(spark: SparkSession, base: str) -> DataFrame:
    """Every glossary word with the entry that is pinned for it and the number of requirements whose title uses it."""
    words = once(table(spark, base, "requirements").where("title is not null"), "rec_id").select("rec_id", F.explode(F.array_distinct(tx.tokenize(F.col("title")))).alias("word"))
    used = words.groupBy("word").agg(F.count("*").alias("titles"))
    return glossary_words(spark, base).join(used, "word", "left").select("word", "chunk", F.coalesce("titles", F.lit(0)).alias("titles"))


def sorted_index(spark: SparkSession, base: str) -> DataFrame:
    """The index of cited standards in its order: spec by text, then release by number."""
    w = Window.partitionBy("spec").orderBy("release_num")
    i = standards_index(spark, base).select("spec", "release_num", "ref_count")
    return i.select("spec", F.row_number().over(w).alias("position"), "release_num", "ref_count").orderBy("spec", "position")


def review_rows(spark: SparkSession, base: str) -> DataFrame:
    """Internal references for review: each with the start of its source's text and the correction that its delivered status
    needs: `false_broken` (called broken, yet it resolves) before `wrong_target` (called resolved, yet nothing is there).
    Per source requirement the last reference of the stronger correction is shown."""
    refs = once(table(spark, base, "refs_internal"), "ref_id").select("ref_id", "source_req_id", "target_req_id", F.col("status").alias("said")).where("source_req_id is not null")
    j = refs.join(resolve_internal(spark, base).select("ref_id", "status", "target_title"), "ref_id")
    kind = F.when((F.col("said") == "broken") & (F.col("status") == "resolved"), "false_broken").when((F.col("said") == "resolved") & (F.col("status") == "broken"), "wrong_target")
    j = j.withColumn("correction", kind).where("correction is not null")
    order = F.struct(F.when(F.col("correction") == "false_broken", 1).otherwise(0), "ref_id")
    one = j.groupBy("source_req_id").agg(F.max_by(F.struct("ref_id", "target_req_id", "target_title", "correction"), order).alias("r"), F.count("*").alias("n"))
    text = table(spark, base, "requirements").where("req_id is not null").groupBy(F.col("req_id").alias("source_req_id")).agg(F.min_by(F.substring("text", 1, PREVIEW), "rec_id").alias("preview"))
    return one.join(text, "source_req_id", "left").select("source_req_id", "r.*", "n", "preview")
