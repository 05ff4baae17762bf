"""Section trees, inheritance and chunk building over requirements and spec sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions import text as tx
from reqloom.operators.patterns import once
from reqloom.sources.tables import table

TREE = ["mno", "release", "plan_id"]
# A small glossary (term, expansion); no expansion contains a term.
GLOSSARY = [("eSIM", "embedded subscriber module"), ("NR", "New Radio"), ("LTE", "Long Term Evolution"), ("UE", "user equipment"), ("WLAN", "wireless local area network")]


def sections(spark: SparkSession, base: str) -> DataFrame:
    """The first requirement of each section of a tree (later ones with its number are re-creations)."""
    r = table(spark, base, "requirements").where("section_number is not null")
    return r.groupBy(*TREE, "section_number").agg(F.min("rec_id").alias("rec_id"), F.min_by("req_id", "rec_id").alias("req_id"), F.min_by("title", "rec_id").alias("title"), F.min_by("applicability", "rec_id").alias("applicability"))


def parent_links(spark: SparkSession, base: str) -> DataFrame:
    """Parent by section number minus its last component, if present; and the number of children."""
    s = sections(spark, base).withColumn("up", tx.parent_section(F.col("section_number")))
    parent = s.select(*TREE, F.col("section_number").alias("up"), F.col("req_id").alias("parent_req_id"))
    kids = s.where("up is not null").groupBy(*TREE, F.col("up").alias("section_number")).agg(F.count("*").alias("n_children"))
    j = s.join(parent, [*TREE, "up"], "left").join(kids, [*TREE, "section_number"], "left")
    return j.select("rec_id", "req_id", F.when(F.col("parent_req_id").isNotNull(), F.col("up")).alias("parent_section"), "parent_req_id", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def hierarchy_paths(spark: SparkSession, base: str) -> DataFrame:
    """For each present prefix of the section number its title, or the number where the title is blank; root to leaf."""
    s = sections(spark, base)
    up = s.select("rec_id", *TREE, F.posexplode(tx.section_prefixes(F.col("section_number"))).alias("pos", "prefix"))
    names = s.select(*TREE, F.col("section_number").alias("prefix"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), "section_number").alias("name"))
    j = up.join(names, [*TREE, "prefix"])
    return j.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " > ").alias("path"))


def applicability(spark: SparkSession, base: str) -> DataFrame:
    """Own labels, else those of the nearest ancestor that has some, else `all`."""
    s = sections(spark, base)
    up = s.select("rec_id", *TREE, F.posexplode(tx.section_prefixes(F.col("section_number"))).alias("pos", "prefix"))
    have = s.where(F.size("applicability") > 0).select(*TREE, F.col("section_number").alias("prefix"), F.col("applicability").alias("labels"))
    got = up.join(have, [*TREE, "prefix"]).groupBy("rec_id").agg(F.max_by("labels", "pos").alias("labels"))
    return s.select("rec_id").join(got, "rec_id", "left").select("rec_id", F.coalesce(F.array_join("labels", ","), F.lit("all")).alias("labels"))


def table_rows(spark: SparkSession, base: str) -> DataFrame:
    """Every row of every table of a requirement as text: `header: cell; ...`."""
    r = once(table(spark, base, "requirements").where(F.size("tables") > 0), "rec_id")
    t = r.select("rec_id", F.posexplode("tables").alias("table_no", "t"))
    x = t.select("rec_id", "table_no", F.col("t.headers").alias("headers"), F.posexplode("t.rows").alias("row_no", "cells"))
    return x.select("rec_id", "table_no", "row_no", tx.row_text(F.col("headers"), F.col("cells")).alias("row_text"))


def markdown_tables(spark: SparkSession, base: str) -> DataFrame:
    r = once(table(spark, base, "requirements").where(F.size("tables") > 0), "rec_id")
    t = r.select("rec_id", F.posexplode("tables").alias("table_no", "t"))
    return t.select("rec_id", "table_no", tx.markdown_table(F.col("t.headers"), F.col("t.rows")).alias("markdown"))


def children_titles(spark: SparkSession, base: str) -> DataFrame:
    """Titles of the listed children, in the list's order (children that exist in the plan only)."""
    r = once(table(spark, base, "requirements"), "rec_id")
    kids = r.where(F.size("children") > 0).select("rec_id", "plan_id", F.posexplode("children").alias("pos", "req_id"))
    names = r.groupBy("plan_id", "req_id").agg(F.min_by("title", "rec_id").alias("title"))
    j = kids.join(names, ["plan_id", "req_id"])
    return j.groupBy("rec_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: x["title"]), "; ").alias("child_titles"))


def chunk_texts(spark: SparkSession, base: str) -> DataFrame:
    """One chunk per requirement id: header, path, id, title, body and tables; of several the longest text, then the first."""
    r = once(table(spark, base, "requirements").where("req_id is not null"), "rec_id")
    head = F.concat(F.lit("[MNO: "), F.col("mno"), F.lit(" | Release: "), F.col("release"), F.lit(" | Plan: "), F.col("plan_id"), F.lit("]"))
    tables = F.array_join(F.filter(F.transform("tables", lambda t: tx.markdown_table(t["headers"], t["rows"])), lambda x: x.isNotNull()), "\n")
    opt = lambda c: F.nullif(F.trim(c), F.lit(""))
    text = F.concat_ws("\n", head, F.concat(F.lit("[Section: "), opt(F.col("section_number")), F.lit("]")), F.concat(F.lit("[Req ID: "), F.col("req_id"), F.lit("]")), F.concat(F.lit("\n"), opt(F.col("title"))), opt(F.col("text")), opt(tables))
    chunks = r.select(F.concat(F.lit("req:"), "req_id").alias("chunk_id"), "rec_id", text.alias("text"))
    best = F.max_by("text", F.struct(F.length("text"), -F.col("rec_id")))
    return chunks.groupBy("chunk_id").agg(best.alias("text"), F.count("*").alias("n_versions"))


def glossary_chunks(spark: SparkSession, base: str) -> DataFrame:
    """One glossary chunk per catalogued spec."""
    c = table(spark, base, "spec_catalog")
    return c.select(F.concat(F.lit("glossary:specs:"), tx.slug(F.col("spec"))).alias("chunk_id"), F.concat(F.lit("[Glossary]\n"), "spec", F.lit(": "), "title").alias("text"), F.col("spec").alias("acronym"), F.col("title").alias("expansion"))


def expand_definitions(c, glossary=GLOSSARY):
    """`TERM (expansion)` at the first whole-word occurrence of each term; longer terms first; case counts."""
    for term, expansion in sorted(glossary, key=lambda x: -len(x[0])):
        c = F.regexp_replace(c, rf"(?s)^(.*?)\b{term}\b", f"$1{term} ({expansion})")
    return c


def definitions_expanded(spark: SparkSession, base: str) -> DataFrame:
    r = once(table(spark, base, "requirements").where("text is not null"), "rec_id")
    return r.select("rec_id", expand_definitions(F.col("text")).alias("text"))


def spec_parent_links(spark: SparkSession, base: str) -> DataFrame:
    """Parent by number: a letter suffix is stripped, then the last component; annexes have none."""
    s = once(table(spark, base, "spec_sections"), "sec_id").where("number is not null")
    bare = F.regexp_replace("number", r"[A-Za-z]+$", "")
    up = F.when(F.startswith("number", F.lit("Annex")), None).otherwise(tx.parent_section(bare))
    s = s.select("sec_id", "spec_ingest_id", "number", up.alias("up"))
    have = s.select("spec_ingest_id", F.col("number").alias("up"), F.lit(True).alias("there")).distinct()
    return s.join(have, ["spec_ingest_id", "up"], "left").select("sec_id", F.when(F.col("there"), F.col("up")).alias("parent"))


def section_neighbourhood(spark: SparkSession, base: str) -> DataFrame:
    """Per parsed spec: sections that requirements cite, and their context (parent, grandparent, children, siblings and 3.1)
    without the cited ones."""
    s = once(table(spark, base, "spec_sections"), "sec_id").select("spec_ingest_id", "spec", "number").where("number is not null").distinct()
    refs = once(table(spark, base, "refs_standards"), "ref_id").select("ref_id", F.regexp_extract("spec", r"[0-9]+\.[0-9]+", 0).alias("spec"), F.col("spec_section").alias("number")).where("number <> ''")
    cited = s.join(refs.select("spec", "number").distinct(), ["spec", "number"]).select("spec_ingest_id", "number")
    parent = tx.parent_section(F.col("number"))
    up = cited.select("spec_ingest_id", parent.alias("number"))
    upup = up.select("spec_ingest_id", tx.parent_section(F.col("number")).alias("number"))
    with_parent = s.select("spec_ingest_id", "number", parent.alias("up"))
    kids = with_parent.join(cited.select("spec_ingest_id", F.col("number").alias("up")), ["spec_ingest_id", "up"]).select("spec_ingest_id", "number")
    sibs = with_parent.join(up.select("spec_ingest_id", F.col("number").alias("up")).where("up is not null").distinct(), ["spec_ingest_id", "up"]).select("spec_ingest_id", "number")
    defs = cited.select("spec_ingest_id", F.lit("3.1").alias("number"))
    wanted = up.union(upup).union(kids).union(sibs).union(defs).where("number is not null").distinct()
    context = wanted.join(s.select("spec_ingest_id", "number"), ["spec_ingest_id", "number"], "left_semi").join(cited, ["spec_ingest_id", "number"], "left_anti")
    return cited.withColumn("role", F.lit("cited")).unionByName(context.withColumn("role", F.lit("context")))


def spec_text_share(spark: SparkSession, base: str) -> DataFrame:
    """Characters of the cited sections as a share of the parsed spec's text."""
    near = section_neighbourhood(spark, base).where("role = 'cited'")
    s = once(table(spark, base, "spec_sections"), "sec_id").groupBy("spec_ingest_id", "number").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    j = s.join(near, ["spec_ingest_id", "number"], "left")
    got = F.sum(F.when(F.col("role").isNotNull(), F.col("n")).otherwise(0))
    return j.groupBy("spec_ingest_id").agg(F.round(F.try_divide(got * 100.0, F.sum("n")), 4).alias("share_pct"))


def section_depths(spark: SparkSession, base: str) -> DataFrame:
    """Per plan: requirements, distinct sections and the deepest section."""
    r = once(table(spark, base, "requirements"), "rec_id")
    return r.groupBy("plan_id").agg(F.count("*").alias("n_reqs"), F.countDistinct("section_number").alias("n_sections"), F.max(tx.section_depth(F.col("section_number"))).alias("max_depth"))


def confidence_rubric(spark: SparkSession, base: str) -> DataFrame:
    """Ordered rules on depth and title, and the tally per plan with a grand total (rollup)."""
    r = once(table(spark, base, "requirements"), "rec_id")
    depth, title = tx.section_depth(F.col("section_number")), F.coalesce(F.trim("title"), F.lit(""))
    conf = F.when(F.col("section_number").isNull() | (title == "") | (depth >= 10), "LOW").when((F.length(title) > 120) | (depth >= 7) | title.rlike(r"[.!?]$"), "MEDIUM").otherwise("HIGH")
    t = r.select("plan_id", conf.alias("c")).rollup("plan_id").agg(*[F.count_if(F.col("c") == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")], F.count("*").alias("total"))
    return t.select(F.coalesce("plan_id", F.lit("(all)")).alias("plan_id"), "high", "medium", "low", "total", F.round(F.col("high") * 100.0 / F.col("total"), 4).alias("high_pct"))


def zone_first_seen(spark: SparkSession, base: str) -> DataFrame:
    """First requirement of each two-level section of a tree, with its zone by keyword (first rule that matches)."""
    s = sections(spark, base).where(tx.section_depth(F.col("section_number")) >= 2)
    top = F.array_join(F.slice(F.split("section_number", r"\."), 1, 2), ".")
    t = F.lower(F.coalesce("title", F.lit("")))
    zone = F.when(t.rlike("timer|wait|retry"), "timing").when(t.rlike("message|request|notice"), "messaging").when(t.rlike("storage|cleanup|counter"), "storage").otherwise("content")
    return s.groupBy(*TREE, top.alias("section")).agg(F.min_by(zone, "rec_id").alias("zone"), F.min("rec_id").alias("rec_id"))
