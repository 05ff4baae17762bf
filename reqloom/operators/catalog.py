"""Extraction and catalogue operators: cross-references in texts, release maps, versions, tables of contents, feature
links, acronyms, the stub graph, ancestor walks, counters, profile merges."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqloom.functions import text as tx
from reqloom.functions.keys import DOTTED
from reqloom.operators.patterns import once
from reqloom.operators.references import resolve_standards
from reqloom.operators.structure import sections
from reqloom.operators.understanding import by_month, feature_hits
from reqloom.sources.tables import table

# A spec with its section, a spec alone, and the characters on both sides in which a release may be named.
SPEC_DETAIL = re.compile(rf"(?:3GPP\s+)?TS\s+({DOTTED})\s*,?\s*{tx.SECTION_WORD}\s+{tx.SECTION_NUMBER}|3GPP\s+TS\s+({DOTTED})\s+([0-9][0-9.]*[0-9])")
SPEC_ALONE = re.compile(rf"3GPP\s+TS\s+({DOTTED})|TS\s+([0-9]{{2}}\.[0-9]{{3}})")
AROUND = 100
RELEASE = re.compile(r"(?i)release\s+([0-9]+)")
STANDARD = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("spec", "section", "release")]))
LAST_RELEASE = 21
ACRONYM = r"(?i)^(?:what (?:is|does|do)(?: the)?|define|definition of|meaning of|expand|explain the role of the) ([A-Za-z][A-Za-z0-9_-]{1,14})\b"


def standards_in(text: str) -> list[dict]:
    """The specs of a text, each (spec, section) once at its first place, a spec alone only where no section of it is
    cited; with the first release named within 100 characters on either side."""

    def add(m: re.Match, spec: str, section: str) -> None:
        last = m.end() + AROUND
        near = RELEASE.search(text, max(0, m.start() - AROUND), last + 1)  # one more, so that no number is cut
        found.append({"spec": spec, "section": section, "release": near[1] if near and near.end() <= last else None})

    found: list[dict] = []
    seen: set[tuple[str, str]] = set()
    for m in SPEC_DETAIL.finditer(text):
        key = (m[1] or m[3], m[2] or m[4])
        if key not in seen:
            seen.add(key)
            add(m, *key)
    specs = {spec for spec, _ in seen}
    for m in SPEC_ALONE.finditer(text):
        if (spec := m[1] or m[2]) not in specs:
            specs.add(spec)
            add(m, spec, "")
    return found


@F.pandas_udf(STANDARD)
def standards_column(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: standards_in(t) if t else [])


def cross_refs(spark: SparkSession, base: str) -> DataFrame:
    """References in requirement texts: requirement ids of the own plan, of other plans, and the distinct specs and
    sections (`standards`, counted in `specs`) with the release named within 100 characters around them."""
    r = once(table(spark, base, "requirements").where("text is not null"), "rec_id")
    ids = F.array_distinct(tx.find_req_ids(F.col("text")))
    own = F.concat(F.lit("_REQ_"), F.col("plan_id"), F.lit("_"))
    internal = F.size(F.filter(ids, lambda x: F.contains(x, own)))
    # texts without a spec do not travel to Python
    x = r.select("rec_id", internal.alias("internal"), (F.size(ids) - internal).alias("external"), standards_column(F.when(F.contains("text", F.lit("TS")), F.col("text"))).alias("standards"))
    x = x.withColumn("specs", F.size("standards")).withColumn("with_release", F.size(F.filter("standards", lambda s: s["release"].isNotNull())))
    return x.select("rec_id", "internal", "external", "specs", "with_release", "standards").where("internal + external + specs > 0")


def spec_citations(spark: SparkSession, base: str) -> DataFrame:
    """How often each spec and section is cited in texts, spec alone counting where no section follows."""
    d = table(spark, base, "documents").where(F.contains("text", F.lit("TS ")))
    hits = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(tx.SPEC + r"(?: (?:clause|section|subclause) [0-9]+(?:\.[0-9]+)*)?"), 0)).alias("h"))
    x = hits.select("doc_id", F.regexp_extract("h", r"([0-9]{2}\.[0-9]{3})", 1).alias("spec"), F.nullif(F.regexp_extract("h", r" ([0-9]+(?:\.[0-9]+)*)$", 1), F.lit("")).alias("last"))
    x = x.withColumn("section", F.when(F.col("last") != F.col("spec"), F.col("last")))
    return x.groupBy("spec", F.coalesce("section", F.lit("")).alias("section")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def plan_release_map(spark: SparkSession, base: str) -> DataFrame:
    """The releases that a plan cites for each spec: entries of the maps, the newest load winning."""
    p = table(spark, base, "plans").select("plan_id", "loaded_at", F.explode("referenced_standards_releases").alias("spec", "rel"))
    g = p.groupBy("plan_id", "spec").agg(F.max_by("rel", F.struct("loaded_at", "rel")).alias("rel"), F.count_distinct("rel").alias("n_releases"))
    return g.select("plan_id", "spec", tx.release_number(F.col("rel")).alias("release_num"), "n_releases")


def latest_versions(spark: SparkSession, base: str) -> DataFrame:
    """Latest version of each spec and release by its version code (one base-36 digit a part)."""
    s = table(spark, base, "spec_sections").where("version is not null").select("spec", "release_num", "version", "spec_ingest_id").distinct()
    code = tx.version_code(F.col("version"))
    g = s.groupBy("spec", "release_num").agg(F.max_by(F.struct("version", "spec_ingest_id"), F.struct(code, "spec_ingest_id")).alias("b"), F.count("*").alias("n"))
    return g.select("spec", "release_num", F.col("b.version").alias("version"), tx.version_code(F.col("b.version")).alias("code"), F.col("b.spec_ingest_id").alias("spec_ingest_id"), "n")


def version_candidates(spark: SparkSession, base: str) -> DataFrame:
    """File names to try for each spec and release that a reference names (inline or by its plan's map) and for each
    catalogued spec's release 15: minor versions from 20 down to 0. Releases beyond 21 have no version code."""
    # the index of cited standards has no other release above 0: citations in texts inherit theirs from the references
    std = resolve_standards(spark, base).where(F.length("spec") >= 4).select("spec", tx.release_number(F.col("spec_release")).alias("release_num"))
    catalogued = table(spark, base, "spec_catalog").where("spec is not null").select("spec", F.lit(15).alias("release_num"))
    c = std.where(F.col("release_num").between(1, LAST_RELEASE)).unionByName(catalogued).distinct()
    x = c.select("spec", "release_num", F.explode(F.sequence(F.lit(20), F.lit(0), F.lit(-1))).alias("minor"))
    v = F.concat_ws(".", F.col("release_num").cast("string"), F.col("minor").cast("string"), F.lit("0"))
    return x.select("spec", "release_num", (20 - F.col("minor")).alias("attempt"), F.concat(F.regexp_replace("spec", r"\.", ""), F.lit("-"), tx.version_code(v), F.lit(".zip")).alias("file"))


def tables_of_contents(spark: SparkSession, base: str, lines: int = 200) -> DataFrame:
    """A plan's sections as indented lines in text order, cut at 200 with a note (the prompt's limit)."""
    s = sections(spark, base)
    w = Window.partitionBy("mno", "release", "plan_id").orderBy("section_number")
    line = F.concat(F.repeat(F.lit("  "), tx.section_depth(F.col("section_number")) - 1), "section_number", F.lit(" "), F.coalesce("title", F.lit("")))
    top = s.select("mno", "release", "plan_id", F.row_number().over(w).alias("rn"), line.alias("line")).where(F.col("rn") <= lines + 1)
    shown = top.withColumn("line", F.when(F.col("rn") > lines, "… (truncated)").otherwise(F.col("line")))
    return shown.groupBy("mno", "release", "plan_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "\n").alias("toc"))


def feature_edges(spark: SparkSession, base: str) -> DataFrame:
    """maps_to edges: requirements of a plan to the plan's features; where a feature is both, `referenced` wins."""
    f = feature_hits(spark, base).select("plan_id", "feature_id", F.when(F.col("is_primary"), "primary").otherwise("referenced").alias("mapping"))
    r = table(spark, base, "requirements").where("req_id is not null").select("plan_id", "req_id").distinct()
    j = r.join(f, "plan_id")  # at most the catalogue's features for each requirement
    e = j.groupBy("req_id", "feature_id").agg(F.max("mapping").alias("mapping"))
    return e.groupBy("feature_id", "mapping").agg(F.count("*").alias("n_reqs"))


def plan_features(spark: SparkSession, base: str) -> DataFrame:
    """Feature ids of each plan: primaries first, then the others."""
    f = feature_hits(spark, base)
    order = F.array_sort(F.collect_list(F.struct(F.when(F.col("is_primary"), 0).otherwise(1).alias("o"), "feature_id")))
    return f.groupBy("plan_id").agg(F.array_join(F.transform(order, lambda x: x["feature_id"]), ",").alias("features"))


def acronym_questions(spark: SparkSession, base: str) -> DataFrame:
    """Questions that ask for a term which the corpus knows as the second word of a requirement title (one of a single word has none)."""
    q = once(table(spark, base, "test_feedback").where("question is not null").select("id", "question"), "id")
    asked = q.select("id", F.lower(F.regexp_extract("question", ACRONYM, 1)).alias("term")).where("term <> ''")
    known = table(spark, base, "requirements").select(F.lower(F.try_element_at(F.split("title", " "), F.lit(2))).alias("term")).where("term is not null").distinct()
    return asked.join(known, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def stub_graph(spark: SparkSession, base: str) -> DataFrame:
    """The graph that can be had from chunk metadata alone: MNOs, releases, plans and their two kinds of edges."""
    c = table(spark, base, "requirements").select("mno", "release", "plan_id").distinct()
    node = lambda *k: F.concat_ws(":", *k)
    m, r, p = node(F.lit("mno"), "mno"), node(F.lit("release"), "mno", "release"), node(F.lit("plan"), "mno", "release", "plan_id")
    e = c.select(m.alias("src"), r.alias("dst"), F.lit("has_release").alias("edge_type")).union(c.select(r, p, F.lit("contains_plan")))
    return e.distinct()


def spec_ancestors(spark: SparkSession, base: str) -> DataFrame:
    """Titles from the root to each numbered spec section (by prefixes of its number)."""
    s = once(table(spark, base, "spec_sections").where("number is not null"), "sec_id").groupBy("spec_ingest_id", "number").agg(F.min_by("title", "sec_id").alias("title"))
    up = s.where(F.col("number").rlike("^[0-9.]+$")).select("spec_ingest_id", "number", F.posexplode(tx.section_prefixes(F.col("number"))).alias("pos", "prefix"))
    j = up.join(s.select("spec_ingest_id", F.col("number").alias("prefix"), "title"), ["spec_ingest_id", "prefix"])
    return j.groupBy("spec_ingest_id", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("title", F.lit("")).alias("t")))), lambda x: x["t"]), " / ").alias("path"))


def busy_share(total: str, idle: str, order: Window):
    """Busy share in percent between two counter readings; null for the first, 0 where the counter did not move."""
    dt, di = F.col(total) - F.lag(total).over(order), F.col(idle) - F.lag(idle).over(order)
    return F.when(dt.isNull(), None).when(dt == 0, 0.0).otherwise(F.round((1 - di / dt) * 100, 1))


def busy_days(spark: SparkSession, base: str) -> DataFrame:
    """Busy share per day from running event counters: all events are the total, views the idle part."""
    d = table(spark, base, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("v"))
    w = Window.orderBy("day")  # one row a day
    c = d.select("day", F.sum("n").over(w).alias("total"), F.sum("v").over(w).alias("idle"))
    return c.select("day", busy_share("total", "idle", w).alias("busy_pct"))


def profile_merge(spark: SparkSession, base: str) -> DataFrame:
    """Two profiles merged: zones of requirements before and from 2025 united, counts added, each zone marked by origin."""
    r = once(table(spark, base, "requirements").where("zone_type is not null"), "rec_id")
    new = F.col("created_at") >= F.lit("2025-01-01").cast("timestamp_ntz")
    g = r.groupBy("zone_type").agg(F.count_if(~new).alias("old"), F.count_if(new).alias("new"))
    origin = F.when((F.col("old") > 0) & (F.col("new") > 0), "both").when(F.col("new") > 0, "new").otherwise("old")
    return g.select("zone_type", (F.col("old") + F.col("new")).alias("n"), origin.alias("origin"))


def chunks_per(spark: SparkSession, base: str) -> DataFrame:
    """Chunks by plan and zone with totals."""
    r = table(spark, base, "requirements").where("req_id is not null").groupBy("req_id").agg(F.min_by("plan_id", "rec_id").alias("plan_id"), F.min_by(F.coalesce("zone_type", F.lit("none")), "rec_id").alias("zone"))
    return r.rollup("plan_id", "zone").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


def side_by_side(spark: SparkSession, base: str) -> DataFrame:
    """Requirements of the first and the last release of a plan and section, side by side, with whether the texts agree."""
    r = table(spark, base, "requirements").where("section_number is not null")
    g = r.groupBy("plan_id", "section_number").agg(F.min_by("req_id", F.struct(by_month(), "rec_id")).alias("first_req"), F.max_by("req_id", F.struct(by_month(), "rec_id")).alias("last_req"), F.min_by(F.coalesce("text", F.lit("")), F.struct(by_month(), "rec_id")).alias("a"), F.max_by(F.coalesce("text", F.lit("")), F.struct(by_month(), "rec_id")).alias("b"))
    return g.where("first_req <> last_req").select("plan_id", "section_number", "first_req", "last_req", (F.col("a") == F.col("b")).alias("same_text"))


def priorities(spark: SparkSession, base: str) -> DataFrame:
    """Priorities in one spelling: High, P1 and p1 are one (upper case, P-numbers kept, blanks none)."""
    r = once(table(spark, base, "requirements"), "rec_id")
    p = F.upper(F.trim(F.coalesce("priority", F.lit(""))))
    return r.select(F.when(p == "", "NONE").otherwise(p).alias("priority")).groupBy("priority").agg(F.count("*").alias("n"))
