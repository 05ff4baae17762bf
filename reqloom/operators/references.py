"""Cross-reference resolution, its summary and the index of cited standards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions.keys import canonical_key, spec_key
from reqloom.functions.text import release_number, section_citations
from reqloom.operators.patterns import once
from reqloom.sources.tables import table


def resolve_internal(spark: SparkSession, base: str) -> DataFrame:
    """Internal references: the target in the same plan, else anywhere (marked), else broken.

    Same plan: the first such requirement; anywhere: the last one. A blank target is broken.
    """
    refs = once(table(spark, base, "refs_internal"), "ref_id")
    reqs = table(spark, base, "requirements").select("mno", "release", "plan_id", "rec_id", canonical_key(F.col("req_id")).alias("k"), "section_number", "title").where("k is not null")
    here = reqs.groupBy("mno", "release", "plan_id", "k").agg(F.min_by(F.struct("section_number", "title"), "rec_id").alias("here"))
    any_ = reqs.groupBy("k").agg(F.max_by(F.struct("plan_id", "section_number", "title"), "rec_id").alias("there"))
    r = refs.select("ref_id", "mno", "release", "plan_id", "source_req_id", canonical_key(F.col("target_req_id")).alias("k"))
    j = r.join(here, ["mno", "release", "plan_id", "k"], "left").join(any_, "k", "left")
    title = F.when(F.col("here").isNotNull(), F.col("here.title")).when(F.col("there").isNotNull(), F.concat(F.lit("[actually in "), F.col("there.plan_id"), F.lit("] "), F.coalesce("there.title", F.lit(""))))
    section = F.coalesce("here.section_number", "there.section_number")
    status = F.when(F.col("here").isNotNull() | F.col("there").isNotNull(), "resolved").otherwise("broken")
    return j.select("ref_id", "plan_id", status.alias("status"), section.alias("target_section"), title.alias("target_title"))


def resolve_cross_plan(spark: SparkSession, base: str) -> DataFrame:
    """References to plans: resolved with the number of the plan's requirements, else unresolved."""
    refs = once(table(spark, base, "refs_cross_plan"), "ref_id").select("ref_id", "plan_id", canonical_key(F.col("target_plan_id")).alias("k"))
    plans = table(spark, base, "plans").select(canonical_key(F.col("plan_id")).alias("k")).distinct().withColumn("known", F.lit(True))
    n = table(spark, base, "requirements").where("req_id <> ''").groupBy(canonical_key(F.col("plan_id")).alias("k")).agg(F.countDistinct("req_id").alias("n"))
    j = refs.join(plans, "k", "left").join(n, "k", "left")
    return j.select("ref_id", "plan_id", F.when(F.col("known"), "resolved").otherwise("unresolved").alias("status"), F.when(F.col("known"), F.coalesce("n", F.lit(0))).otherwise(0).alias("n_targets"))


def resolve_standards(spark: SparkSession, base: str) -> DataFrame:
    """References to standards: release given inline, else by the citing plan's map, else unresolved."""
    refs = once(table(spark, base, "refs_standards"), "ref_id").select("ref_id", "mno", "release", "plan_id", spec_key(F.col("spec")).alias("k"), F.nullif(F.col("spec_release"), F.lit("")).alias("inline"))
    # repeated deliveries of a plan carry the same map
    plans = table(spark, base, "plans").groupBy("mno", "release", "plan_id").agg(F.max_by("referenced_standards_releases", "loaded_at").alias("releases"))
    j = refs.join(plans, ["mno", "release", "plan_id"], "left")
    doc = F.nullif(F.try_element_at("releases", F.col("k")), F.lit(""))
    source = F.when(F.col("inline").isNotNull(), "inline").when(doc.isNotNull(), "doc_level").otherwise("")
    return j.select("ref_id", "plan_id", F.col("k").alias("spec"), F.coalesce("inline", doc, F.lit("")).alias("spec_release"), source.alias("release_source"), F.when(source == "", "unresolved").otherwise("resolved").alias("status"))


def status_summary(spark: SparkSession, base: str, internal: DataFrame | None = None, cross: DataFrame | None = None, standards: DataFrame | None = None) -> DataFrame:
    """Nine counters per plan: references of each kind by outcome; resolved tables that exist already can be given."""
    given = [("internal", internal, resolve_internal), ("cross", cross, resolve_cross_plan), ("std", standards, resolve_standards)]
    parts = [(kind, resolve(spark, base) if df is None else df) for kind, df, resolve in given]
    u = None
    for kind, df in parts:
        x = df.select("plan_id", F.lit(kind).alias("kind"), "status")
        u = x if u is None else u.unionByName(x)
    count = lambda kind, *status: F.count_if((F.col("kind") == kind) & F.col("status").isin(*status) if status else F.col("kind") == kind)
    return u.groupBy("plan_id").agg(
        count("internal").alias("internal_total"), count("internal", "resolved").alias("internal_resolved"), count("internal", "broken").alias("internal_broken"),
        count("cross").alias("cross_total"), count("cross", "resolved").alias("cross_resolved"), count("cross", "unresolved").alias("cross_unresolved"),
        count("std").alias("std_total"), count("std", "resolved").alias("std_resolved"), count("std", "unresolved").alias("std_unresolved"),
    )


def standards_index(spark: SparkSession, base: str, resolved: DataFrame | None = None) -> DataFrame:
    """Per spec and release: references of the manifests, and sections and plans of manifests and texts.

    Sections found in texts inherit the release with which their plan cites the spec (the highest known one); where it
    cites none they stand under release 0.
    """
    std = (resolve_standards(spark, base) if resolved is None else resolved).where(F.length("spec") >= 4)
    refs = std.select("plan_id", "spec", release_number(F.col("spec_release")).alias("release_num"), F.lit(1).alias("manifest"), F.lit(None).cast("string").alias("section"))
    cited = refs.where("release_num > 0").groupBy("plan_id", "spec").agg(F.max("release_num").alias("release_num"))
    reqs = once(table(spark, base, "requirements").where(F.contains("text", F.lit("TS"))), "rec_id")
    found = reqs.select("plan_id", F.explode(section_citations(F.col("text"))).alias("x")).select("plan_id", "x.spec", "x.section")
    texts = found.join(cited, ["plan_id", "spec"], "left").select("plan_id", "spec", F.coalesce("release_num", F.lit(0)).alias("release_num"), F.lit(0).alias("manifest"), "section")
    u = refs.unionByName(texts)
    return u.groupBy("spec", "release_num").agg(
        F.sum("manifest").alias("ref_count"), F.count("*").alias("total_refs"),
        F.array_join(F.sort_array(F.collect_set("section")), ",").alias("sections"), F.array_join(F.sort_array(F.collect_set("plan_id")), ",").alias("plans"),
    )


def broken_targets(spark: SparkSession, base: str) -> DataFrame:
    """Distinct targets that no requirement has, with how often they are named (left-anti, then count)."""
    refs = once(table(spark, base, "refs_internal"), "ref_id").select(canonical_key(F.col("target_req_id")).alias("target")).where("target is not null")
    # counted first: a hot target is one row when it meets the requirements
    named = refs.groupBy("target").agg(F.count("*").alias("n_refs"))
    have = table(spark, base, "requirements").select(canonical_key(F.col("req_id")).alias("target"))
    return named.join(have, "target", "left_anti")


def refs_of_requirement(spark: SparkSession, base: str) -> DataFrame:
    """Number of references of each kind by source requirement (the union of the three lists)."""
    u = None
    for kind in ("refs_internal", "refs_cross_plan", "refs_standards"):
        x = table(spark, base, kind).select("ref_id", F.lit(kind).alias("kind"), "source_req_id").distinct()
        u = x if u is None else u.unionByName(x)
    c = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return u.groupBy("source_req_id").agg(c("refs_internal"), c("refs_cross_plan"), c("refs_standards"))


def latest_reference_per_source(spark: SparkSession, base: str) -> DataFrame:
    """The last recorded internal reference of each source requirement (ties by ref_id)."""
    refs = once(table(spark, base, "refs_internal"), "ref_id")
    return refs.groupBy("source_req_id").agg(F.max_by("ref_id", F.struct("recorded_at", "ref_id")).alias("ref_id"), F.max("recorded_at").alias("recorded_at"))


def release_of_section(spark: SparkSession, base: str) -> DataFrame:
    """As-of join: each internal reference with the release of its plan that was loaded last when it was recorded.

    Both sides are one stream per plan, ordered by time; a running last value carries the release to the references.
    """
    refs = once(table(spark, base, "refs_internal"), "ref_id").select("plan_id", F.col("recorded_at").alias("at"), F.lit(1).alias("side"), "ref_id", F.lit(None).cast("string").alias("loaded"))
    plans = table(spark, base, "plans").select("plan_id", F.col("loaded_at").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("ref_id"), F.col("release").alias("loaded"))
    # a month is one window group, so a plan with a third of all references is many groups; what was loaded before the
    # month comes from the few plan rows
    month = F.date_trunc("month", "at")
    w = Window.partitionBy("plan_id", "month").orderBy("at", "side", "loaded").rowsBetween(Window.unboundedPreceding, 0)
    u = refs.unionByName(plans).withColumn("month", month).withColumn("seen", F.last("loaded", ignorenulls=True).over(w))
    ends = plans.withColumn("month", month).groupBy("plan_id", "month").agg(F.max_by("loaded", F.struct("at", "loaded")).alias("loaded"))
    months = refs.select("plan_id", month.alias("month")).distinct()
    pw = Window.partitionBy("plan_id").orderBy("month", "side").rowsBetween(Window.unboundedPreceding, 0)
    carry = ends.withColumn("side", F.lit(1)).unionByName(months.withColumn("loaded", F.lit(None).cast("string")).withColumn("side", F.lit(0)))
    before = carry.withColumn("before", F.last("loaded", ignorenulls=True).over(pw)).where("side = 0").select("plan_id", "month", "before")
    return u.where("side = 1").join(before, ["plan_id", "month"], "left").select("ref_id", "plan_id", F.coalesce("seen", "before").alias("plan_release"))
