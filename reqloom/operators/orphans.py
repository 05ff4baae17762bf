"""References to records that do not exist.

Parent keys end in an integer more often than not (``nv_req_x_17``, ``63.417``), and the integers of one prefix are
dense. So existence is decided on *runs*: the sorted integers of a prefix are compressed to [start, end] runs, and each
distinct referenced integer is matched as-of to the run that starts at or before it; it is missing when it lies beyond
that run's end. Integers are cut into blocks of ``BLOCK`` so that no group of the window ever holds more than
``2 * BLOCK`` rows, however hot a prefix is. Whether an existing target was alive is then asked of its lives: disjoint
[start, end) intervals, one short array per key.

Defined results: a null or blank key is no reference; a null start never started, a null end never ended; a life that
ends at or before its start is never alive but counts as started; a null ``at`` finds nothing alive (reason by whether
the key exists: ``late``). Repeated deliveries of a reference or a parent give no further rows. Extra columns are
ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions.keys import canonical_key, spec_key
from reqloom.sources.tables import table

BLOCK = 1 << 13
# An integer tail of up to 17 digits without leading zero; any other key is its own prefix with number 0.
TAIL = r"^(.*?)(0|[1-9][0-9]{0,16})$"


def numbered(df: DataFrame, key: str = "key") -> DataFrame:
    """Adds (prefix, n, block) to a key column. The split is one-to-one: equal triples mean equal keys."""
    tail = F.regexp_extract(key, TAIL, 2)
    # the lazy prefix could end in a digit only when the tail starts with 0 or is over 17 digits long: both keep whole keys apart
    whole = tail == ""
    df = df.withColumn("prefix", F.when(whole, F.concat(F.lit("="), F.col(key))).otherwise(F.concat(F.lit("#"), F.regexp_extract(key, TAIL, 1))))
    df = df.withColumn("n", F.when(whole, F.lit(0)).otherwise(tail.cast("long")))
    return df.withColumn("block", F.expr(f"n div {BLOCK}"))


def runs(parents: DataFrame) -> DataFrame:
    """Contiguous runs of the distinct integers of each (kind, prefix), cut at block borders."""
    keys = parents.select("kind", "prefix", "block", "n").distinct()
    w = Window.partitionBy("kind", "prefix", "block").orderBy("n")
    return (
        keys.withColumn("island", F.col("n") - F.row_number().over(w))
        .groupBy("kind", "prefix", "block", "island")
        .agg(F.min("n").alias("run_start"), F.max("n").alias("run_end"))
        .drop("island")
    )


def missing_keys(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Distinct referenced (kind, key) with no parent: beyond the end of the preceding run, or with no preceding run."""
    asked = refs.select("kind", "prefix", "block", "n", "key").distinct()
    asked = asked.select("kind", "prefix", "block", F.col("n").alias("at"), F.lit(1).alias("is_ref"), "key", F.lit(None).cast("long").alias("run_end"))
    starts = runs(parents).select("kind", "prefix", "block", F.col("run_start").alias("at"), F.lit(0).alias("is_ref"), F.lit(None).cast("string").alias("key"), "run_end")
    w = Window.partitionBy("kind", "prefix", "block").orderBy("at", "is_ref").rowsBetween(Window.unboundedPreceding, 0)
    seen = starts.unionByName(asked).withColumn("reach", F.last("run_end", ignorenulls=True).over(w))
    return seen.where((F.col("is_ref") == 1) & (F.col("reach").isNull() | (F.col("at") > F.col("reach")))).select("kind", "key")


def lives(parents: DataFrame) -> DataFrame:
    """Per (kind, key): when it first started and its disjoint alive intervals in order."""
    spans = parents.select("kind", "key", "started", "ended").distinct()
    w = Window.partitionBy("kind", "key").orderBy("started", "ended")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    far = F.lit("9999-12-31 23:59:59").cast("timestamp_ntz")
    real = spans.where(F.col("started").isNotNull() & (F.col("ended").isNull() | (F.col("ended") > F.col("started"))))
    merged = (
        real.withColumn("until", F.coalesce("ended", far))
        .withColumn("reach", F.max("until").over(before))
        .withColumn("fresh", F.when(F.col("reach").isNull() | (F.col("started") > F.col("reach")), 1).otherwise(0))
        .withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("kind", "key", "island")
        .agg(F.min("started").alias("started"), F.max("until").alias("until"))
    )
    alive = merged.groupBy("kind", "key").agg(F.collect_list(F.struct("started", "until")).alias("alive"))
    first = spans.groupBy("kind", "key").agg(F.min("started").alias("first_start"))
    return first.join(alive, ["kind", "key"], "left")


def orphan_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(kind, ref_id, at, reason) of every reference without an alive target.

    refs: kind, ref_id, key, at; parents: kind, key, started, ended. Keys are canonical already.
    """
    refs = numbered(refs.select("kind", "ref_id", "key", "at").where(F.col("key").isNotNull()))
    parents = numbered(parents.select("kind", "key", "started", "ended").where(F.col("key").isNotNull()))
    gone = missing_keys(refs, parents).withColumn("is_missing", F.lit(True))
    known = lives(parents).unionByName(gone, allowMissingColumns=True)
    found = refs.select("kind", "ref_id", "key", "at").join(known, ["kind", "key"], "left")
    alive = F.exists("alive", lambda x: (x["started"] <= F.col("at")) & (x["until"] > F.col("at")))
    reason: Column = F.when(F.col("is_missing"), "missing").when(F.col("first_start") <= F.col("at"), "deleted").otherwise("late")
    return (
        found.where(~F.coalesce(alive, F.lit(False)))
        .select("kind", "ref_id", "at", reason.alias("reason"))
        .dropDuplicates(["kind", "ref_id"])
    )


def plan_references(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """The three reference tables and their parents under the key rule."""

    def ref(name: str, key: Column) -> DataFrame:
        return table(spark, base, name).select(F.lit(name).alias("kind"), "ref_id", key.alias("key"), F.col("recorded_at").alias("at"))

    def parent(kind: str, name: str, key: Column, start: str, end: str) -> DataFrame:
        return table(spark, base, name).select(F.lit(kind).alias("kind"), key.alias("key"), F.col(start).alias("started"), F.col(end).alias("ended"))

    refs = (
        ref("refs_internal", canonical_key(F.col("target_req_id")))
        .unionByName(ref("refs_cross_plan", canonical_key(F.col("target_plan_id"))))
        .unionByName(ref("refs_standards", spec_key(F.col("spec"))))
    )
    parents = (
        parent("refs_internal", "requirements", canonical_key(F.col("req_id")), "created_at", "deleted_at")
        .unionByName(parent("refs_cross_plan", "plans", canonical_key(F.col("plan_id")), "loaded_at", "withdrawn_at"))
        .unionByName(parent("refs_standards", "spec_catalog", spec_key(F.col("spec")), "available_at", "withdrawn_at"))
    )
    return refs, parents


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return orphan_references(*plan_references(spark, base)).select(F.col("kind").alias("ref_table"), "ref_id", "reason")


def p1_by_month(spark: SparkSession, base: str) -> DataFrame:
    """Per reference table and month of recording: references, and orphans by reason."""
    refs, parents = plan_references(spark, base)
    # one row per reference first; both sides are then small per month
    total = (
        refs.where(F.col("key").isNotNull())
        .select("kind", "ref_id", F.date_format("at", "yyyy-MM").alias("month"))
        .distinct()
        .groupBy("kind", "month")
        .agg(F.count("*").alias("refs"))
    )
    bad = (
        orphan_references(refs, parents)
        .groupBy("kind", F.date_format("at", "yyyy-MM").alias("month"))
        .agg(*[F.sum(F.when(F.col("reason") == r, 1).otherwise(0)).alias(r) for r in ("missing", "deleted", "late")])
    )
    counts = [F.coalesce(r, F.lit(0)).cast("long").alias(r) for r in ("missing", "deleted", "late")]
    t, b = total.alias("t"), bad.alias("b")
    joined = t.join(b, (F.col("t.kind") == F.col("b.kind")) & F.col("t.month").eqNullSafe(F.col("b.month")), "left")
    return joined.select(F.col("t.kind").alias("ref_table"), F.col("t.month").alias("month"), "refs", *counts)
