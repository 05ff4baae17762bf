"""Operations analytics over metrics, feedback and events: filters, summaries, latest values, retention, job states."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.operators.patterns import once
from reqloom.sources.tables import table

STATUSES = ("submitted", "running", "completed", "failed", "cancelled")
TERMINAL = ("completed", "failed", "cancelled")
NOW = dt.datetime(2026, 1, 1)  # the clock of the test tables; a parameter everywhere


def metric_rows(spark: SparkSession, base: str) -> DataFrame:
    """Metrics with finite values, each id once. Grouping by the needed columns is the dedup."""
    v = F.col("value")
    m = table(spark, base, "metrics").where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return m.select("id", "ts", "category", "name", "value", "unit", "tags").distinct()


def filtered(df: DataFrame, category: str | None = None, name: str | None = None, since: dt.datetime | None = None, limit: int | None = None) -> DataFrame:
    """The metrics query: optional AND-ed predicates, newest first, optional limit."""
    if category is not None:
        df = df.where(F.col("category") == category)
    if name is not None:
        df = df.where(F.col("name") == name)
    if since is not None:
        df = df.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return df.orderBy(F.desc("ts"), F.desc("id")).limit(limit) if limit is not None else df


def metrics_recent(spark: SparkSession, base: str) -> DataFrame:
    """The 100 newest request metrics of the second half of 2025 (the report's limit)."""
    return filtered(metric_rows(spark, base), category="request", since=dt.datetime(2025, 7, 1), limit=100).select("id", "ts", "name", "value")


BINS = 32  # ranges of each group in which the wanted position is looked for
SAMPLE = 1024  # values of each group, at most, that the ranges are cut by


def exact_position(df: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """The keys and `p95`: of every group the value at the 1-based position max(1, floor(n * share)), exactly.

    Rows are counted by distinct value first; a sample of these, the least hash in each of SAMPLE buckets, cuts each group
    into BINS ranges of about as many of them, whatever its tail looks like; running counts over the ranges say in which the
    position lies, and only that range is ordered. So a group that holds a third of all rows is many small windows. The
    ranges depend on nothing but the values: the plan uses them twice, and where Spark works them out anew (an exchange that
    is not reused, a lost executor) they must be the same, which a sketch with random compactions does not give. Null keys
    are a group of their own.
    """
    m = df.select(F.struct(*keys).alias("k_"), F.col(value).alias("v_"))
    values = m.groupBy("k_", "v_").agg(F.count("*").alias("c"))
    h = F.xxhash64("v_")
    least = values.groupBy("k_", F.pmod(h, F.lit(SAMPLE)).alias("bucket")).agg(F.sum("c").alias("c"), F.min(F.struct(h.alias("h"), "v_")).alias("s"))
    sampled = least.groupBy("k_").agg(F.sum("c").alias("n_"), F.sort_array(F.collect_list("s.v_")).alias("sample"))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(BINS - 1)), lambda i: F.get("sample", F.floor(i * F.size("sample") / BINS).cast("int")))
    groups = sampled.select("k_", "n_", cuts.alias("cuts"))
    counted = values.join(groups, "k_").select("k_", "n_", "v_", "c", F.size(F.filter("cuts", lambda x: x < F.col("v_"))).alias("bin"))
    per_bin = counted.groupBy("k_", "n_", "bin").agg(F.sum("c").alias("c"))
    wb = Window.partitionBy("k_").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    target = F.greatest(F.lit(1), F.floor(F.col("n_") * F.lit(share)).cast("long"))
    hit = per_bin.withColumn("before", F.coalesce(F.sum("c").over(wb), F.lit(0))).where((F.col("before") < target) & (F.col("before") + F.col("c") >= target)).select("k_", "bin", "before")
    wv = Window.partitionBy("k_", "bin").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)
    inside = counted.join(hit, ["k_", "bin"]).withColumn("upto", F.col("before") + F.sum("c").over(wv)).where((F.col("upto") >= target) & (F.col("upto") - F.col("c") < target))
    return inside.select("k_.*", F.col("v_").alias("p95"))


def metrics_summary(spark: SparkSession, base: str) -> DataFrame:
    """Per category and name: count, mean, least, greatest, p95 by the floor rule, and the newest unit."""
    m = metric_rows(spark, base)
    agg = m.groupBy("category", "name").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"), F.max_by("unit", F.when(F.col("unit").isNotNull(), F.struct("ts", "id"))).alias("unit"))
    p = exact_position(m, ["category", "name"], "value").select(F.struct("category", "name").alias("k_"), "p95")
    return agg.withColumn("k_", F.struct("category", "name")).join(p, "k_").select("category", "name", "n", "mean", "low", "high", "p95", "unit")


def metric_totals(spark: SparkSession, base: str) -> DataFrame:
    """Sum, count and mean of the last 24 hours before NOW for every category and name, zeros where there is nothing."""
    m = metric_rows(spark, base)
    recent = m.where(F.col("ts") >= F.lit(NOW - dt.timedelta(hours=24)).cast("timestamp_ntz")).groupBy("category", "name").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    allk = table(spark, base, "metrics").select("category", "name").distinct()
    j = allk.join(recent, ["category", "name"], "left")
    return j.select("category", "name", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("s", F.lit(0.0)), 4).alias("total"), F.round(F.coalesce(F.try_divide("s", "n"), F.lit(0.0)), 4).alias("mean"))


def latest_per_key(spark: SparkSession, base: str) -> DataFrame:
    m = metric_rows(spark, base)
    return m.groupBy("category", "name").agg(F.max_by("value", F.struct("ts", "id")).alias("value"), F.max("ts").alias("ts"))


def error_rate(spark: SparkSession, base: str) -> DataFrame:
    """Requests, errors (status 500 or more) and error rate per endpoint, from the JSON tags; bad JSON counts as no tags."""
    m = metric_rows(spark, base).where("category = 'request'")
    t = F.from_json("tags", "endpoint string, status int")
    x = m.select(F.coalesce(t["endpoint"], F.lit("")).alias("endpoint"), t["status"].alias("status"))
    bad = F.count_if(F.coalesce(F.col("status") >= 500, F.lit(False)))
    return x.groupBy("endpoint").agg(F.count("*").alias("requests"), bad.alias("errors"), F.round(F.coalesce(F.try_divide(bad * 100.0, F.count("*")), F.lit(0.0)), 4).alias("error_pct"))


def tags_map(spark: SparkSession, base: str) -> DataFrame:
    """How often each tag key and value occurs (values as text)."""
    m = metric_rows(spark, base).select(F.from_json("tags", "map<string,string>").alias("t"))
    return m.select(F.explode("t").alias("tag", "val")).groupBy("tag", "val").agg(F.count("*").alias("n"))


def retention(spark: SparkSession, base: str, days: int = 30) -> DataFrame:
    """What a retention of `days` keeps of each category, and what it deletes."""
    cut = F.lit(NOW - dt.timedelta(days=days)).cast("timestamp_ntz")
    m = metric_rows(spark, base)
    return m.groupBy("category").agg(F.count_if(F.col("ts") >= cut).alias("kept"), F.count_if(F.col("ts") < cut).alias("deleted"))


def counters(spark: SparkSession, base: str) -> DataFrame:
    """Change of each resource gauge against its previous sample: per name and month, rises, falls and first samples.

    The previous sample of a window's first row comes from the day before: windows are per name and day, and the last
    sample of each day is carried over the few days of a name.
    """
    m = metric_rows(spark, base).where("category = 'resource'").withColumn("day", F.to_date("ts"))
    order = [F.col("ts"), F.col("id")]
    w = Window.partitionBy("name", "day").orderBy(*order)
    ends = m.groupBy("name", "day").agg(F.max_by("value", F.struct("ts", "id")).alias("end"))
    carry = ends.withColumn("carried", F.lag("end").over(Window.partitionBy("name").orderBy("day"))).select("name", "day", "carried")
    d = m.withColumn("prev", F.lag("value").over(w)).withColumn("rn", F.row_number().over(w)).join(carry, ["name", "day"])
    prev = F.when(F.col("rn") == 1, F.col("carried")).otherwise(F.col("prev"))
    d = d.select("name", F.date_format("day", "yyyy-MM").alias("month"), (F.col("value") - prev).alias("delta"))
    return d.groupBy("name", "month").agg(F.count_if(F.col("delta") > 0).alias("rises"), F.count_if(F.col("delta") < 0).alias("falls"), F.count_if(F.col("delta").isNull()).alias("firsts"))


def job_events(spark: SparkSession, base: str) -> DataFrame:
    """Job events: every user of `events` is a job; its event types are its states."""
    e = table(spark, base, "events")
    state = F.element_at(F.create_map(*[x for t, s in (("view", "submitted"), ("click", "running"), ("purchase", "completed"), ("error", "failed")) for x in (F.lit(t), F.lit(s))]), F.col("event_type"))
    return e.select(F.col("user_id").alias("job_id"), "event_id", "ts", F.coalesce(state, F.lit("submitted")).alias("status"))


def job_states(events: DataFrame) -> DataFrame:
    """Latest state per job; the first terminal state is sticky. started_at is the first running, completed_at the terminal."""
    e = F.struct("ts", "event_id")
    terminal = F.col("status").isin(*TERMINAL)
    return events.groupBy("job_id").agg(
        F.coalesce(F.min_by("status", F.when(terminal, e)), F.max_by("status", e)).alias("status"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.min(F.when(terminal, F.col("ts"))).alias("completed_at"),
        F.count("*").alias("n_events"),
    )


def job_state_latest(spark: SparkSession, base: str) -> DataFrame:
    return job_states(job_events(spark, base))


def job_counts(spark: SparkSession, base: str) -> DataFrame:
    """Jobs by state over the 1,000 newest jobs (the dashboard's limit)."""
    newest = job_states(job_events(spark, base)).orderBy(F.desc("started_at"), F.desc("job_id")).limit(1000)
    return newest.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


def job_log_lines(spark: SparkSession, base: str) -> DataFrame:
    """Running line number of every event within its job (ordered by time, then id)."""
    w = Window.partitionBy("job_id").orderBy("ts", "event_id")
    return job_events(spark, base).select("job_id", "event_id", F.row_number().over(w).alias("line_number"))


def feedback_votes(spark: SparkSession, base: str) -> DataFrame:
    """Votes per page section and model over the latest version of each feedback row; unknown votes count as none."""
    t = table(spark, base, "test_feedback").groupBy("id").agg(F.max_by(F.struct("page_section", "llm_model", "vote", "query_elapsed_ms"), "ingested_at").alias("r")).select("r.*")
    v = F.when(F.col("vote").isin("up", "down"), F.col("vote"))
    return t.groupBy("page_section", "llm_model").agg(F.count_if(v == "up").alias("up"), F.count_if(v == "down").alias("down"), F.count_if(v.isNull()).alias("open"), F.round(F.avg("query_elapsed_ms"), 3).alias("mean_ms"))


def feedback_recent(spark: SparkSession, base: str) -> DataFrame:
    """The 50 newest feedback rows of each page section (the list's limit)."""
    t = once(table(spark, base, "test_feedback").select("id", "ts", "page_section", "vote", "ingested_at"), "id")
    w = Window.partitionBy("page_section").orderBy(F.desc("ts"), F.desc("id"))
    return t.withColumn("rank", F.row_number().over(w)).where("rank <= 50").select("page_section", "rank", "id", "vote")


def feedback_citations(spark: SparkSession, base: str) -> DataFrame:
    """How often each requirement is cited by answers, from the JSON list."""
    t = once(table(spark, base, "test_feedback").select("id", "citations_json"), "id")
    c = t.select(F.explode(F.from_json("citations_json", "array<struct<req_id string>>")).alias("c"))
    return c.groupBy(F.col("c.req_id").alias("req_id")).agg(F.count("*").alias("n"))


def late_arrivals(spark: SparkSession, base: str) -> DataFrame:
    """Per category: how many rows were ingested more than an hour or a day after their time."""
    m = table(spark, base, "metrics").groupBy("id", "category", "ts").agg(F.min("ingested_at").alias("first_seen"))
    late = F.unix_micros(F.col("first_seen").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return m.groupBy("category").agg(F.count("*").alias("n"), F.count_if(late > 3_600_000_000).alias("late_hour"), F.count_if(late > 86_400_000_000).alias("late_day"))


def p95_by_day(spark: SparkSession, base: str) -> DataFrame:
    """p95 by the floor rule per category, name and day."""
    m = metric_rows(spark, base).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return exact_position(m, ["category", "name", "day"], "value").withColumn("p95", F.round("p95", 6))


def duration_text(ms):
    """`1h 02m 03s` of milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string("%dh %02dm %02ds", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def durations(spark: SparkSession, base: str) -> DataFrame:
    """Total query time per model as text."""
    t = once(table(spark, base, "test_feedback").select("id", "llm_model", "query_elapsed_ms"), "id")
    return t.groupBy("llm_model").agg(F.coalesce(F.sum("query_elapsed_ms"), F.lit(0)).alias("ms")).select("llm_model", duration_text(F.col("ms")).alias("total"))
