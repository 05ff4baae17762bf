"""Understanding questions: entities, concepts, scopes, type rules; feature keywords; taxonomy. All column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.functions import text as tx
from reqloom.operators.patterns import once
from reqloom.sources.tables import table

# Keyword maps in fixed order (the first hit of a rule decides).
MNOS = {"NVA": ["nva", "nova"], "OKT": ["okt"], "BRZ": ["brz", "breeze"], "HLM": ["hlm", "helm"]}
STANDARD = r"3gpp\s+ts\s+[0-9]|\bts\s+[0-9]{2}\.[0-9]{3}"
COMPARE_WORDS = ["differ", "compare", "vs", "versus", "3gpp"]
RELEASE_WORDS = ["delta", "diff", "changed"]
TRACE_WORDS = ["test case", "test plan", "coverage", "traceability", "mention ", "mentions ", "mentioned "]
FEATURE_WORDS = ["everything about", "related to"]
CROSS_WORDS = ["across all", "across the", "in all", "across mnos", "across plans", "across specs", "all the requirements", "all reqs", "what are all", "what requirements"]
LIST_WORDS = ["list the requirements", "all plans", "every plan"]  # how this corpus asks for lists
CONCEPTS = ["timer", "counter", "handover", "roaming", "paging", "battery", "barring", "throttling", "certificate", "message"]
# A feature catalogue (id, name, keywords).
FEATURES = [
    ("DATA_RETRY", "Data retry and throttling", ["retry", "throttling", "back-off", "attempt"]),
    ("MOBILITY", "Mobility and handover", ["handover", "roaming", "cell", "mobility"]),
    ("MESSAGING", "Messaging", ["message", "notification", "texting"]),
    ("POWER", "Power saving", ["battery", "idle", "sleep"]),
    ("SECURITY", "Security and provisioning", ["certificate", "security", "encrypt", "token"]),
    ("TIMING", "Timers", ["timer", "expires", "seconds", "wait for"]),
]
# Features that build on another one.
DEPENDS = [("DATA_RETRY", "TIMING"), ("MESSAGING", "MOBILITY"), ("SECURITY", "MESSAGING")]
SYNONYM_DEFAULT = "latest"


def has_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def word_hits(c: Column, words: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def mno_hits(c: Column) -> Column:
    """MNOs whose alias occurs as a whole word."""
    hits = [F.when(c.rlike(r"\b(" + "|".join(al) + r")\b"), F.lit(m)) for m, al in MNOS.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def question_type(c: Column, plans: Column) -> Column:
    """The ordered rules; `c` is the lower-case question, `plans` the plan ids it names."""
    n_mno = F.size(mno_hits(c))
    std = c.rlike(STANDARD)
    releases = F.size(F.regexp_extract_all(c, F.lit(r"20[0-9]{2}_[a-z]{3}"), 0))
    return (
        F.when((n_mno >= 2) | (F.contains(c, F.lit("compare")) & (n_mno >= 1)), "cross_mno_comparison")
        .when(std & has_any(c, COMPARE_WORDS), "standards_comparison")
        .when((releases >= 2) | has_any(c, RELEASE_WORDS), "release_diff")
        .when(has_any(c, TRACE_WORDS), "traceability")
        .when(has_any(c, FEATURE_WORDS), "feature_level")
        .when(has_any(c, CROSS_WORDS + LIST_WORDS) | (F.size(plans) >= 2), "cross_doc")
        .when(F.size(plans) >= 1, "single_doc")
        .otherwise("general")
    )


def question_rows(spark: SparkSession, base: str) -> DataFrame:
    return once(table(spark, base, "test_feedback").select("id", "question", "answer", "citations_json", "page_section", "llm_model"), "id")


def classify(spark: SparkSession, base: str) -> DataFrame:
    q = question_rows(spark, base).where("question is not null")
    low = F.lower("question")
    plans = F.array_distinct(F.regexp_extract_all("question", F.lit(r"[A-Z]{2}_REQ_([A-Z]+)_[0-9]+"), 1))
    return q.select("id", question_type(low, plans).alias("query_type"), F.array_join(word_hits(low, CONCEPTS), ",").alias("concepts"), F.array_join(F.array_distinct(F.regexp_extract_all("question", F.lit(r"\b[A-Z]{5}_[A-Z]{4}_[A-Z]{4}\b"), 0)), ",").alias("entities"))


def policy(spark: SparkSession, base: str) -> DataFrame:
    """Type-dependent settings by map lookup with defaults, counted per type."""
    from reqloom.operators.retrieval import BM25_WEIGHT, TOP_K

    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    c = classify(spark, base).groupBy("query_type").agg(F.count("*").alias("n"))
    return c.select("query_type", "n", F.greatest(F.lit(10), F.coalesce(F.try_element_at(m(TOP_K), F.col("query_type")), F.lit(0))).alias("top_k"), F.coalesce(F.try_element_at(m(BM25_WEIGHT), F.col("query_type")), F.lit(0.0)).alias("bm25_weight"))


def by_month(c="release") -> Column:
    """A sortable form of a release like 2025_feb."""
    c = F.col(c)
    month = F.instr(F.lit("jan feb mar apr may jun jul aug sep oct nov dec"), F.lower(F.substring_index(c, "_", -1)))
    return F.struct(F.substring_index(c, "_", 1).alias("y"), month.alias("m"), c.alias("r"))


def release_match(spark: SparkSession, base: str) -> DataFrame:
    """The release of a plan that a feedback row's wish names: exact, substring, part, else the latest by month.

    The wish is the row's release; it is matched against the releases of its MNO.
    """
    wishes = table(spark, base, "documents").select("mno", F.coalesce(F.lower("release"), F.lit("latest")).alias("wish")).where("mno is not null").distinct()
    p = table(spark, base, "plans").select("mno", "release").distinct()
    month = F.instr(F.lit("jan feb mar apr may jun jul aug sep oct nov dec"), F.lower(F.substring_index("release", "_", -1)))
    j = wishes.join(p, "mno")
    low = F.lower("release")
    rank = F.when(F.col("wish").isin("latest", "current"), 9).when(low == F.col("wish"), 1).when(F.contains(low, F.col("wish")), 2).when(F.exists(F.split("wish", "_"), lambda x: F.contains(low, x)), 3).otherwise(9)
    j = j.select("mno", "wish", "release", rank.alias("rule"), F.substring_index("release", "_", 1).alias("y"), month.alias("m"))
    best = F.max_by(F.struct("release", "rule"), F.struct(-F.col("rule"), "y", "m", "release"))
    return j.groupBy("mno", "wish").agg(best.alias("b")).select("mno", "wish", F.col("b.release").alias("release"), F.col("b.rule").alias("rule"))


def citations(spark: SparkSession, base: str) -> DataFrame:
    """Citations of each answer: requirement ids and spec sections, in order of appearance, each once."""
    q = question_rows(spark, base).where("answer is not null")
    ids = F.array_distinct(tx.find_req_ids(F.col("answer")))
    specs = F.array_distinct(F.regexp_extract_all("answer", F.lit(tx.SPEC), 1))
    return q.select("id", F.array_join(ids, ",").alias("req_ids"), F.array_join(specs, ",").alias("specs"), tx.token_estimate(F.col("answer")).alias("tokens"))


def feature_hits(spark: SparkSession, base: str) -> DataFrame:
    """Per plan and feature: distinct keywords that its requirements contain; two or more make the plan primary.

    The catalogue is an array literal (a few entries); texts are scanned once and only (plan, feature, keyword) meet.
    """
    r = once(table(spark, base, "requirements").where("text is not null"), "rec_id")
    low = F.lower(F.concat_ws(" ", "title", "text"))
    feats = F.array(*[F.struct(F.lit(f).alias("feature_id"), F.lit(n).alias("name"), word_hits(low, kw).alias("hits")) for f, n, kw in FEATURES])
    x = r.select("plan_id", F.explode(feats).alias("f")).select("plan_id", "f.feature_id", "f.name", F.explode("f.hits").alias("keyword"))
    g = x.groupBy("plan_id", "feature_id", "name").agg(F.countDistinct("keyword").alias("n"), F.array_join(F.sort_array(F.collect_set("keyword")), ",").alias("keywords"))
    conf = F.least(F.lit(0.5) + F.lit(0.15) * F.col("n"), F.lit(0.95))
    return g.select("plan_id", "feature_id", "name", "keywords", F.round(conf, 4).alias("confidence"), (F.col("n") >= 2).alias("is_primary"))


def taxonomy(spark: SparkSession, base: str) -> DataFrame:
    """Features over all plans: primary and referencing plans, all keywords, in the order (most primaries, name)."""
    f = feature_hits(spark, base)
    plans = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("plan_id")))), ",")
    words = F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.split("keywords", ","))))), ",")
    g = f.groupBy("feature_id").agg(F.min("name").alias("name"), plans(F.col("is_primary")).alias("primary_in"), plans(~F.col("is_primary")).alias("referenced_in"), words.alias("keywords"), F.count_if("is_primary").alias("n_primary"))
    return g.orderBy(F.desc("n_primary"), "name")


def mno_coverage(spark: SparkSession, base: str) -> DataFrame:
    """Per feature the map MNO -> plans, as text."""
    f = feature_hits(spark, base)
    p = table(spark, base, "requirements").select("mno", "plan_id").distinct()
    per = f.join(p, "plan_id").groupBy("feature_id", "mno").agg(F.array_join(F.sort_array(F.collect_set("plan_id")), ",").alias("plans"))
    return per.groupBy("feature_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("mno", F.lit("="), "plans"))), ";").alias("coverage"))


def taxonomy_diff(spark: SparkSession, base: str) -> DataFrame:
    """Added, removed and changed keywords between the feature rows of the first and the last release (full outer join)."""
    r = once(table(spark, base, "requirements").where("text is not null"), "rec_id")
    low = F.lower(F.concat_ws(" ", "title", "text"))
    feats = F.array(*[F.struct(F.lit(f).alias("feature_id"), word_hits(low, kw).alias("hits")) for f, _, kw in FEATURES])
    x = r.select("release", F.explode(feats).alias("f")).select("release", "f.feature_id", F.explode("f.hits").alias("keyword")).distinct()
    ends = x.agg(F.min_by("release", by_month()).alias("lo"), F.max_by("release", by_month()).alias("hi"))
    x = x.crossJoin(F.broadcast(ends))  # one row
    a = x.where("release = lo").select("feature_id", "keyword", F.lit(1).alias("old"))
    b = x.where("release = hi").select("feature_id", "keyword", F.lit(1).alias("new"))
    j = a.join(b, ["feature_id", "keyword"], "full_outer")
    return j.select("feature_id", "keyword", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("kept").alias("change"))


def score_questions(spark: SparkSession, base: str, known: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """Scores of each answer against its expected citations: completeness, accuracy, citation, standards, grounding.

    Expected ids come from citations_json, found ones from the answer's text; an id that no requirement has is
    ungrounded (left-anti against the corpus, not a fixed plan list). `answers` (id, answer) scores another run's answers.
    """
    q = question_rows(spark, base)
    if answers is not None:
        q = q.drop("answer").join(answers.select("id", "answer"), "id", "left")
    expected = F.array_distinct(F.filter(F.coalesce(F.transform(F.from_json("citations_json", "array<struct<req_id string>>"), lambda x: x["req_id"]), F.array().cast("array<string>")), lambda x: x.isNotNull()))
    x = q.select("id", "page_section", "llm_model", expected.alias("expected"), F.array_distinct(tx.find_req_ids(F.coalesce("answer", F.lit("")))).alias("found"), F.contains(F.coalesce("answer", F.lit("")), F.lit("3GPP TS")).alias("std"))
    have = (table(spark, base, "requirements") if known is None else known).select("req_id").distinct()
    ungrounded = x.select("id", F.explode("found").alias("req_id")).join(have, "req_id", "left_anti").groupBy("id").agg(F.count("*").alias("bad"))
    plan = lambda c: F.array_distinct(F.transform(c, lambda i: F.coalesce(tx.plan_of_req(i), F.lit(""))))
    share = lambda a, b: F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    e, f = F.col("expected"), F.col("found")
    j = x.join(ungrounded, "id", "left").select(
        "id", "page_section", "llm_model",
        share(plan(e), plan(f)).alias("completeness"), share(e, f).alias("accuracy"),
        F.when(F.size(f) == 0, 0.0).when(F.size(F.array_intersect(e, f)) > 0, 1.0).otherwise(0.5).alias("citation"),
        F.when(F.col("std"), 1.0).otherwise(0.0).alias("standards"), F.when(F.col("bad") > 0, 0.0).otherwise(1.0).alias("grounded"),
    )
    total = 0.30 * F.col("completeness") + 0.25 * F.col("accuracy") + 0.20 * F.col("citation") + 0.15 * F.col("standards") + 0.10 * F.col("grounded")
    return j.withColumn("overall", F.round(total, 6))


def category_rollup(spark: SparkSession, base: str) -> DataFrame:
    """Mean scores per page section and over all."""
    s = score_questions(spark, base)
    return s.rollup("page_section").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("completeness", "accuracy", "citation", "standards", "grounded", "overall")], F.grouping("page_section").cast("int").alias("is_total"))


def ab_compare(spark: SparkSession, base: str) -> DataFrame:
    """Wins, ties and mean difference of two scores of the same questions, per page section: completeness against accuracy."""
    s = score_questions(spark, base)
    a, b = s.select("id", "page_section", F.col("completeness").alias("a")), s.select("id", F.col("accuracy").alias("b"))
    j = a.join(b, "id")
    return j.groupBy("page_section").agg(F.count_if(F.col("a") > F.col("b")).alias("a_wins"), F.count_if(F.col("a") < F.col("b")).alias("b_wins"), F.count_if(F.col("a") == F.col("b")).alias("ties"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("delta"))


def ab_runs(spark: SparkSession, base: str) -> DataFrame:
    """Two runs over the same questions, paired by question: the delivered answers against those of a model that gives the
    question back. Wins, ties and mean difference of the overall score per page section and in total."""
    q = question_rows(spark, base)
    a = score_questions(spark, base).select("id", "page_section", F.col("overall").alias("a"))
    b = score_questions(spark, base, answers=q.select("id", F.col("question").alias("answer"))).select("id", F.col("overall").alias("b"))
    j = a.join(b, "id")
    d = F.col("a") - F.col("b")
    return j.rollup("page_section").agg(F.count("*").alias("n"), F.count_if(d > 0).alias("a_wins"), F.count_if(d < 0).alias("b_wins"), F.count_if(d == 0).alias("ties"), F.round(F.avg(d), 6).alias("delta"), F.grouping("page_section").cast("int").alias("is_total"))


# Targets of an evaluation. Completeness is asked of questions over several plans only.
TARGETS = [("completeness", 0.8, False), ("accuracy", 0.9, False), ("citation", 1.0, True), ("standards", 0.8, False), ("grounded", 1.0, True)]


def target_checks(spark: SparkSession, base: str) -> DataFrame:
    """Per model and target its mean, the target, and whether it is met: more than the target, or all of it where that is 1."""
    s = score_questions(spark, base)
    plans = question_rows(spark, base).select("id", F.size(F.array_distinct(F.transform(F.from_json("citations_json", "array<struct<req_id string>>"), lambda x: tx.plan_of_req(x["req_id"])))).alias("plans"))
    s = s.join(plans, "id", "left")
    means = s.groupBy("llm_model").agg(*[F.avg(F.when(F.col("plans") >= 2, F.col(c)) if c == "completeness" else F.col(c)).alias(c) for c, _, _ in TARGETS])
    rows = F.array(*[F.struct(F.lit(c).alias("target"), F.round(F.col(c), 6).alias("mean"), F.lit(t).alias("wanted"), (F.col(c) >= t if whole else F.col(c) > t).alias("met")) for c, t, whole in TARGETS])
    return means.select("llm_model", F.explode(rows).alias("r")).select("llm_model", "r.*")


def verdicts(spark: SparkSession, base: str) -> DataFrame:
    """PASS from 0.6, WARN from 0.3, else FAIL: per model."""
    s = score_questions(spark, base)
    v = F.when(F.col("overall") >= 0.6, "PASS").when(F.col("overall") >= 0.3, "WARN").otherwise("FAIL")
    return s.groupBy("llm_model").agg(*[F.count_if(v == x).alias(x.lower()) for x in ("PASS", "WARN", "FAIL")])


def set_diff(spark: SparkSession, base: str) -> DataFrame:
    """Sections added, removed, changed and kept between each plan's first and last release (full outer join on the key)."""
    r = table(spark, base, "requirements").where("section_number is not null")
    r = r.groupBy("plan_id", "release", "section_number").agg(F.min_by("title", "rec_id").alias("title"))
    ends = r.groupBy("plan_id").agg(F.min_by("release", by_month()).alias("lo"), F.max_by("release", by_month()).alias("hi"))
    x = r.join(ends, "plan_id").where("lo <> hi")
    a = x.where("release = lo").select("plan_id", "section_number", F.coalesce("title", F.lit("")).alias("old"))
    b = x.where("release = hi").select("plan_id", "section_number", F.coalesce("title", F.lit("")).alias("new"))
    j = a.join(b, ["plan_id", "section_number"], "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("kept")
    return j.groupBy("plan_id").agg(*[F.count_if(kind == k).alias(k) for k in ("added", "removed", "changed", "kept")])
