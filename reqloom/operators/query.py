"""Answering questions over the corpus, as one batch: intent, scope, graph seeds and traversal, retrieval, context, answer.

Every step is a table keyed by question (`qid`), so a batch of questions is a side of joins and no question is a loop.

1. intents: entities, concepts, operators, releases, standards, features, plans and the question's type;
2. scopes: (operator, release) pairs that the question is about; the latest release where it names none;
3. graph_seeds: requirements that it names (1.0), else those of its features (0.8), else of its plans (0.6), else those whose
   title or text has its concepts (0.3 + 0.2 for each, three at most);
4. graph_scope: what lies within one or two steps of the seeds over the edge types of the question's type; a standard that
   many requirements share is met once for each question, and its members join it, never each other; questions that agree in
   type, scopes and named things share seeds and candidates, which are worked out once for all of them;
5. retrieve: the candidates (or, without any, the chunks in scope) ranked by vector distance, fused with BM25 where the type
   asks for it, reranked where it asks for that, diversified by plan, glossary entries pinned;
6. contexts and answers: parent, standards' text, dependencies; a prompt text; the structured answer of the model-free
   synthesizer, and citations recovered from the context where an answer has too few.

Defined results: a question without scope matches every release; without candidates its scope is searched; without any
chunk it is answered with the not-found text. Null questions are left out. Ties go to the smaller chunk id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions import text as tx
from reqloom.functions.keys import spec_key
from reqloom.operators import graph as g
from reqloom.operators import understanding as u
from reqloom.operators.catalog import ACRONYM
from reqloom.operators.patterns import rrf_fuse, topk_per_group
from reqloom.operators.retrieval import BM25_WEIGHT, EPSILON, K1, RRF_K, TOP_K, B, Bm25, bm25_grid, glossary_words, vectors
from reqloom.sources.tables import Scratch, table

# Fixed values of the query policy: depth and edge types by question type, fan-out, types that are reranked, limits.
DEPTH = {"single_doc": 1, "release_diff": 1}
DEFAULT_DEPTH = 2
EDGES = {
    "single_doc": ["depends_on", "parent_of", "references_standard"],
    "cross_doc": ["depends_on", "parent_of", "references_standard", "shared_standard"],
    "cross_mno_comparison": ["maps_to", "references_standard"],
    "feature_level": ["maps_to", "depends_on", "references_standard"],
    "standards_comparison": ["references_standard", "parent_section"],
    "general": ["depends_on", "parent_of", "references_standard", "shared_standard", "maps_to"],
}
RERANKED = ["cross_doc", "standards_comparison", "feature_level", "cross_mno_comparison", "traceability", "release_diff"]
LEAST_K, FANOUT, DENSE_WEIGHT = 10, 3, 1.0
CONTEXT_CHARS, PARENT_CHARS, STANDARD_CHARS, LISTED_IDS, LISTED_DEPENDS, PER_PLAN, TITLE_CHARS, LEAST_CITED = 30000, 500, 1500, 20, 5, 5, 100, 2
NOT_FOUND = "No requirement in the corpus matches this question."

# The forms of the registered questions, one for each route; {i}, {t}, {p}, {m}, {r} are the requirement's
# id, title, plan, operator and release, {w} the first word of its title.
FORMS = ["What is {i} of {m} {r}?", "What does the {p} plan of {m} {r} say about {t}?", "Compare {m} on {t}", "Everything about {t}", "Which requirements mention {t} in 3GPP TS 24.301?", "{t}", "What is {w}?"]


def asked(spark: SparkSession, base: str) -> DataFrame:
    """qid, question: one question about every requirement whose chunk id is divisible by 100, by one of the forms in turn.
    The question's vector is the one with its id."""
    r = table(spark, base, "requirements").where("req_id is not null")
    r = r.groupBy("req_id").agg(F.min("rec_id").alias("qid"), *[F.min_by(c, "rec_id").alias(c) for c in ("title", "plan_id", "mno", "release")]).where("qid % 100 = 0")
    t = F.coalesce("title", "req_id")
    parts = {"i": F.col("req_id"), "t": t, "p": F.coalesce("plan_id", F.lit("")), "m": F.lower(F.coalesce("mno", F.lit(""))), "r": F.coalesce("release", F.lit("")), "w": F.substring_index(t, " ", 1)}
    q = F.lit(None).cast("string")
    for n, form in reversed(list(enumerate(FORMS))):
        whole = F.lit(form)
        for name, c in parts.items():
            whole = F.replace(whole, F.lit("{" + name + "}"), c)
        q = F.when(F.expr(f"(qid div 100) % {len(FORMS)}") == n, whole).otherwise(q)
    return r.select("qid", q.alias("question"))


def _by_type(m: dict, default) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in m.items() for x in (F.lit(k), F.array(*[F.lit(y) for y in v]) if isinstance(v, list) else F.lit(v))]), F.col("query_type")), F.array(*[F.lit(y) for y in default]) if isinstance(default, list) else F.lit(default))


def intents(questions: DataFrame, plan_ids: DataFrame) -> DataFrame:
    """questions: qid, question; plan_ids: plan_id. One row per question with what it asks for."""
    low = F.lower("question")
    q = questions.where("question is not null")
    words = q.select("qid", F.explode(F.array_distinct(tx.tokenize(F.col("question")))).alias("w"))
    plans = words.join(plan_ids.select("plan_id", F.lower("plan_id").alias("w")).distinct(), "w").groupBy("qid").agg(F.sort_array(F.collect_set("plan_id")).alias("plan_ids"))
    j = q.join(plans, "qid", "left").withColumn("plan_ids", F.coalesce("plan_ids", F.array().cast("array<string>")))
    features = F.filter(F.array(*[F.when(u.has_any(low, kw), F.lit(f)) for f, _, kw in u.FEATURES]), lambda x: x.isNotNull())
    ids = F.array_distinct(tx.find_req_ids(F.col("question")))
    timers = F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(r"\bt3[0-9]{3}\b"), 0), lambda x: F.upper(x)))
    releases = F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit(r"20[0-9]{2}_[a-z]{3}"), 0), F.regexp_extract_all(low, F.lit("latest|current"), 0)))
    out = j.select(
        "qid", "question", F.concat(ids, timers).alias("entities"), u.word_hits(low, u.CONCEPTS).alias("concepts"), u.mno_hits(low).alias("mnos"), releases.alias("releases"),
        F.array_distinct(F.regexp_extract_all(low, F.lit(r"3gpp\s+ts\s+([0-9][0-9.]*[0-9])"), 1)).alias("standards"), features.alias("features"), "plan_ids", u.question_type(low, F.col("plan_ids")).alias("query_type"),
    )
    return out.select(
        "*", _by_type(DEPTH, DEFAULT_DEPTH).alias("depth"), _by_type(EDGES, EDGES["general"]).alias("edge_types"), F.greatest(F.lit(LEAST_K), _by_type(TOP_K, 0)).alias("k"),
        _by_type(BM25_WEIGHT, 0.0).alias("weight"), F.col("query_type").isin(RERANKED).alias("reranks"),
    )


def month_of(release: Column) -> Column:
    """A sortable form of a release like 2025_feb: year, then month; other spellings come before in their year."""
    month = F.instr(F.lit("jan feb mar apr may jun jul aug sep oct nov dec"), F.lower(F.substring_index(release, "_", -1)))
    return F.struct(F.substring_index(release, "_", 1).alias("y"), month.alias("m"), release.alias("r"))


def scopes(intent: DataFrame, available: DataFrame) -> DataFrame:
    """available: mno, release. The (mno, release) pairs of each question: its operators (all where it names none that
    exists), in the release that it names, exactly, in part, or the latest."""
    rel = available.where("mno is not null and release is not null").select("mno", "release").distinct()
    latest = rel.groupBy("mno").agg(F.max_by("release", month_of(F.col("release"))).alias("latest"))
    named = intent.select("qid", F.explode("mnos").alias("mno"), F.try_element_at("releases", F.lit(1)).alias("wish")).join(latest, "mno")
    wished = named.where("wish is not null").join(rel, "mno")
    low = F.lower("release")
    rule = F.when(F.col("wish").isin("latest", "current"), 9).when(low == F.col("wish"), 1).when(F.contains(low, F.col("wish")), 2).when(F.exists(F.split(low, "_"), lambda x: F.contains(F.col("wish"), x)), 3).otherwise(9)
    met = wished.withColumn("rule", rule).where("rule < 9").groupBy("qid", "mno").agg(F.max_by("release", F.struct(-F.col("rule"), month_of(F.col("release")))).alias("met"))
    own = named.join(met, ["qid", "mno"], "left").select("qid", "mno", F.coalesce("met", "latest").alias("release"))
    rest = intent.select("qid").join(own.select("qid"), "qid", "left_anti").crossJoin(latest.select("mno", F.col("latest").alias("release")))  # a row for each operator
    return own.unionByName(rest)


def graph_seeds(intent: DataFrame, scope: DataFrame, reqs: DataFrame, feature_plans: DataFrame) -> DataFrame:
    """reqs: req_id, mno, release, plan_id, title, text; feature_plans: feature_id, plan_id. qid, id, score, source."""
    keys = ["qid", "mno", "release"]
    r = reqs.select(g.nid("req", "req_id").alias("id"), "req_id", "mno", "release", "plan_id")

    def found(df: DataFrame, score, source: str) -> DataFrame:
        return df.join(scope, keys, "left_semi").select("qid", "id", score.alias("score"), F.lit(source).alias("source")).distinct()

    named = found(intent.select("qid", F.explode("entities").alias("req_id")).distinct().join(r, "req_id"), F.lit(1.0), "entity")
    left = intent.join(named.select("qid"), "qid", "left_anti")
    by_feature = left.select("qid", F.explode("features").alias("feature_id")).join(feature_plans, "feature_id").select("qid", "plan_id").distinct()
    feature = found(by_feature.join(r, "plan_id"), F.lit(0.8), "feature")
    left = left.join(feature.select("qid"), "qid", "left_anti")
    plan = found(left.select("qid", F.explode("plan_ids").alias("plan_id")).join(r, "plan_id"), F.lit(0.6), "plan")
    left = left.join(plan.select("qid"), "qid", "left_anti").where(F.size("concepts") > 0)
    # every text is scanned once for all concepts; named entities are looked up among its words
    low = F.lower(F.concat_ws(" ", "title", "text"))
    have = reqs.select(g.nid("req", "req_id").alias("id"), "mno", "release", F.explode(F.array_union(u.word_hits(low, u.CONCEPTS), F.filter(F.array_distinct(tx.tokenize(low)), lambda w: w.rlike("^t3[0-9]{3}$")))).alias("term"))
    want = left.select("qid", F.explode(F.array_union("concepts", F.transform("entities", lambda x: F.lower(x)))).alias("term"))
    hits = want.join(have, "term").groupBy("qid", "id", "mno", "release").agg(F.count("*").alias("n"))
    title = found(hits, F.round(0.3 + 0.2 * F.least("n", F.lit(3)), 4), "title_search")
    return named.unionByName(feature).unionByName(plan).unionByName(title)


def traverse(seeds: DataFrame, intent: DataFrame, scope: DataFrame, edges: DataFrame, reqs: DataFrame) -> DataFrame:
    """qid, id, depth, score of the seeds (depth 0) and of everything within the type's depth; requirements in scope only."""
    tmp = Scratch(seeds.sparkSession)
    where = reqs.select(g.nid("req", "req_id").alias("id"), "mno", "release", "plan_id")
    kinds = sorted({t for ts in EDGES.values() for t in ts})
    bit = F.coalesce(*[F.when(F.col("edge_type") == t, F.lit(1 << n)) for n, t in enumerate(kinds)])
    used = edges.where(F.col("edge_type").isin(kinds)).select("src", "dst", bit.alias("bit"))
    both = used.select(F.col("src").alias("id"), F.col("dst").alias("next"), "bit").unionByName(used.select(F.col("dst").alias("id"), F.col("src").alias("next"), "bit"))
    # a node that many requirements share is asked for its neighbours in scope only: they carry operator and release
    to_req, from_req = F.startswith("next", F.lit("req:")), F.startswith("id", F.lit("req:"))
    near = tmp.save(both.where(to_req).join(where.select(F.col("id").alias("next"), "mno", "release"), "next"))
    other = both.where(~to_req)
    std = tmp.save(edges.where("edge_type = 'references_standard'").select(F.col("src").alias("id"), F.col("dst").alias("std")).join(where, "id"))
    types = sum(F.when(F.array_contains("edge_types", F.lit(t)), F.lit(1 << n)).otherwise(F.lit(0)) for n, t in enumerate(kinds))
    policy = intent.select("qid", types.alias("types"), F.col("depth").alias("most"))
    keys = ["qid", "mno", "release"]
    seen = seeds.select("qid", "id", F.lit(0).alias("depth"), "score")
    frontier = seen.select("qid", "id").distinct()
    deepest = max([DEFAULT_DEPTH, *DEPTH.values()])
    for d in range(1, deepest + 1):
        at = frontier.join(policy.where(F.col("most") >= d), "qid")
        follows = F.col("types").bitwiseAND(F.col("bit")) != 0
        step = at.join(other, "id").where(follows).select("qid", F.col("next").alias("id")).distinct()
        kin = at.where(from_req).join(near, "id").where(follows).select(*keys, F.col("next").alias("id")).distinct().join(scope, keys, "left_semi").select("qid", "id")
        hub = at.where(~from_req).join(scope, "qid").join(near, ["id", "mno", "release"]).where(follows).select("qid", F.col("next").alias("id"))
        # a shared standard: first the distinct standards of the question, then their members of other plans
        shared = at.where(F.col("types").bitwiseAND(F.lit(1 << kinds.index("shared_standard"))) != 0).join(std.select("id", "std", "plan_id"), "id").groupBy("qid", "std").agg(F.min("plan_id").alias("lo"), F.max("plan_id").alias("hi"))
        members = shared.join(scope, "qid").join(std, ["std", "mno", "release"]).where("plan_id <> lo or plan_id <> hi").select("qid", "id")
        new = step.unionByName(kin).unionByName(hub).unionByName(members).distinct().join(seen.select("qid", "id"), ["qid", "id"], "left_anti")
        new = tmp.save(new.withColumn("depth", F.lit(d)).withColumn("score", F.lit(round(g.DECAY**d, 6))))
        seen = seen.unionByName(new)
        frontier = new.select("qid", "id")
    return seen


class Batch:
    """The tables of one batch of questions; each is written once and read by the steps after it."""

    def __init__(self, spark: SparkSession, base: str, questions: DataFrame | None = None) -> None:
        self.spark, self.base = spark, base
        self.tmp = Scratch(spark)
        self.questions = asked(spark, base) if questions is None else questions
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.tmp.save(make())
        return self._made[name]

    @property
    def intents(self) -> DataFrame:
        return self._once("intents", lambda: intents(self.questions, table(self.spark, self.base, "plans").select("plan_id").distinct()))

    @property
    def scopes(self) -> DataFrame:
        return self._once("scopes", lambda: scopes(self.intents, table(self.spark, self.base, "plans")))

    @property
    def reqs(self) -> DataFrame:
        def make() -> DataFrame:
            r = table(self.spark, self.base, "requirements").where("req_id is not null")
            cols = ("mno", "release", "plan_id", "title", "text", "section_number")
            return r.groupBy("req_id").agg(F.min("rec_id").alias("chunk_id"), *[F.min_by(c, "rec_id").alias(c) for c in cols])

        return self._once("reqs", make)

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: g.edges(self.spark, self.base))

    @property
    def groups(self) -> DataFrame:
        """qid, gid: questions with the same type, scopes and named things have the same seeds and candidates, which are worked
        out once, for the question with the least id of them."""

        def make() -> DataFrame:
            # lists of strings as they are, no text made of them, so that nothing is mistaken for the same
            scope = self.scopes.groupBy("qid").agg(F.sort_array(F.collect_set(F.struct("mno", "release"))).alias("scope"))
            i = self.intents.join(scope, "qid", "left").select("qid", F.struct("query_type", *[F.sort_array(F.array_distinct(c)).alias(c) for c in ("entities", "features", "plan_ids", "concepts")], "scope").alias("same"))
            return i.join(i.groupBy("same").agg(F.min("qid").alias("gid")), "same").select("qid", "gid")

        return self._once("groups", make)

    def _first(self, df: DataFrame) -> DataFrame:
        """The rows of the questions that stand for their group."""
        return df.join(self.groups.where("qid = gid").select("qid"), "qid", "left_semi")

    def _each(self, df: DataFrame) -> DataFrame:
        """The rows of a group for every question of the group."""
        return df.withColumnRenamed("qid", "gid").join(self.groups, "gid").select("qid", *[c for c in df.columns if c != "qid"])

    @property
    def group_seeds(self) -> DataFrame:
        return self._once("group_seeds", lambda: graph_seeds(self._first(self.intents), self._first(self.scopes), self.reqs, u.feature_hits(self.spark, self.base).select("feature_id", "plan_id")))

    @property
    def seeds(self) -> DataFrame:
        return self._each(self.group_seeds)

    @property
    def group_candidates(self) -> DataFrame:
        return self._once("group_candidates", lambda: traverse(self.group_seeds, self._first(self.intents), self._first(self.scopes), self.edges, self.reqs))

    @property
    def candidates(self) -> DataFrame:
        return self._each(self.group_candidates)

    @property
    def population(self) -> DataFrame:
        """gid, chunk_id, scoped: the chunks that may answer the questions of a group: its candidates, else what is in its scope."""

        def make() -> DataFrame:
            r = self.reqs.select("chunk_id", g.nid("req", "req_id").alias("id"), "mno", "release")
            c = self.group_candidates.where(F.startswith("id", F.lit("req:"))).select(F.col("qid").alias("gid"), "id")
            near = c.join(r.select("id", "chunk_id"), "id").select("gid", "chunk_id", F.lit(True).alias("scoped"))
            far = self._first(self.scopes).withColumnRenamed("qid", "gid").join(c.select("gid").distinct(), "gid", "left_anti").join(r, ["mno", "release"]).select("gid", "chunk_id", F.lit(False).alias("scoped"))
            return near.unionByName(far)

        return self._once("population", make)

    @property
    def dense(self) -> DataFrame:
        """qid, chunk_id, distance, rank: the nearest chunks of the population, as many as the type's fan-out. Groups become
        questions only where both the question and the chunk have a vector."""

        def make() -> DataFrame:
            v = vectors(self.spark, self.base).select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("x"))
            q = self.groups.join(v.select(F.col("chunk_id").alias("qid"), F.col("x").alias("y")), "qid")
            pairs = self.population.join(v, "chunk_id").join(q, "gid").select("qid", "chunk_id", "scoped", F.round(tx.cosine_distance(F.col("y"), F.col("x")), 6).alias("distance"))
            fan = self.intents.select("qid", (F.col("k") * F.when(F.col("reranks"), 2).otherwise(1) * F.when(F.col("weight") > 0, FANOUT).otherwise(1)).alias("fan"))
            widest = max(LEAST_K, *TOP_K.values()) * 2 * FANOUT
            top = topk_per_group(pairs, ["qid"], [F.asc("distance"), F.asc("chunk_id")], widest)
            return top.join(fan, "qid").where("rank <= fan").drop("fan")

        return self._once("dense", make)

    @property
    def sparse(self) -> DataFrame:
        """qid, chunk_id, score, rank by BM25 for the types that use it. Candidates are all ranked, chunks without a common
        term with score 0; without candidates only what the vectors found is."""

        def make() -> DataFrame:
            i = self.intents.where((F.col("weight") > 0) & (F.size(tx.tokenize(F.col("question"))) > 0)).select("qid", "question", (F.col("k") * F.when(F.col("reranks"), 2).otherwise(1) * FANOUT).alias("fan"))
            i = i.join(self.groups, "qid").join(self.population.where("scoped").select("gid").distinct().withColumn("scoped", F.lit(True)), "gid", "left")
            # the key of a question with candidates is its group, of another the question itself; no id is both
            i = self.tmp.save(i.select("qid", "question", "fan", F.when(F.col("scoped"), F.col("gid")).otherwise(F.col("qid")).alias("key")))
            among = self.population.where("scoped").select(F.col("gid").alias("key"), "chunk_id").unionByName(self.dense.where("not scoped").select(F.col("qid").alias("key"), "chunk_id"))
            x = Bm25(self.reqs.select("chunk_id", F.concat_ws(" ", "title", "text").alias("text")), i.select("qid", "question"), "chunk_id", "text", K1, B, EPSILON)
            return bm25_grid(x, self.reqs.select("chunk_id"), i.select("qid", "key", "fan"), among)

        return self._once("sparse", make)

    @property
    def fused(self) -> DataFrame:
        """qid, chunk_id, distance (0 where only BM25 found it), rank: both lists fused, as many as retrieval keeps."""

        def make() -> DataFrame:
            w = self.intents.select("qid", "weight", (F.col("k") * F.when(F.col("reranks"), 2).otherwise(1)).alias("keep"))
            f = rrf_fuse([self.dense.select("qid", "chunk_id", "rank"), self.sparse.select("qid", "chunk_id", "rank")], ["qid"], "chunk_id", k=RRF_K, weights=[DENSE_WEIGHT, self._weight()])
            f = f.withColumn("fused", F.round("fused", 9))
            top = topk_per_group(f, ["qid"], [F.desc("fused"), F.asc("first_list"), F.asc("first_rank")], 2 * max(LEAST_K, *TOP_K.values()))
            top = top.join(w, "qid").where("rank <= keep").select("qid", "chunk_id", "rank")
            return top.join(self.dense.select("qid", "chunk_id", "distance"), ["qid", "chunk_id"], "left").withColumn("distance", F.coalesce("distance", F.lit(0.0)))

        return self._once("fused", make)

    @staticmethod
    def _weight() -> float:
        weights = set(BM25_WEIGHT.values())
        if len(weights) != 1:
            raise ValueError("types with different BM25 weights need one fusion for each weight")
        return weights.pop()

    @property
    def retrieved(self) -> DataFrame:
        """qid, chunk_id (null for a pinned entry), chunk, pinned, distance, rank: reranked, diversified, pinned, cut at k."""

        def make() -> DataFrame:
            i = self.intents.select("qid", "question", "k", "reranks")
            r = self.reqs.select("chunk_id", "req_id", "plan_id", F.concat_ws(" ", "title", "text").alias("text"))
            f = self.fused.join(i, "qid").join(r, "chunk_id")
            terms = F.array_distinct(tx.tokenize(F.col("question")))
            share = F.floor(F.size(F.array_intersect(terms, tx.tokenize(F.col("text")))) * 10 / F.greatest(F.size(terms), F.lit(1)))
            f = f.withColumn("pair_score", F.when(F.col("reranks"), share).otherwise(0))
            again = topk_per_group(f.withColumnRenamed("rank", "prior"), ["qid"], [F.desc("pair_score"), F.asc("prior")], 2 * max(LEAST_K, *TOP_K.values())).where(~F.col("reranks") | (F.col("rank") <= F.col("k")))
            # one of each plan, in order of rank, then the others up to k; ordered by distance
            first = F.row_number().over(Window.partitionBy("qid", "plan_id").orderBy("rank")) == 1
            picked = again.withColumn("first", first).withColumn("pick", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("first"), "rank"))).where(F.col("first") | (F.col("pick") <= F.col("k")))
            order = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "rank"))
            found = picked.withColumn("at", order).select("qid", "k", "chunk_id", g.nid("req", "req_id").alias("chunk"), F.lit(False).alias("pinned"), "distance", "at")
            asks = i.select("qid", "k", F.lower(F.regexp_extract("question", ACRONYM, 1)).alias("word")).where("word <> ''")
            pins = asks.join(glossary_words(self.spark, self.base), "word").select("qid", "k", F.lit(None).cast("long").alias("chunk_id"), "chunk", F.lit(True).alias("pinned"), F.lit(1.0).alias("distance"), F.lit(0).alias("at"))
            u_ = found.unionByName(pins)
            last = F.row_number().over(Window.partitionBy("qid").orderBy("at"))
            return u_.withColumn("rank", last).where(F.col("rank") <= F.col("k")).select("qid", "chunk_id", "chunk", "pinned", "distance", "rank")

        return self._once("retrieved", make)

    @property
    def enriched(self) -> DataFrame:
        """The retrieved requirements with parent, standards (those whose text is known) and dependencies. Edges are cut down
        to those of retrieved requirements before anything is joined to them."""

        def make() -> DataFrame:
            r = self.reqs
            hit = self.retrieved.where("not pinned").join(r, "chunk_id").withColumn("id", F.col("chunk"))
            ids = hit.select("id").distinct()
            e = self.edges
            up = e.where("edge_type = 'parent_of'").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("up"))
            above = r.select(g.nid("req", "req_id").alias("up"), F.nullif("title", F.lit("")).alias("up_title"), F.nullif("text", F.lit("")).alias("up_text"))
            parent = up.join(above, "up").select("id", F.coalesce(F.when(F.col("up_text").isNotNull(), F.concat(F.coalesce("up_title", F.lit("")), F.lit(": "), "up_text")), "up_title").alias("parent"))
            dep = e.where("edge_type = 'depends_on' and dst like 'req:%'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.substring("dst", 5, 1000))).alias("related"))
            ref = e.where("edge_type = 'references_standard'").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("id"), F.col("dst").alias("std"))
            s = table(self.spark, self.base, "spec_sections").where("text is not null and trim(text) <> ''").select(spec_key(F.col("spec")).alias("spec"), F.coalesce("release_num", F.lit(0)).alias("rel"), F.col("number").alias("section"), "sec_id", "title", "text")
            s = s.where("section is not null").withColumn("std", F.concat_ws(":", F.lit("std"), "spec", "rel", "section"))
            known = s.join(ref.select("std").distinct(), "std", "left_semi").groupBy("std", "spec", "rel", "section").agg(F.min_by(F.struct("title", "text"), "sec_id").alias("t"))
            std = ref.join(known, "std").select("id", F.struct("std", "spec", "section", "rel", F.col("t.title").alias("title"), F.substring("t.text", 1, STANDARD_CHARS).alias("text")).alias("s"))
            std = std.groupBy("id").agg(F.sort_array(F.collect_list("s")).alias("standards"))
            j = hit.join(parent, "id", "left").join(dep, "id", "left").join(std, "id", "left")
            none = F.array().cast("array<string>")
            return j.select("qid", "chunk_id", "chunk", "rank", "distance", "req_id", "plan_id", "mno", "release", "section_number", "title", "text", "parent", F.coalesce("related", none).alias("related"), F.coalesce("standards", F.array().cast(j.schema["standards"].dataType)).alias("standards"))

        return self._once("enriched", make)

    @property
    def contexts(self) -> DataFrame:
        """qid, context: the text that a model is given, cut at the limit with a note."""
        e, line = self.enriched, "\n"
        opt = lambda c, label: F.when(c.isNotNull(), F.concat(F.lit(label), c))
        std = F.array_join(F.transform("standards", lambda s: F.concat_ws(line, F.concat(F.lit("[Standard "), s["spec"], F.lit(" section "), s["section"], F.lit(" release "), s["rel"].cast("string"), F.lit("]")), F.nullif(s["title"], F.lit("")), s["text"])), line)
        part = F.concat_ws(
            line,
            F.concat(F.lit("--- Requirement "), F.col("rank").cast("string"), F.lit(" ---")),
            F.concat(F.lit("Source: "), F.concat_ws(" | ", "mno", "release", "plan_id", "section_number")), F.concat(F.lit("Requirement ID: "), "req_id"),
            opt(F.substring("parent", 1, PARENT_CHARS), "Parent: "), F.nullif("title", F.lit("")), F.nullif("text", F.lit("")), F.nullif(std, F.lit("")),
            F.when(F.size("related") > 0, F.concat(F.lit("Depends on: "), F.array_join(F.slice("related", 1, LISTED_DEPENDS), ", "))),
            F.concat(F.lit("Distance in millionths: "), F.round(F.col("distance") * 1_000_000).cast("long").cast("string")),
        )
        parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("t"), "req_id")))
        x = e.groupBy("qid").agg(parts.alias("ps")).join(self.intents.select("qid", "question"), "qid")
        ids = F.transform("ps", lambda p: p["req_id"])
        cite = F.concat(F.lit("Cite these requirement IDs for every claim: "), F.array_join(F.slice(ids, 1, LISTED_IDS), ", "), F.when(F.size(ids) > LISTED_IDS, F.lit(" ...")).otherwise(""))
        whole = F.concat_ws("\n\n", F.concat(F.lit("Question: "), "question"), F.array_join(F.transform("ps", lambda p: p["t"]), "\n\n"), cite)
        return x.select("qid", whole.alias("w")).select("qid", F.when(F.length("w") > CONTEXT_CHARS, F.concat(F.substring("w", 1, CONTEXT_CHARS), F.lit("\n\n[Context truncated]"))).otherwise(F.col("w")).alias("context"))

    @property
    def answers(self) -> DataFrame:
        """qid, answer: requirements grouped by plan in order of their first rank, five of each plan at most."""
        e = self.enriched
        plan = F.coalesce("plan_id", F.lit("unknown"))
        w = Window.partitionBy("qid", plan)
        refs = F.array_join(F.transform(F.slice("standards", 1, 2), lambda s: F.concat(F.lit("\n  see TS "), s["spec"], F.lit(", section "), s["section"])), "")
        entry = F.concat(F.lit("- "), "req_id", F.lit(" ("), F.coalesce("section_number", F.lit("?")), F.lit("): "), F.substring(F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.substring_index(F.trim("text"), "\n", 1), F.lit("")), 1, TITLE_CHARS), refs)
        x = e.select("qid", plan.alias("plan"), F.min("rank").over(w).alias("seen"), F.count("*").over(w).alias("n"), F.row_number().over(w.orderBy("rank")).alias("nth"), "rank", entry.alias("entry")).where(F.col("nth") <= PER_PLAN)
        per = x.groupBy("qid", "plan", "seen", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda p: p["entry"]), "\n").alias("t"))
        block = F.concat(F.lit("## "), "plan", F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), "t")
        a = per.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seen", block.alias("b")))), lambda p: p["b"]), "\n\n").alias("body"))
        return self.intents.select("qid").join(a, "qid", "left").select("qid", F.coalesce("body", F.lit(NOT_FOUND)).alias("answer"))

    def citations(self, answers: DataFrame) -> DataFrame:
        """answers: qid, answer. qid, cited (ids of the answer's text), recovered: the context's ids and standards that the
        answer does not name, added where it names fewer than two ids."""
        cited = answers.select("qid", F.array_distinct(tx.find_req_ids(F.col("answer"))).alias("ids"), F.array_distinct(F.regexp_extract_all("answer", F.lit(r"3GPP\s+TS\s+([0-9][0-9.]*[0-9])"), 1)).alias("specs"))
        e = self.enriched
        ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "req_id"))), lambda x: x["req_id"])
        std = F.array_distinct(F.sort_array(F.flatten(F.collect_list(F.transform("standards", lambda s: F.concat(s["spec"], F.lit(":"), s["section"]))))))
        have = e.groupBy("qid").agg(ids.alias("context_ids"), std.alias("context_stds"))
        j = cited.join(have, "qid", "left")
        none = F.array().cast("array<string>")
        few = F.size("ids") < LEAST_CITED
        more = F.when(few, F.concat(F.array_except(F.coalesce("context_ids", none), "ids"), F.coalesce("context_stds", none))).otherwise(none)
        return j.select("qid", F.array_join(F.concat("ids", "specs"), ",").alias("cited"), F.array_join(more, ",").alias("recovered"))


def _text(*cols: str):
    return [F.array_join(c, ",").alias(c) for c in cols]


def query_intents(spark: SparkSession, base: str) -> DataFrame:
    return Batch(spark, base).intents.select("qid", "question", "query_type", "depth", "k", "weight", "reranks", *_text("entities", "concepts", "mnos", "releases", "standards", "features", "plan_ids"))


def query_scopes(spark: SparkSession, base: str) -> DataFrame:
    return Batch(spark, base).scopes


def query_seeds(spark: SparkSession, base: str) -> DataFrame:
    return Batch(spark, base).seeds


def query_graph_scope(spark: SparkSession, base: str) -> DataFrame:
    return Batch(spark, base).candidates


def scoped_dense(spark: SparkSession, base: str) -> DataFrame:
    return Batch(spark, base).dense


def scoped_bm25(spark: SparkSession, base: str) -> DataFrame:
    return Batch(spark, base).sparse


def query_retrieve(spark: SparkSession, base: str) -> DataFrame:
    return Batch(spark, base).retrieved


def context_full(spark: SparkSession, base: str) -> DataFrame:
    return Batch(spark, base).contexts


def citation_recovery(spark: SparkSession, base: str) -> DataFrame:
    """Citations of a model that gives the question back: named ids, and what the context adds."""
    b = Batch(spark, base)
    return b.citations(b.intents.select("qid", F.col("question").alias("answer")))


def query_pipeline(spark: SparkSession, base: str) -> DataFrame:
    """Every question with its type, candidates, retrieved chunks, answer and the size of its context in tokens."""
    b = Batch(spark, base)
    found = b.retrieved.groupBy("qid").agg(F.count("*").alias("retrieved"))
    cand = b.groups.join(b.group_candidates.groupBy(F.col("qid").alias("gid")).agg(F.count("*").alias("candidates")), "gid").select("qid", "candidates")
    ctx = b.contexts.select("qid", tx.token_estimate(F.col("context")).alias("context_tokens"))
    j = b.intents.select("qid", "query_type").join(cand, "qid", "left").join(found, "qid", "left").join(ctx, "qid", "left").join(b.answers, "qid")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("qid", "query_type", zero("candidates"), zero("retrieved"), zero("context_tokens"), "answer")
