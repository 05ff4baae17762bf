"""Full-text and vector search for batches of questions: BM25, exact vector top-k, fusion, diversity, pins, thresholds.

A batch is one job: questions are a side of joins, never a loop, and never come to the driver. BM25 joins question terms
with postings on the term (a term that a third of all texts have is split by the skew join). Where only the best k are
wanted and scores would be many, they are made in a grid of blocks of questions and blocks of texts (`bm25_grid`). Vector search is a grid of blocks of queries and
blocks of vectors: the vectors are read once whatever the number of questions, every pair of blocks is one matrix product
in one task, and only the k best of each query leave it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions import text as tx
from reqloom.operators.patterns import once, rrf_fuse, topk_per_group
from reqloom.sources.tables import Scratch, table

K1, B, EPSILON = 1.5, 0.75, 0.25  # fixed values: Okapi defaults
QUERY_BLOCK = 8192  # queries of one block; 8192 x 1024 dimensions are 32 MB
VECTOR_BLOCK = 50_000  # vectors of one block
STEP = 4096  # vectors multiplied at once
RRF_K = 60
THRESHOLD = 0.5
# Fixed values of the retrieval policy by question type: fan-out and weight of BM25.
TOP_K = {"cross_doc": 25, "cross_mno_comparison": 25, "standards_comparison": 25, "feature_level": 25, "traceability": 20, "release_diff": 20}
BM25_WEIGHT = {"standards_comparison": 0.5, "traceability": 0.5, "single_doc": 0.5}


def chunks(spark: SparkSession, base: str) -> DataFrame:
    """chunk_id (first rec_id of a requirement), req_id, plan_id, mno, release, text = title and body."""
    r = table(spark, base, "requirements").where("req_id is not null")
    cols = ("plan_id", "mno", "release", "title", "text")
    r = r.groupBy("req_id").agg(F.min("rec_id").alias("chunk_id"), *[F.min_by(c, "rec_id").alias(c) for c in cols])
    return r.select("chunk_id", "req_id", "plan_id", "mno", "release", F.concat_ws(" ", "title", "text").alias("text"))


def questions(spark: SparkSession, base: str) -> DataFrame:
    """Every feedback question whose id is divisible by 100."""
    return once(table(spark, base, "test_feedback").where("id % 100 = 0"), "id").select(F.col("id").alias("qid"), F.col("question").alias("question"))


def postings(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """term, id, tf, dl."""
    t = docs.select(id_, tx.tokenize(F.col(text)).alias("ts")).select(id_, F.explode("ts").alias("term"), F.size("ts").alias("dl"))
    return t.groupBy("term", id_, "dl").agg(F.count("*").alias("tf"))


DIRECT = 1_000_000  # scores of (question, posting) up to which a join is cheaper than the grid
TEXT_BLOCK = 20_000  # texts of one block


class Bm25:
    """Term weights and postings of a batch: texts are tokenised once, into a written table. Document frequencies of all
    terms combine before the shuffle; only occurrences of terms that are asked for become postings. Terms in more than half
    of the texts get epsilon times the mean idf, as the usual scorer does."""

    def __init__(self, docs: DataFrame, asked: DataFrame, id_: str, text: str, k1: float, b: float, epsilon: float) -> None:
        tmp = self.tmp = Scratch(docs.sparkSession)
        self.id = id_
        toks = tmp.save(docs.select(id_, tx.tokenize(F.col(text)).alias("ts")))
        q = asked.select("qid", F.explode(tx.tokenize(F.col("question"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
        stats = F.broadcast(toks.agg(F.count("*").alias("n_docs"), F.avg(F.size("ts")).alias("avgdl")))  # one row
        df = toks.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        idf = tmp.save(df.crossJoin(stats).select("term", "df", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw")))
        mean = F.broadcast(idf.agg(F.avg("raw").alias("mean")))  # one row
        weight = F.when(F.col("raw") < 0, F.lit(epsilon) * F.col("mean")).otherwise(F.col("raw"))
        self.terms = q.join(idf, "term").crossJoin(mean).select("qid", "term", "df", (F.col("qtf") * weight).alias("w"))
        tf, dl = F.col("tf"), F.col("dl")
        seen = toks.select(id_, F.size("ts").alias("dl"), F.explode("ts").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))
        self.post = seen.groupBy("term", id_, "dl").agg(F.count("*").alias("tf")).crossJoin(stats).select("term", id_, part.alias("part"))

    def scores(self) -> DataFrame:
        return self.post.join(self.terms, "term").groupBy("qid", self.id).agg(F.sum(F.col("w") * F.col("part")).alias("score"))


def bm25(docs: DataFrame, asked: DataFrame, id_: str = "chunk_id", text: str = "text", k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """qid, chunk, score of every chunk that shares a term with the question; repeated terms count repeatedly."""
    return Bm25(docs, asked, id_, text, k1, b, epsilon).scores()


def bm25_best(docs: DataFrame, asked: DataFrame, k: int, id_: str = "chunk_id", text: str = "text", k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """qid, chunk, score (six decimals), rank: the k best of every question, the same as of `bm25`.

    The document frequencies say how many scores there are; up to DIRECT of them are made by a join, more in a grid of blocks
    (`bm25_grid`); both ways give the same rows. Where fewer chunks than k share a term with a question that has any, others
    follow with score 0, by id.
    """
    x = Bm25(docs, asked, id_, text, k1, b, epsilon)
    some = asked.where(F.size(tx.tokenize(F.col("question"))) > 0).select("qid").distinct()
    work = x.terms.agg(F.sum("df")).first()[0] or 0
    if work > DIRECT:
        return bm25_grid(x, docs.select(id_), some.withColumn("fan", F.lit(k)))
    # of the first 2 k ids at least k are not among fewer than k that share a term
    ids = docs.select(id_).orderBy(id_).limit(2 * k).agg(F.collect_list(id_).alias("ids"))
    none = some.crossJoin(F.broadcast(ids)).select("qid", F.explode("ids").alias(id_), F.lit(0.0).alias("score"))
    total = x.scores().unionByName(none).groupBy("qid", id_).agg(F.round(F.sum("score"), 6).alias("score"))
    return topk_per_group(total, ["qid"], [F.desc("score"), F.asc(id_)], k)


def _best(texts: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """The best texts of a block for every question of a block: one array of scores, to which each term adds its postings."""
    if not len(texts) or not len(asked):
        return pd.DataFrame({"qid": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    texts = texts.sort_values("id", ignore_index=True)  # ties go to the smaller id
    ids, n = texts["id"].to_numpy(), len(texts)

    def flat(col: str, kind: str) -> tuple[np.ndarray, np.ndarray]:
        lists = [x if x is not None else () for x in texts[col]]
        at = np.repeat(np.arange(n), [len(x) for x in lists])
        return (np.concatenate(lists).astype(kind) if len(at) else np.empty(0, kind)), at

    def slices(keys: np.ndarray) -> tuple[np.ndarray, dict]:
        order = np.argsort(keys, kind="stable")
        names, first = np.unique(keys[order], return_index=True)
        return order, {k: (lo, hi) for k, lo, hi in zip(names.tolist(), first.tolist(), np.append(first, len(keys))[1:].tolist(), strict=True)}

    term, at = flat("terms", "int64")
    part, _ = flat("parts", "float64")
    order, where = slices(term)
    at, part = at[order], part[order]
    own, own_at = flat("keys", "int64")
    own_order, mine = slices(own)
    own_at = own_at[own_order]
    qids, found, scores = [], [], []
    for qid, key, fan, ts, ws in zip(asked["qid"], asked["key"], asked["fan"], asked["terms"], asked["ws"], strict=True):
        among = None
        if not pd.isna(key):
            if int(key) not in mine:
                continue
            among = own_at[slice(*mine[int(key)])]
        s = np.zeros(n)
        for t, w in zip(ts, ws, strict=True) if ts is not None else ():
            if t in where:
                lo, hi = where[t]
                s[at[lo:hi]] += w * part[lo:hi]
        s = np.round(s if among is None else s[among], 6) + 0.0
        pick = np.arange(len(s))
        if len(s) > fan:
            least = np.partition(s, len(s) - fan)[len(s) - fan]
            above = np.flatnonzero(s > least)
            pick = np.concatenate([above, np.flatnonzero(s == least)[: fan - len(above)]])
        qids.append(np.full(len(pick), qid))
        found.append(ids[pick if among is None else among[pick]])
        scores.append(s[pick])
    none = [np.empty(0, "int64")]
    return pd.DataFrame({"qid": np.concatenate(none + qids), "id": np.concatenate(none + found), "score": np.concatenate([np.empty(0), *scores])})


def bm25_grid(x: Bm25, texts: DataFrame, asked: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """qid, id, score (six decimals), rank: the best `fan` texts of every question among all, with score 0 where no term is shared.

    asked: qid, fan, and with `among` (key, id) also key: then only texts of the question's key are ranked. Texts are dealt to
    blocks of about TEXT_BLOCK, questions to blocks of about QUERY_BLOCK; every pair of blocks is one task, from which the best
    leave. Scores are made and ranked where the texts are, so neither they nor pairs of questions and texts are ever shuffled.
    """
    tmp, id_ = x.tmp, x.id
    n, m = texts.count(), asked.count()
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cb, qb = max(parts, -(-n // TEXT_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    deal = lambda c, count: F.pmod(F.xxhash64(c), F.lit(count)).cast("int")
    tids = tmp.save(x.terms.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    post = x.post.join(tids, "term").groupBy(id_).agg(F.collect_list(F.struct("tid", "part")).alias("ps"))
    weights = x.terms.join(tids, "term").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("tid", "w"))).alias("ws"))
    q = asked if among is not None else asked.withColumn("key", F.lit(None).cast("long"))
    q = q.withColumn("qb", deal("qid", qb)).join(weights, "qid", "left")
    q = tmp.save(q.select("qid", "key", "fan", "qb", F.col("ws.tid").alias("terms"), F.col("ws.w").alias("ws")))
    t = texts.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    if among is not None:
        keys = among.join(q.select("key", "qb").distinct(), "key").groupBy(id_, "qb").agg(F.collect_list("key").alias("keys"))
        t = t.join(keys, [id_, "qb"])
    else:
        t = t.withColumn("keys", F.array().cast("array<bigint>"))
    t = t.join(post, id_, "left").select(F.col(id_).alias("id"), deal(id_, cb).alias("cb"), "qb", F.col("ps.tid").alias("terms"), F.col("ps.part").alias("parts"), "keys")
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cb - 1))))
    hits = t.groupBy("cb", "qb").cogroup(q.groupBy("cb", "qb")).applyInPandas(_best, "qid long, id long, score double")
    # a block gives no more than the fan, so the groups that are ranked are small
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    ranked = hits.join(asked.select("qid", "fan"), "qid").withColumn("rank", F.row_number().over(w)).where("rank <= fan")
    return ranked.select("qid", F.col("id").alias(id_), "score", "rank")


def bm25_topk(spark: SparkSession, base: str, k: int = 10) -> DataFrame:
    return bm25_best(chunks(spark, base), questions(spark, base), k).select("qid", "chunk_id", "score", "rank")


def vectors(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "embeddings").where("embedding is not null")


def _nearest(k: int, metric: str, same_label: bool):
    """The k nearest vectors of every query of a block in one block of vectors."""

    def nearest(vectors_: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"qid": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "distance": pd.Series(dtype="float64")})
        if not len(vectors_) or not len(queries):
            return none
        out = [none]
        ids, x = vectors_["id"].to_numpy(), np.stack(vectors_["v"].to_numpy()).astype(np.float64)
        qid, q = queries["id"].to_numpy(), np.stack(queries["v"].to_numpy()).astype(np.float64)
        lab, want = vectors_["label"].to_numpy(), queries["label"].to_numpy()
        xn, qn = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        for lo in range(0, len(q), 512):
            part = slice(lo, lo + 512)
            best_d = np.full((len(qid[part]), k), np.inf)
            best_i = np.full((len(qid[part]), k), np.iinfo(np.int64).max)
            for at in range(0, len(x), STEP):
                v = slice(at, at + STEP)
                dots = q[part] @ x[v].T
                if metric == "cosine":
                    with np.errstate(divide="ignore", invalid="ignore"):
                        d = 1 - dots / (qn[part][:, None] * xn[v][None, :])
                elif metric == "l2":
                    d = np.sqrt(np.maximum(0, qn[part][:, None] ** 2 + xn[v][None, :] ** 2 - 2 * dots))
                else:
                    d = 1 - dots
                d = np.round(np.nan_to_num(d, nan=np.inf), 6)
                if same_label:
                    d[want[part][:, None] != lab[v][None, :]] = np.inf
                all_d, all_i = np.hstack([best_d, d]), np.hstack([best_i, np.broadcast_to(ids[v], d.shape)])
                order = np.lexsort((all_i, all_d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
            ok = np.isfinite(best_d)
            out.append(pd.DataFrame({"qid": np.repeat(qid[part], k).reshape(ok.shape)[ok], "vec_id": best_i[ok], "distance": best_d[ok]}))
        return pd.concat(out)

    return nearest


def vector_search(data: DataFrame, asked: DataFrame, k: int, metric: str = "cosine", same_label: bool = False) -> DataFrame:
    """asked and data: vec_id, embedding, label. The exact k nearest of every query, all against all.

    Vectors are dealt to blocks of about VECTOR_BLOCK, queries to blocks of about QUERY_BLOCK; every pair of blocks is one
    task. A vector travels once for each block of queries, a query once for each block of vectors.
    """
    n, m = data.count(), asked.count()
    parts = int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vb, qb = max(parts, -(-n // VECTOR_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    own = lambda df: df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("label"))
    deal = lambda count: F.pmod(F.xxhash64("id"), F.lit(count))
    v = own(data).withColumn("vb", deal(vb)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    q = own(asked).withColumn("qb", deal(qb).cast("int")).withColumn("vb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(vb - 1).cast("long"))))
    hits = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInPandas(_nearest(k, metric, same_label), "qid long, vec_id long, distance double")
    return topk_per_group(hits, ["qid"], [F.asc("distance"), F.asc("vec_id")], k)


def asked_vectors(spark: SparkSession, base: str) -> DataFrame:
    return vectors(spark, base).where("vec_id % 100 = 0")


def _top(metric: str, same_label: bool = False):
    def query(spark: SparkSession, base: str) -> DataFrame:
        return vector_search(vectors(spark, base), asked_vectors(spark, base), 10, metric, same_label).select("qid", "vec_id", "distance", "rank")

    return query


cosine_topk, l2_topk, ip_topk, filtered_topk = _top("cosine"), _top("l2"), _top("ip"), _top("cosine", True)


def paired_questions(spark: SparkSession, base: str) -> DataFrame:
    """The hybrid questions: the title of every requirement whose chunk_id is divisible by 100; its vector is that of its id."""
    c = table(spark, base, "requirements").where("req_id is not null").groupBy("req_id").agg(F.min("rec_id").alias("chunk_id"), F.min_by("title", "rec_id").alias("title"))
    return c.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("qid"), F.col("title").alias("question"))


def ranked_lists(spark: SparkSession, base: str, fan: int = 30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, dense list, BM25 list): qid, chunk_id, score or distance, rank."""
    q = Scratch(spark).save(paired_questions(spark, base))
    v = vectors(spark, base)
    dense = vector_search(v, v.join(q.select(F.col("qid").alias("vec_id")), "vec_id", "left_semi"), fan).select("qid", F.col("vec_id").alias("chunk_id"), "distance", "rank")
    sparse = bm25_best(chunks(spark, base), q, fan)
    return q, dense, sparse


def fused(spark: SparkSession, base: str, weight: float = 0.5) -> DataFrame:
    """Reciprocal rank fusion of both lists (ties: the list and rank that had the chunk first)."""
    _, dense, sparse = ranked_lists(spark, base)
    f = rrf_fuse([dense, sparse], ["qid"], "chunk_id", k=RRF_K, weights=[1.0, weight]).withColumn("fused", F.round("fused", 9))
    top = topk_per_group(f, ["qid"], [F.desc("fused"), F.asc("first_list"), F.asc("first_rank")], 20).select("qid", "chunk_id", "fused", "rank")
    return Scratch(spark).save(top)  # later stages read it more than once


def diversity(ranked: DataFrame, k: int, plan: str = "plan_id") -> DataFrame:
    """At least one of each plan first (in order of rank), then filled by rank up to k; ordered by rank again."""
    per = Window.partitionBy("qid", plan).orderBy("rank")
    first = F.row_number().over(per) == 1
    w = Window.partitionBy("qid").orderBy(F.desc("first"), "rank")
    picked = ranked.withColumn("first", first).withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)
    return picked.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).drop("first", "pick")


def diverse(spark: SparkSession, base: str) -> DataFrame:
    plans = table(spark, base, "requirements").where("req_id is not null").groupBy("req_id").agg(F.min("rec_id").alias("chunk_id"), F.min_by("plan_id", "rec_id").alias("plan_id"))
    f = fused(spark, base).join(plans.select("chunk_id", "plan_id"), "chunk_id")
    # vectors without a requirement are no chunks: ranks close up first
    f = f.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return diversity(f, 10).select("qid", "chunk_id", "plan_id", "rank")


def hybrid(spark: SparkSession, base: str) -> DataFrame:
    """The whole retrieval: lists, fusion, diversity, pinned glossary chunk first, cut at k.

    A glossary chunk is pinned where the question names a catalogued spec title's first word.
    """
    d = diverse(spark, base)
    q = paired_questions(spark, base)
    pins = q.join(glossary_words(spark, base), F.lower(F.substring_index("question", " ", 1)) == F.col("word")).groupBy("qid").agg(F.min("chunk").alias("chunk"))
    pinned = pins.select("qid", F.col("chunk").alias("chunk"), F.lit(0).alias("rank"), F.lit(True).alias("pinned"))
    c = d.select("qid", F.concat(F.lit("req:"), "chunk_id").alias("chunk"), "rank", F.lit(False).alias("pinned"))
    return topk_per_group(pinned.unionByName(c), ["qid"], [F.asc("rank")], 10, "final_rank").select("qid", "chunk", "pinned", "final_rank")


def glossary_words(spark: SparkSession, base: str) -> DataFrame:
    c = table(spark, base, "spec_catalog").where("title is not null")
    return c.groupBy(F.lower(F.substring_index("title", " ", 1)).alias("word")).agg(F.min(F.concat(F.lit("glossary:specs:"), tx.slug(F.col("spec")))).alias("chunk"))


def threshold(spark: SparkSession, base: str, t: float = THRESHOLD) -> DataFrame:
    """Answers within the distance; questions with none get one not-found row."""
    hits = vector_search(vectors(spark, base), asked_vectors(spark, base), 5).where((F.col("distance") <= t) & (F.col("qid") != F.col("vec_id")))
    q = asked_vectors(spark, base).select(F.col("vec_id").alias("qid"))
    return q.join(hits, "qid", "left").select("qid", "vec_id", "distance", F.when(F.col("vec_id").isNull(), "not_found").otherwise("found").alias("outcome"))


def rerank_stable(spark: SparkSession, base: str) -> DataFrame:
    """A scorer's order with the prior rank breaking ties: here the share of question terms in the chunk, in tenths."""
    q, _, sparse = ranked_lists(spark, base)
    c = chunks(spark, base)
    j = sparse.join(q, "qid").join(c.select("chunk_id", "text"), "chunk_id")
    terms = F.array_distinct(tx.tokenize(F.col("question")))
    share = F.floor(F.size(F.array_intersect(terms, tx.tokenize(F.col("text")))) * 10 / F.greatest(F.size(terms), F.lit(1)))
    j = j.select("qid", "chunk_id", F.col("rank").alias("prior_rank"), share.cast("long").alias("pair_score"))
    return topk_per_group(j, ["qid"], [F.desc("pair_score"), F.asc("prior_rank")], 10)


def context(spark: SparkSession, base: str, limit: int = 30000) -> DataFrame:
    """Numbered context text of each question, cut at the limit with a note."""
    d = diverse(spark, base).join(chunks(spark, base).select("chunk_id", "req_id", "text"), "chunk_id")
    part = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "req_id", F.lit("\n"), "text")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))), lambda x: x["t"]), "\n\n")
    g = d.groupBy("qid").agg(whole.alias("whole"))
    return g.select("qid", F.when(F.length("whole") > limit, F.concat(F.substring("whole", 1, limit), F.lit("\n\n[Context truncated]"))).otherwise(F.col("whole")).alias("context"))


def enrich(spark: SparkSession, base: str) -> DataFrame:
    """Each retrieved chunk with its parent's title and the number of its standards and dependencies (four left joins)."""
    from reqloom.operators import graph as g

    tmp = Scratch(spark)
    e = tmp.save(g.edges(spark, base))
    d = diverse(spark, base).join(chunks(spark, base).select("chunk_id", "req_id"), "chunk_id").withColumn("id", F.concat(F.lit("req:"), "req_id"))
    names = g.requirement_rows(spark, base).select(F.concat(F.lit("req:"), "req_id").alias("up"), F.col("title").alias("parent_title"))
    parent = e.where("edge_type = 'parent_of'").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("up"))
    std = e.where("edge_type = 'references_standard'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_standards"))
    dep = e.where("edge_type = 'depends_on'").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n_depends"))
    j = d.join(parent, "id", "left").join(names, "up", "left").join(std, "id", "left").join(dep, "id", "left")
    return j.select("qid", "chunk_id", "rank", "parent_title", F.coalesce("n_standards", F.lit(0)).alias("n_standards"), F.coalesce("n_depends", F.lit(0)).alias("n_depends"))


def tokens(spark: SparkSession, base: str) -> DataFrame:
    """Document frequency and total count of every token of the chunks."""
    return postings(chunks(spark, base), "chunk_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def fingerprint(spark: SparkSession, base: str) -> DataFrame:
    """Per plan: chunks, and the first 16 hex digits of the hash of its sorted chunk ids."""
    c = chunks(spark, base)
    # sha256 of a list needs the list: a plan's ids are hashed by ranges of 10,000 ids in order, then the hashes; a range is a
    # group of its own, so a plan with a third of all chunks is many
    parts = c.select("plan_id", "chunk_id", F.expr("chunk_id div 10000").alias("block")).groupBy("plan_id", "block").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.lpad(F.col("chunk_id").cast("string"), 12, "0"))), "\n"), 256).alias("h"), F.count("*").alias("n"))
    return parts.groupBy("plan_id").agg(F.sum("n").alias("n_chunks"), F.left(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), "\n"), 256), F.lit(16)).alias("fingerprint"))


def similar_labels(spark: SparkSession, base: str) -> DataFrame:
    """Mean vector of each label, normalised, and its distance to the overall mean vector (aggregates per dimension)."""
    v = vectors(spark, base).select("label", F.posexplode("embedding").alias("i", "x"))
    m = v.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    al = v.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("y"))
    j = m.join(al, "i").groupBy("label").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return j.select("label", F.round(1 - F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), 6).alias("distance"))
