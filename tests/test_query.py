"""BM25 in a grid of blocks, and work that questions of one group share."""

import os
import random

import pytest

from reqloom.operators import query as Q
from reqloom.operators import retrieval as R
from tests.test_functions import brute_bm25

BASE = "/root/testdata/sf0.001"


def test_bm25_grid_ranks_among_the_texts_of_a_key(spark, monkeypatch):
    monkeypatch.setattr(R, "TEXT_BLOCK", 11)
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 20))) + (" the" if i % 10 else "")) for i in range(60)]
    asked = [(q, " ".join(rnd.choice(words) for _ in range(3)) + " the", q % 3, 2 + q) for q in range(10)] + [(99, "nothing known", 1, 4)]
    mine = {k: [i for i, _ in docs if i % (k + 2) == 0] for k in range(2)}  # key 2 has no texts
    d, a = spark.createDataFrame(docs, "chunk_id long, text string"), spark.createDataFrame(asked, "qid long, question string, key long, fan int")
    among = spark.createDataFrame([(k, i) for k, ids in mine.items() for i in ids], "key long, chunk_id long")
    x = R.Bm25(d, a, "chunk_id", "text", R.K1, R.B, R.EPSILON)
    got = {}
    for r in R.bm25_grid(x, d.select("chunk_id"), a.select("qid", "key", "fan"), among).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.chunk_id, r.score))
    every = brute_bm25(docs, [(q, t) for q, t, _, _ in asked], len(docs))
    for q, _, key, fan in asked:
        want = [(i, s) for i, s in every[q] if i in mine.get(key, ())][:fan]
        assert [i for i, _ in got.get(q, [])] == [i for i, _ in want]
        assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in want], abs=2e-6)


@pytest.mark.skipif(not os.path.isdir(BASE), reason="no test tables")
def test_alike_questions_share_candidates(spark):
    plan = spark.read.parquet(f"{BASE}/requirements.parquet").where("req_id is not null and mno is not null").groupBy("mno", "release", "plan_id").count().orderBy("count", "plan_id").tail(1)[0]
    text = f"What does the {plan.plan_id} plan of {plan.mno} {plan.release} say about "
    asked = [(100 + n, text + ("roaming timer", "attach procedure", "the highest power")[n % 3]) for n in range(6)] + [(200, None)]
    b = Q.Batch(spark, BASE, spark.createDataFrame(asked, "qid long, question string"))
    assert b.intents.count() == 6
    groups = {r.qid: r.gid for r in b.groups.collect()}
    pop = {(r.gid, r.chunk_id) for r in b.population.where("scoped").collect()}
    assert len(set(groups.values())) <= 3 and {g for g, _ in pop} == set(groups.values())  # once for a group, not for each question
    every = {}
    for r in b.sparse.collect():
        every.setdefault(r.qid, set()).add((r.chunk_id, r.score, r.rank))
    assert set(every) == set(groups) and all(every[q] == every[q + 3] for q in (100, 101, 102))
    assert all(len(rows) == min(30, len({c for g, c in pop if g == groups[q]})) for q, rows in every.items())
