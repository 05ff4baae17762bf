import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from reqloom.functions import plugins as G
from reqloom.functions import text as X
from reqloom.operators import layout as Y
from reqloom.operators import patterns as P
from reqloom.operators import retrieval as R


def one(spark, col, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for x in v]))
    return df.select(col).first()[0]


def test_text_functions(spark):
    c = F.col("c")
    assert one(spark, X.tokenize(c), c="The NV_REQ_A_1, TS 24.301 a Rel-9") == ["the", "nv_req_a_1", "ts", "24.301", "rel-9"]
    assert one(spark, X.applicability_labels(c), c="Phone, tablet;PHONE | watch and car") == ["Phone", "tablet", "watch", "car"]
    assert one(spark, X.version_code(c), c="11.7.0") == "b70" and one(spark, X.code_version(c), c="b70") == "11.7.0"
    assert [one(spark, X.release_number(c), c=v) for v in ("Release 15", "rel-9", " 12 ", "none", "")] == [15, 9, 12, 0, 0]
    assert one(spark, X.clean_spec_number(c), c="3GPP TS 24.301.") == "24.301"
    assert one(spark, X.slug(c), c="a b/c!") == "a_b_c" and one(spark, X.slug(c), c="!!") == "term"
    assert one(spark, X.parent_section(c), c="1.2.3") == "1.2" and one(spark, X.parent_section(c), c="1") is None
    assert one(spark, X.section_prefixes(c), c="1.2.3") == ["1", "1.2", "1.2.3"]
    assert one(spark, X.strip_headers(c), c="[a]\n[b] x\nbody") == "body"
    assert one(spark, X.truncate_note(c), c="word " * 20).endswith("…") and one(spark, X.truncate_note(c), c="short") == "short"
    assert one(spark, X.plan_of_req(c), c="NV_REQ_ABC_1") == "ABC" and one(spark, X.plan_of_req(c), c="x") is None
    assert one(spark, X.canonicalize_req_id(c), c=" NV  REQ ") == "NV_REQ"


def test_markdown(spark):
    h, r = F.col("h"), F.col("r")
    assert one(spark, X.markdown_table(h, r), h=["A", "B"], r=[["1", ""], ["2", "3"]]) == "| A | B |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"
    assert one(spark, X.markdown_table(h, r), h=[" ", ""], r=[["a", "b"]]) == "[Table: a | b]"
    assert one(spark, X.row_text(h, F.col("r")[0]), h=["A", ""], r=[["1", "2"]]) == "A: 1; 2"
    df = spark.createDataFrame([(["A"], [["1", "x"], []]), (["A"], []), (["A"], None), ([], [["z", None]])], "h array<string>, r array<array<string>>")
    assert [x[0] for x in df.select(X.markdown_table(h, r)).collect()] == ["| A |\n| --- |\n| 1 |\n|  |", None, None, "| z |  |"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    got = df.select(X.l2_normalize(a), X.l2_distance(a, b), X.inner_product_distance(a, b), X.dot(a, b)).collect()
    assert got[0][0] == pytest.approx([0.6, 0.8]) and got[1][0] == [0.0, 0.0]
    assert got[0][1] == pytest.approx(math.sqrt(2)) and got[0][2] == -23 and got[0][3] == 24


def test_patterns(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("b", 7.0), ("c", None)], "k string, v double")
    assert {r.k: r.p95 for r in P.p95_floor(df, ["k"], "v").collect()} == {"a": 3.0, "b": 7.0, "c": None}
    idx = spark.createDataFrame([("d", i) for i in (1, 2, 3, 7, 8, 10)], "k string, i int")
    assert sorted((r["first"], r["last"], r.n) for r in P.gaps_islands(idx, ["k"], "i").collect()) == [(1, 3, 3), (7, 8, 2), (10, 10, 1)]
    m = spark.createDataFrame([("x", 5, 3), ("x", 6, 1), ("x", 5, 4), ("x", 6, 2)], "k string, v int, o int")
    assert P.mode_first(m, ["k"], "v", "o").first().v == 6
    one_, two = (spark.createDataFrame(r, "q int, id int, rank int") for r in ([(1, 10, 1), (1, 11, 2)], [(1, 12, 1), (1, 11, 2)]))
    f = {r.id: r.fused for r in P.rrf_fuse([one_, two], ["q"], "id").collect()}
    assert f[11] == pytest.approx(2 / 62) and f[10] == pytest.approx(1 / 61) == pytest.approx(f[12])
    with pytest.raises(ValueError):
        P.rrf_fuse([one_], ["q"], "id", weights=[1, 2])


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma"), (3, "alpha delta epsilon"), (4, ""), (5, None)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "beta beta nothing"), (2, "alpha"), (3, None), (4, "")], "qid long, question string")
    got = {(r.qid, r.chunk_id): r.score for r in R.bm25(docs.where("text is not null"), q).collect()}
    lens = [3, 2, 3, 0]
    avg = sum(lens) / 4
    idf = {t: math.log((4 - n + 0.5) / (n + 0.5)) for t, n in {"alpha": 3, "beta": 1, "gamma": 1, "delta": 1, "epsilon": 1}.items()}
    mean = sum(idf.values()) / 5
    part = lambda w, tf, dl: w * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got[(1, 1)] == pytest.approx(2 * part(idf["beta"], 2, 3)) and (1, 2) not in got
    assert got[(2, 2)] == pytest.approx(part(0.25 * mean, 1, 2)) and len(got) == 4


def test_vector_search_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 8))
    v[7] = 0
    v[9] = v[3]
    df = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(v)], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    got = R.vector_search(df, df.where("vec_id < 10"), 5).collect()
    x = np.float32(v).astype(float)
    for q in range(10):
        mine = [(r.vec_id, r.distance) for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)]
        with np.errstate(invalid="ignore", divide="ignore"):
            d = np.round(1 - x @ x[q] / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])), 6)
        want = sorted((i for i in range(50) if np.isfinite(d[i])), key=lambda i: (d[i], i))[:5]
        assert [m[0] for m in mine] == want
    assert R.vector_search(df, df.limit(0), 5).count() == 0


def test_diversity(spark):
    rows = [(1, i, p, i + 1) for i, p in enumerate("aaaabbc")]
    df = spark.createDataFrame(rows, "qid int, chunk_id int, plan_id string, rank int")
    got = [(r.chunk_id, r.rank) for r in R.diversity(df, 4).orderBy("rank").collect()]
    assert got == [(0, 1), (1, 2), (4, 3), (6, 4)]


def test_bfs(spark):
    from reqloom.operators.graph import bounded_bfs

    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), ("a", "e", "y"), ("c", "a", "x")], "src string, dst string, edge_type string")
    s = spark.createDataFrame([("a", "a")], "seed string, id string")
    assert {r.id: r.depth for r in bounded_bfs(e, s, 2, ["x"]).collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}
    assert {r.id: r.depth for r in bounded_bfs(e, s, 0).collect()} == {"a": 0}


def test_layout(spark):
    cols = "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double, page_h double"
    b = spark.createDataFrame([("d", p, f"Page {p}", 0.0, 10.0, 50.0, 20.0, 800.0) for p in (1, 2, 3)] + [("d", 1, "body", 0.0, 100.0, 90.0, 120.0, 800.0), ("d", 2, "once", 0.0, 10.0, 9.0, 20.0, 800.0), ("d", 1, "cell", 100.0, 200.0, 150.0, 210.0, 800.0)], cols)
    assert {r.text for r in Y.without_margins(b).collect()} == {"body", "cell"}
    assert {r.text for r in Y.without_running_lines(b).collect()} == {"body", "once", "cell"}
    t = spark.createDataFrame([("d", 1, 0, 90.0, 190.0, 200.0, 300.0)], "doc_id string, page int, table_no int, x0 double, y0 double, x1 double, y1 double")
    assert "cell" not in {r.text for r in Y.without_table_text(b, t).collect()}
    lines = spark.createDataFrame([("d", 1, 90.0, 205.0, 190.0, 205.5), ("d", 1, 90.0, 250.0, 93.0, 250.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    lines = Y.strike_lines(lines)
    assert lines.count() == 1
    rows = spark.createDataFrame([("d", 1, 0, 0, 90.0, 200.0, 200.0, 210.0), ("d", 1, 0, 1, 90.0, 205.0, 200.0, 220.0)], "doc_id string, page int, table_no int, row_no int, x0 double, y0 double, x1 double, y1 double")
    assert [r.row_no for r in Y.struck_rows(rows, lines).collect()] == [0]
    assert {r.text for r in Y.struck_spans(b, lines).collect()} == {"cell"}
    assert Y.struck_tables(t, lines, rows).count() == 0 and Y.struck_tables(t, lines, rows.limit(1)).count() == 1
    s = spark.createDataFrame([("d", 0, "ab", True), ("d", 0, "cd", False), ("d", 1, "abc", True), ("d", 1, "d", False)], "doc_id string, idx int, text string, struck boolean")
    assert {r.idx: r.struck for r in Y.struck_by_characters(s).collect()} == {0: False, 1: True}


def test_plugins(spark):
    df = spark.createDataFrame([("a b a",), ("",), (None,)], "t string")
    v = [r[0] for r in df.select(G.embedding_column()("t")).collect()]
    assert len(v[0]) == 64 and sum(x * x for x in v[0]) == pytest.approx(1) and not any(v[1])
    assert [r[0] for r in df.select(G.completion_column()(F.concat(F.lit("x\n"), F.coalesce("t", F.lit("n"))))).collect()] == ["a b a", "x", "n"]
    assert df.select(G.score_column()(F.lit("aa bb"), F.lit("bb cc"))).first()[0] == 0.5
    assert G.parse_rewrites('1. "one"\n- two\n\nthree\nfour') == ["one", "two", "three"] and G.expand_query("q", ["a"]) == "q | a"
    assert G.json_answer('text ```json\n{"a": [1]}\n``` rest') == {"a": [1]} and G.json_answer("none") is None
    assert G.runaway("abc" * 12) and not G.runaway("abc" * 5) and not G.runaway(None)


def test_metrics_filter(spark):
    from reqloom.operators.ops import filtered

    df = spark.createDataFrame([(1, dt.datetime(2025, 1, 1), "a", "x"), (2, dt.datetime(2025, 1, 2), "a", "y"), (3, dt.datetime(2025, 1, 3), "b", "x")], "id long, ts timestamp_ntz, category string, name string")
    assert [r.id for r in filtered(df, category="a", limit=1).collect()] == [2]
    assert {r.id for r in filtered(df, name="x", since=dt.datetime(2025, 1, 2)).collect()} == {3} and filtered(df).count() == 3


def test_embedder_reads_whole_texts():
    long = "alpha " * 5000 + "omega"
    whole, cut = G.hash_embedder()([long])[0], G.hash_embedder(chars=8000)([long])[0]
    assert whole != cut and cut == G.hash_embedder()(["alpha " * 1333])[0]


def brute_bm25(docs, asked, k):
    import re
    from collections import Counter

    tok = lambda s: [x for x in re.findall(r"[a-z0-9_.\-]+", s.lower()) if len(x) > 1]
    ts = {i: Counter(tok(t)) for i, t in docs}
    df = Counter(w for c in ts.values() for w in c)
    n, avg = len(docs), sum(sum(c.values()) for c in ts.values()) / len(docs)
    idf = {w: math.log((n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    out = {}
    for q, text in asked:
        if not tok(text):
            out[q] = []
            continue
        s = {i: round(sum(idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in tok(text)), 6) for i, c in ts.items()}
        out[q] = [(i, s[i]) for i in sorted(s, key=lambda i: (-s[i], i))[:k]]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bm25_bounds_change_nothing(spark, seed, monkeypatch):
    """The best by bounds are those of scoring everything, also with words that most texts have and texts that share none."""
    import random

    monkeypatch.setattr(R, "DIRECT", 10**9 if seed == 3 else -1)
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rnd.choice(words[: rnd.choice([3, 10, 60])]) for _ in range(rnd.randint(0, 30))) + (" the" if i % 10 else "")) for i in range(120)]
    asked = [(q, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 5))) + " the") for q in range(15)] + [(99, "nothing known"), (98, "")]
    d, a = spark.createDataFrame(docs, "chunk_id long, text string"), spark.createDataFrame(asked, "qid long, question string")
    for k in (1, 5, 200):
        got = {}
        for r in R.bm25_best(d, a, k).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((r.chunk_id, r.score))
        want = brute_bm25(docs, asked, k)
        for q, rows in want.items():
            assert [s for _, s in got.get(q, [])] == pytest.approx([s for _, s in rows], abs=2e-6), (q, k)
            assert not rows or {i for i, _ in got[q]} == {i for i, _ in rows} or rows[-1][1] in [s for _, s in rows[:-1]] or k == 1


def test_vector_search_over_many_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "VECTOR_BLOCK", 20)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 8)).astype(np.float32)
    x[3] = 0
    df = spark.createDataFrame([(i, x[i].tolist(), i % 3) for i in range(150)], "vec_id long, embedding array<float>, label int")
    asked = df.where("vec_id % 5 = 0")
    for same in (False, True):
        got = {}
        for r in R.vector_search(df, asked, 4, "l2", same).collect():
            got.setdefault(r.qid, []).append((r.rank, r.vec_id))
        for q in range(0, 150, 5):
            d = np.round(np.linalg.norm(x.astype(float) - x[q].astype(float), axis=1), 6)
            if same:
                d[np.arange(150) % 3 != q % 3] = np.inf
            assert [i for _, i in sorted(got[q])] == np.lexsort((np.arange(150), d))[:4].tolist()
    assert R.vector_search(df.limit(0), asked, 4).count() == 0 and R.vector_search(df, asked.limit(0), 4).count() == 0
    plan = R.vector_search(df, asked, 4)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("FlatMapCoGroupsInPandas") == 1


def test_exact_position_of_skewed_groups(spark):
    import random

    from reqloom.operators.ops import exact_position

    rnd = random.Random(6)
    rows = [("hot", rnd.paretovariate(0.4)) for _ in range(4000)] + [("ties", float(rnd.choice([1, 1, 1, 2]))) for _ in range(500)] + [(None, float(i)) for i in range(7)] + [("one", -3.5)] + [("neg", -rnd.paretovariate(0.5)) for _ in range(900)]
    got = {r.k: r.p95 for r in exact_position(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in ("hot", "ties", None, "one", "neg"):
        v = sorted(x for g, x in rows if g == k)
        assert got[k] == v[max(1, int(len(v) * 0.95)) - 1], k


def test_exact_position_does_not_depend_on_reused_exchanges(spark):
    import random

    from reqloom.operators.ops import exact_position

    rnd = random.Random(7)
    rows = [(f"g{g}", rnd.paretovariate(0.5)) for g in range(40) for _ in range(1000)]
    df = spark.createDataFrame(rows, "k string, v double")
    before = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r.k: r.p95 for r in exact_position(df, ["k"], "v").collect()}
    finally:
        spark.conf.set("spark.sql.exchange.reuse", before)
    assert got == {f"g{g}": sorted(x for k, x in rows if k == f"g{g}")[949] for g in range(40)}
