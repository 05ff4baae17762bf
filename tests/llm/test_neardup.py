import itertools
import random
import re

import pytest

from reqloom.llm import neardup as N
from reqloom.sources.tables import Scratch

VOCAB = [f"w{i}" for i in range(400)]


def grams(title, text):
    w = [x.lower() for x in re.findall("[A-Za-z0-9]+", f"{title or ''} {text}")]
    return set(zip(w, w[1:], w[2:], strict=False))


def brute(rows, t=0.6, least=25):
    docs = {}
    for k, title, text in rows:
        if k and text and len(re.findall("[A-Za-z0-9]+", text)) >= least:
            docs[k] = grams(title, text)
    return {(a, b) for a, b in itertools.combinations(sorted(docs), 2) if len(docs[a] & docs[b]) >= t * len(docs[a] | docs[b])}


def run(spark, rows, tmp_path):
    spark.createDataFrame(rows, "req_id string, title string, text string").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/requirements.parquet")
    base = str(tmp_path)
    return {(r.req_id_a, r.req_id_b) for r in N.p2_found(spark, base).collect()}, N.p2_groups(spark, base).collect()


def collection(n, edits, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rnd.choice(VOCAB) for _ in range(60)]
        rows.append((f"r{i:04d}", f"t {i % 7}", " ".join(words)))
        for e in range(rnd.choice(edits)):
            w = list(words)
            for _ in range(rnd.randint(0, 6)):
                k = rnd.randrange(len(w))
                rnd.choice([lambda: w.insert(k, rnd.choice(VOCAB)), lambda: w.pop(k), lambda: w.__setitem__(k, rnd.choice(VOCAB))])()
            rows.append((f"r{i:04d}e{e}", f"t {i % 7}", " ".join(w)))
    return rows


def test_against_brute_force(spark, tmp_path):
    rows = collection(80, [0, 1, 3])
    rows += [("dup1", "A", rows[0][2]), ("dup2", "A", rows[0][2]), ("dup2", "A", rows[0][2])]
    rows += [("n1", None, None), (None, "x", rows[1][2]), ("short", "x", "too few words"), ("empty", "", "")]
    got, groups = run(spark, rows, tmp_path)
    want = brute(rows)
    assert got == want and want
    by = {g.req_id: g for g in groups}
    assert by["dup1"].group_id == by["dup2"].group_id and all(by[a].group_id == by[b].group_id for a, b in want)
    links = {k: sum(k in p for p in want) for k in by}
    assert {k: g.links for k, g in by.items()} == links
    assert "short" not in by and "n1" not in by


def test_crowded_region_loses_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "CROWD", 8)
    rnd = random.Random(3)
    base = [rnd.choice(VOCAB) for _ in range(200)]
    rows = []
    for i in range(60):
        w = list(base)
        w[rnd.randrange(200)] = f"edit{i}"
        rows.append((f"c{i:03d}", "same title", " ".join(w)))
    got, _ = run(spark, rows, tmp_path)
    assert got == brute(rows) and len(got) == 60 * 59 // 2


def test_empty(spark, tmp_path):
    got, groups = run(spark, [("a", "t", "short")], tmp_path)
    assert got == set() and groups == []


def test_unicode_lower_case_stays_out_of_words(spark, tmp_path):
    text = " ".join(f"Word{i}" for i in range(30))
    rows = [("k1", "Kelvin K", text), ("k2", "Kelvin", text)]
    got, _ = run(spark, rows, tmp_path)
    assert got == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_short_sets(n):
    assert len(N.shingles([b"a", b"b"], n, {})) == max(0, 2 - n + 1)


def test_recall_figure():
    for threshold in (0.3, 0.4, 0.5, 0.6, 0.8, 1.0):
        for depth in range(N.BASE, N.DEPTH + 1):
            n = N.orders(depth, threshold)
            assert (1 - threshold**depth) ** n <= N.MISS and len(N.factors(n)[0]) == n
    with pytest.raises(ValueError):
        N.orders(3, 0)
    assert Scratch is not None


@pytest.mark.parametrize("threshold", [0.4, 0.5, 0.8])
def test_other_thresholds_lose_nothing(spark, threshold):
    rows = collection(60, [1, 2, 3], seed=11)
    docs = spark.createDataFrame(rows, "key string, title string, text string")
    members, pairs = N.similar_classes(Scratch(spark), docs, 3, threshold, 25)
    of = {}
    for r in members.collect():
        of.setdefault((r.id, r.id2), []).append(r.key)
    got = {(min(x, y), max(x, y)) for r in pairs.collect() for x in of[(r.a, r.a2)] for y in of[(r.b, r.b2)]}
    got |= {(x, y) for ks in of.values() for x in ks for y in ks if x < y}
    want = brute(rows, threshold)
    assert got <= want and len(want - got) <= 0.01 * len(want)


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_regions_across_partitions(spark, partitions, monkeypatch):
    """Neighbours are found wherever the borders of the sorted orders lie: with few rows each partition cuts many regions."""
    monkeypatch.setattr(N, "CROWD", 16)
    rnd = random.Random(2)
    rows = []
    for r in range(40):  # 40 regions of 1 to 30 records, 10 of them crowded, and rows that share a prefix only
        for i in range(rnd.choice([1, 2, 5, 12, 30])):
            rows.append((r, (rnd.randrange(3) << 47) | (rnd.randrange(3) << 32) | 50, r * 1000 + i))
    df = spark.createDataFrame(rows, "k long, t long, id long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs, crowded, _ = N._candidates(Scratch(spark), df, 3, 0.6)
        pairs = {(min(p), max(p)) for p in map(tuple, pairs.collect())}
        crowded = {tuple(r) for r in crowded.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = {}
    for k, _, i in rows:
        sizes.setdefault(k, []).append(i)
    small = {(a, b) for ids in sizes.values() if len(ids) <= 16 for a, b in itertools.combinations(sorted(ids), 2)}
    assert small <= pairs
    needs = {}
    for i, need in crowded:
        needs.setdefault(i // 1000, {}).setdefault(need, set()).add(i)
    # all records of a crowded region meet at one depth
    assert all(any(x == set(sizes[k]) for x in needs[k].values()) for k, ids in sizes.items() if len(ids) > 16)
    assert all(len(sizes[k]) > 16 for k in needs)

def test_crowded_region_keeps_pairs_at_the_threshold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(N, "CROWD", 8)
    rnd = random.Random(9)
    base = [rnd.choice(VOCAB) for _ in range(120)]
    rows = []
    for i in range(70):  # one boilerplate, each with enough words of its own that pairs lie around 0.6
        w = list(base)
        for _ in range(rnd.randint(4, 12)):
            w[rnd.randrange(120)] = f"own{rnd.randrange(4000)}"
        rows.append((f"c{i:03d}", "same title", " ".join(w)))
    got, _ = run(spark, rows, tmp_path)
    want = brute(rows)
    assert 300 < len(want) < 70 * 69 // 2 - 300
    assert got <= want and len(want - got) <= 0.005 * len(want)


def variants(n=40, seed=5):
    """Each key has a null text, a text of its own and one near to that of its partner."""
    rnd = random.Random(seed)
    text = lambda: [rnd.choice(VOCAB) for _ in range(60)]
    rows, want = [], set()
    for i in range(n):
        a, b = f"a{i:03d}", f"b{i:03d}"
        near = text()
        twin = [*near[:-1], "other"]
        for key, words in ((a, near), (b, twin)):
            both = [(key, "t", " ".join(words)), (key, "t", " ".join(text()))]
            rows += [(key, "t", None), *(both if rnd.random() < 0.5 else both[::-1])]
        want.add((a, b))
    return rows, want


@pytest.mark.parametrize("crowd", [128, 4])
def test_a_key_with_several_texts_keeps_its_links(spark, tmp_path, monkeypatch, crowd):
    rows, want = variants()
    if crowd < 128:
        rows += [(f"c{i:02d}", "t", rows[1][2] + f" end{i}") for i in range(12)]
        want = None
    monkeypatch.setattr(N, "CROWD", crowd)
    got, _ = run(spark, rows, tmp_path)
    if want is None:
        sets = [(k, grams(t, x)) for k, t, x in rows if x]
        want = {(min(a, b), max(a, b)) for (a, x), (b, y) in itertools.combinations(sets, 2) if a != b and len(x & y) >= 0.6 * len(x | y)}
    assert got == want
