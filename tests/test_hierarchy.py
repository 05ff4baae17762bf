import random

from reqloom.operators.components import components
from reqloom.operators.hierarchy import hierarchy

NODES = "tree string, name string, id string, parent string, size int, pre int, head string"


def run(spark, nodes):
    df = spark.createDataFrame([("t", str(n), str(n), None if p is None else str(p), 0, 0, "h") for n, p in nodes], NODES)
    return {r.name: r for r in hierarchy(spark, df).collect()}


def check(spark, nodes):
    parent = {}
    for n, p in nodes:
        parent.setdefault(str(n), None if p is None else str(p))
    got = run(spark, nodes)
    assert set(got) == set(parent)
    kids = {n: set() for n in parent}
    path = {}
    for n in parent:
        seen, x = [], n
        while x is not None and x not in seen and x in parent:
            seen.append(x)
            x = parent[x]
        if x is not None and x in seen:
            assert got[n].state == ("cycle" if x == n else "into_cycle") and got[n].depth is None and got[n].path is None, n
        else:
            path[n] = seen[::-1]
    for n, p in path.items():
        r = got[n]
        assert r.path == p and r.depth == len(p) - 1 and r.root == p[0]
        assert r.state == ("no_parent" if parent[n] is not None and parent[n] not in parent else None)
        for a in p[:-1]:
            kids[a].add(n)
    by_root = {}
    for n in path:
        by_root.setdefault(path[n][0], []).append(n)
        assert got[n].subtree_size == len(kids[n]) + 1
    for ns in by_root.values():
        assert sorted(got[n].pre for n in ns) == list(range(len(ns)))
        for n in ns:
            assert {m for m in ns if got[n].pre < got[m].pre <= got[n].last} == kids[n]
    return got


def test_shapes(spark):
    check(spark, [(1, None)])
    check(spark, [(i, i - 1 if i else None) for i in range(70)])  # a path
    check(spark, [(0, None)] + [(i, 0) for i in range(1, 60)])  # a star
    check(spark, [(1, 1), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99), (7, 6)])  # cycles, tails, no parent
    check(spark, [(1, 2), (2, 3), (3, 1)])  # nothing but a cycle
    assert hierarchy(spark, spark.createDataFrame([], NODES)).count() == 0


def test_random_forests(spark):
    rnd = random.Random(2)
    nodes = []
    for i in range(400):
        nodes.append((i, rnd.choice([None, rnd.randrange(max(0, i - 6), i + 1), rnd.randrange(400), 1000 + i % 3]) if i else None))
    check(spark, nodes)
    nodes = [(i, None if i == 0 else rnd.randrange(max(0, i - 3), i)) for i in range(300)]
    check(spark, nodes + nodes[:50])  # repeated rows


def test_star_with_many_buckets(spark, monkeypatch):
    from reqloom.operators import hierarchy as h

    monkeypatch.setattr(h, "SIBLINGS", 7)
    check(spark, [(0, None)] + [(i, 0) for i in range(1, 90)] + [(i, i - 89) for i in range(90, 120)])


def test_components(spark):
    rnd = random.Random(7)
    edges = [(str(rnd.randrange(300)), str(rnd.randrange(300))) for _ in range(200)] + [(str(1000 + i), str(1001 + i)) for i in range(40)] + [("5", "5"), (None, "7"), ("hub", None)]
    edges += [("hub", str(i)) for i in range(0, 300, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges + edges[:20], "src string, dst string")).collect()}
    want = {}
    for n in up:
        want.setdefault(find(n), []).append(n)
    assert got == {n: min(ns) for ns in want.values() for n in ns}
    assert components(spark.createDataFrame([], "src string, dst string")).count() == 0
