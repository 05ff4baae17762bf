import random

import pytest

from reqloom.operators.components import components


def brute(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for v in sorted(near):
        if v in out:
            continue
        todo = [v]
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = v
                todo += near[x]
    return out


def run(spark, edges):
    df = spark.createDataFrame(edges, "src long, dst long, component string")
    return {r.node: r.component for r in components(df).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(300), rnd.randrange(300), "x") for _ in range(190)] + [(5, 5, "x"), (None, 4, "x"), (901, 901, "x"), (7, 5, "x"), (5, 7, "x")]
    assert run(spark, edges) == brute([e[:2] for e in edges])


def test_chains_and_hubs(spark):
    chain = [(i, i + 1, "x") for i in range(1000, 1130)]
    back = [(2000 - i, 1999 - i, "x") for i in range(60)]
    hub = [(3000, 3001 + i, "x") for i in range(400)]
    edges = chain + back + hub
    assert run(spark, edges) == brute([e[:2] for e in edges])
    assert run(spark, []) == {}
