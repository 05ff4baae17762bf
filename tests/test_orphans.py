import datetime as dt
import random

from pyspark.sql import functions as F

from reqloom.functions.keys import canonical_key, spec_key, strip_space
from reqloom.operators import orphans as O

REFS = "kind string, ref_id long, key string, at timestamp_ntz, prefix string, n string"
PARENTS = "kind string, key string, started timestamp_ntz, ended timestamp_ntz, block int"


def t(h):
    return None if h is None else dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)


def run(spark, refs, parents):
    r = spark.createDataFrame([(k, i, key, t(at), "p", "n") for k, i, key, at in refs], REFS)
    p = spark.createDataFrame([(k, key, t(s), t(e), 1) for k, key, s, e in parents], PARENTS)
    return {(x.kind, x.ref_id): x.reason for x in O.orphan_references(r, p).collect()}


def brute(refs, parents):
    out = {}
    for k, i, key, at in refs:
        if key is None:
            continue
        own = [(s, e) for k2, key2, s, e in parents if k2 == k and key2 == key]
        alive = any(s is not None and at is not None and s <= at and (e is None or e > at) for s, e in own)
        if not alive:
            begun = any(s is not None and at is not None and s <= at for s, _ in own)
            out[(k, i)] = "missing" if not own else "deleted" if begun else "late"
    return out


def test_reasons(spark):
    parents = [("a", "x_1", 0, None), ("a", "x_2", 0, 10), ("a", "x_2", 20, None), ("a", "x_3", 30, None), ("b", "x_9", 0, None), ("a", None, 0, None), ("a", "x_5", None, None), ("a", "x_6", 10, 5)]
    refs = [("a", 1, "x_1", 5), ("a", 2, "x_2", 10), ("a", 3, "x_2", 20), ("a", 4, "x_3", 29), ("a", 5, "x_4", 5), ("a", 6, "x_9", 5), ("a", 7, None, 5), ("a", 8, "x_1", None), ("a", 9, "x_5", 5), ("a", 10, "x_6", 20), ("a", 1, "x_1", 5), ("a", 5, "x_4", 5)]
    got = run(spark, refs, parents)
    assert got == brute(refs, parents)
    assert got == {("a", 2): "deleted", ("a", 4): "late", ("a", 5): "missing", ("a", 6): "missing", ("a", 8): "late", ("a", 9): "late", ("a", 10): "deleted"}


def test_random_keys(spark):
    rnd = random.Random(5)
    keys = [f"{rnd.choice(['x_', 'y', '', '63.', 'x_0'])}{rnd.choice(['', '0', '00'])}{rnd.randint(0, 60)}" for _ in range(300)] + ["x_", "9" * 30, "plan", str(10**17 - 1), str(10**17), "8191", "8192", "8193"]
    parents = [(rnd.choice("ab"), rnd.choice(keys), rnd.choice([None, *range(30)]), rnd.choice([None, *range(40)])) for _ in range(400)]
    refs = [(rnd.choice("ab"), i, rnd.choice([*keys, None]), rnd.choice(range(40))) for i in range(900)]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_hot_key_and_empty(spark):
    refs = [("a", i, "hot_7", i % 50) for i in range(2000)]
    parents = [("a", "hot_7", 3 * i, 3 * i + 2) for i in range(10)] * 3
    assert run(spark, refs, parents) == brute(refs, parents)
    assert run(spark, [], parents) == {}
    assert set(run(spark, refs[:3], []).values()) == {"missing"}


def test_key_rule(spark):
    df = spark.createDataFrame([(" Ab__c- d\t",), ("　x\xa0y",), ("_-_",), (None,), ("",)], "k string")
    assert [r[0] for r in df.select(canonical_key(F.col("k"))).collect()] == ["ab_c_d", "x_y", None, None, None]
    df = spark.createDataFrame([("3GPP_TS 63.417",), ("ts63.417 ",), ("TS x",), (" ",)], "k string")
    assert [r[0] for r in df.select(spec_key(F.col("k"))).collect()] == ["63.417", "63.417", "ts_x", None]
    df = spark.createDataFrame([(" 1.2\t",), ("Annex A .",), (" ",)], "k string")
    assert [r[0] for r in df.select(strip_space(F.col("k"))).collect()] == ["1.2", "Annex A .", None]
