import datetime as dt

import numpy as np
import pytest

from reqloom.llm import mixing as M
from reqloom.llm import packing as K
from reqloom.llm import percentiles as Q


def rank_gap(values, estimate, share):
    v = np.sort(values)
    lo, hi = np.searchsorted(v, estimate, "left") / len(v), np.searchsorted(v, estimate, "right") / len(v)
    return 0 if lo <= share <= hi else min(abs(lo - share), abs(hi - share))


def test_percentiles(spark, tmp_path):
    rng = np.random.default_rng(1)
    day = dt.datetime(2025, 1, 1)
    rows, i = [], 0
    groups = {("a", "x"): rng.lognormal(0, 2, 20000), ("a", "y"): np.repeat([1.0, 2.0, 2.0, 3.0], 500), ("b", "x"): rng.normal(size=3)}
    for (c, n), vs in groups.items():
        for v in vs:
            rows.append((i, c, n, float(v), day + dt.timedelta(hours=int(i % 96))))
            i += 1
    rows += [rows[0]] * 50  # repeated deliveries
    rows += [(i + 1, "a", "x", None, day), (i + 2, "a", "x", float("nan"), day), (i + 3, "a", "x", float("inf"), day), (i + 4, None, None, 5.0, None), (i + 5, "gone", "x", None, day)]
    spark.createDataFrame(rows, "id long, category string, name string, value double, ts timestamp_ntz").write.parquet(f"{tmp_path}/metrics.parquet")
    got = Q.p4_percentiles(spark, str(tmp_path)).collect()
    whole = {(r.category, r.name): r for r in got if r.whole}
    assert set(whole) == {*groups, (None, None)}
    for k, vs in groups.items():
        r = whole[k]
        assert r.n == len(vs) and r.low == vs.min() and r.high == vs.max()
        for share, est in zip(Q.SHARES, (r.p50, r.p90, r.p95, r.p99), strict=True):
            assert rank_gap(vs, est, share) <= (Q.rank_error() if len(vs) >= Q.K else 1 / len(vs))
    assert whole[("b", "x")].rank_error == 0
    assert sum(r.n for r in got if not r.whole) == sum(r.n for r in got if r.whole)


def test_percentiles_empty(spark, tmp_path):
    spark.createDataFrame([], "id long, category string, name string, value double, ts timestamp_ntz").write.parquet(f"{tmp_path}/metrics.parquet")
    assert Q.p4_percentiles(spark, str(tmp_path)).count() == 0


def naive_ffd(sizes, capacity):
    rooms = []
    for s in sorted((x for x in sizes if x > 0), reverse=True):
        for i, r in enumerate(rooms):
            if r >= s:
                rooms[i] -= s
                break
        else:
            rooms.append(capacity - s)
    return rooms


def test_packing_is_first_fit_decreasing():
    rng = np.random.default_rng(2)
    for cap in (7, 50, 512):
        sizes = rng.integers(0, cap + 1, 400).tolist()
        placed = K.pack(sizes, cap)
        room = {}
        for box, _, _, s in placed:
            room[box] = room.get(box, cap) - s
        assert [room[i] for i in sorted(room)] == naive_ffd(sizes, cap)
        assert sorted(i for _, i, _, _ in placed) == [i for i, s in enumerate(sizes) if s]


def test_packing_splits_only_the_oversized():
    placed = K.pack([10, 25, 0, 10], 10)
    assert sorted((i, part, s) for _, i, part, s in placed) == [(0, 1, 10), (1, 1, 10), (1, 2, 10), (1, 3, 5), (3, 1, 10)]
    assert len({b for b, *_ in placed}) == 5
    with pytest.raises(ValueError):
        K.pack([1], 0)
    assert K.pack([], 5) == []


def test_packing_operator(spark):
    items = spark.createDataFrame([(i, (i * 37) % 100 if i % 11 else None) for i in range(500)], "doc_id long, tokens int")
    limits = spark.createDataFrame([("a", 100), ("b", 60), ("b", 60)], "pack_id string, capacity_tokens int")
    rows = K.pack_groups(items, limits, 500, per_group=100).collect()
    want = sum((i * 37) % 100 for i in range(500) if i % 11)
    for p, cap in (("a", 100), ("b", 60)):
        mine = [r for r in rows if r.pack_id == p]
        assert sum(r.used_tokens for r in mine) == want and max(r.used_tokens for r in mine) <= cap
        assert len({r.container_id for r in mine}) == len(mine)
    assert K.pack_groups(items.limit(0), limits, 0).count() == 0


def mix(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id long, source string, tokens int")
    t = spark.createDataFrame(targets, "mix_id string, source string, target_share double, max_repeats int")
    chosen, rates = M.choose(d, t, **kw)
    return chosen.collect(), {(r.mix_id, r.source): r for r in rates.collect()}


def test_mixing(spark):
    rng = np.random.default_rng(3)
    docs = [(i, "big" if i % 10 else "small", int(rng.lognormal(5, 1)) + 1) for i in range(6000)]
    docs += [(9001, None, 50), (9002, "big", None), (9003, "big", 0), (9004, "unnamed", 70)]
    targets = [("m", "big", 0.6, 1), ("m", "small", 0.3, 3), ("m", "none", 0.1, 2), ("k", "small", 1.0, 2)]
    got, rates = mix(spark, docs, targets, per_group=700)
    tok = {d[0]: d[2] for d in docs}
    most = {("m", "big"): 1, ("m", "small"): 3, ("k", "small"): 2}
    for r in got:
        assert 1 <= r.repeats <= most[(r.mix_id, r.source)] and tok[r.doc_id]
    size = {}
    for r in got:
        size[(r.mix_id, r.source)] = size.get((r.mix_id, r.source), 0) + r.tokens * r.repeats
    total = size[("m", "big")] + size[("m", "small")]
    assert abs(size[("m", "big")] / total - 2 / 3) < 0.005
    # token totals are balanced to less than one document
    largest = {s: max(d[2] for d in docs if d[1] == s and d[2]) for s in ("big", "small")}
    for k, r in rates.items():
        if r.rate:
            assert abs(size[k] - r.rate * r.available) < largest[k[1]], (k, size[k], r.rate * r.available)
    again, _ = mix(spark, docs, targets, per_group=700)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert len({(r.mix_id, r.doc_id) for r in got}) == len(got)


def test_mixing_edges(spark):
    assert mix(spark, [], [("m", "a", 1.0, 1)])[0] == []
    got, _ = mix(spark, [(1, "a", 10), (2, "a", 10), (3, "a", 10)], [("m", "a", 1.0, 2)])
    assert {r.repeats for r in got} == {2}
    assert mix(spark, [(1, "a", 10)], [("m", "a", None, 1), ("n", "a", 0.5, 0)])[0] == []


def heavy(rng, n):
    return [float(x) for x in np.maximum(1, rng.pareto(0.9, n) * 60).astype(int)]


def test_least_miss_is_exact():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 9, 12):
        t = [float(x) for x in rng.integers(1, 90, n)]
        sums = [sum(x for k, x in enumerate(t) if m >> k & 1) for m in range(1 << n)]
        for target in (0.0, 3.2, 70.0, sum(t) / 3, sum(t) + 5):
            got = M.least_miss(t, target, rng)
            assert abs(abs(np.dot(got, t) - target) - min(abs(s - target) for s in sums)) < 1e-9


def test_landing_of_heavy_tails_misses_by_little():
    for seed in range(10):
        rng = np.random.default_rng(seed)
        for n in (30, 60, 300, 3000):
            t = sorted(heavy(rng, n), reverse=True)
            for rate in (0.1, 0.5, 0.93):
                p = M.flight([rate] * n, t, rng, M.reserve([rate] * n, t))
                p = M.land(p, t, rng)
                assert set(p) <= {0.0, 1.0}
                miss = abs(np.dot(p, t) - rate * sum(t)) / (rate * sum(t))
                # a document over half of all tokens may leave nothing nearer
                if t[0] < 0.4 * sum(t) * min(rate, 1 - rate) or n >= 300 and t[0] < 0.1 * sum(t):
                    assert miss < 0.02, (seed, n, rate, miss, t[:3])


def test_landing_keeps_inclusion_probabilities():
    t = [900.0, 500.0, 300.0] + [float(x) for x in range(60, 0, -1)]
    hits = np.zeros(len(t))
    for seed in range(400):
        rng = np.random.default_rng(seed)
        p = [0.4] * len(t)
        hits += M.land(M.flight(p, t, rng, M.reserve(p, t)), t, rng)
    assert abs(np.dot(hits / 400, t) / sum(t) - 0.4) < 0.01 and abs(hits[:40].mean() / 400 - 0.4) < 0.08


def test_mixing_of_heavy_tails_hits_the_shares(spark):
    rng = np.random.default_rng(8)
    docs, i = [], 0
    for source, n in (("a", 150), ("b", 400), ("c", 90), ("d", 1500)):
        for x in heavy(rng, n):
            docs.append((i, source, int(min(x, 4000))))
            i += 1
    targets = [("m", "a", 0.2, 2), ("m", "b", 0.3, 2), ("m", "c", 0.2, 4), ("m", "d", 0.3, 1)]
    for seed in range(3):
        got, rates = mix(spark, docs, targets, seed=seed, per_group=600)
        size = {}
        for r in got:
            size[r.source] = size.get(r.source, 0) + r.tokens * r.repeats
        for (_, s), r in rates.items():
            assert abs(size[s] / (r.rate * r.available) - 1) < 0.02, (seed, s)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    t = [float(x) for x in rng.integers(1, 1000, 200)]
    p = M.flight([0.3] * 200, t, rng)
    assert sum(0 < x < 1 for x in p) <= 2
    assert abs(sum(p) - 60) < 1e-6 and abs(np.dot(p, t) - 0.3 * sum(t)) < 1e-3


def test_tiny_probabilities_reach_the_landing():
    rng = np.random.default_rng(3)
    t = [float(x) for x in rng.integers(1, 500, 1000)]
    p = M.flight([1e-10] * 1000, t, rng)
    assert sum(0 < x < 1 for x in p) <= 2 and sum(x > 0 for x in p) <= 2
    assert abs(sum(p) - 1e-7) < 1e-13 and abs(sum(x * y for x, y in zip(p, t)) / (1e-10 * sum(t)) - 1) < 1e-6


def test_mixing_keeps_a_source_with_a_tiny_rate(spark):
    items = spark.range(1_500_000).selectExpr("id AS doc_id", "'big' AS source", "10 AS tokens").unionByName(spark.createDataFrame([(-1, "scarce", 10)], "doc_id bigint, source string, tokens int"))
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "scarce", 0.5, 1)], "mix_id string, source string, target_share double, max_repeats int")
    chosen, _ = M.choose(items, targets)
    assert {r.source: r.n for r in chosen.groupBy("source").sum("tokens").toDF("source", "n").collect()} == {"big": 10, "scarce": 10}
