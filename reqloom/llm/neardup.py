"""Near-duplicate records: an LSH forest over word-shingle sets, with an exact check.

1. Words are runs of ASCII letters and digits; a record's set are its hashed `n`-word sequences. Records with equal sets
   form one class at once (hash of the set), so that copies cost nothing further on.
2. The forest: ``orders(BASE, threshold)`` signature orders of one record per class, each a sequence of min-hashes. All
   orders are one range-partitioned, sorted table; equal stretches are told apart by the id, so that no partition is
   larger than the others, however many records look alike. Neighbours whose longest common prefix has at least BASE
   labels are candidates: their region is a run of the sorted order. Regions that the border of two partitions cuts are
   put together in a second, small step.
3. Adaptive depth per region: where a region has more than CROWD records, neighbours with a longer common prefix are its
   candidates, by one or two labels more as its runs tell; and its records, and only those, are sorted anew in as many
   orders as that depth needs for the same chance of missing a pair (``orders``), and so on until regions are small or
   DEPTH is reached. A region still crowded then holds nearly equal records whose pairs are results; it is compared in
   blocks of CROWD, each block pair a group of its own. Nothing is capped or dropped.
4. Candidate pairs whose sizes allow it meet their sketches, two bits of each of 96 min-hashes: a pair at the threshold
   differs from what is expected by more than ``SIGMAS`` standard deviations with probability below 10^-6, and nearly all
   chance neighbours fall out before any text is fetched for them. The rest is checked exactly on the sets.

A pair at the threshold is missed with probability MISS at most at each depth that it passes, one well above it with far
less: at threshold 0.6 a pair of similarity 0.7 with less than 10^-5.

Defined results: null titles count as empty; null texts and texts below `least` words are left out; repeated
deliveries and re-created records of one id are one record; equal ids never pair.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqloom.operators.components import components
from reqloom.sources.tables import Scratch, table

BASE, DEPTH, CROWD, MISS = 3, 8, 128, 0.0005
SKETCHED = 32  # orders whose base labels make the sketch; two bits of each fill a long
AHEAD = 2  # labels behind the prefix that a row carries for neighbours with a longer common prefix
SIGMAS = 5
_WORDS = re.compile(rb"[a-z0-9]+")
_SEED = 20240607


def orders(depth: int, threshold: float) -> int:
    """Orders that a prefix length needs so that a pair at the threshold is missed by all with probability MISS at most."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    return 1 if threshold == 1 else math.ceil(math.log(MISS) / math.log(1 - threshold**depth))


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.lru_cache(maxsize=None)
def factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    """One multiplier and one summand for each of `count` orders and each depth; the first ones are always the same."""
    rows = 256 * -(-count // 256)
    size = DEPTH + AHEAD
    mul = np.concatenate([_random(256 * size, _SEED + 10 * i) for i in range(rows // 256)]).reshape(-1, size)
    add = np.concatenate([_random(256 * size, _SEED + 10 * i + 1) for i in range(rows // 256)]).reshape(-1, size)
    return mul[:count], add[:count]


@functools.lru_cache(maxsize=None)
def flat_factors(count: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.ascontiguousarray(x[:, :depth]).reshape(1, -1) for x in factors(count))


_MIX = _random(DEPTH + 1, _SEED + 2)
_SPREAD = _random(16, _SEED + 3)


def shingles(words: list[bytes], n: int, cache: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the n-word sequences."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    for w in set(words).difference(cache):
        cache[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    s = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        s += h[i : len(h) - n + 1 + i] * _SPREAD[i]
        s ^= s >> np.uint64(29)
        s *= _SPREAD[15 - i]
    return np.unique(s ^ (s >> np.uint64(32)))


def minima(s: np.ndarray, count: int, depth: int) -> np.ndarray:
    """The first `depth` min-hashes of a set in each of `count` orders."""
    mul, add = flat_factors(count, depth)
    x = np.multiply(s[:, None], mul)
    x += add
    return (x.min(axis=0) >> np.uint64(31)).reshape(count, depth)


def prefix_keys(labels: np.ndarray) -> np.ndarray:
    """One 64-bit key per order of its label sequence; the orders are the last axis but one."""
    k = np.broadcast_to((np.arange(labels.shape[-2], dtype=np.uint64) + np.uint64(1)) * _MIX[0], labels.shape[:-1]).copy()
    for d in range(labels.shape[-1]):
        k = (k ^ labels[..., d]) * _MIX[1 + d]
        k ^= k >> np.uint64(30)
    return k


def sort_rows(labels: np.ndarray, depth: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """labels: records, orders, labels. (prefix key, what follows) of each order: the key of its first `depth` labels; then
    15 bits of each of the labels behind them, and the size of the set."""
    key = prefix_keys(labels[..., :depth]).view(np.int64)
    tail = np.zeros(labels.shape[:-1], dtype=np.uint64)
    for i in range(AHEAD):
        tail = (tail << np.uint64(15)) | (labels[..., depth + i] & np.uint64(0x7FFF))
    return key, ((tail << np.uint64(32)) | m.astype(np.uint64)[:, None]).view(np.int64)


def words_of(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits, lower-cased; bytes of other characters are never part of one."""
    return _WORDS.findall(text.encode("utf-8", "surrogatepass").lower())


def text_of(title: str | None, text: str | None) -> list[bytes]:
    return words_of(title or "") + words_of(text or "")


def class_of(s: np.ndarray) -> tuple[int, int]:
    """The two halves of a set's 128-bit hash: equal sets are one class."""
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d & (2**64 - 1)) - 2**63, (d >> 64) - 2**63


_LONGS = T.ArrayType(T.LongType())
_FIRST = T.StructType([T.StructField("id", T.LongType()), T.StructField("id2", T.LongType()), T.StructField("m", T.IntegerType()), T.StructField("keys", _LONGS), T.StructField("tails", _LONGS), T.StructField("sketch", _LONGS)])
_ROWS = T.StructType([T.StructField("keys", _LONGS), T.StructField("tails", _LONGS)])


def _first_column(n: int, least: int, threshold: float):
    count = orders(BASE, threshold)
    shift = (2 * np.arange(SKETCHED, dtype=np.uint64))[:, None]

    @F.pandas_udf(_FIRST)
    def first(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, int] = {}
        for title, text in batches:
            if len(cache) > 500_000:
                cache.clear()
            out: list[tuple] = [(0, 0, 0, None, None, None)] * len(text)
            at, sets = [], []
            for i, (a, b) in enumerate(zip(title, text, strict=True)):
                words = words_of(b) if isinstance(b, str) else []
                s = shingles(words_of(a) + words if a else words, n, cache) if len(words) >= least else ()
                if len(s):
                    at.append(i)
                    sets.append(s)
            for lo in range(0, len(at), 1000):
                part = sets[lo : lo + 1000]
                labels = np.stack([minima(s, max(count, SKETCHED), BASE + AHEAD) for s in part])
                keys, tails = sort_rows(labels[:, :count], BASE, np.array([len(s) for s in part]))
                sketch = ((labels[:, :SKETCHED, :BASE] & np.uint64(3)) << shift).sum(axis=1, dtype=np.uint64).view(np.int64)
                for k, s in enumerate(part):
                    out[at[lo + k]] = (*class_of(s), len(s), keys[k], tails[k], sketch[k])
            yield pd.DataFrame(out, columns=_FIRST.names)

    return first.asNondeterministic()  # else a filter on its result would run it once more


def _set_column(n: int):
    """The set of a text; null where it is not the set of the class (id, id2), as when a key has several texts."""

    @F.pandas_udf(_LONGS)
    def sets(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        cache: dict[bytes, int] = {}
        for rows in batches:
            found = ((shingles(text_of(a, b), n, cache), (i, i2)) for a, b, i, i2 in zip(*rows, strict=True))
            yield pd.Series([s.view(np.int64) if class_of(s) == k else None for s, k in found], dtype=object)

    return sets.asNondeterministic()  # else a filter on its result would run it once more


def _deeper_column(n: int, depth: int, threshold: float):
    """The sort rows of the orders that a depth needs; null where the text does not make the class (id, id2)."""
    count = orders(depth, threshold)

    @F.pandas_udf(_ROWS)
    def deeper(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        cache: dict[bytes, int] = {}
        for rows in batches:
            out = []
            for a, b, i, i2 in zip(*rows, strict=True):
                s = shingles(text_of(a, b), n, cache)
                if class_of(s) != (i, i2):
                    out.append((None, None))
                    continue
                keys, tails = sort_rows(minima(s, count, depth + AHEAD)[None], depth, np.array([len(s)]))
                out.append((keys[0], tails[0]))
            yield pd.DataFrame(out, columns=_ROWS.names)

    return deeper.asNondeterministic()  # else a filter on its result would run it once more


def alike(a: str, b: str, threshold: float):
    """Whether two sketches agree in as many of their two-bit fields as a pair at the threshold does."""
    fields, p = SKETCHED * BASE, threshold + (1 - threshold) / 4
    least = math.floor(fields * p - SIGMAS * math.sqrt(fields * p * (1 - p)))
    differ = F.lit(0)
    for i in range(BASE):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return F.lit(fields) - differ >= least


PAIR, CROWDED, EDGE, MARK, PENDING = range(5)
_OUT = "kind byte, a long, b long, t long"


def _pairs_of(key: np.ndarray, tail: np.ndarray, ids: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours at every distance whose keys are equal and whose sizes allow a pair at the threshold. Keys are sorted."""
    a, b = [], []
    m = (tail & np.int64(0xFFFFFFFF)).astype(np.float64)
    left = np.arange(len(key) - 1)
    for k in range(1, len(key)):
        left = left[left + k < len(key)]
        left = left[key[left] == key[left + k]]
        if not len(left):
            break
        x, y = m[left], m[left + k]
        fit = left[(np.minimum(x, y) >= threshold * np.maximum(x, y)) & (ids[left] != ids[left + k])]
        a.append(ids[fit])
        b.append(ids[fit + k])
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _sizes(change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the runs that begin where `change` says."""
    at = np.flatnonzero(change)
    return at, np.diff(np.append(at, len(change)))


def _frame(kind: int, a, b, t=0) -> pd.DataFrame:
    return pd.DataFrame({"kind": np.full(len(a), kind, dtype=np.int8), "a": a, "b": b, "t": np.full(len(a), t) if np.isscalar(t) else t})


def _regions(key: np.ndarray, tail: np.ndarray, ids: np.ndarray, depth: int, threshold: float, crowd: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Candidates of whole regions, and what each crowded one needs: yields (start, size, depth needed, pairs as two rows);
    size 0 stands for the pairs of all regions that are not crowded."""
    change = np.ones(len(key), dtype=bool)
    change[1:] = key[1:] != key[:-1]
    at, size = _sizes(change)
    small = np.repeat(size <= crowd, size)
    yield 0, 0, 0, np.stack(_pairs_of(key[small], tail[small], ids[small], threshold))
    for st, sz in zip(at[size > crowd], size[size > crowd], strict=True):
        need, found = min(DEPTH, depth + AHEAD + 1), []
        t, own = tail[st : st + sz], ids[st : st + sz]
        for i in range(1, AHEAD + 1):
            # runs of the region that share i labels more; the small ones among them are candidates already here
            longer = t >> np.int64(32 + 15 * (AHEAD - i))
            new = np.ones(sz, dtype=bool)
            new[1:] = longer[1:] != longer[:-1]
            _, runs = _sizes(new)
            fits = np.repeat(runs <= crowd, runs)
            found.append(np.stack(_pairs_of(longer[fits], t[fits], own[fits], threshold)))
            if fits.all():
                need = min(DEPTH, depth + i)
                break
            t, own = t[~fits], own[~fits]
            sz = len(t)
        yield int(st), int(size[np.searchsorted(at, st)]), need, np.concatenate(found, axis=1)


def _neighbours(depth: int, threshold: float, crowd: int):
    """One partition of the sorted orders: candidate pairs, records of crowded regions with the depth they need, and the
    rows of its first and last region, which may go on in the partitions beside it."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry, first = None, True

        def complete(x: tuple[np.ndarray, ...]) -> Iterator[pd.DataFrame]:
            for st, sz, need, (a, b) in _regions(*x, depth, threshold, crowd):
                yield _frame(PAIR, a, b)
                if sz and depth == DEPTH:
                    yield _frame(PENDING, x[0][st : st + sz], x[2][st : st + sz])
                elif sz:
                    yield _frame(CROWDED, x[2][st : st + sz], np.full(sz, need))

        def edge(x: tuple[np.ndarray, ...]) -> Iterator[pd.DataFrame]:
            k, t, i = x
            if len(k) <= crowd:
                yield _frame(EDGE, k, i, t)
                return
            for _, sz, need, (a, b) in _regions(*x, depth, threshold, crowd):
                yield _frame(PAIR, a, b)
                if sz:
                    yield _frame(MARK, k[:1], np.array([need]))
                    yield _frame(PENDING, k, i)

        for pdf in batches:
            x = tuple(pdf[c].to_numpy(dtype=np.int64) for c in ("k", "t", "id"))
            if not len(x[0]):
                continue
            if carry is not None:
                x = tuple(np.concatenate(y) for y in zip(carry, x, strict=True))
            starts = np.flatnonzero(x[0][1:] != x[0][:-1]) + 1
            if not len(starts):
                carry = x
                continue
            lo, hi = 0, int(starts[-1])
            if first:
                first, lo = False, int(starts[0])
                yield from edge(tuple(y[:lo] for y in x))
            if hi > lo:
                yield from complete(tuple(y[lo:hi] for y in x))
            carry = tuple(y[hi:] for y in x)
        if carry is not None:
            yield from edge(carry)

    return scan


def _candidates(tmp: Scratch, rows: DataFrame, depth: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: k, t, id. Sorts the orders and returns candidate pairs (a, b), crowded records (id, depth needed) and, at the
    greatest depth, the members of crowded regions (k, id)."""
    crowd = CROWD
    order = rows.repartitionByRange("k", "t", "id").sortWithinPartitions("k", "t", "id")
    found = tmp.save(order.mapInPandas(_neighbours(depth, threshold, crowd), _OUT))
    level = found.where(F.col("kind") == MARK).groupBy(F.col("a").alias("k")).agg(F.max("b").alias("need"))
    cut = found.where(F.col("kind") == EDGE).select(F.col("a").alias("k"), F.col("b").alias("id"), "t").join(level, "k", "left")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "id"], kind="stable")
        x = tuple(pdf[c].to_numpy(dtype=np.int64) for c in ("k", "t", "id"))
        out = []
        for _, sz, need, (a, b) in _regions(*x, depth, threshold, crowd):
            out.append(_frame(PAIR, a, b))
            if sz:
                out.append(_frame(PENDING, x[0], x[2]) if depth == DEPTH else _frame(CROWDED, x[2], np.full(sz, need)))
        return pd.concat(out)

    # the edges of a region whose parts are all small; more than one partition's worth of them is never met
    whole = tmp.save(cut.where("need is null").select("k", "t", "id").groupBy("k").applyInPandas(joined, _OUT))
    both = found.where(F.col("kind") != EDGE).unionByName(whole)
    pairs = both.where(F.col("kind") == PAIR).select("a", "b")
    pending = both.where(F.col("kind") == PENDING).select(F.col("a").alias("k"), F.col("b").alias("id")).unionByName(cut.where("need is not null").select("k", "id"))
    crowded = both.where(F.col("kind") == CROWDED).select(F.col("a").alias("id"), F.col("b").alias("need"))
    if depth < DEPTH:
        crowded = crowded.unionByName(pending.join(level, "k").select("id", "need"))
    return pairs, crowded, pending


def _block_pairs(rows: DataFrame) -> DataFrame:
    """rows: k, id of crowded regions. Pairs of a region in blocks of about CROWD; every pair of blocks is a group of its own."""
    sizes = rows.groupBy("k").agg(F.count("*").alias("region"))
    blocks = rows.join(sizes, "k").withColumn("blocks", F.expr(f"(region + {CROWD} - 1) div {CROWD}")).withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    spread = blocks.withColumn("other", F.expr("explode(sequence(0L, blocks - 1))")).select("k", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id")
    x, y = spread.alias("x"), spread.alias("y")
    same = (F.col("x.k") == F.col("y.k")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    joined = x.join(y, same & (F.col("x.id") < F.col("y.id")) & (F.when(F.col("x.lo") == F.col("x.hi"), True).otherwise(F.col("x.block") != F.col("y.block"))))
    return joined.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def _sort_rows(df: DataFrame) -> DataFrame:
    """keys, tails, id -> k, t, id: one row of every order."""
    return df.select(F.explode(F.arrays_zip("keys", "tails")).alias("r"), "id").select(F.col("r.keys").alias("k"), F.col("r.tails").alias("t"), "id")


def similar_classes(tmp: Scratch, docs: DataFrame, n: int, threshold: float, least: int) -> tuple[DataFrame, DataFrame]:
    """docs: key, title, text. Returns members (key, id, id2: the class) and pairs of classes (a, a2, b, b2, similarity)."""
    seen = docs.where(F.col("text").isNotNull() & F.col("key").isNotNull())
    # the UDF is asked for once; selecting its fields one by one would run it for each
    signed = tmp.save(seen.select("key", _first_column(n, least, threshold)("title", "text").alias("s")).select("key", "s.*").where(F.col("m") > 0))
    members = signed.select("key", "id", "id2").distinct()
    classes = tmp.save(signed.groupBy("id", "id2").agg(F.min("key").alias("key"), F.first("sketch").alias("sketch")))
    # a re-created record may come with another text under the same key: only a text that makes the class stands for it
    texts = docs.select("key", "title", "text").where(F.col("text").isNotNull())

    first = signed.groupBy("id").agg(F.first("keys").alias("keys"), F.first("tails").alias("tails"))
    pairs, crowded, _ = _candidates(tmp, _sort_rows(first), BASE, threshold)
    waiting = tmp.save(crowded.distinct())
    for depth in range(BASE + 1, DEPTH + 1):
        ids = waiting.where(F.col("need") == depth).select("id")
        if not ids.limit(1).count():
            continue
        of = classes.select("id", "id2", "key").join(ids, "id").join(texts, "key")
        rows = of.select("id", _deeper_column(n, depth, threshold)("title", "text", "id", "id2").alias("r")).select("id", "r.*").where(F.col("keys").isNotNull()).dropDuplicates(["id"])
        more, crowded, last = _candidates(tmp, _sort_rows(rows), depth, threshold)
        pairs = pairs.unionByName(more)
        if depth == DEPTH:
            pairs = pairs.unionByName(_block_pairs(tmp.save(last)))
        else:
            waiting = tmp.save(waiting.where(F.col("need") > depth).unionByName(crowded).distinct())
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sk = lambda c: classes.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"))
    pairs = tmp.save(pairs.join(sk("a"), "a").join(sk("b"), "b").where(alike("sa", "sb", threshold)).select("a", "b"))

    needed = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    reps = classes.join(needed, "id", "left_semi").select("id", "id2", "key")
    sets = reps.join(texts, "key").select("id", "id2", _set_column(n)("title", "text", "id", "id2").alias("s"))
    sets = sets.where(F.col("s").isNotNull()).dropDuplicates(["id", "id2"])
    sets = tmp.save(sets)
    x = sets.select(F.col("id").alias("a"), F.col("id2").alias("a2"), F.col("s").alias("sa"))
    y = sets.select(F.col("id").alias("b"), F.col("id2").alias("b2"), F.col("s").alias("sb"))
    checked = pairs.join(x, "a").join(y, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    sim = F.col("both") / (F.size("sa") + F.size("sb") - F.col("both"))
    return members, tmp.save(checked.select("a", "a2", "b", "b2", sim.alias("similarity")).where(F.col("similarity") >= threshold))


def requirement_texts(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "requirements").select(F.col("req_id").alias("key"), "title", "text")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    """Every pair of different requirements that share at least 0.6 of their three-word sequences."""
    members, pairs = similar_classes(Scratch(spark), requirement_texts(spark, base), 3, 0.6, 25)
    x = members.select(F.col("key").alias("ka"), F.col("id").alias("a"), F.col("id2").alias("a2"))
    y = members.select(F.col("key").alias("kb"), F.col("id").alias("b"), F.col("id2").alias("b2"))
    across = pairs.join(x, ["a", "a2"]).join(y, ["b", "b2"])
    inside = x.join(y, (F.col("a") == F.col("b")) & (F.col("a2") == F.col("b2")) & (F.col("ka") < F.col("kb")))
    both = across.select("ka", "kb").unionByName(inside.select("ka", "kb")).where(F.col("ka") != F.col("kb"))
    return both.select(F.least("ka", "kb").alias("req_id_a"), F.greatest("ka", "kb").alias("req_id_b")).distinct()


def p2_groups(spark: SparkSession, base: str) -> DataFrame:
    """Every requirement compared, with its group (the smallest req_id of all that it is linked with, directly or not)
    and the number of requirements it is directly linked with. Copies are counted, not expanded."""
    tmp = Scratch(spark)
    members, pairs = similar_classes(tmp, requirement_texts(spark, base), 3, 0.6, 25)
    name = F.concat_ws("/", F.lit("c"), "id", "id2")
    sizes = tmp.save(members.groupBy("id", "id2").agg(F.count("*").alias("copies"), F.min("key").alias("first_key")).withColumn("node", name))
    link = pairs.select(F.concat_ws("/", F.lit("c"), "a", "a2").alias("src"), F.concat_ws("/", F.lit("c"), "b", "b2").alias("dst"))
    comp = components(link)
    both = link.unionByName(link.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    near = both.join(sizes.select(F.col("node").alias("dst"), "copies"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("copies").alias("links"))
    placed = sizes.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    group = placed.groupBy("component").agg(F.min("first_key").alias("group_id"))
    placed = placed.join(group, "component").join(near, "node", "left").select("id", "id2", "group_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    return members.join(placed, ["id", "id2"]).groupBy(F.col("key").alias("req_id")).agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"))
