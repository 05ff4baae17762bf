"""Mixing sources to target weights by balanced sampling (the cube method).

The total of a mix is the largest for which no source needs more than its cap of repeats (or a given total). A source
then needs `rate` copies of each of its documents on average: all get floor(rate) copies, and the fraction becomes each
document's inclusion probability for one copy more. The cube method turns the fractions into 0 or 1 while it keeps two
totals of every source, documents and tokens: it takes three documents that are still undecided, and moves their
probabilities along the null-space of the two constraints, (t2 - t3, t3 - t1, t1 - t2), until one hits 0 or 1. That runs
in groups of about ``GROUP`` documents, large documents first; each leaves at most two undecided ones and its smallest
(``OPEN`` or more), which took no part, and these are grouped again until one small landing problem remains per source. There the
document total is given up and the tokens are kept: large documents are drawn among the ways after which the rest can
still reach the total, and the smallest are enumerated for the least miss. A source with a few dozen small documents
that are not all needed misses its tokens by a few tokens, one without by the least that its documents allow.

Defined results: a source with no tokens can give nothing; it is reported with share 0 and the others keep their
proportions. Documents without tokens, without a source or of a source that the mix does not name are never chosen.
The draws come from a seed and the document's id: the same input gives the same result. A target share of null or 0
or less names nothing; max_repeats null or below 1 gives nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.llm.packing import document_tokens
from reqloom.llm.tokens import VOCABULARY
from reqloom.sources.tables import Scratch, table

GROUP = 5000
OPEN = 24  # documents of each group, its smallest, that are left to the landing
HALF = 12  # the landing enumerates the sums of two halves of at most this many documents
# What counts as rounding, relative to the numbers that were added.
NOISE = 1e-14


def move(p: list[float], at: Sequence[int], u: Sequence[float], r: float) -> None:
    """Moves the probabilities at `at` along u, one way or the other by the draw r, until one is exactly 0 or 1."""
    up = down = float("inf")
    for k, x in zip(at, u, strict=True):
        if x > 0:
            up, down = min(up, (1 - p[k]) / x), min(down, p[k] / x)
        elif x < 0:
            up, down = min(up, p[k] / -x), min(down, (1 - p[k]) / -x)
    step = up if r * (up + down) < down else -down
    for k, x in zip(at, u, strict=True):
        if x:
            d = step * x
            v, noise = p[k] + d, NOISE * (p[k] + abs(d))
            p[k] = 0.0 if v <= noise else 1.0 if v >= 1 - noise else v


def flight(p: list[float], t: list[float], rng: np.random.Generator, keep: int = 0) -> list[float]:
    """Moves probabilities along the null-space of (count, tokens) until at most two are undecided, and the last `keep`
    undecided of the list, which take no part."""
    p = list(p)
    draws = iter(())
    live: list[int] = []
    open_ = [i for i in range(len(p)) if 0 < p[i] < 1]
    for i in open_[: max(0, len(open_) - keep)]:
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = (t[b] - t[c], t[c] - t[a], t[a] - t[b])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)  # equal sizes: any exchange keeps both totals
            r = next(draws, None)
            if r is None:
                draws = iter(rng.random(256).tolist())
                r = next(draws)
            move(p, live, u, r)
            live = [k for k in live if 0 < p[k] < 1]
    return p


def least_miss(t: Sequence[float], target: float, rng: np.random.Generator) -> np.ndarray:
    """The subset of at most 2 * HALF sizes whose sum is nearest to the target, by enumeration in two halves; of equally
    good ones the draw decides."""
    t = np.asarray(t, dtype=np.float64)
    order = rng.permutation(len(t))
    halves = [order[: len(t) // 2], order[len(t) // 2 :]]
    sums = []
    for h in halves:
        s = np.zeros(1)
        for x in t[h]:
            s = np.concatenate([s, s + x])  # bit k of the position says whether the k-th is in
        sums.append(s)
    by = np.argsort(sums[1], kind="stable")
    ordered = sums[1][by]
    at = np.searchsorted(ordered, target - sums[0])
    best = None
    for j in (np.maximum(at - 1, 0), np.minimum(at, len(ordered) - 1)):
        miss = np.abs(sums[0] + ordered[j] - target)
        i = int(miss.argmin())
        if best is None or miss[i] < best[0]:
            best = (miss[i], i, int(by[j[i]]))
    out = np.zeros(len(t))
    for h, bits in zip(halves, best[1:], strict=True):
        out[h] = (bits >> np.arange(len(h))) & 1
    return out


def land(p: list[float], t: list[float], rng: np.random.Generator) -> list[float]:
    """The landing: the document total is given up, and the undecided are taken so that their tokens miss the expected
    ones by as little as can be.

    Undecided documents go from large to small. One that is larger than all smaller ones together (there are few, each
    is over twice the next) cannot be made up for: of these the combination is drawn among those after which the rest can
    still reach the total, or the nearest is taken. The others are drawn with a probability that keeps the expected
    rest, as long as both ways can reach the total. The smallest 2 * HALF are enumerated.
    """
    p = list(p)
    live = sorted((i for i in range(len(p)) if 0 < p[i] < 1), key=lambda i: -t[i])
    want = sum(p[i] * t[i] for i in live)
    head, tail = live[: max(0, len(live) - 2 * HALF)], live[max(0, len(live) - 2 * HALF) :]
    below = np.concatenate([np.cumsum([t[i] for i in live][::-1])[::-1][1:], [0.0]]) if live else np.empty(0)
    giant = [i for k, i in enumerate(head) if t[i] > below[k]]
    if giant:
        bits = (np.arange(1 << len(giant))[:, None] >> np.arange(len(giant))) & 1
        q = np.array([p[i] for i in giant])
        odds = np.where(bits == 1, q, 1 - q).prod(axis=1)
        rest = want - bits @ np.array([t[i] for i in giant])
        room = sum(t[i] for i in live) - sum(t[i] for i in giant)
        miss = np.maximum(0, -rest) + np.maximum(0, rest - room)
        fair = miss <= miss.min() + NOISE * max(1.0, want)
        pick = int(rng.choice(len(odds), p=np.where(fair, odds, 0) / odds[fair].sum()))
        for i, x in zip(giant, bits[pick], strict=True):
            p[i] = float(x)
        want = float(rest[pick])
    chosen = set(giant)
    rest_sum = sum(t[i] for i in live if i not in chosen)
    expected = sum(p[i] * t[i] for i in live if i not in chosen)
    for i in head:
        if i in chosen:
            continue
        others = rest_sum - t[i]
        # tilted so that what is expected of the open ones stays what is wanted of them
        q = p[i] * want / expected if want <= expected else 1 - (1 - p[i]) * (rest_sum - want) / max(rest_sum - expected, NOISE)
        expected -= p[i] * t[i]
        if want < t[i]:
            take = False
        elif want > others:
            take = True
        else:
            take = rng.random() < q
        p[i] = float(take)
        want -= t[i] * take
        rest_sum = others
    if tail:
        for i, x in zip(tail, least_miss([t[i] for i in tail], want, rng), strict=True):
            p[i] = float(x)
    return p


def mix_rates(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per mix and named source: available tokens and documents, and copies needed of each document on average."""
    t = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") >= 1)).groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    named = t.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0))).withColumn("docs", F.coalesce("docs", F.lit(0)))
    w = Window.partitionBy("mix_id")
    there = F.col("available") > 0
    share = F.col("target_share") / F.sum(F.when(there, F.col("target_share"))).over(w)
    named = named.withColumn("share", F.when(there, share).otherwise(0.0))
    most = F.min(F.when(there, F.col("max_repeats") * F.col("available") / F.col("share"))).over(w)
    named = named.withColumn("total", F.lit(float(total)) if total else most)
    return named.withColumn("rate", F.when(there, F.least(F.col("max_repeats").cast("double"), F.col("share") * F.col("total") / F.col("available"))).otherwise(0.0))


def reserve(p: Sequence[float], t: Sequence[float]) -> int:
    """How many of the last (smallest) undecided documents hold twice the tokens of the two largest, OPEN at least."""
    sizes = [t[i] for i in range(len(p)) if 0 < p[i] < 1]
    need, total, n = 2 * sum(sorted(sizes)[-2:]), 0.0, 0
    for x in reversed(sizes):
        if n >= OPEN and total >= need:
            break
        total, n = total + x, n + 1
    return n


def _stage(df: DataFrame, seed: int, last: bool) -> DataFrame:
    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable")
        rng = np.random.default_rng([seed, abs(hash_text(f"{key[0]}|{key[1]}")), int(key[2])])
        tokens = [float(x) for x in pdf["tokens"]]
        # large documents are decided first, in random order within a size class, so that what stays open is small
        order = np.lexsort((rng.random(len(tokens)), -np.floor(2 * np.log2(tokens))))
        p, t = pdf["p"].to_numpy()[order].tolist(), [tokens[i] for i in order]
        # small ones stay open for the landing: there as many as make up for any that the flight leaves undecided
        # (before the last stage a quarter of the group at most, so that every stage leaves far fewer)
        p = flight(p, t, rng, reserve(p, t) if last else min(reserve(p, t), len(p) // 4))
        if last:
            p = land(p, t, rng)
        out = np.empty(len(p))
        out[order] = p
        return pdf.assign(p=out)

    return df.groupBy("mix_id", "source", "grp").applyInPandas(one, df.schema)


def hash_text(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode())


def choose(items: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11, per_group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """items: doc_id, source, tokens (written). Returns the chosen documents (mix_id, source, doc_id, tokens, repeats)
    and the rates."""
    tmp = Scratch(items.sparkSession)
    items = items.where((F.col("tokens") > 0) & F.col("source").isNotNull())
    sizes = items.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("docs"))
    rates = tmp.save(mix_rates(sizes, targets, total))  # as many rows as targets
    use = rates.where(F.col("rate") > 0).select("mix_id", "source", "rate", "docs")  # the planner knows the written table's size
    dealt = items.join(use, "source").withColumn("whole", F.floor(F.col("rate") * (1 + NOISE)).cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    dealt = dealt.select("mix_id", "source", "doc_id", "tokens", "whole", "p", F.expr(f"(docs + {per_group} - 1) div {per_group}").alias("groups"))
    dealt = dealt.withColumn("p", F.when(F.col("p") > F.col("whole") * NOISE, F.col("p")).otherwise(0.0))
    settled = [dealt.where(F.col("p") == 0)]
    open_ = dealt.where(F.col("p") > 0)
    level = 0
    while True:
        g = F.pmod(F.xxhash64("doc_id", "mix_id", F.lit(seed + level)), F.col("groups"))
        most = (rates.agg(F.max("docs")).first()[0] or 0) if level == 0 else most_open
        last = most <= per_group
        staged = _stage(open_.withColumn("grp", F.lit(0).cast("long") if last else g), seed + level, last).drop("grp")
        if last:
            settled.append(staged)
            break
        staged = tmp.save(staged)
        undecided = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(staged.where(~undecided))
        left = staged.where(undecided)
        per = tmp.save(left.groupBy("mix_id", "source").agg(F.count("*").alias("n")))
        most_open = per.agg(F.max("n")).first()[0] or 0
        open_ = left.drop("groups").join(per, ["mix_id", "source"]).withColumn("groups", F.expr(f"(n + {per_group} - 1) div {per_group}")).select(*dealt.columns)
        level += 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    out = out.withColumn("repeats", F.col("whole") + F.round("p").cast("int")).where(F.col("repeats") > 0)
    return out.select("mix_id", "source", "doc_id", "tokens", "repeats"), rates


def p8_mix_documents(spark: SparkSession, base: str) -> DataFrame:
    """The chosen documents of every mix with their repeats."""
    return choose(document_tokens(spark, base, VOCABULARY), table(spark, base, "mix_targets"))[0]


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    """Target and actual shares of every named source of every mix."""
    chosen, rates = choose(document_tokens(spark, base, VOCABULARY), table(spark, base, "mix_targets"))
    per = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("mixed_tokens"), F.sum("repeats").alias("mixed_docs"), F.max("repeats").alias("most_repeats"))
    w = Window.partitionBy("mix_id")
    r = rates.join(per, ["mix_id", "source"], "left")
    got = F.coalesce("mixed_tokens", F.lit(0))
    return r.select("mix_id", "source", "target_share", "max_repeats", "available", got.alias("mixed_tokens"), F.coalesce("mixed_docs", F.lit(0)).alias("mixed_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), (got / F.sum(got).over(w)).alias("actual_share"))


def p8_share_check(spark: SparkSession, base: str) -> DataFrame:
    """Per mix and named source: documents with text, whether no document is used more often than allowed, and whether the
    source's tokens are within 2 % of what its share asks for (where it has 30 documents or more; fewer may not allow it)."""
    items = document_tokens(spark, base, VOCABULARY)
    chosen, rates = choose(items, table(spark, base, "mix_targets"))
    per = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("got"), F.max("repeats").alias("most"))
    r = rates.join(per, ["mix_id", "source"], "left")
    want = F.col("rate") * F.col("available")
    kept = F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True))
    near = F.abs(F.coalesce("got", F.lit(0)) - want) <= 0.02 * want
    near = near | (F.col("docs") < 30)
    return r.select("mix_id", "source", "target_share", "max_repeats", F.col("docs").cast("long").alias("docs"), kept.alias("kept"), near.alias("near"))
