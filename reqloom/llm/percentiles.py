"""Percentiles of very large numeric columns with mergeable sketches.

The sketch is a hierarchy of compactors: a full level is sorted, a fair coin keeps its odd or its even values, and what
is kept moves one level up with double weight; levels of two sketches are merged one by one. Spark runs this hierarchy
natively (``kll_sketch_agg_double``), inside the partial aggregation, so a group that holds a third of all rows is
compacted where its rows lie. Rows that were delivered twice are told apart by their id first, in one shuffle of narrow
rows (id, group, value); where deliveries are known to be single (``repeated=False``) that is left out, and only sketches
of a few KB are shuffled.

With parameter k the rank error of one quantile stays within ``rank_error(k)`` (as a share of the group's rows) with
99 % probability, for a sketch of one group and for any merge of sketches alike. Groups of fewer than k values are exact.

Defined results: null, NaN and infinite values are left out; a group without finite values has no row; a null category,
name or day is a group of its own; a percentile is the smallest value whose rank reaches its share (inclusive).
Repeated deliveries (same id, same content) count once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.sources.tables import table

K = 400
SHARES = (0.5, 0.9, 0.95, 0.99)


def rank_error(k: int = K) -> float:
    """The published 99 % bound of the rank error of a single quantile (fixed values: fit of the sketch's authors)."""
    return 2.296 / k**0.9021


def finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def sketch(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """One sketch per group: the keys, n, low, high, sketch (binary)."""
    v = F.col(value).cast("double")
    return df.where(finite(v)).groupBy(*keys).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of parts (days, partitions, files) to sketches of the wholes."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, keys: Sequence[str], shares: Sequence[float] = SHARES, k: int = K) -> DataFrame:
    """The percentiles of each sketch with the bound of their rank error, and the sketch itself, which can be merged further."""
    q = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(s)) for s in shares]))
    cols = [F.element_at("q", i + 1).alias(f"p{s * 100:g}".replace(".", "_")) for i, s in enumerate(shares)]
    error = F.when(F.col("n") < k, 0.0).otherwise(rank_error(k)).alias("rank_error")
    return sketches.withColumn("q", q).select(*keys, "n", "low", "high", *cols, error, "sketch")


def daily_sketches(spark: SparkSession, base: str, k: int = K, repeated: bool = True) -> DataFrame:
    """One sketch per category, name and day of `metrics`; each id counts once.

    Grouping by what is needed of a row, id included, is the dedup: one shuffle of narrow rows.
    """
    m = table(spark, base, "metrics").where(finite("value")).select("id", "category", "name", F.to_date("ts").alias("day"), "value")
    return sketch(m.distinct() if repeated else m, ["category", "name", "day"], "value", k)


def p4_percentiles(spark: SparkSession, base: str) -> DataFrame:
    """Per category, name and day, and (day null, whole = true) per category and name from the merged daily sketches."""
    days = daily_sketches(spark, base)
    # each daily sketch goes to its own row and to the whole: one more level of merging, no second pass over the data
    both = days.withColumn("whole", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("day", F.when(~F.col("whole"), F.col("day")))
    keys = ["category", "name", "whole", "day"]
    return quantiles(merge(both, keys), keys)


def p4_daily_sketches(spark: SparkSession, base: str) -> DataFrame:
    """The combinable form: one sketch per category, name and day."""
    return daily_sketches(spark, base)


def p4_rank_check(spark: SparkSession, base: str) -> DataFrame:
    """Per category and name: rows, least and greatest value, and whether every percentile lies within the stated bound of
    its exact rank: the share of values below it is at most share + error, that of values up to it at least share - error."""
    whole = p4_percentiles(spark, base).where("whole").select("category", "name", "n", "low", "high", "rank_error", *[f"p{s * 100:g}" for s in SHARES])
    m = table(spark, base, "metrics").where(finite("value")).select("id", F.col("category").alias("c"), F.col("name").alias("m"), F.col("value").cast("double").alias("v")).distinct()
    j = m.join(whole.select("category", "name", *[f"p{s * 100:g}" for s in SHARES]), F.col("c").eqNullSafe(F.col("category")) & F.col("m").eqNullSafe(F.col("name")))
    counts = [F.count_if(F.col("v") < F.col(f"p{s * 100:g}")).alias(f"lt{i}") for i, s in enumerate(SHARES)] + [F.count_if(F.col("v") <= F.col(f"p{s * 100:g}")).alias(f"le{i}") for i, s in enumerate(SHARES)]
    ranks = j.groupBy(F.col("c").alias("c1"), F.col("m").alias("m1")).agg(*counts)
    both = whole.join(ranks, F.col("c1").eqNullSafe(F.col("category")) & F.col("m1").eqNullSafe(F.col("name")))
    ok = F.lit(True)
    for i, s in enumerate(SHARES):
        e = F.col("rank_error") + 1e-9
        ok = ok & (F.col(f"lt{i}") <= (s + e) * F.col("n")) & (F.col(f"le{i}") >= (s - e) * F.col("n"))
    return both.select("category", "name", "n", "low", "high", ok.alias("within"))
