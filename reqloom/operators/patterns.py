"""Relational building blocks that the queries share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per key of rows that are delivered repeatedly with the same content."""
    return df.dropDuplicates([key])


def topk_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark prunes to k per task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_write(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """First row per key in `order`: a struct minimum, so it combines before the shuffle."""
    got = df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("v"))
    return got.select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])


def last_write(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("v"))
    return got.select(*keys, *[F.col(f"v.{v}").alias(v) for v in values])


def gaps_islands(df: DataFrame, keys: Sequence[str], idx: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Runs of consecutive idx per key: the keys, first, last, n."""
    w = Window.partitionBy(*keys).orderBy(idx)
    runs = df.withColumn("island", F.col(idx) - F.row_number().over(w))
    return runs.groupBy(*keys, "island").agg(F.min(idx).alias("first"), F.max(idx).alias("last"), F.count("*").alias("n"), *extra).drop("island")


def mode_first(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """Most frequent value per group; ties go to the value seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    best = counts.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("first_seen"))).alias("v"))
    return best.select(*keys, F.col(f"v.{value}").alias(value), F.col("v.n").alias("n"))


def p95_floor(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.95) -> DataFrame:
    """The value at 0-based ascending position max(0, floor(n * share) - 1): a contract, not a percentile function."""
    w = Window.partitionBy(*keys)
    at = F.greatest(F.lit(1), F.floor(F.col("n_") * F.lit(share)).cast("int"))
    ranked = df.withColumn("n_", F.count(value).over(w)).withColumn("r_", F.row_number().over(w.orderBy(F.col(value).asc_nulls_last())))
    return ranked.where(F.col("r_") == at).select(*keys, F.col(value).alias("p95"))


def running_any(flag: Column, keys: Sequence[str], order: str, including: bool = False) -> Column:
    """Whether the flag was set on an earlier row (or on this one)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    return F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0)) == 1


def rrf_fuse(lists: Sequence[DataFrame], keys: Sequence[str], id_: str, rank: str = "rank", k: int = 60, weights: Sequence[float] | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: the keys, id, fused; plus the first list and rank that had the id."""
    weights = list(weights) if weights is not None else [1.0] * len(lists)
    if len(weights) != len(lists):
        raise ValueError("one weight for each list")
    parts = [x.select(*keys, F.col(id_), F.col(rank).alias("r_"), F.lit(i).alias("list_"), (F.lit(float(w)) / (F.lit(k) + F.col(rank))).alias("s_")) for i, (x, w) in enumerate(zip(lists, weights, strict=True))]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    got = u.groupBy(*keys, id_).agg(F.sum("s_").alias("fused"), F.min(F.struct("list_", "r_")).alias("seen"))
    return got.select(*keys, id_, "fused", F.col("seen.list_").alias("first_list"), F.col("seen.r_").alias("first_rank"))
