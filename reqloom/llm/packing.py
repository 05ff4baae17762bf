"""Filling fixed-capacity containers: first-fit decreasing on a tournament tree, in randomised groups.

Items are dealt to groups by a hash of their id, about ``GROUP`` to a group, so that a group is a random sample of all
sizes whatever the order or source of the items, and every group is packed by itself: one shuffle, no group grows with
the data. Within a group items go in decreasing size to the first container with room; a tournament tree over the room
left finds it in log2 steps.

Defined results: an item larger than the capacity is cut into full containers and a rest that is packed like an item of
its own (its parts are numbered); items of size 0 or null (empty texts) need no container and come out in none. Equal
sizes go by id. A capacity below 1 and more than ``MOST_PACKS`` packs raise ValueError; repeated ids are separate items.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.llm.tokens import VOCABULARY, ship, token_count
from reqloom.sources.tables import Scratch, table

GROUP = 20_000
MOST_PACKS = 1000  # packs of one call: their definitions travel inside the plan


class Room:
    """A tournament tree over the room left in each container; a container not opened yet has the whole capacity."""

    def __init__(self, capacity: int, leaves: int) -> None:
        self.capacity, self.n = capacity, 1 << max(0, leaves - 1).bit_length()
        self.tree = [capacity] * (2 * self.n)

    def first_fit(self, size: int) -> int:
        """Puts an item into the first container with room and returns that container."""
        tree, n, i = self.tree, self.n, 1
        while i < n:
            i <<= 1
            if tree[i] < size:
                i += 1
        tree[i] -= size
        leaf = i - n
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            best = a if a > b else b
            if tree[i] == best:
                break
            tree[i] = best
        return leaf


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(container, item position, part, size of the part) of every part; containers are numbered from 0."""
    if capacity < 1:
        raise ValueError("a container must hold something")
    out, rest, full = [], [], 0
    for i, s in enumerate(sizes):
        part = 1
        while s > capacity:
            out.append((full, i, part, capacity))
            full, part, s = full + 1, part + 1, s - capacity
        if s > 0:
            rest.append((s, i, part))
    rest.sort(key=lambda x: (-x[0], x[1]))
    room = Room(capacity, len(rest))
    out += [(full + room.first_fit(s), i, part, s) for s, i, part in rest]
    return out


SCHEMA = "pack_id string, container_id string, capacity_tokens int, n_items int, used_tokens long, fill double, doc_ids array<long>, parts array<int>, part_tokens array<int>"


def pack_groups(items: DataFrame, limits: DataFrame, rows: int, per_group: int = GROUP) -> DataFrame:
    """items: doc_id, tokens; limits: pack_id, capacity_tokens (a few rows). One row per container.

    Every pack's groups are separate, so `rows` items make rows / per_group groups for each pack.
    """
    groups = max(1, -(-rows // per_group))
    dealt = items.where(F.col("tokens") > 0).withColumn("grp", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(groups)))
    packs = limits.select("pack_id", "capacity_tokens").distinct().limit(MOST_PACKS + 1).collect()
    if len(packs) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs: pack them in several calls")
    packs = [F.struct(F.lit(p.pack_id).cast("string").alias("pack_id"), F.lit(p.capacity_tokens).cast("int").alias("capacity_tokens")) for p in packs]
    packs = F.array(*packs) if packs else F.array().cast("array<struct<pack_id string, capacity_tokens int>>")
    dealt = dealt.withColumn("pack", F.explode(packs)).select("*", "pack.*").drop("pack")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pack_id, capacity, grp = key
        pdf = pdf.sort_values("doc_id", kind="stable")
        ids = pdf["doc_id"].tolist()
        boxes: dict[int, list] = {}
        for box, i, part, size in pack(pdf["tokens"].tolist(), int(capacity)):
            boxes.setdefault(box, []).append((ids[i], part, size))
        made = []
        for box, content in boxes.items():
            used = sum(x[2] for x in content)
            made.append((pack_id, f"{pack_id}-{grp}-{box}", int(capacity), len(content), used, used / capacity, [x[0] for x in content], [x[1] for x in content], [x[2] for x in content]))
        return pd.DataFrame(made, columns=["pack_id", "container_id", "capacity_tokens", "n_items", "used_tokens", "fill", "doc_ids", "parts", "part_tokens"])

    return dealt.select("pack_id", "capacity_tokens", "grp", "doc_id", "tokens").groupBy("pack_id", "capacity_tokens", "grp").applyInPandas(one, SCHEMA)


def document_tokens(spark: SparkSession, base: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, tokens of every document; written once, so that texts are tokenised once."""
    ship(spark, vocabulary)
    d = table(spark, base, "documents").select("doc_id", "source", token_count(vocabulary)("text").alias("tokens"))
    return Scratch(spark).save(d)


def p7_containers(spark: SparkSession, base: str) -> DataFrame:
    """The containers of every pack with their items and fill."""
    items = document_tokens(spark, base)
    return pack_groups(items.select("doc_id", "tokens"), table(spark, base, "pack_limits"), items.count())


def p7_coverage(spark: SparkSession, base: str) -> DataFrame:
    """Per pack: documents placed, containers over the capacity, documents whose parts do not add up or that lie in two
    containers without being larger than one, and whether the containers are at most 3 % more than their tokens need."""
    items = document_tokens(spark, base)
    boxes = pack_groups(items.select("doc_id", "tokens"), table(spark, base, "pack_limits"), items.count())
    over = boxes.groupBy("pack_id").agg(F.count_if(F.col("used_tokens") > F.col("capacity_tokens")).alias("overfull"), F.count("*").alias("n"), F.ceil(F.sum("used_tokens") / F.max("capacity_tokens")).alias("least"))
    parts = boxes.select("pack_id", "capacity_tokens", F.explode(F.arrays_zip("doc_ids", "part_tokens")).alias("p")).groupBy("pack_id", "capacity_tokens", F.col("p.doc_ids").alias("doc_id")).agg(F.sum("p.part_tokens").alias("placed"), F.count("*").alias("parts"))
    j = parts.join(items.select("doc_id", "tokens"), "doc_id")
    wrong = (F.col("placed") != F.col("tokens")) | (F.col("parts") != F.ceil(F.col("tokens") / F.col("capacity_tokens")))
    docs = j.groupBy("pack_id").agg(F.count("*").alias("docs"), F.count_if(wrong).alias("broken"))
    return docs.join(over, "pack_id").select("pack_id", "docs", "overfull", "broken", (F.col("n") <= F.ceil(F.col("least") * 1.03) + 1).alias("tight"))
