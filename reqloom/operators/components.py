"""Connected components of an undirected graph by hooking, pointer jumping and contraction.

Each round hooks every node to its smallest neighbour, follows these pointers to their ends by doubling, and then replaces
the edges by edges between the ends; what lies inside a component falls away, so every round works on a graph of at most half
the nodes. At the end the rounds' maps are composed from the smallest to the largest. All joins have one row per node on
one side and all minima combine before the shuffle, so a hub with millions of neighbours is no single task. Every table is
written.

Defined results: null ends are ignored; self loops make a node of its own; repeated and reversed edges count once; the
component's name is its smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqloom.sources.tables import Scratch


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """edges(a, b) -> node, component (for every node that occurs in an edge)."""
    tmp = Scratch(edges.sparkSession)
    all_ = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    first = tmp.save(all_)
    e = first.where("a <> b")
    maps: list[DataFrame] = []
    while e.limit(1).count():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = tmp.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")))
        while True:
            up = to.select(F.col("node").alias("root"), F.col("root").alias("up"))
            further = tmp.save(to.join(up, "root").select("node", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")))
            moved = further.where("moved").limit(1).count()
            tmp.drop(to)
            to = further.select("node", "root")
            if not moved:
                break
        maps.append(to)
        ends = e.join(to.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(to.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        e = tmp.save(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    alone = first.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    if not maps:
        return alone
    out = maps[-1]
    for m in reversed(maps[:-1]):
        out = tmp.save(m.join(out.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", F.coalesce("last", "root").alias("root")))
    named = out.select("node", F.col("root").alias("component"))
    return named.unionByName(alone.join(named.select("node"), "node", "left_anti"))
