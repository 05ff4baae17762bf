"""The property graph of plans, requirements, features and standards: build, search, statistics.

Edges are a simple digraph: of several writes to one ordered pair the last step wins. Which requirements share a standard
is kept as membership of the standard's node, never as all pairs of its members; pair counts between plans come from
counts per standard and plan.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.functions.keys import canonical_key, spec_key
from reqloom.functions.text import release_number
from reqloom.operators.components import components
from reqloom.operators.references import resolve_standards
from reqloom.operators.understanding import DEPENDS, feature_hits
from reqloom.sources.tables import Scratch, table

DECAY = 0.7


def nid(kind: str, *cols: str):
    return F.concat_ws(":", F.lit(kind), *[F.col(c) for c in cols])


def requirement_rows(spark: SparkSession, base: str) -> DataFrame:
    """One row per req_id: its first record."""
    r = table(spark, base, "requirements").where("req_id is not null")
    return r.groupBy("req_id").agg(*[F.min_by(c, "rec_id").alias(c) for c in ("mno", "release", "plan_id", "title", "text", "section_number", "parent_req_id")])


def standard_refs(spark: SparkSession, base: str, resolved: DataFrame | None = None) -> DataFrame:
    """source_req_id, std (node id) of every reference to a standard: by section where one is given, else by release."""
    std = (resolve_standards(spark, base) if resolved is None else resolved).select("ref_id", "spec", release_number(F.col("spec_release")).alias("rel"))
    raw = table(spark, base, "refs_standards").select("ref_id", "source_req_id", "plan_id", F.nullif("spec_section", F.lit("")).alias("section")).distinct()
    j = std.join(raw, "ref_id").where("spec is not null")
    node = F.when((F.col("rel") > 0) & F.col("section").isNotNull(), F.concat_ws(":", F.lit("std"), "spec", "rel", "section")).otherwise(F.concat_ws(":", F.lit("std"), "spec", "rel"))
    return j.select("ref_id", "source_req_id", "plan_id", node.alias("std"), F.concat_ws(":", F.lit("std"), "spec", "rel").alias("std_spec"))


def nodes(spark: SparkSession, base: str, resolved: DataFrame | None = None) -> DataFrame:
    """id, node_type, plan_id of every node; edges' targets that no table describes are nodes too."""
    p = table(spark, base, "plans").select("mno", "release", "plan_id").distinct()
    none = F.lit(None).cast("string")
    out = p.select(nid("mno", "mno").alias("id"), F.lit("MNO").alias("node_type"), none.alias("plan_id")).distinct()
    out = out.unionByName(p.select(nid("release", "mno", "release").alias("id"), F.lit("Release").alias("node_type"), none.alias("plan_id")).distinct())
    out = out.unionByName(p.select(nid("plan", "mno", "release", "plan_id").alias("id"), F.lit("Plan").alias("node_type"), "plan_id"))
    out = out.unionByName(requirement_rows(spark, base).select(nid("req", "req_id").alias("id"), F.lit("Requirement").alias("node_type"), "plan_id"))
    refs = standard_refs(spark, base, resolved)
    cat = table(spark, base, "spec_catalog").select(F.concat(F.lit("std:"), spec_key(F.col("spec")), F.lit(":0")).alias("id"))
    std = refs.select(F.explode(F.array("std", "std_spec")).alias("id")).unionByName(cat).distinct()
    feats = feature_hits(spark, base).select(nid("feature", "feature_id").alias("id")).distinct()
    out = out.unionByName(feats.select("id", F.lit("Feature").alias("node_type"), none.alias("plan_id")))
    return out.unionByName(std.select("id", F.lit("Standard").alias("node_type"), none.alias("plan_id")))


def edges(spark: SparkSession, base: str, resolved: DataFrame | None = None) -> DataFrame:
    """src, dst, edge_type; per ordered pair the last step wins."""
    p = table(spark, base, "plans").select("mno", "release", "plan_id").distinct()
    r = requirement_rows(spark, base)
    req = nid("req", "req_id")
    key = r.select(req.alias("id"), canonical_key(F.col("req_id")).alias("k"), "plan_id")

    def e(df: DataFrame, src, dst, kind: str, step: int) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("edge_type"), F.lit(step).alias("step"))

    parts = [
        e(p, nid("mno", "mno"), nid("release", "mno", "release"), "has_release", 1),
        e(p, nid("release", "mno", "release"), nid("plan", "mno", "release", "plan_id"), "contains_plan", 1),
        e(r.join(p, ["mno", "release", "plan_id"], "left_semi"), req, nid("plan", "mno", "release", "plan_id"), "belongs_to", 2),
    ]
    kid = r.select(req.alias("child"), "plan_id", canonical_key(F.col("parent_req_id")).alias("k")).where("k is not null")
    parts.append(e(kid.join(key.withColumnRenamed("id", "parent"), ["k", "plan_id"]), F.col("parent"), F.col("child"), "parent_of", 3))
    internal = table(spark, base, "refs_internal").select(canonical_key(F.col("source_req_id")).alias("s"), canonical_key(F.col("target_req_id")).alias("t")).where("s is not null and t is not null and s <> t").distinct()
    a, b = key.select(F.col("k").alias("s"), F.col("id").alias("src")), key.select(F.col("k").alias("t"), F.col("id").alias("dst"))
    dep = internal.join(a, "s").join(b, "t")
    # not where the pair is linked already as parent and child, in either direction
    tree = parts[-1].select("src", "dst")
    linked = tree.unionByName(tree.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    parts.append(e(dep.join(linked, ["src", "dst"], "left_anti"), F.col("src"), F.col("dst"), "depends_on", 4))
    first_plan = p.groupBy(canonical_key(F.col("plan_id")).alias("k")).agg(F.min(nid("plan", "mno", "release", "plan_id")).alias("dst"))
    cross = table(spark, base, "refs_cross_plan").select(canonical_key(F.col("source_req_id")).alias("s"), canonical_key(F.col("target_plan_id")).alias("k")).distinct()
    parts.append(e(cross.join(first_plan, "k").join(a, "s"), F.col("src"), F.col("dst"), "depends_on", 5))
    std = standard_refs(spark, base, resolved)
    s = std.select(canonical_key(F.col("source_req_id")).alias("s"), "std").distinct().join(a, "s")
    parts.append(e(s, F.col("src"), F.col("std"), "references_standard", 6))
    sec = std.where("std <> std_spec").select("std", "std_spec").distinct()
    parts.append(e(sec, F.col("std_spec"), F.col("std"), "parent_section", 7))
    # a feature is mapped by all requirements of the plans that have it; features depend on features that are there
    feats = feature_hits(spark, base).select("plan_id", nid("feature", "feature_id").alias("feature")).distinct()
    parts.append(e(r.join(feats, "plan_id"), req, F.col("feature"), "maps_to", 8))
    known = feats.select("feature").distinct()
    deps = spark.createDataFrame([(f"feature:{a}", f"feature:{b}") for a, b in DEPENDS], "src string, dst string")
    deps = deps.join(known.withColumnRenamed("feature", "src"), "src", "left_semi").join(known.withColumnRenamed("feature", "dst"), "dst", "left_semi")
    parts.append(e(deps, F.col("src"), F.col("dst"), "feature_depends_on", 9))
    u = parts[0]
    for x in parts[1:]:
        u = u.unionByName(x)
    return u.groupBy("src", "dst").agg(F.max_by("edge_type", "step").alias("edge_type"))


def graph_stats(spark: SparkSession, base: str) -> DataFrame:
    n = nodes(spark, base).groupBy(F.lit("node").alias("what"), F.col("node_type").alias("kind")).agg(F.count("*").alias("n"))
    e = edges(spark, base).groupBy(F.lit("edge").alias("what"), F.col("edge_type").alias("kind")).agg(F.count("*").alias("n"))
    return n.unionByName(e)


def in_degree_top(spark: SparkSession, base: str, k: int = 10) -> DataFrame:
    e = edges(spark, base).where("edge_type = 'references_standard'")
    return e.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(k)


def degrees(spark: SparkSession, base: str) -> DataFrame:
    e = edges(spark, base).select("src", "dst")
    both = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def shared_standards(spark: SparkSession, base: str) -> DataFrame:
    """Pairs of requirements of different plans that share a standard, counted per unordered plan pair.

    Per standard only its counts per plan meet each other, never its requirements.
    """
    s = standard_refs(spark, base).select("std", "plan_id", "source_req_id").distinct().groupBy("std", "plan_id").agg(F.count("*").alias("n"))
    a, b = s.select("std", F.col("plan_id").alias("plan_a"), F.col("n").alias("na")), s.select("std", F.col("plan_id").alias("plan_b"), F.col("n").alias("nb"))
    j = a.join(b, "std").where("plan_a < plan_b")
    return j.groupBy("plan_a", "plan_b").agg(F.sum(F.col("na") * F.col("nb")).alias("req_pairs"), F.countDistinct("std").alias("standards"))


def bounded_bfs(edges_: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None) -> DataFrame:
    """seeds: seed, id -> seed, id, depth for every node within `depth` undirected steps over the allowed edge types.

    Unrolled frontier joins; a node counts at its smallest depth. Each frontier is distinct before it is joined.
    """
    e = edges_ if types is None else edges_.where(F.col("edge_type").isin(types))
    both = e.select(F.col("src").alias("id"), F.col("dst").alias("next")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("next"))).distinct()
    seen = seeds.select("seed", "id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        frontier = frontier.select("seed", "id").join(both, "id").select("seed", F.col("next").alias("id")).distinct().join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def bfs_depth2(spark: SparkSession, base: str) -> DataFrame:
    """Two steps around every requirement whose first rec_id is divisible by 100, over parents and dependencies."""
    e = Scratch(spark).save(edges(spark, base))
    ids = table(spark, base, "requirements").where("req_id is not null").groupBy("req_id").agg(F.min("rec_id").alias("rec_id")).where("rec_id % 100 = 0")
    seeds = ids.select(nid("req", "req_id").alias("seed"), nid("req", "req_id").alias("id"))
    found = bounded_bfs(e, seeds, 2, ["parent_of", "depends_on"])
    return found.select("seed", "id", "depth", F.round(F.pow(F.lit(DECAY), F.col("depth") + 1), 6).alias("score"))


def graph_components(spark: SparkSession, base: str) -> DataFrame:
    """Component sizes over parent and dependency edges: size, how many components have it."""
    e = edges(spark, base).where(F.col("edge_type").isin("parent_of", "depends_on"))
    sizes = components(e.select("src", "dst")).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("components"))


def hops_from(spark: SparkSession, base: str) -> DataFrame:
    """Hops from the first plan node to every plan that it reaches by undirected steps, however far.

    Level by level; a level reads only the frontier and the nodes not reached yet, each level a written table.
    """
    tmp = Scratch(spark)
    e = edges(spark, base).select("src", "dst")
    both = tmp.save(e.select(F.col("src").alias("id"), F.col("dst").alias("next")).unionByName(e.select(F.col("dst").alias("id"), F.col("src").alias("next"))).distinct())
    p = table(spark, base, "plans").select(nid("plan", "mno", "release", "plan_id").alias("id"))
    seen = tmp.save(p.agg(F.min("id").alias("id")).select("id", F.lit(0).alias("hops")))
    for d in itertools.count(1):
        edge = seen.where(F.col("hops") == d - 1).join(both, "id").select(F.col("next").alias("id")).distinct()
        new = edge.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(d))
        old, seen = seen, tmp.save(seen.unionByName(new))
        tmp.drop(old)
        if not seen.where(F.col("hops") == d).limit(1).count():
            break
    return seen.join(p.distinct(), "id", "left_semi")


def cross_plan_edges(spark: SparkSession, base: str) -> DataFrame:
    """Dependency edges whose ends lie in different plans, by ordered plan pair."""
    n = nodes(spark, base).where("plan_id is not null").select("id", "plan_id")
    e = edges(spark, base).where("edge_type = 'depends_on'")
    j = e.join(n.select(F.col("id").alias("src"), F.col("plan_id").alias("from_plan")), "src").join(n.select(F.col("id").alias("dst"), F.col("plan_id").alias("to_plan")), "dst")
    return j.where("from_plan <> to_plan").groupBy("from_plan", "to_plan").agg(F.count("*").alias("n"))


def release_discovery(spark: SparkSession, base: str) -> DataFrame:
    """Per MNO the releases, latest first, in text order and in month order."""
    p = table(spark, base, "plans").select("mno", "release").distinct()
    month = F.instr(F.lit("jan feb mar apr may jun jul aug sep oct nov dec"), F.lower(F.substring_index("release", "_", -1)))
    return p.groupBy("mno").agg(
        F.array_join(F.sort_array(F.collect_list("release"), asc=False), ",").alias("by_text"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.substring_index("release", "_", 1).alias("y"), month.alias("m"), "release")), asc=False), lambda x: x["release"]), ",").alias("by_month"),
    )


def focus_subgraph(spark: SparkSession, base: str) -> DataFrame:
    """The induced subgraph of the first plan with requirements: edges with both ends among its nodes, standards and features aside."""
    n = nodes(spark, base)
    plan = n.where("node_type = 'Requirement'").agg(F.min("plan_id").alias("plan_id"))
    inside = n.join(plan, "plan_id").select("id")
    e = edges(spark, base)
    return e.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "edge_type")


