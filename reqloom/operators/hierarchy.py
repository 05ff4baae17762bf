"""Parent-child links to full hierarchies, by heavy-path decomposition.

1. *Pointer doubling* follows parents 1, 2, 4, ... steps, so a tree of depth D takes log2 D rounds. The same rounds add
   up subtree sizes: the descendants nearer than 2^(k+1) are those nearer than 2^k plus those of the nodes 2^k below.
2. *Cycle separation*: a node that reaches no root lies on or below a cycle. Doubling on among those until the set of
   nodes arrived at stops shrinking leaves exactly the nodes on cycles.
3. *Heavy paths*: each node keeps its largest child; the nodes linked this way form chains, and any path to a root
   crosses at most log2 n chains. Chains are found by doubling over heavy links.
4. A chain's prefix is the concatenation of the segments of the chains above it (doubling over chains, so log2 log2 n
   rounds); a node's path is its chain's prefix plus its own place in the chain. Pre-order numbers follow the same way:
   along a chain they are consecutive, so a node's descendants are the numbers (pre, last] of its root's tree.

Every round reads and writes tables, no group is collected but a chain (which is itself one node's path), and joins have
one row per key on one side, so a hot parent is split by the engine's skew join and sums combine before the shuffle.

Defined results: a null parent is a root; a parent that does not exist makes its node a root flagged ``no_parent``; a
node that is its own parent is a cycle; repeated rows of a node count once (the smallest parent wins should they
disagree); a null id is no node. Nodes on or below cycles have no root, depth or path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions.keys import canonical_key, strip_space
from reqloom.sources.tables import Scratch, table

SIBLINGS = 4096  # light siblings that one window group holds on average
DEEP = 15


def _double(tmp: Scratch, state: DataFrame, sums: bool) -> tuple[DataFrame, int]:
    """Jump pointers until no node is left that still can arrive.

    state: id, anc, dist, done, cnt. Nodes not done have `anc` exactly 2^k steps above. Returns the state and how many
    nodes never arrive (they follow a cycle).
    """
    state = tmp.save(state)
    left = state.where(~F.col("done")).count()
    while left:
        go, right = state.where(~F.col("done")), state.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        moved = go.join(right, "anc").select("id", F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), "cnt")
        new = moved.unionByName(state.where("done"))
        if sums:
            more = go.groupBy(F.col("anc").alias("id")).agg(F.sum("cnt").alias("more"))
            new = new.join(more, "id", "left").withColumn("cnt", F.col("cnt") + F.coalesce("more", F.lit(0))).drop("more")
        new = tmp.save(new)
        tmp.drop(state)
        state, before = new, left
        left = state.where(~F.col("done")).count()
        if left == before:
            break
    return state, left


def _on_cycles(tmp: Scratch, lost: DataFrame) -> DataFrame:
    """Of nodes that never arrive (id, anc), the ids that lie on a cycle."""
    lost = tmp.save(lost)
    reached = lost.select("anc").distinct().count()
    while True:
        right = lost.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"))
        new = tmp.save(lost.join(right, "anc").select("id", F.col("anc2").alias("anc")))
        now = new.select("anc").distinct().count()
        tmp.drop(lost)
        lost = new
        if now == reached:
            return lost.select(F.col("anc").alias("id")).distinct()
        reached = now


def hierarchy(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """nodes: tree, name, id, parent (id and parent comparable strings, unique over all trees).

    Returns tree, name, state (null, no_parent, cycle, into_cycle), root, depth, path (array of names from the root),
    subtree_size, pre, last. The last six are null for nodes on or below cycles.
    """
    tmp = Scratch(spark)
    nodes = nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("tree").alias("tree"), F.min("name").alias("name"), F.min("parent").alias("parent"))
    nodes = tmp.save(nodes)
    there = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    linked = nodes.join(there, "parent", "left").select("id", "tree", "name", F.when(F.col("there"), F.col("parent")).alias("parent"), (F.col("parent").isNotNull() & F.col("there").isNull()).alias("orphan"))
    linked = tmp.save(linked)
    tmp.drop(nodes)

    start = linked.select("id", F.coalesce("parent", "id").alias("anc"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("dist"), F.col("parent").isNull().alias("done"), F.lit(1).cast("long").alias("cnt"))
    state, lost = _double(tmp, start, sums=True)
    bad = None
    if lost:
        off = state.where(~F.col("done")).select("id", "anc")
        ring = _on_cycles(tmp, off).withColumn("ring", F.lit(True))
        bad = tmp.save(off.select("id").join(ring, "id", "left").select("id", F.when(F.col("ring"), "cycle").otherwise("into_cycle").alias("state")))
    tree = tmp.save(linked.join(state.where("done"), "id").select("id", "tree", "name", "parent", "orphan", F.col("anc").alias("root"), F.col("cnt").alias("size")))

    # heavy child of each parent, and what is needed to number its light ones
    kids = tree.where(F.col("parent").isNotNull()).groupBy("parent").agg(F.max(F.struct("size", "id")).alias("big"), F.count("*").alias("kids"))
    kids = tmp.save(kids.select("parent", F.col("big.id").alias("heavy"), F.col("big.size").alias("heavy_size"), "kids"))
    marked = tree.join(kids.select(F.col("heavy").alias("id"), F.lit(True).alias("is_heavy")), "id", "left")
    chain_start = marked.select("id", F.when(F.col("is_heavy"), F.col("parent")).otherwise(F.col("id")).alias("anc"), F.when(F.col("is_heavy"), 1).otherwise(0).alias("dist"), F.col("is_heavy").isNull().alias("done"), F.lit(0).cast("long").alias("cnt"))
    chain_of, _ = _double(tmp, chain_start, sums=False)
    placed = tmp.save(tree.join(chain_of.select("id", F.col("anc").alias("head"), F.col("dist").alias("pos")), "id"))
    tmp.drop(state, tree, chain_of)

    chains = tmp.save(placed.groupBy("head").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "size", "orphan"))).alias("members"), F.min("tree").alias("tree"), F.min("root").alias("root")))

    # light heads: where they hang, and how far below their parent's number they start
    light = placed.where((F.col("pos") == 0) & F.col("parent").isNotNull()).select(F.col("id").alias("head"), "parent", "size")
    at = placed.select(F.col("id").alias("parent"), F.col("head").alias("up"), F.col("pos").alias("up_pos")).join(kids.select("parent", "heavy_size", "kids"), "parent")
    hung = light.join(at, "parent").withColumn("bucket", F.expr(f"pmod(xxhash64(head), (kids + {SIBLINGS} - 1) div {SIBLINGS})"))
    per_bucket = hung.groupBy("parent", "bucket").agg(F.sum("size").alias("total"))
    over_buckets = Window.partitionBy("parent").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.select("parent", "bucket", F.coalesce(F.sum("total").over(over_buckets), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("parent", "bucket").orderBy("head").rowsBetween(Window.unboundedPreceding, -1)
    hung = hung.withColumn("inside", F.coalesce(F.sum("size").over(in_bucket), F.lit(0))).join(per_bucket, ["parent", "bucket"])
    hung = hung.select("head", "up", "up_pos", (1 + F.col("heavy_size") + F.col("before") + F.col("inside") + F.col("up_pos")).alias("shift"))
    keys = chains.select(F.col("head").alias("up"), F.transform("members", lambda m: m["name"]).alias("names"))
    segments = hung.join(keys, "up").select("head", F.col("up").alias("anc"), "shift", F.expr("slice(names, 1, up_pos + 1)").alias("prefix"))

    # concatenate segments up to the root's chain
    top = chains.select("head").join(segments, "head", "left").select("head", F.coalesce("anc", "head").alias("anc"), F.coalesce("shift", F.lit(0)).alias("shift"), F.coalesce("prefix", F.array().cast("array<string>")).alias("prefix"), F.col("anc").isNull().alias("done"))
    top = tmp.save(top)
    while top.where(~F.col("done")).limit(1).count():
        right = top.select(F.col("head").alias("anc"), F.col("anc").alias("anc2"), F.col("shift").alias("shift2"), F.col("prefix").alias("prefix2"), F.col("done").alias("done2"))
        new = top.where(~F.col("done")).join(right, "anc").select("head", F.col("anc2").alias("anc"), (F.col("shift") + F.col("shift2")).alias("shift"), F.concat("prefix2", "prefix").alias("prefix"), F.col("done2").alias("done"))
        new = tmp.save(new.unionByName(top.where("done")))
        tmp.drop(top)
        top = new

    whole = chains.join(top.select("head", "shift", "prefix"), "head").withColumn("names", F.transform("members", lambda m: m["name"]))
    out = whole.select("tree", "root", "shift", "prefix", "names", F.explode("members").alias("m")).select(
        "tree",
        F.col("m.name").alias("name"),
        F.when(F.col("m.orphan"), "no_parent").alias("state"),
        "root",
        (F.size("prefix") + F.col("m.pos")).alias("depth"),
        F.concat("prefix", F.expr("slice(names, 1, m.pos + 1)")).alias("path"),
        F.col("m.size").alias("subtree_size"),
        (F.col("shift") + F.col("m.pos")).alias("pre"),
        (F.col("shift") + F.col("m.pos") + F.col("m.size") - 1).alias("last"),
    )
    if bad is not None:
        out = out.unionByName(linked.join(bad, "id").select("tree", "name", "state"), allowMissingColumns=True)
    return out


def requirement_nodes(spark: SparkSession, base: str) -> DataFrame:
    """Requirements as nodes: one per req_id, parents by the key rule."""
    r = table(spark, base, "requirements")
    return r.select(F.concat(F.lit("requirement"), F.lit("\t"), F.coalesce("plan_id", F.lit(""))).alias("tree"), F.col("req_id").alias("name"), F.concat(F.lit("r\t"), canonical_key(F.col("req_id"))).alias("id"), F.concat(F.lit("r\t"), canonical_key(F.col("parent_req_id"))).alias("parent"))


def section_nodes(spark: SparkSession, base: str) -> DataFrame:
    """Spec sections as nodes: one per number of a parsed file, parents trimmed and then equal."""
    s = table(spark, base, "spec_sections")
    ingest = F.col("spec_ingest_id").cast("string")
    return s.select(F.concat(F.lit("spec_section"), F.lit("\t"), ingest).alias("tree"), F.col("number").alias("name"), F.concat(F.lit("s\t"), ingest, F.lit("\t"), F.col("number")).alias("id"), F.concat(F.lit("s\t"), ingest, F.lit("\t"), strip_space(F.col("parent_number"))).alias("parent"))


def plan_hierarchies(spark: SparkSession, base: str) -> DataFrame:
    """Both hierarchies in one pass: hier, tree_key, node_key and what `hierarchy` gives."""
    h = hierarchy(spark, requirement_nodes(spark, base).unionByName(section_nodes(spark, base)))
    parts = F.split("tree", "\t", 2)
    return h.select(parts[0].alias("hier"), parts[1].alias("tree_key"), F.col("name").alias("node_key"), *[c for c in h.columns if c not in ("tree", "name")])


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    state = F.coalesce("state", F.when(F.col("depth") >= DEEP, "deep"))
    return plan_hierarchies(spark, base).select("hier", "tree_key", "node_key", state.alias("state")).where(F.col("state").isNotNull())


def p6_hierarchy(spark: SparkSession, base: str) -> DataFrame:
    """Root, depth, path and number of descendants of every node that reaches a root."""
    h = plan_hierarchies(spark, base).where(F.col("depth").isNotNull())
    return h.select("hier", "tree_key", "node_key", F.col("path")[0].alias("root_key"), F.col("depth").cast("long").alias("depth"), F.array_join("path", " > ").alias("path"), (F.col("subtree_size") - 1).alias("n_descendants"))


def p6_intervals(spark: SparkSession, base: str) -> DataFrame:
    """All descendants of every node, as the interval (pre, last] of pre-order numbers of its root's tree."""
    h = plan_hierarchies(spark, base).where(F.col("depth").isNotNull())
    return h.select("hier", "tree_key", "node_key", F.col("path")[0].alias("root_key"), "pre", "last")


def p6_interval_check(spark: SparkSession, base: str) -> DataFrame:
    """Per root: nodes, and whether the numbers are 0 to n - 1, each once, and every node's interval lies within its parent's."""
    h = Scratch(spark).save(plan_hierarchies(spark, base).where(F.col("depth").isNotNull()))
    up = h.select("hier", "root", F.col("node_key").alias("up"), F.col("pre").alias("up_pre"), F.col("last").alias("up_last"))
    kids = h.where(F.size("path") > 1).withColumn("up", F.element_at("path", -2)).join(up, ["hier", "root", "up"])
    within = (F.col("pre") > F.col("up_pre")) & (F.col("last") <= F.col("up_last"))
    inside = kids.groupBy("hier", "root").agg(F.count_if(within).alias("inside"))
    g = h.groupBy("hier", "root", F.col("path")[0].alias("root_key")).agg(F.min("tree_key").alias("tree_key"), F.count("*").alias("n"), F.countDistinct("pre").alias("numbers"), F.min("pre").alias("low"), F.max("pre").alias("high"))
    ok = (F.col("numbers") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.coalesce("inside", F.lit(0)) == F.col("n") - 1)
    return g.join(inside, ["hier", "root"], "left").select("hier", "tree_key", "root_key", "n", ok.alias("ok"))
