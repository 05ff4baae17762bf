"""Ordered document blocks: classification, filters, sections, ranges. Windows are per document.

`idx` is a block's place in its document and the only ordering key; nothing relies on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions import text as tx
from reqloom.operators.patterns import gaps_islands, mode_first, once
from reqloom.sources.tables import table

# How lines of the text corpus show what they are.
HEADING = r"^(=== .* ===|#[0-9]+|Scope: .*|CR-[0-9]+ \| .*|\[[0-9]{2}\.[0-9]{3}\] .*)\r?$"
LIST_ITEM = r"^\s*([-*•>]|\(?[0-9]+[.)])\s+"
REQ_LINE = r"[A-Z]{2}_REQ_[A-Z]+_[0-9]+"


def blocks(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, source, idx, text, type of every line of every document; blank lines are no blocks."""
    d = table(spark, base, "documents").where("text is not null")
    b = d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    b = b.select("doc_id", "source", "idx", F.trim(F.regexp_replace("line", "\r", "")).alias("text")).where("text <> ''")
    kind = F.when(F.startswith("text", F.lit("|")), "table").when(F.col("text").rlike(HEADING), "heading").when(F.col("text").rlike(LIST_ITEM), "list").otherwise("paragraph")
    return b.withColumn("type", kind)


def doc_window(order: str = "idx"):
    return Window.partitionBy("doc_id").orderBy(order)


def reindexed(spark: SparkSession, base: str) -> DataFrame:
    """Blocks with a dense 0-based index per document."""
    return blocks(spark, base).select("doc_id", "idx", (F.row_number().over(doc_window()) - 1).alias("dense"), "type", F.length("text").alias("chars"))


def type_counts(spark: SparkSession, base: str) -> DataFrame:
    """Blocks by source and type, with subtotals (cube)."""
    return blocks(spark, base).cube("source", "type").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.grouping_id().alias("gid"))


def table_blocks(spark: SparkSession, base: str) -> DataFrame:
    return blocks(spark, base).where("type = 'table'").select("doc_id", "idx", F.size(F.split("text", r"\|")).alias("cells"))


def normal_line(c: Column) -> Column:
    return F.regexp_replace(c, "[0-9]+", "#")


def repeated_lines(spark: SparkSession, base: str, share: float = 0.02) -> DataFrame:
    """Headers and footers: normalised lines in at least `share` of a source's documents; what is left without them.

    Lines are reduced to distinct (source, line, document) and counted, both with partial aggregation, before the few
    that repeat meet the blocks in an anti join.
    """
    b = blocks(spark, base).withColumn("norm", normal_line(F.col("text")))
    docs = b.groupBy("source").agg(F.countDistinct("doc_id").alias("docs"))
    per = b.select("source", "norm", "doc_id").distinct().groupBy("source", "norm").agg(F.count("*").alias("n"))
    rep = per.join(docs, "source").where(F.col("n") >= F.greatest(F.lit(2.0), F.lit(share) * F.col("docs"))).select("source", "norm")
    left = b.join(rep, ["source", "norm"], "left_anti")
    return left.groupBy("source").agg(F.count("*").alias("blocks"), F.countDistinct("doc_id").alias("docs"))


def toc_ratio(spark: SparkSession, base: str, at_least: float = 0.3) -> DataFrame:
    """Documents of two or more lines of which at least this share ends in a number (the table-of-contents rule)."""
    b = blocks(spark, base).where("type in ('paragraph', 'list')")
    hit = F.count_if(F.col("text").rlike(r"[0-9]+\.?$"))
    g = b.groupBy("doc_id").agg(F.count("*").alias("n"), hit.alias("hits"))
    return g.where((F.col("n") >= 2) & (F.col("hits") / F.col("n") >= at_least))


def sections(spark: SparkSession, base: str, lines: DataFrame | None = None) -> DataFrame:
    """Blocks into sections: a heading opens one, what follows attaches, blocks before the first heading are dropped."""
    b = (blocks(spark, base) if lines is None else lines).withColumn("section", F.sum((F.col("type") == "heading").cast("int")).over(doc_window().rowsBetween(Window.unboundedPreceding, 0)))
    b = b.where("section > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") != "heading", F.struct("idx", "text")))), lambda x: x["text"]), "\n")
    return b.groupBy("doc_id", "section").agg(F.min_by("text", "idx").alias("title"), F.count_if(F.col("type") == "table").alias("tables"), body.alias("body"))


def first_section_wins(spark: SparkSession, base: str) -> DataFrame:
    """Of sections of a document with one (digit-free) title only the first counts; later ones become its body."""
    s = sections(spark, base).withColumn("key", normal_line(F.col("title")))
    w = Window.partitionBy("doc_id", "key").orderBy("section")
    return s.withColumn("nth", F.row_number().over(w)).groupBy("doc_id", "key").agg(F.min("section").alias("section"), F.count("*").alias("merged"), F.sum("tables").alias("tables"))


def ranges(spark: SparkSession, base: str) -> DataFrame:
    """Runs of consecutive blocks of one type (gaps and islands)."""
    b = reindexed(spark, base).where("type <> 'paragraph'")
    return gaps_islands(b, ["doc_id", "type"], "dense").select("doc_id", "type", F.col("first").alias("start"), F.col("last").alias("end"), "n")


def spans(spark: SparkSession, base: str) -> DataFrame:
    """First start and last end of each type's ranges in a document."""
    return ranges(spark, base).groupBy("doc_id", "type").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_ranges"))


def annotated(spark: SparkSession, base: str) -> DataFrame:
    """Each block with the table range it lies in: an interval join within a document, as a running last start.

    Ranges of one type do not overlap, so the range that starts last at or before a block is the only candidate.
    """
    r = ranges(spark, base).where("type = 'table'").select("doc_id", F.col("start").alias("at"), F.lit(0).alias("side"), F.struct("start", "end").alias("r"))
    b = reindexed(spark, base).select("doc_id", F.col("dense").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<start:int,end:int>").alias("r"))
    w = Window.partitionBy("doc_id").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    u = b.unionByName(r).withColumn("r", F.last("r", ignorenulls=True).over(w)).where("side = 1")
    inside = F.col("at") <= F.col("r.end")
    return u.select("doc_id", F.col("at").alias("dense"), F.when(inside, F.col("r.start")).alias("range_start"))


def consumed_after_heading(spark: SparkSession, base: str) -> DataFrame:
    """Revision-history rule: after a marked heading, non-paragraph blocks drop until the next paragraph."""
    b = reindexed(spark, base).join(blocks(spark, base).select("doc_id", "idx", "text"), ["doc_id", "idx"])
    mark = F.when((F.col("type") == "heading") & F.startswith("text", F.lit("CR-")), "open").when(F.col("type") == "paragraph", "close")
    w = doc_window("dense").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("state", F.last(mark, ignorenulls=True).over(w)).where("state = 'open'").groupBy("doc_id").agg(F.count("*").alias("dropped"))


def req_id_of_section(spark: SparkSession, base: str) -> DataFrame:
    """The first requirement id of each section's blocks; ids before any heading go to the first section without one."""
    b = blocks(spark, base).withColumn("section", F.sum((F.col("type") == "heading").cast("int")).over(doc_window().rowsBetween(Window.unboundedPreceding, 0)))
    ids = b.select("doc_id", "idx", "section", F.regexp_extract("text", REQ_LINE, 0).alias("rid")).where("rid <> ''")
    own = ids.where("section > 0").groupBy("doc_id", "section").agg(F.min_by("rid", "idx").alias("rid"))
    pending = ids.where("section = 0").groupBy("doc_id").agg(F.max_by("rid", "idx").alias("pending"))
    first = b.where("section = 1").select("doc_id", "section").distinct().join(pending, "doc_id")
    j = own.join(first, ["doc_id", "section"], "full_outer")
    return j.select("doc_id", "section", F.coalesce("rid", "pending").alias("rid"))


def surrounding(spark: SparkSession, base: str) -> DataFrame:
    """For each table range's first block: the last two text blocks before it, 200 characters each.

    Every text block carries itself and the text before it; a block takes over the last of these pairs: two running last
    values, linear in the document.
    """
    b = blocks(spark, base)
    w = doc_window().rowsBetween(Window.unboundedPreceding, -1)
    is_text = F.col("type") != "table"
    b = b.withColumn("own", F.when(is_text, F.substring("text", 1, 200))).withColumn("before", F.last("own", ignorenulls=True).over(w))
    b = b.withColumn("pair", F.when(is_text, F.concat_ws("\n", "before", "own"))).withColumn("around", F.coalesce(F.last("pair", ignorenulls=True).over(w), F.lit("")))
    prev = F.lag("type").over(doc_window())
    return b.withColumn("prev", prev).where("type = 'table' and (prev is null or prev <> 'table')").select("doc_id", "idx", F.trim(F.col("around"), F.lit("\n")).alias("around"))


def size_runs(spark: SparkSession, base: str, step: int = 200) -> DataFrame:
    """Runs of blocks whose length changes by no more than `step` from one to the next (the font-run rule on lengths)."""
    b = blocks(spark, base).withColumn("size", F.length("text"))
    jump = F.coalesce((F.abs(F.col("size") - F.lag("size").over(doc_window())) > step).cast("int"), F.lit(0))
    b = b.withColumn("jump", jump).withColumn("run", F.sum("jump").over(doc_window().rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("doc_id", "run").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def continuation(spark: SparkSession, base: str) -> DataFrame:
    """Headings directly after a heading once a table was seen: they continue its title."""
    b = blocks(spark, base)
    seen = F.coalesce(F.max((F.col("type") == "table").cast("int")).over(doc_window().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    prev = F.lag("type").over(doc_window())
    return b.select("doc_id", "idx", "type", (seen & (prev == "heading")).alias("continues")).where("type = 'heading'").select("doc_id", "idx", F.coalesce("continues", F.lit(False)).alias("continues"))


def paragraphs_page(spark: SparkSession, base: str) -> DataFrame:
    """Page of each block, a blank line being a page break: running count of breaks, and blocks per page."""
    d = table(spark, base, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    blank = (F.trim(F.regexp_replace("line", "\r", "")) == "").cast("int")
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    p = d.withColumn("blank", blank).withColumn("page", 1 + F.sum("blank").over(w)).where("blank = 0")
    return p.groupBy("doc_id", "page").agg(F.count("*").alias("blocks"))


def strike_cascade(spark: SparkSession, base: str) -> DataFrame:
    """Requirements dropped by a deleted heading at or above them: of a section tree the region of a struck heading ends at the
    next heading of its depth or above, which in numbering order is its subtree. So a section is dropped when one of its
    prefixes is struck: a join on prefixes, without a scan of the plan."""
    r = once(table(spark, base, "requirements").where("section_number is not null"), "rec_id")
    struck = r.where("deleted_at is not null").select("mno", "release", "plan_id", F.col("section_number").alias("prefix")).distinct()
    up = r.select("rec_id", "mno", "release", "plan_id", F.explode(tx.section_prefixes(F.col("section_number"))).alias("prefix"))
    return up.join(struck, ["mno", "release", "plan_id", "prefix"]).groupBy("rec_id").agg(F.min(tx.section_depth(F.col("prefix"))).alias("struck_depth"))


def struck_majority(spark: SparkSession, base: str) -> DataFrame:
    """Plans of whose requirement text more than half the characters are struck (exactly half is not)."""
    r = once(table(spark, base, "requirements"), "rec_id")
    n = F.coalesce(F.length("text"), F.lit(0))
    g = r.groupBy("plan_id").agg(F.sum(F.when(F.col("deleted_at").isNotNull(), n).otherwise(0)).alias("struck"), F.sum(n).alias("total"))
    return g.select("plan_id", "struck", "total", (F.col("struck") * 2 > F.col("total")).alias("is_struck"))


def body_size(spark: SparkSession, base: str) -> DataFrame:
    """Most frequent rounded block length of each source's paragraphs (ties: the one seen first)."""
    b = blocks(spark, base).where("type = 'paragraph'").select("source", (F.round(F.length("text") / 20) * 20).cast("int").alias("size"), (F.col("doc_id") * 100000 + F.col("idx")).alias("ord"))
    return mode_first(b, ["source"], "size", "ord")


def heading_clusters(spark: SparkSession, base: str) -> DataFrame:
    """Heading shapes by source: digit-free first word, count, and up to five first samples (80 characters)."""
    h = blocks(spark, base).where("type = 'heading'").select("source", F.substring_index(normal_line(F.col("text")), " ", 1).alias("shape"), F.col("doc_id"), "idx", F.substring("text", 1, 80).alias("sample"))
    w = Window.partitionBy("source", "shape").orderBy("doc_id", "idx")
    top = h.withColumn("rn", F.row_number().over(w)).where("rn <= 5")  # bounded before it is collected
    samples = top.groupBy("source", "shape").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "sample"))), lambda x: x["sample"]), " / ").alias("samples"))
    counts = h.groupBy("source", "shape").agg(F.count("*").alias("n")).where("n >= 3")
    return counts.join(samples, ["source", "shape"])


# Candidate patterns of the requirement-id election, in order.
CANDIDATES = [("underscored", r"[A-Z]{2}_REQ_[A-Z]+_[0-9]+"), ("dashed", r"[A-Z]{2}-REQ-[A-Z]+-[0-9]+"), ("change", r"CR-[0-9]+"), ("hash", r"#[0-9]+")]


def pattern_election(spark: SparkSession, base: str) -> DataFrame:
    """Matches of each candidate pattern over all texts; the first of the most frequent is elected."""
    d = table(spark, base, "documents").where("text is not null")
    g = d.agg(*[F.sum(F.regexp_count("text", F.lit(p))).alias(n) for n, p in CANDIDATES])
    rows = g.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("pattern"), F.coalesce(F.col(n), F.lit(0)).alias("matches")) for i, (n, _) in enumerate(CANDIDATES)])).alias("r")).select("r.*")
    best = rows.agg(F.max_by("ord", F.struct("matches", -F.col("ord"))).alias("best"))
    return rows.crossJoin(F.broadcast(best)).select("pattern", "matches", (F.col("ord") == F.col("best")).alias("elected"))  # one row


def profile_counts(spark: SparkSession, base: str, lines: DataFrame | None = None) -> DataFrame:
    """One pass per source: numbered lines, ids, greatest number of bars, longest block, distinct sizes."""
    b = blocks(spark, base) if lines is None else lines
    return b.groupBy("source").agg(
        F.count_if(F.col("text").rlike(r"^[0-9]+(\.[0-9]+)*\s")).alias("numbered"), F.sum(F.regexp_count("text", F.lit(REQ_LINE))).alias("ids"),
        F.max(F.length("text")).alias("longest"), F.countDistinct(F.length("text")).alias("sizes"), F.count_if(F.col("type") == "heading").alias("headings"),
    )
