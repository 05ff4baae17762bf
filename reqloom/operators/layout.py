"""Page geometry: margins, running headers, text inside tables, strike lines. Columns x0, y0, x1, y1 in points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reqloom.functions.text import bbox_overlap
from reqloom.operators.blocks import blocks

# Fixed values of the page rules, in points or shares.
TOP, BOTTOM, REPEAT_SHARE, REPEAT_PAGES, LEAST_AREA, OVERLAP = 65.0, 50.0, 0.6, 20, 10.0, 0.5
BOILERPLATE = r"(?i)^\s*page \d+ of \d+\s*$|confidential|proprietary"


def box(df: DataFrame, p: str = ""):
    return F.array(*[F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")])


def in_margin(page_height="page_h"):
    return ((F.col("y0") < TOP) & (F.col("y1") < TOP)) | (F.col("y0") > F.col(page_height) - BOTTOM)


def without_margins(blocks: DataFrame) -> DataFrame:
    return blocks.where(~in_margin())


def without_boilerplate(blocks: DataFrame) -> DataFrame:
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return blocks.where((area >= LEAST_AREA) & ~F.col("text").rlike(BOILERPLATE))


def running_lines(blocks: DataFrame) -> DataFrame:
    """doc_id, norm of margin texts (digits folded) on at least 60 % of the first 20 pages."""
    b = blocks.where((F.col("page") <= REPEAT_PAGES) & in_margin()).select("doc_id", "page", F.regexp_replace(F.trim("text"), r"\d+", "#").alias("norm")).distinct()
    pages = blocks.where(F.col("page") <= REPEAT_PAGES).groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    return b.groupBy("doc_id", "norm").agg(F.count("*").alias("n")).join(pages, "doc_id").where(F.col("n") >= REPEAT_SHARE * F.col("pages")).select("doc_id", "norm")


def without_running_lines(blocks: DataFrame) -> DataFrame:
    b = blocks.withColumn("norm", F.regexp_replace(F.trim("text"), r"\d+", "#")).withColumn("edge", in_margin())
    lines = running_lines(blocks).withColumn("edge", F.lit(True))
    return b.join(lines, ["doc_id", "norm", "edge"], "left_anti").drop("norm", "edge")


def without_table_text(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Drops text of which more than half lies in a table of its page (an anti join on the page with the overlap)."""
    t = tables.select("doc_id", "page", F.array("x0", "y0", "x1", "y1").alias("tbox"))
    b, q = blocks.alias("b"), t.alias("q")
    bb = F.array(*[F.col(f"b.{c}") for c in ("x0", "y0", "x1", "y1")])
    cond = (F.col("b.doc_id") == F.col("q.doc_id")) & (F.col("b.page") == F.col("q.page")) & (bbox_overlap(bb, F.col("q.tbox")) > OVERLAP)
    return b.join(q, cond, "left_anti")


def strike_lines(drawings: DataFrame) -> DataFrame:
    """Horizontal strokes: at most 1.5 high and at least 5 long."""
    return drawings.where((F.abs(F.col("y1") - F.col("y0")) <= 1.5) & (F.abs(F.col("x1") - F.col("x0")) >= 5))


def struck_rows(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Table rows with a stroke strictly inside (a range join on the page)."""
    r, q = rows.alias("r"), lines.alias("q")
    y = (F.col("q.y0") + F.col("q.y1")) / 2
    cond = (F.col("r.doc_id") == F.col("q.doc_id")) & (F.col("r.page") == F.col("q.page")) & (y > F.col("r.y0") + 1.5) & (y < F.col("r.y1") - 1.5) & (F.col("q.x1") > F.col("r.x0")) & (F.col("q.x0") < F.col("r.x1"))
    return r.join(q, cond, "left_semi")


def struck_spans(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Text spans with a stroke near mid-height over at least half their width."""
    r, q = spans.alias("r"), lines.alias("q")
    mid, y, h = (F.col("r.y0") + F.col("r.y1")) / 2, (F.col("q.y0") + F.col("q.y1")) / 2, F.col("r.y1") - F.col("r.y0")
    over = F.least("r.x1", "q.x1") - F.greatest("r.x0", "q.x0")
    cond = (F.col("r.doc_id") == F.col("q.doc_id")) & (F.col("r.page") == F.col("q.page")) & (F.abs(mid - y) <= F.greatest(F.lit(2.0), 0.4 * h)) & (over >= 0.5 * (F.col("r.x1") - F.col("r.x0")))
    return r.join(q, cond, "left_semi")


def struck_tables(tables: DataFrame, lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Tables with enough strokes inside that cover half the width: two, or one where at most one row is left."""
    left = rows.groupBy("doc_id", "page", "table_no").agg(F.count("*").alias("n_rows"))
    t = tables.join(left, ["doc_id", "page", "table_no"], "left").alias("t")
    q = lines.alias("q")
    y = (F.col("q.y0") + F.col("q.y1")) / 2
    over = F.least("t.x1", "q.x1") - F.greatest("t.x0", "q.x0")
    cond = (F.col("t.doc_id") == F.col("q.doc_id")) & (F.col("t.page") == F.col("q.page")) & (y > F.col("t.y0") + 1.5) & (y < F.col("t.y1") - 1.5) & (over >= 0.5 * (F.col("t.x1") - F.col("t.x0")))
    hits = t.join(q, cond).groupBy("t.doc_id", "t.page", "t.table_no").agg(F.count("*").alias("n"), F.max(F.coalesce("n_rows", F.lit(0))).alias("n_rows"))
    return hits.where(F.col("n") >= F.when(F.col("n_rows") <= 1, 1).otherwise(2)).select("doc_id", "page", "table_no")


def struck_by_characters(spans: DataFrame) -> DataFrame:
    """Blocks of which more than half the characters are struck (exactly half is not)."""
    n = F.length("text")
    return spans.groupBy("doc_id", "idx").agg((F.sum(F.when(F.col("struck"), n).otherwise(0)) * 2 > F.sum(n)).alias("struck"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Dense index per document by page and top; blocks without a box come last on their page."""
    w = Window.partitionBy("doc_id").orderBy("page", F.coalesce("y0", F.lit(9999.0)), F.coalesce("x0", F.lit(9999.0)))
    return blocks.withColumn("idx", F.row_number().over(w) - 1)


def running_sides(blocks_: DataFrame) -> DataFrame:
    """The running lines of each document as header or footer: by the side of the page on which they stand more often."""
    b = blocks_.where((F.col("page") <= REPEAT_PAGES) & in_margin()).select("doc_id", "page", F.regexp_replace(F.trim("text"), r"\d+", "#").alias("norm"), (F.col("y1") < TOP).alias("above"))
    n = b.join(running_lines(blocks_), ["doc_id", "norm"]).groupBy("doc_id", "norm").agg(F.count_if("above").alias("above"), F.count("*").alias("n"))
    return n.select("doc_id", "norm", F.when(F.col("above") * 2 >= F.col("n"), "header").otherwise("footer").alias("side"))


# Fixed values of the pages on which the registered queries lay out the text corpus: twelve lines to a page.
LINES, PITCH, LEFT, CHAR_W, LINE_H, PAGE_H, PAGE_W = 12, 66.0, 72.0, 4.0, 12.0, 792.0, 540.0


def pages(spark: SparkSession, base: str) -> DataFrame:
    """Blocks of the documents on pages of LINES lines: doc_id, idx, page, type, text, x0, y0, x1, y1, page_h."""
    y0 = (F.col("idx") % LINES) * PITCH + 20
    return blocks(spark, base).select(
        "doc_id", "idx", (F.floor(F.col("idx") / LINES) + 1).cast("int").alias("page"), "type", "text", F.lit(LEFT).alias("x0"), y0.alias("y0"),
        F.least(F.lit(PAGE_W), LEFT + CHAR_W * F.length("text")).alias("x1"), (y0 + LINE_H).alias("y1"), F.lit(PAGE_H).alias("page_h"),
    )


def drawn(spark: SparkSession, base: str) -> DataFrame:
    """Strokes on those pages: through the middle of every 17th block, over three fifths or a quarter of its width, and boxes
    that are no strokes."""
    p = pages(spark, base)
    k = F.pmod(F.col("doc_id") * 31 + F.col("idx"), F.lit(17))
    mid, w = (F.col("y0") + F.col("y1")) / 2, F.col("x1") - F.col("x0")
    return p.where(k.isin(0, 1, 2)).select("doc_id", "page", "x0", F.when(k == 2, F.col("y0")).otherwise(mid - 0.5).alias("y0"), (F.col("x0") + w * F.when(k == 1, 0.25).otherwise(0.6)).alias("x1"), F.when(k == 2, F.col("y1")).otherwise(mid + 0.5).alias("y1"))


def table_boxes(spark: SparkSession, base: str) -> DataFrame:
    """The box around the table lines of each page."""
    t = pages(spark, base).where("type = 'table'")
    return t.groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def kept_in_margins(spark: SparkSession, base: str) -> DataFrame:
    return without_margins(pages(spark, base)).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))


def kept_boilerplate(spark: SparkSession, base: str) -> DataFrame:
    return without_boilerplate(pages(spark, base)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def headers_footers(spark: SparkSession, base: str) -> DataFrame:
    return running_sides(pages(spark, base))


def kept_running(spark: SparkSession, base: str) -> DataFrame:
    return without_running_lines(pages(spark, base)).groupBy("doc_id").agg(F.count("*").alias("n"))


def kept_table_text(spark: SparkSession, base: str) -> DataFrame:
    p = pages(spark, base).where("type <> 'table'")
    return without_table_text(p, table_boxes(spark, base)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("idx").alias("idxs"))


def struck_blocks(spark: SparkSession, base: str) -> DataFrame:
    """Spans and rows that a stroke strikes, by document."""
    p, q = pages(spark, base), strike_lines(drawn(spark, base))
    spans = struck_spans(p, q).groupBy("doc_id").agg(F.count("*").alias("spans"))
    rows = struck_rows(p.where("type = 'table'"), q).groupBy("doc_id").agg(F.count("*").alias("rows"))
    return spans.join(rows, "doc_id", "full_outer").select("doc_id", F.coalesce("spans", F.lit(0)).alias("spans"), F.coalesce("rows", F.lit(0)).alias("rows"))


def struck_characters(spark: SparkSession, base: str) -> DataFrame:
    """Documents' pages as blocks of spans, every third span struck where the document's id is even: struck by characters?"""
    p = pages(spark, base).select("doc_id", F.col("page").alias("idx"), "text", ((F.col("idx") % 3 != 1) & (F.col("doc_id") % 2 == 0)).alias("struck"))
    return struck_by_characters(p)


def ordered(spark: SparkSession, base: str) -> DataFrame:
    """Reading order restored from the boxes alone."""
    p = pages(spark, base).select("doc_id", F.col("idx").alias("was"), "page", "x0", "y0")
    return reading_order(p).select("doc_id", "was", "idx")
