"""Document files to block rows: a directory scan with per-file errors as data, never as failures.

Formats: .docx and .xlsx (read with the standard library), .json (block files this module writes), .txt/.md. PDF needs a
layout library; where none is installed its files come out with an error. Every file is parsed where it lies, one task
per group of files; blocks of a file stay together in order.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = ("docx", "xlsx", "json", "txt", "md", "pdf")
BLOCK = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("mno", T.StringType()), T.StructField("release", T.StringType()), T.StructField("doc_type", T.StringType()),
        T.StructField("idx", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("level", T.IntegerType()), T.StructField("style", T.StringType()), T.StructField("struck", T.BooleanType()),
        T.StructField("headers", T.ArrayType(T.StringType())), T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("error", T.StringType()),
    ]
)

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
Block = dict


def path_metadata(path: str) -> tuple[str, str, str]:
    """(MNO, release, type): the two segments after `input`, else the last two folders."""
    parts = [p for p in path.split("://")[-1].replace("file:", "").split("/") if p]
    folders = parts[:-1]
    if "input" in folders and len(folders) - folders.index("input") > 2:
        i = folders.index("input")
        mno, release = folders[i + 1 : i + 3]
    else:
        mno, release = ([""] * 2 + folders)[-2:]
    return mno.upper(), release, "requirement"


def path_metadata_columns(path: Column) -> tuple[Column, Column]:
    """The same as column expressions."""
    inside = (F.regexp_extract(path, r"/input/([^/]+)/([^/]+)/[^/]*", i) for i in (1, 2))
    last = (F.regexp_extract(path, r"([^/]+)/([^/]+)/[^/]*$", i) for i in (1, 2))
    a, b = (F.coalesce(F.nullif(x, F.lit("")), y) for x, y in zip(inside, last, strict=True))
    return F.upper(a), b


def _block(kind: str, text: str = "", **more) -> Block:
    return {"type": kind, "text": text, "page": 1, "level": None, "style": "", "struck": False, "headers": [], "rows": [], **more}


def _runs(p) -> tuple[str, bool, int, int]:
    """Text, whether some run is struck, page breaks before the text and after it."""
    text, struck, lead, trail = [], False, 0, 0
    for r in p.iter(f"{_W}r"):
        prop = r.find(f"{_W}rPr")
        s = prop is not None and any((e := prop.find(f"{_W}{k}")) is not None and e.get(f"{_W}val", "true") not in ("0", "false") for k in ("strike", "dstrike"))
        for e in r:
            if e.tag == f"{_W}t":
                text.append(e.text or "")
                struck |= s and bool((e.text or "").strip())
            elif e.tag in (f"{_W}tab",):
                text.append("\t")
            elif e.tag == f"{_W}br" and e.get(f"{_W}type") == "page":
                if "".join(text).strip():
                    trail += 1
                else:
                    lead += 1
    return "".join(text), struck, lead, trail


def read_docx(data: bytes) -> list[Block]:
    """Paragraphs, headings (styles `Heading N`) and tables in body order; pages by explicit page breaks."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    out, page = [], 1
    for e in body if body is not None else []:
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            text, struck, lead, trail = _runs(e)
            page += lead
            if text.strip():
                m = re.match(r"Heading ?([1-9])$", name)
                out.append(_block("heading" if m else "paragraph", text.strip(), page=page, level=int(m[1]) if m else None, style=name, struck=struck))
            page += trail
        elif e.tag == f"{_W}tbl":
            rows = [[" ".join(_runs(p)[0].strip() for p in c.iter(f"{_W}p")).strip() for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            if not degenerate(rows[:1], rows[1:]):
                out.append(_block("table", page=page, headers=rows[0], rows=rows[1:]))
    return out


def degenerate(head: list[list[str]], rows: list[list[str]]) -> bool:
    """No content: at most one non-empty header and no cells, or a single cell."""
    cells = sum(bool(c and c.strip()) for r in rows for c in r)
    heads = sum(bool(c and c.strip()) for r in head for c in r)
    return (heads <= 1 and cells == 0) or (len(rows) == 1 and len(rows[0]) == 1 and not head)


def read_xlsx(data: bytes) -> list[Block]:
    """One heading and one table for each sheet with content; the first non-empty row is the header; rows of which all
    non-empty cells are struck are left out."""
    z = zipfile.ZipFile(io.BytesIO(data))
    names = set(z.namelist())
    shared = []
    if "xl/sharedStrings.xml" in names:
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    struck_styles: set[int] = set()
    if "xl/styles.xml" in names:
        st = ElementTree.fromstring(z.read("xl/styles.xml"))
        fonts = [f.find(f"{_S}strike") is not None and f.find(f"{_S}strike").get("val", "1") not in ("0", "false") for f in st.findall(f"{_S}fonts/{_S}font")]
        struck_styles = {i for i, x in enumerate(st.findall(f"{_S}cellXfs/{_S}xf")) if (k := int(x.get("fontId", 0))) < len(fonts) and fonts[k]}
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out: list[Block] = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        target = rels[sheet.get(f"{_R}id")].lstrip("/")
        rows = []
        for r in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_S}row"):
            cells: dict[int, tuple[str, bool]] = {}
            for c in r.findall(f"{_S}c"):
                v, inline = c.find(f"{_S}v"), c.find(f"{_S}is")
                text = "".join(t.text or "" for t in inline.iter(f"{_S}t")) if inline is not None else (v.text or "" if v is not None else "")
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                col = 0
                for ch in re.match(r"[A-Z]*", c.get("r", ""))[0]:
                    col = col * 26 + ord(ch) - 64
                cells[max(col - 1, 0)] = (text.strip(), int(c.get("s", 0)) in struck_styles)
            full = [x for x in cells.values() if x[0]]
            if full and not all(s for _, s in full):
                rows.append([cells.get(i, ("", False))[0] for i in range(max(cells) + 1)])
        if rows:
            out.append(_block("heading", sheet.get("name", ""), level=1, page=len(out) // 2 + 1))
            out.append(_block("table", headers=rows[0], rows=rows[1:], page=len(out) // 2 + 1))
    return out


def read_text(data: bytes) -> list[Block]:
    """Lines as paragraphs; a form feed starts a page."""
    out = []
    for page, part in enumerate(data.decode("utf-8", "replace").split("\f"), 1):
        out += [_block("paragraph", x.strip(), page=page) for x in part.splitlines() if x.strip()]
    return out


def read_json(data: bytes) -> list[Block]:
    """A block file: {"content_blocks": [...]} with any of the block fields."""
    out = []
    for b in json.loads(data).get("content_blocks", []):
        pos = b.get("position", {})
        out.append(_block(b.get("type", "paragraph"), b.get("text", "") or "", page=pos.get("page", 1), level=b.get("level"), style=b.get("style", "") or "", struck=bool((b.get("font_info") or {}).get("strikethrough")), headers=b.get("headers") or [], rows=b.get("rows") or [], order=pos.get("index")))
    if all(b.get("order") is not None for b in out):
        out.sort(key=lambda b: b["order"])
    return out


def read_pdf(data: bytes) -> list[Block]:
    try:
        import fitz
    except ImportError:
        raise RuntimeError("no PDF library is installed") from None
    out = []
    for n, page in enumerate(fitz.open(stream=data, filetype="pdf"), 1):
        out += [_block("paragraph", b[4].strip(), page=n) for b in sorted(page.get_text("blocks"), key=lambda b: b[1]) if b[4].strip()]
    return out


READERS: dict[str, Callable[[bytes], list[Block]]] = {"docx": read_docx, "xlsx": read_xlsx, "txt": read_text, "md": read_text, "json": read_json, "pdf": read_pdf}


def parse_file(path: str, data: bytes) -> list[tuple]:
    mno, release, kind = path_metadata(path)
    suffix = path.rsplit(".", 1)[-1].lower()
    try:
        found = READERS[suffix](data)
        warn = None
    except Exception as e:  # noqa: BLE001 - a bad file is a row with its error
        found, warn = [], f"{type(e).__name__}: {e}"[:300]
    rows = [(path, mno, release, kind, i, b["page"], b["type"], b["text"], b["level"], b["style"], b["struck"], b["headers"], b["rows"], None) for i, b in enumerate(found)]
    return rows or [(path, mno, release, kind, None, None, None, None, None, None, None, None, None, warn or "no blocks")]


def read_blocks(spark: SparkSession, root: str) -> DataFrame:
    """All blocks of all known files below `root`; a file that cannot be read is one row with `error`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join([*SUFFIXES, *map(str.upper, SUFFIXES)]) + "}").load(root)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                yield pd.DataFrame(parse_file(path, bytes(data)), columns=BLOCK.names)

    return files.select("path", "content").mapInPandas(parse, BLOCK)


def stream_blocks(spark: SparkSession, root: str) -> DataFrame:
    """The same for files that arrive: a file stream of contents, parsed as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                if path.rsplit(".", 1)[-1].lower() in SUFFIXES:
                    yield pd.DataFrame(parse_file(path, bytes(data)), columns=BLOCK.names)

    return files.select("path", "content").mapInPandas(parse, BLOCK)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Files with a readable size, in the order of their lower-case names."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    k = F.col("length")
    size = F.when(k < 1024, F.format_string("%d B", k)).when(k < 1024**2, F.format_string("%.1f KB", k / 1024)).when(k < 1024**3, F.format_string("%.1f MB", k / 1024**2)).otherwise(F.format_string("%.1f GB", k / 1024**3))
    return f.select("path", "length", size.alias("size")).orderBy(F.lower(F.substring_index("path", "/", -1)), "path")


def spec_sections(blocks: DataFrame) -> DataFrame:
    """Spec documents: headings `number<tab>title` or `Annex X` open sections; text up to the next one is their body."""
    from pyspark.sql import Window

    head = (F.col("type") == "heading") & F.col("text").rlike(r"^([0-9A-Z]+(\.[0-9A-Za-z]+)*\t|Annex [A-Z])")
    w = Window.partitionBy("path").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    b = blocks.where("error is null").withColumn("head", head.cast("int")).withColumn("sec", F.sum("head").over(w)).where("sec > 0")
    first = F.min_by("text", "idx")
    number = F.when(F.startswith(F.col("heading"), F.lit("Annex")), F.regexp_extract("heading", r"^Annex [A-Z]", 0)).otherwise(F.substring_index("heading", "\t", 1))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head") == 0, F.struct("idx", "text")))), lambda x: x["text"]), "\n")
    g = b.groupBy("path", "sec").agg(first.alias("heading"), body.alias("text"))
    return g.select("path", "sec", number.alias("number"), F.trim(F.regexp_replace("heading", r"^([^\t]*\t|Annex [A-Z]\s*)", "")).alias("title"), "text")


# How a spec's front page names its number, version and release.
FRONT_SPEC = r"(?:3GPP\s+)?TS\s+([0-9]{2}[.][0-9]{3})"
FRONT_VERSION = r"\bV\s?([0-9]+[.][0-9]+[.][0-9]+)"
FRONT_RELEASE = r"(?i)release\s+([0-9]+)"


def spec_front_matter(blocks: DataFrame, lines: int = 40) -> DataFrame:
    """path, spec, version, release_num, title of spec documents, from the first lines before the first section: the first
    number, version and release named; the release follows from the version where none is. Null where nothing is named."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("idx")
    b = blocks.where("error is null and text is not null").withColumn("n", F.row_number().over(w)).where(F.col("n") <= lines)

    def first(pattern: str):
        v = F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
        return F.min_by(v, F.when(v.isNotNull(), F.col("n")))

    title = F.min_by("text", F.when((F.col("type") != "table") & ~F.col("text").rlike(f"{FRONT_SPEC}|{FRONT_VERSION}|{FRONT_RELEASE}"), F.col("n")))
    g = b.groupBy("path").agg(first(FRONT_SPEC).alias("spec"), first(FRONT_VERSION).alias("version"), first(FRONT_RELEASE).alias("rel"), title.alias("title"))
    return g.select("path", "spec", "version", F.coalesce("rel", F.substring_index("version", ".", 1)).cast("int").alias("release_num"), "title")


def save_documents(blocks: DataFrame, path: str) -> None:
    """Blocks as JSON documents, one line each, that `load_documents` reads back; a document's blocks are at most some ten
    thousand."""
    cols = [c for c in blocks.columns if c != "path"]
    b = blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in cols if c != "idx"]))).alias("blocks"))
    b.write.mode("overwrite").json(path)


def load_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What `save_documents` wrote; `schema` is that of the blocks without `path`."""
    d = spark.read.schema(f"path string, blocks array<struct<{schema}>>").json(path)
    return d.select("path", F.explode("blocks").alias("b")).select("path", "b.*")
