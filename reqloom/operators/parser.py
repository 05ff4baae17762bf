"""The structural parser: ordered blocks of documents to requirement sections, in one pass per document.

Most of its rules are windows (operators.blocks); a few need the state of an ordered scan: continuation headings that
chain, phantom sections that a later one replaces, and the cascade of struck headings. They run as a grouped scan, one
document at a time (a document is at most some ten thousand blocks), after everything that a column expression can say
has been said: kind, heading number, depth, ids, table-of-contents lines.

Input: doc_id, idx, page, type (paragraph, heading, table, image), text, struck, size, headers, rows.
Defined results: null texts are empty; blocks without an index come first; documents without headings give no sections.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reqloom.functions.text import REQ_ID, TOC_LINE


@dataclass(frozen=True)
class Profile:
    """What a document family looks like. Regexes are data."""

    numbering: str = r"^(\d+(?:\.\d+)*)\.?\s+\S"
    req_id: str = REQ_ID
    toc_line: str = TOC_LINE
    toc_share: float = 0.7
    revision_history: str = r"(?i)^\s*(?:\d+(?:\.\d+)*\s+)?(?:revision|change|document) history\s*$"
    definitions: str = r"(?i)^(?:glossary|definitions|acronyms|abbreviations)"
    definition_line: str = r"^\s*([A-Z][A-Za-z0-9/-]{1,14})(?:\s+[-–—]|\s*:)\s+(.{3,})$"
    body_size: float = 12.0
    heading_chars: int = 200
    sentence_chars: int = 80
    ignore_struck: bool = True
    treat_headings: bool = True


SECTION = "doc_id string, ord int, section string, title string, req_id string, text string, n_tables int, n_images int, parent_section string, first_idx int, last_idx int"
DROPPED = "doc_id string, idx int, page int, reason string"


def heading_of(text: str, p: Profile) -> tuple[str, str] | None:
    """(number, title) of a heading-shaped line: numbered, not too long, and not a sentence unless it is short."""
    m = re.match(p.numbering, text)
    if not m or len(text) > p.heading_chars or (text[-1:] in ".!?" and len(text) > p.sentence_chars):
        return None
    number = m[1].rstrip(".")
    return number, text[len(m[1]) :].lstrip(" .\t")


def depth(number: str) -> int:
    return number.count(".") + 1


def toc_pages(rows: list[dict], p: Profile) -> set[int]:
    """Pages of two or more paragraphs of which the share of entries reaches the threshold."""
    seen: dict[int, list[bool]] = {}
    for r in rows:
        if r["type"] in ("paragraph", "heading") and r["text"]:
            seen.setdefault(r["page"], []).append(re.match(p.toc_line, r["text"]) is not None)
    return {k for k, v in seen.items() if len(v) >= 2 and sum(v) / len(v) >= p.toc_share}


@dataclass
class Section:
    number: str
    title: str
    idx: int
    req_id: str = ""
    text: list[str] = field(default_factory=list)
    tables: list[tuple] = field(default_factory=list)
    images: int = 0
    last: int = 0
    merged: int = 0

    def phantom(self) -> bool:
        return not (self.req_id or self.text or self.tables or self.images)


def parse(rows: list[dict], p: Profile = Profile()) -> tuple[list[Section], list[tuple[int, int, str]], dict[str, str]]:
    """(sections, dropped (idx, page, reason), definitions) of one document's blocks in order."""
    rows = [r | {"text": (r["text"] or "").strip()} for r in rows]
    toc = toc_pages(rows, p)
    canonical = lambda s: re.sub(r"\s+", "_", s).strip("_")
    ids = lambda s: [canonical(x) for x in re.findall(p.req_id, s)]
    sections: list[Section] = []
    by_number: dict[str, int] = {}
    dropped: list[tuple[int, int, str]] = []
    struck_ids: set[str] = set()
    cascade = None  # shallowest depth of the struck headings that are open
    in_history, deep_seen, after_heading, pending = False, False, False, ""
    for r in rows:
        idx, text, kind = r["idx"], r["text"], r["type"]
        shape = kind in ("paragraph", "heading") if p.treat_headings else kind == "paragraph"
        head = heading_of(text, p) if shape and text else None
        d = depth(head[0]) if head else None
        drop = lambda why, i=idx, pg=r["page"]: dropped.append((i, pg, why))
        if p.ignore_struck and r["struck"]:
            struck_ids.update(ids(text))
            if head and (cascade is None or d < cascade):
                cascade = d
            drop("strikeout")
            continue
        if cascade is not None:
            if head and d <= cascade:
                cascade = None
            else:
                struck_ids.update(ids(text))
                drop("strikeout_cascade")
                continue
        if shape and (r["page"] in toc or re.match(p.toc_line, text)):
            drop("toc")
            continue
        if shape and re.match(p.revision_history, text):
            in_history = True
            drop("revision_history")
            continue
        if in_history:
            if shape:
                in_history = False
            else:
                drop("revision_history")
                continue
        cur = sections[-1] if sections else None
        small = shape and r["size"] is not None and r["size"] < p.body_size - 2 and bool(ids(text))
        if small:
            rid = ids(text)[0]
            if cur is None:
                pending = pending or rid
            elif not cur.req_id:
                cur.req_id = rid
            after_heading = True
            continue
        if head:
            if d == 1 and deep_seen and after_heading and cur is not None:
                cur.title = f"{cur.title} {text}".strip()  # a number at the start of a wrapped title
                cur.last = idx
                continue
            number, title = head
            at = by_number.get(number)
            new = Section(number, title, idx, last=idx)
            if at is None:
                by_number[number] = len(sections)
                sections.append(new)
            elif sections[at].phantom():
                sections[at] = new  # in place
                sections.append(sections.pop(at))
                by_number = {s.number: i for i, s in enumerate(sections)}
            elif cur is not None:
                cur.text.append(text)
                cur.last = idx
                after_heading = False
                continue
            if pending:
                sections[-1].req_id, pending = pending, ""
            deep_seen |= d >= 2
            after_heading = True
            continue
        if cur is None:
            continue
        cur.last = idx
        if kind == "table":
            cur.tables.append((r["headers"] or [], r["rows"] or []))
        elif kind == "image":
            cur.images += 1
        elif text:
            cur.text.append(text)
            after_heading = False
            found = ids(text)
            if found and not cur.req_id:
                cur.req_id = found[0]
    taken = {s.req_id for s in sections if s.req_id} | struck_ids
    children = []
    for s in sections:
        for headers, body in s.tables:
            seen: set[str] = set()
            for row in body:
                cells = [c or "" for c in row]
                rid = next((x for c in cells for x in ids(c) if x not in taken and x not in seen), None)
                if rid:
                    seen.add(rid)
                    said = "; ".join(f"{h.strip()}: {c.strip()}" if h and h.strip() else c.strip() for h, c in zip([*headers, *[""] * len(cells)], cells, strict=False) if c.strip())
                    children.append(Section("", "", s.idx, rid, [said], last=s.idx, merged=1))
                    children[-1].title = s.number
        taken |= {c.req_id for c in children}
    terms: dict[str, str] = {}
    gloss = next((s for s in sections if re.match(p.definitions, s.title)), None)
    if gloss:
        for line in "\n".join(gloss.text).split("\n"):
            if m := re.match(p.definition_line, line):
                terms.setdefault(m[1], m[2].strip())
        for headers, body in gloss.tables:
            pairs = body if [h.strip().lower() for h in headers if h] in (["term", "definition"], ["acronym", "expansion"], ["acronym", "definition"]) else [headers, *body]
            for row in pairs:
                if len(row) >= 2 and row[0] and row[1]:
                    terms.setdefault(row[0].strip(), row[1].strip())
    return sections + children, dropped, terms


COLUMNS = ["doc_id", "idx", "page", "type", "text", "struck", "size", "headers", "rows"]


def _row(r: dict) -> dict:
    return {
        "idx": -1 if r["idx"] is None else r["idx"], "page": r["page"] or 0, "type": r["type"] or "paragraph", "text": r["text"], "struck": bool(r["struck"]),
        "size": r["size"], "headers": r["headers"] or [], "rows": r["rows"] or [],
    }


def _scan(blocks: DataFrame, make: Callable[[str | None, list[dict]], list[tuple]], schema: str) -> DataFrame:
    """Calls `make` with every document's blocks in order. Documents are brought together by one shuffle and a sort; they
    stream through Arrow batches, so that a task holds one document at a time and pays nothing per group."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc: list[dict] = []
        out: list[tuple] = []

        def table() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=arrow[n]) for n, c in zip(names, cols, strict=True)], names=names)

        arrow = {n: {"string": pa.string(), "int": pa.int32()}[k] for n, k in (c.split() for c in schema.split(", "))}
        for batch in batches:
            for r in batch.to_pylist():
                if doc and r["doc_id"] != doc[0]["doc_id"]:
                    out += make(doc[0]["doc_id"], [_row(x) for x in doc])
                    doc = []
                doc.append(r)
            if out:
                yield table()
                out = []
        if doc:
            out += make(doc[0]["doc_id"], [_row(x) for x in doc])
        if out:
            yield table()

    return blocks.select(*COLUMNS).repartition("doc_id").sortWithinPartitions("doc_id", F.asc_nulls_first("idx")).mapInArrow(run, schema)


def parse_sections(blocks: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """Sections and table-anchored requirements (these have no section number of their own)."""

    def one(doc: str | None, rows: list[dict]) -> list[tuple]:
        sections, _, _ = parse(rows, profile)
        numbers = {s.number for s in sections if s.number}
        out = []
        for i, s in enumerate(sections):
            up = s.number.rpartition(".")[0]
            parent = s.title if s.merged else (up if up in numbers else None)
            out.append((doc, i, s.number or None, None if s.merged else s.title, s.req_id or None, "\n".join(s.text), len(s.tables), s.images, parent, s.idx, s.last))
        return out

    return _scan(blocks, one, SECTION)


def parse_dropped(blocks: DataFrame, profile: Profile = Profile()) -> DataFrame:
    """The audit of dropped blocks with their reasons."""
    return _scan(blocks, lambda doc, rows: [(doc, *d) for d in parse(rows, profile)[1]], DROPPED)


def parse_definitions(blocks: DataFrame, profile: Profile = Profile()) -> DataFrame:
    return _scan(blocks, lambda doc, rows: [(doc, k, v) for k, v in parse(rows, profile)[2].items()], "doc_id string, term string, expansion string")


# In lines of the text corpus, list numbers are the headings.
LINES = Profile(numbering=r"^(?:\(?)(\d+(?:\.\d+)*)[.)]\s+\S", heading_chars=2000, sentence_chars=2000)


def line_blocks(b: DataFrame) -> DataFrame:
    """Lines of documents (`blocks.blocks`) as the parser's blocks."""
    cells = F.filter(F.split("text", r"\|"), lambda x: F.trim(x) != "")
    return b.select(F.col("doc_id").cast("string").alias("doc_id"), "idx", F.lit(1).alias("page"), F.when(F.col("type") == "table", "table").otherwise("paragraph").alias("type"), "text", F.lit(False).alias("struck"), F.lit(None).cast("double").alias("size"), F.array().cast("array<string>").alias("headers"), F.array(cells).alias("rows"))


def parse_documents(spark, base: str) -> DataFrame:
    """The parser over all lines of `documents`."""
    from reqloom.operators.blocks import blocks

    return parse_sections(line_blocks(blocks(spark, base)), LINES)


def file_blocks(b: DataFrame) -> DataFrame:
    """Blocks of document files (`sources.documents.read_blocks`) as the parser's blocks."""
    return b.where("error is null").select(F.col("path").alias("doc_id"), "idx", "page", "type", "text", "struck", F.lit(None).cast("double").alias("size"), "headers", "rows")
