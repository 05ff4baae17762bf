"""The stage runner: named stages in order, each writing its tables; a range and skips; errors end it or are passed over."""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.functions.plugins import Embed, embedding_column, hash_embedder

# Codes of what can go wrong.
ERRORS = {"PIP-E001": "a stage raised", "PIP-E002": "no such stage", "PIP-E003": "stages out of order", "EXT-E001": "no readable file", "STO-E001": "a table is missing"}


@dataclass
class Outcome:
    stage: str
    status: str
    seconds: float = 0.0
    rows: dict[str, int] = field(default_factory=dict)
    code: str = ""
    message: str = ""


# A stage takes the session, the folder of the engine's tables and, if it has a third parameter, the folder of the tables
# that earlier stages wrote (None after a failed stage). A value may be a function: it is called once the tables before it
# are written.
Stage = Callable[..., dict[str, DataFrame | Callable[[], DataFrame]]]


def made(spark: SparkSession, out: str | None, name: str) -> DataFrame | None:
    """A table that an earlier stage wrote; None where there is none, and the stage computes it itself."""
    try:
        return spark.read.parquet(f"{out}/{name}") if out else None
    except AnalysisException:
        return None


def default_stages(documents: str | None = None, embed: Callable[[], Embed] = hash_embedder) -> dict[str, Stage]:
    """The nine stages over the engine's tables, and over the document files below `documents` where that is given."""
    from reqloom.operators import blocks, graph, parser, references, structure, understanding
    from reqloom.sources.documents import read_blocks

    def lines(s, b, o):
        found = made(s, o, "blocks")
        return blocks.blocks(s, b) if found is None else found

    def extract(s, b, o):
        return {"blocks": blocks.blocks(s, b)} | ({"file_blocks": read_blocks(s, documents)} if documents else {})

    def profile(s, b, o):
        return {"profile": blocks.profile_counts(s, b, lines(s, b, o)), "req_id_patterns": blocks.pattern_election(s, b)}

    def parse(s, b, o):
        x = lines(s, b, o)
        parts = [(parser.line_blocks(x), parser.LINES)]
        if documents:
            files = made(s, o, "file_blocks")
            parts.append((parser.file_blocks(read_blocks(s, documents) if files is None else files), parser.Profile()))
        every = lambda f: reduce(DataFrame.unionByName, [f(*p) for p in parts])
        return {"sections": blocks.sections(s, b, x), "parsed_sections": every(parser.parse_sections), "parse_dropped": every(parser.parse_dropped), "definitions": every(parser.parse_definitions)}

    def resolve(s, b, o):
        names = ("refs_internal_resolved", "refs_cross_plan_resolved", "refs_standards_resolved")
        found = (references.resolve_internal(s, b), references.resolve_cross_plan(s, b), references.resolve_standards(s, b))
        return dict(zip(names, found, strict=True)) | {"ref_summary": lambda: references.status_summary(s, b, *[made(s, o, n) for n in names])}

    def standards(s, b, o):
        return {"reference_index": references.standards_index(s, b, made(s, o, "refs_standards_resolved")), "spec_context": structure.section_neighbourhood(s, b)}

    def build_graph(s, b, o):
        std = made(s, o, "refs_standards_resolved")
        return {"nodes": graph.nodes(s, b, std), "edges": graph.edges(s, b, std)}

    def vectorstore(s, b, o):
        make = {"chunks": structure.chunk_texts, "glossary": structure.glossary_chunks}

        def vectors():
            texts = [(make[n](s, b) if (df := made(s, o, n)) is None else df).select("chunk_id", "text") for n in make]
            return texts[0].unionByName(texts[1]).select("chunk_id", embedding_column(embed)("text").alias("vector"))

        return {n: f(s, b) for n, f in make.items()} | {"vectors": vectors}

    def evaluate(s, b, o):
        chunks = made(s, o, "chunks")
        known = None if chunks is None else chunks.select(F.regexp_replace("chunk_id", "^req:", "").alias("req_id"))
        return {"scores": understanding.score_questions(s, b, known)}

    return {
        "extract": extract,
        "profile": profile,
        "parse": parse,
        "resolve": resolve,
        "taxonomy": lambda s, b: {"taxonomy": understanding.taxonomy(s, b)},
        "standards": standards,
        "graph": build_graph,
        "vectorstore": vectorstore,
        "eval": evaluate,
    }


def stage_range(names: Sequence[str], first: str | None = None, last: str | None = None, skip: Sequence[str] = ()) -> list[str]:
    """The stages from first to last without the skipped ones."""
    for n in [first, last, *skip]:
        if n is not None and n not in names:
            raise ValueError(f"PIP-E002: {n}")
    a, b = names.index(first) if first else 0, names.index(last) if last else len(names) - 1
    if a > b:
        raise ValueError("PIP-E003: the first stage comes after the last")
    return [n for n in names[a : b + 1] if n not in skip]


def run(spark: SparkSession, base: str, out: str, stages: dict[str, Stage] | None = None, first: str | None = None, last: str | None = None, skip: Sequence[str] = (), continue_on_error: bool = False) -> list[Outcome]:
    """Runs the stages; each table is written (overwriting) below `out`, and counted from what was written."""
    stages = stages or default_stages()
    done = []
    for name in stage_range(list(stages), first, last, skip):
        began = time.time()
        o = Outcome(name, "OK")
        try:
            takes = len(inspect.signature(stages[name]).parameters)
            earlier = None if any(x.status == "FAIL" for x in done) else out
            for table, df in stages[name](*(spark, base, earlier)[:takes]).items():
                df = df() if callable(df) else df
                df.write.mode("overwrite").parquet(f"{out}/{table}")
                o.rows[table] = spark.read.parquet(f"{out}/{table}").count()
        except Exception as e:  # noqa: BLE001 - reported as the stage's outcome
            o.status, o.code, o.message = "FAIL", "PIP-E001", f"{type(e).__name__}: {e}"[:500]
        o.seconds = round(time.time() - began, 2)
        done.append(o)
        if o.status == "FAIL" and not continue_on_error:
            break
    return done


def report(outcomes: Sequence[Outcome]) -> str:
    """A compact text report."""
    return "\n".join(f"{o.stage:<10} {o.status:<4} {o.seconds:7.2f}s " + (", ".join(f"{k}={v}" for k, v in o.rows.items()) if o.status == "OK" else f"{o.code} {o.message}") for o in outcomes)


def layered(*values):
    """The first option that is set: command line, environment, file, default."""
    return next((v for v in values if v is not None and v != ""), None)


def map_path(path: str, mappings: Sequence[tuple[str, str]]) -> str:
    """The first mapping whose prefix matches (case and slashes aside) rewrites the path."""
    norm = path.replace("\\", "/")
    for a, b in mappings:
        a = a.replace("\\", "/").rstrip("/")
        if norm.lower() == a.lower() or norm.lower().startswith(a.lower() + "/"):
            return b.rstrip("/") + norm[len(a) :]
    return norm


def inside(path: str, roots: Sequence[str]) -> bool:
    """Whether a path lies in one of the roots, `..` resolved."""
    import posixpath

    p = posixpath.normpath(path)
    return any(p == (r := posixpath.normpath(root)) or p.startswith(r.rstrip("/") + "/") for root in roots)
