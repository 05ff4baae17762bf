"""Scalar text functions as column expressions (no Python in the row path unless said so)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference data model.
TOKEN = r"[a-z0-9_.\-]+"
REQ_ID = r"[A-Z]{2}_REQ_[A-Z0-9]+_[0-9]+"
SECTION_WORD = r"(?:[Ss]ection|(?:[Ss]ub)?[Cc]lause|§)"
SECTION_NUMBER = r"([0-9]+(?:\.[0-9]+)*)"
SPEC_NUMBER = r"([0-9][0-9.]*[0-9])"
# Section citations: pattern, group of the spec, group of the section.
SPEC_SECTIONS = [
    (rf"(?U)TS\s+{SPEC_NUMBER}\s*,?\s*{SECTION_WORD}\s+{SECTION_NUMBER}", 1, 2),
    (rf"(?U){SECTION_WORD}\s+{SECTION_NUMBER}\s+of\s+(?:3GPP\s+)?TS\s+{SPEC_NUMBER}", 2, 1),
    (rf"(?U)TS\s+{SPEC_NUMBER}\s*\(?\s*(?:reference\s*)?\[[0-9]+\]\s*\)?\s*,?\s*{SECTION_WORD}\s+{SECTION_NUMBER}", 1, 2),
]
SPEC = r"TS ([0-9]{2}\.[0-9]{3})"
TOC_LINE = r".*\.{3,}\s*[0-9]+\s*$"
BASE36 = "0123456789abcdefghijklmnopqrstuvwxyz"


def tokenize(c: Column) -> Column:
    """Lower-case search tokens of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0), lambda x: F.length(x) >= 2)


def canonicalize_req_id(c: Column) -> Column:
    """White-space runs become one `_`; none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", "_"), F.lit("_"))


def find_req_ids(c: Column, pattern: str = REQ_ID) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), canonicalize_req_id)


def plan_of_req(c: Column, separator: str = "_", position: int = 2) -> Column:
    return F.try_element_at(F.split(c, separator), F.lit(position + 1))


def section_depth(c: Column) -> Column:
    return F.size(F.split(c, r"\."))


def parent_section(c: Column) -> Column:
    """The number without its last component; null at the top."""
    return F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, r"\.[^.]+$", ""))


def section_prefixes(c: Column) -> Column:
    """All prefixes of a dotted number, from the root to itself."""
    parts = F.split(c, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def applicability_labels(c: Column) -> Column:
    """Labels split at commas, semicolons, bars and and/or; trimmed, first spelling of each kept."""
    parts = F.filter(F.transform(F.split(c, r"(?i)[,;|]|\band\b|\bor\b"), lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)),
    )


def clean_spec_number(c: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.trim(c), r"^(3GPP )?TS ", ""), F.lit("."))


def section_citations(c: Column) -> Column:
    """Every `TS x, section y`, `section y of TS x` and `TS x [n] section y` of a text: array of (spec, section)."""
    found = []
    for pattern, spec, section in SPEC_SECTIONS:
        specs, sections = (F.regexp_extract_all(c, F.lit(pattern), i) for i in (spec, section))
        found.append(F.arrays_zip(specs.alias("spec"), sections.alias("section")))
    return F.filter(F.concat(*found), lambda x: F.length(x["spec"]) >= 4)


def release_number(c: Column) -> Column:
    """`Release 15`, `Rel-15` or a bare integer; 0 for anything else."""
    named = F.regexp_extract(c, r"(?i)rel(?:ease)?[- ]?([0-9]+)", 1)
    bare = F.regexp_extract(c, r"^\s*([0-9]+)\s*$", 1)
    return F.coalesce(F.when(named != "", named).when(bare != "", bare).cast("int"), F.lit(0))


def version_code(c: Column) -> Column:
    """`11.7.0` to `b70`: one base-36 digit for each part."""
    return F.array_join(F.transform(F.split(c, r"\."), lambda p: F.substring(F.lit(BASE36), p.cast("int") + 1, F.lit(1))), "")


def code_version(c: Column) -> Column:
    """`b70` to `11.7.0`."""
    return F.array_join(F.transform(F.split(c, ""), lambda p: (F.instr(F.lit(BASE36), p) - 1).cast("string")), ".")


def slug(c: Column) -> Column:
    s = F.trim(F.regexp_replace(c, r"[^A-Za-z0-9_\-]", "_"), F.lit("_"))
    return F.when(s == "", "term").otherwise(s)


def feature_slug(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), r"[^A-Z0-9_]", "_")


def truncate_note(c: Column, limit: int = 50) -> Column:
    """At most `limit` characters, cut at a word border, with an ellipsis when cut."""
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, limit), r"\s+\S*$", ""), F.lit("…")))


def strip_headers(c: Column) -> Column:
    """Without leading bracketed header lines."""
    return F.regexp_replace(c, r"^(\[[^\n]*\][^\n]*\n)+", "")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def markdown_table(headers: Column, rows: Column) -> Column:
    """A table as Markdown; short rows are padded and long ones cut to the headers. Null without rows."""
    blank = F.forall(headers, lambda h: F.trim(F.coalesce(h, F.lit(""))) == "")
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))
    n = F.size(headers)
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), n)), F.lit(1), n)
    plain = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("[Table: "), F.array_join(r, " | ", ""), F.lit("]"))), "\n")
    bare = F.array_join(F.transform(rows, line), "\n")
    full = F.concat_ws("\n", line(headers), line(F.array_repeat(F.lit("---"), n)), F.array_join(F.transform(rows, lambda r: line(fit(r))), "\n"))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, None).when(F.coalesce(n, F.lit(0)) <= 0, bare).when(blank, plain).otherwise(full)


def row_text(headers: Column, cells: Column) -> Column:
    """`header: cell; ...` of the non-blank cells."""
    pairs = F.zip_with(headers, cells, lambda h, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.when(F.trim(F.coalesce(h, F.lit(""))) != "", F.concat(F.trim(h), F.lit(": "), F.trim(c))).otherwise(F.trim(c))))
    return F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "; ")


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(c)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit vector; the zero vector stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, x: s + x))


def inner_product_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def bbox_overlap(a: Column, b: Column) -> Column:
    """Share of box `a` that box `b` covers; boxes are (x0, y0, x1, y1)."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = (a[2] - a[0]) * (a[3] - a[1])
    return F.when(area > 0, w * h / area).otherwise(0.0)


def list_literal(c: Column) -> Column:
    """A list written as `['a', "b"]` or as JSON to an array of text; null where it is none."""
    return F.from_json(c, "array<string>", {"allowSingleQuotes": "true"})
