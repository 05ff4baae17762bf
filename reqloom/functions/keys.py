"""The key rule: when two written keys name the same thing. Column expressions and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What separates the parts of a key.
SEPARATORS = r"[\s\x{0b}_\-\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
SPACES = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
DOTTED = r"[0-9]+(?:\.[0-9]+)+"


def canonical_key(c: Column) -> Column:
    """Lower case, every run of white space, `_` or `-` one `_`, none at the ends; null when nothing is left."""
    folded = F.regexp_replace(F.lower(c), SEPARATORS, "_")
    return F.nullif(F.trim(folded, F.lit("_")), F.lit(""))


def spec_key(c: Column) -> Column:
    """The dotted number of a spec key; a non-blank key without one stays as its canonical text."""
    number = F.regexp_extract(c, DOTTED, 0)
    return F.when(number != "", number).otherwise(canonical_key(c))


def strip_space(c: Column) -> Column:
    """White space off both ends; null when nothing is left."""
    return F.nullif(F.regexp_replace(c, f"^{SPACES}|{SPACES}$", ""), F.lit(""))


def sql_canonical_key(c: str) -> str:
    return f"nullif(trim(regexp_replace(lower({c}), '{SEPARATORS}', '_', 'g'), '_'), '')"


def sql_spec_key(c: str) -> str:
    return f"coalesce(nullif(regexp_extract({c}, '{DOTTED}'), ''), {sql_canonical_key(c)})"


def sql_strip_space(c: str) -> str:
    return f"nullif(regexp_replace({c}, '^{SPACES}|{SPACES}$', '', 'g'), '')"
