"""Splitting oversized items at natural boundaries.

A text is a run of tokens; the prefix sums of their lengths say how long every stretch of it is, in code points or in
tokens of a public tokenizer. Boundaries are sorted offsets, one array for each rank (paragraph, line, sentence,
clause, blank). A piece is cut at the last boundary under the limit, found by binary search; a higher rank wins if it
fills at least ``FILL`` of the piece. The next piece steps back by at most `overlap`, onto a blank where there is one.

Every piece brings at least a quarter of the limit that no earlier piece has. Where no boundary in reach does, the
overlap gives way first, so that the piece reaches the next boundary; a shorter piece is made only where the stretch after
it would not fit otherwise. Only a stretch longer than the limit without any boundary is cut hard, with its overlap kept.

Defined results: null texts and texts within the limit give no rows; every longer text gives pieces numbered from 1
whose `text` without its first `overlap` characters concatenates to the whole text. Offsets are Unicode code points.
Repeated deliveries of an item count once; rows with a null id are items of their own, one for each text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqloom.llm.tokens import encoding, ship
from reqloom.sources.tables import table

LIMIT, OVERLAP, FILL = 2000, 200, 0.5

# Characters at which a text may be cut.
BLANKS = " \t\n\r 　"
STOPS = ".!?。！？"
CLAUSES = ";:,、，；："
BOUNDARY = BLANKS + STOPS + CLAUSES

_CODE = {ord(c): 1 for c in BLANKS} | {ord(c): 2 for c in CLAUSES} | {ord(c): 3 for c in STOPS}
_TABLE = np.zeros(0x10000, dtype=np.int8)
for _k, _v in _CODE.items():
    _TABLE[_k] = _v


def boundaries(text: str) -> list[np.ndarray]:
    """Offsets at which the text may be cut, by rank: paragraph, line, sentence, clause, blank, and before a boundary."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.where(cp < 0x10000, _TABLE[np.minimum(cp, 0xFFFF)], 0)
    at = np.flatnonzero(kind)
    after = at + 1
    k = kind[at]
    nl = cp[at] == 10
    # a full stop ends a sentence before white space or the end; the full-width ones always do
    nxt = np.append(kind, 1)[after]
    wide = cp[at] >= 0x3000
    sentence = after[(k == 3) & (wide | (nxt == 1))]
    paragraph = after[nl & np.insert(nl[1:] & nl[:-1] & (np.diff(at) == 1), 0, False)] if len(at) else after
    return [paragraph, after[nl], sentence, after[(k == 2) & (wide | (nxt == 1))], after[k == 1], after, at]


class Measure:
    """How long stretches of a text are: prefix sums of the lengths of its tokens, at every offset (None: code points)."""

    def __init__(self, n: int, sums: np.ndarray | None = None) -> None:
        self.n, self.sums = n, sums

    def ahead(self, at: int, size: int) -> int:
        """The last offset that is at most `size` after `at`."""
        if self.sums is None:
            return min(self.n, at + size)
        return int(np.searchsorted(self.sums, self.sums[at] + size, side="right")) - 1

    def behind(self, at: int, size: int) -> int:
        """The first offset that is at most `size` before `at`."""
        if self.sums is None:
            return max(0, at - size)
        return int(np.searchsorted(self.sums, self.sums[at] - size, side="left"))


def token_sums(text: str, encoding) -> np.ndarray:
    """Tokens begun before each offset of a text: the prefix sums of token lengths, inverted."""
    lengths = [len(x) for x in encoding.decode_tokens_bytes(encoding.encode_ordinary(text))]
    ends = np.cumsum(lengths)  # byte offsets at which tokens end
    starts = ends - lengths
    width = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    at = np.append(np.flatnonzero((width & 0xC0) != 0x80), len(width))  # byte offset of each code point
    return np.searchsorted(starts, at, side="left")


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP, measure: Measure | None = None) -> list[tuple[int, int, bool]]:
    """(start, end, hard) of the pieces of a text; the pieces cover it in order and overlap by at most `overlap`."""
    n = len(text)
    m = measure or Measure(n)
    ranks = boundaries(text)
    every = np.union1d(ranks[5], ranks[6])
    quarter = max(1, limit // 4)
    out: list[tuple[int, int, bool]] = []

    def last(r: np.ndarray, upto: int, least: int) -> int:
        j = np.searchsorted(r, upto, side="right") - 1
        return int(r[j]) if j >= 0 and r[j] >= least else -1

    def first(r: np.ndarray, after: int) -> int:
        j = np.searchsorted(r, after, side="right")
        return int(r[j]) if j < len(r) else n

    start, done = 0, 0  # the piece starts at `start`; up to `done` everything is in earlier pieces
    while True:
        reach = m.ahead(start, limit)
        if reach >= n:
            out.append((start, n, False))
            return out
        enough, far = m.ahead(done, quarter), m.ahead(done, limit)
        filled = max(enough, m.ahead(start, int(FILL * limit)))
        end, hard = -1, False
        for i, r in enumerate(ranks):
            end = last(r, reach, filled if i < 4 else enough)
            if end >= 0:
                break
        if end < 0:
            beyond = first(every, reach)
            if beyond <= far:  # less overlap, and the piece reaches the next boundary
                end = beyond
                start = max(start, m.behind(end, limit))
            else:
                near = last(every, reach, done + 1)
                if near >= 0 and m.ahead(near, limit) >= first(every, near):
                    end = near  # what follows fits only from here
                else:
                    end, hard = max(reach, done + 1), True
        out.append((start, end, hard))
        done = end
        if done >= n:
            return out
        back = max(m.behind(end, overlap), start + 1)
        j = np.searchsorted(ranks[4], back)  # step back onto a blank
        start = int(ranks[4][j]) if j < len(ranks[4]) and ranks[4][j] < end else min(back, end)


def token_cut_points(text: str, limit: int, overlap: int, enc) -> list[tuple[int, int, bool]]:
    """Pieces of at most `limit` tokens each when tokenised by themselves: a cut inside a token of the whole text can make
    one more, so the cutting is repeated with as many tokens less as the longest piece has too many."""
    measure, inner = Measure(len(text), token_sums(text, enc)), limit
    while True:
        cuts = cut_points(text, inner, min(overlap, inner - 1), measure)
        over = max(len(enc.encode_ordinary(text[a:b])) for a, b, _ in cuts) - limit
        if over <= 0 or inner == 1:
            return cuts
        inner = max(1, inner - over)


PIECE = T.ArrayType(T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("overlap", T.IntegerType()), T.StructField("hard", T.BooleanType()), T.StructField("text", T.StringType())]))


def piece_column(limit: int, overlap: int, with_text: bool, vocabulary: str | None = None):
    """Pieces of a text; with a vocabulary file the limit and the overlap are in its tokens."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")

    @F.pandas_udf(PIECE)
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(vocabulary) if vocabulary else None
        for texts in batches:
            out = []
            for t in texts:
                done, rows = 0, []
                for i, (a, b, hard) in enumerate(token_cut_points(t, limit, overlap, enc) if enc else cut_points(t, limit, overlap)):
                    rows.append((i + 1, a, b, max(0, done - a), hard, t[a:b] if with_text else None))
                    done = b
                out.append(rows)
            yield pd.Series(out)

    return pieces


def oversized(spark: SparkSession, base: str, limit: int = LIMIT) -> DataFrame:
    """Items over the limit, each once: item_table, item_id, text. The filter runs before the one shuffle."""

    def part(name: str, key: str) -> DataFrame:
        t = table(spark, base, name).where(F.length("text") > limit)
        return t.select(F.lit(name).alias("item_table"), F.col(key).alias("item_id"), "text").distinct()

    return part("requirements", "rec_id").unionByName(part("spec_sections", "sec_id"))


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True, vocabulary: str | None = None) -> DataFrame:
    """item_table, item_id, text -> one row per piece."""
    if vocabulary:
        ship(items.sparkSession, vocabulary)
    p = piece_column(limit, overlap, with_text, vocabulary)
    return items.select("item_table", "item_id", F.explode(p("text")).alias("p")).select("item_table", "item_id", "p.*")


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    pieces = split_items(oversized(spark, base), with_text=False)
    hard = pieces.groupBy("item_table", "item_id").agg(F.max("hard").alias("hard"))
    return hard.select("item_table", "item_id", F.when(F.col("hard"), "forced").otherwise("natural").alias("cut"))


def p3_pieces(spark: SparkSession, base: str) -> DataFrame:
    """Every piece of every oversized item."""
    return split_items(oversized(spark, base))


def p3_restored(spark: SparkSession, base: str) -> DataFrame:
    """What the pieces of each item restore (its hash), whether all keep the limit and the overlap, whether each but the
    last brings something new, and whether they are numbered from 1."""
    p = p3_pieces(spark, base)
    own = F.expr("substring(text, overlap + 1)")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", own.alias("t")))), lambda x: x["t"]), "")
    g = p.groupBy("item_table", "item_id").agg(
        F.md5(whole.cast("binary")).alias("restored"),
        F.max(F.length("text")).alias("longest"), F.max("overlap").alias("most"), F.min(F.length("text") - F.col("overlap")).alias("least_new"), F.count("*").alias("n"), F.max("piece").alias("last"),
    )
    kept = (F.col("longest") <= LIMIT) & (F.col("most") <= OVERLAP) & (F.col("least_new") > 0) & (F.col("n") == F.col("last"))
    return g.select("item_table", "item_id", "restored", kept.alias("kept"))
