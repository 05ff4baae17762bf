"""Extension points: language model, embedding, reranker and rewriter as plain callables, applied in batches.

A plug-in is built on the worker by a factory (so that a model is loaded once per Python process) and called with lists.
The defaults are deterministic and need no model.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqloom.functions.text import TOKEN


class Complete(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class Embed(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Score(Protocol):
    def __call__(self, questions: list[str], texts: list[str]) -> list[float]: ...


def hash_embedder(dimension: int = 64, chars: int | None = None) -> Embed:
    """Unit vectors of signed token counts; stable across processes. An empty text is the zero vector.

    Whole texts are embedded; `chars` limits them to a prefix, as a model with a bounded input does (8,000 characters
    are usual for served models).
    """
    import re

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(dimension)
            for w in re.findall(TOKEN, (t or "")[:chars].lower()):
                h = zlib.crc32(w.encode())
                v[h % dimension] += 1 if (h >> 16) & 1 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out

    return embed


def mock_model() -> Complete:
    """Answers with the prompt's last line."""
    return lambda prompts: [(p or "").strip().split("\n")[-1] for p in prompts]


def overlap_scorer() -> Score:
    import re

    def score(questions: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(questions, texts, strict=True):
            a, b = set(re.findall(TOKEN, (q or "").lower())), set(re.findall(TOKEN, (t or "").lower()))
            out.append(len(a & b) / len(a) if a else 0.0)
        return out

    return score


def embedding_column(factory: Callable[[], Embed] = hash_embedder):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for texts in batches:
            yield pd.Series(model(texts.tolist()))

    return embed.asNondeterministic()


def completion_column(factory: Callable[[], Complete] = mock_model):
    @F.pandas_udf(T.StringType())
    def complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for prompts in batches:
            yield pd.Series(model(prompts.tolist()))

    return complete.asNondeterministic()


def score_column(factory: Callable[[], Score] = overlap_scorer):
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for q, t in batches:
            yield pd.Series(model(q.tolist(), t.tolist()), dtype="float64")

    return score.asNondeterministic()


def parse_rewrites(answer: str | None, most: int = 3, chars: int = 240) -> list[str]:
    """Rewrites from a model's lines: list marks and quotes stripped, cut, at most `most`."""
    import re

    out = []
    for line in (answer or "").split("\n"):
        s = re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", line).strip().strip("\"'“”`").strip()
        if s:
            out.append(s[:chars])
    return out[:most]


def expand_query(question: str, rewrites: list[str]) -> str:
    return " | ".join([question, *rewrites])


def json_answer(answer: str | None):
    """The first balanced JSON value of a model's answer, without fences; None when there is none."""
    import json

    s = (answer or "").replace("```json", "```").replace("```", "")
    for i, c in enumerate(s):
        if c in "{[":
            try:
                return json.JSONDecoder().raw_decode(s[i:])[0]
            except ValueError:
                continue
    return None


def runaway(text: str | None, times: int = 12) -> bool:
    """A chunk of two to four characters repeated at least `times` times in a row."""
    import re

    return re.search(r"(.{2,4}?)\1{%d,}" % (times - 1), text or "", re.S) is not None
