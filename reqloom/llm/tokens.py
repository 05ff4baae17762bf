"""Token counts with a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("REQLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: how the vocabulary's tokenizer splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


def ship(spark: SparkSession, path: str = VOCABULARY) -> None:
    """Sends the vocabulary file to the executors, once per Spark application."""
    sc = spark.sparkContext
    sent = getattr(sc, "_reqloom_vocabularies", set())
    if path not in sent:
        sc.addFile(path)
        sc._reqloom_vocabularies = sent | {path}


def encoding(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file, loaded once per Python worker."""
    if path not in _loaded:
        import tiktoken

        # on an executor without the path the shipped copy is read
        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_count(path: str = VOCABULARY):
    """A column function: tokens of a text, 0 for null."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(path).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return count
