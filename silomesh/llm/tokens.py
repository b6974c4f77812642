"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter.

The file is read where an executor has it; elsewhere it is taken from what ``SparkContext.addFile`` sent along.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies unless a caller or the environment names another file.
VOCABULARY = os.environ.get("SILOMESH_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[str, object] = {}


def encoder(path: str):
    if path not in _LOADED:
        import tiktoken
        from pyspark import SparkFiles

        held = path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))
        with open(held, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(text: Column | str, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text; 0 for null and empty texts.  Special tokens in a text are ordinary text."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for texts in batches:
            yield pd.Series([len(found) for found in enc.encode_ordinary_batch([t or "" for t in texts], num_threads=1)], dtype="int64")

    return count(F.col(text) if isinstance(text, str) else text)


def sized(documents: DataFrame, path: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., n_tokens) of texts with at least one token."""
    return documents.select("doc_id", *keep, token_count("text", path).alias("n_tokens")).filter("n_tokens > 0")
