"""Sizes of texts in tokens of a public tokenizer, read from a vocabulary file whose path is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: The splitting pattern that belongs to the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_PIECE = 100_000  # characters encoded at a time; a text is cut at blanks only


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str, path: str) -> int:
    """Tokens of a text. A very long one is encoded in parts that meet before a blank, where the pattern parts anyway."""
    enc, total, start = encoder(path), 0, 0
    while len(text) - start > _PIECE:
        end = text.rfind(" ", start + 1, start + _PIECE)
        while end > start + 1 and (text[end - 1].isspace() or text[end + 1 : end + 2].isspace()):
            end = text.rfind(" ", start + 1, end)
        if end <= start + 1:
            break
        total += len(enc.encode_ordinary(text[start:end]))
        start = end
    return total + len(enc.encode_ordinary(text[start:]))


def with_tokens(documents: DataFrame, keep: list[str], path: str, text: str = "text") -> DataFrame:
    """keep + tokens of every document by the vocabulary file at path, which every executor must reach; null and empty texts have 0."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([count_tokens(t, path) if t else 0 for t in texts], dtype="int64")

    return documents.select(*keep, F.pandas_udf(run, "bigint")(F.coalesce(text, F.lit(""))).alias("tokens"))
