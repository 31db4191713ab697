"""Places to plug in what a corpus brings itself: embedders and token counters, called with a batch of texts at a time."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.text import estimate_tokens

Embedder = Callable[[list[str]], list]


def hashing_embedder(dimension: int = 64) -> Embedder:
    """An embedder without a model: signed hashes of words and word pairs, of length one. The same everywhere."""

    def embed(texts: list[str]) -> list:
        out = np.zeros((len(texts), dimension), np.float32)
        for row, text in zip(out, texts):
            words = text.lower().split()
            for token in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = zlib.crc32(token.encode())
                row[h % dimension] += 1 if h >> 31 else -1
        return list(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9))

    return embed


def embedded(text: Column, embed: Embedder) -> Column:
    """The vectors of texts; null for null and blank ones, which are not passed on."""

    def run(s: pd.Series) -> pd.Series:
        keep = s.notna() & (s.str.strip() != "")
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        if keep.any():
            out[keep] = pd.Series([np.asarray(v, np.float32) for v in embed(s[keep].tolist())], index=s.index[keep])
        return out

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)


def token_count(text: Column, counter: Callable[[list[str]], list[int]] | None = None) -> Column:
    """Tokens of texts by a counter of batches; without one, by the offline estimate. 0 for null."""
    if counter is None:
        return estimate_tokens(text)

    def run(s: pd.Series) -> pd.Series:
        return pd.Series(counter(s.fillna("").tolist()), index=s.index, dtype="int64")

    return F.pandas_udf(run, T.LongType())(text)


def decoded_vector(text: Column) -> Column:
    """A vector written as base64 of little-endian floats; null for what is none."""

    def one(x: str):
        try:
            raw = base64.b64decode(x, validate=True)
        except ValueError:
            return None
        return np.frombuffer(raw, "<f4") if len(raw) % 4 == 0 else None

    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore")

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)
