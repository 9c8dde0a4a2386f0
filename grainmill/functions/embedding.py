"""Embeddings by a pluggable encoder that is loaded once per Python worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: texts -> one row of floats each
Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dimension: int = 64) -> Encoder:
    """A deterministic stand-in for tests: signed word hashes, unit length. It knows nothing of meaning."""
    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                out[i, h % dimension] += 1 if h >> 32 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def letter_encoder() -> Encoder:
    """A deterministic stand-in whose rows anyone can check: how often each of the letters a to z occurs in the lower-case text."""
    def encode(texts: list[str]) -> np.ndarray:
        return np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], np.float32).reshape(len(texts), 26)

    return encode


def embed(text: Column, load: Callable[[], Encoder]) -> Column:
    """array<float> of a text column; load runs once per worker; null texts give null."""
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for s in batches:
            has = s.notna()
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            if has.any():
                for i, v in zip(s.index[has], encode(s[has].tolist())):
                    out[i] = v
            yield out

    return run(text)


def dimension(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """One row: the greatest length of a vector; null without any."""
    return vectors.agg(F.max(F.size(column)).alias("dimension"))
