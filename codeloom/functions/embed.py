"""A deterministic text embedding for use without a model: hashed words and word pairs with signs, of unit length."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 256


def vector(text: str | None, dimensions: int = DIMENSIONS) -> list[float]:
    words = "".join(c.lower() if c.isalnum() else " " for c in text or "").split()
    v = np.zeros(dimensions)
    for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]:
        h = zlib.crc32(w.encode())
        v[h % dimensions] += 1 if h & 0x10000 else -1
    n = float(np.linalg.norm(v))
    return (v / n if n else v).tolist()


def vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """The same, a row a text: distinct words and pairs are hashed once a batch, sums are one count over all texts."""
    split = ["".join(c.lower() if c.isalnum() else " " for c in t or "").split() for t in texts]
    terms = [[*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))] for w in split]
    known = {t: zlib.crc32(t.encode()) for each in terms for t in each}
    h = np.fromiter((known[t] for each in terms for t in each), np.int64)
    row = np.repeat(np.arange(len(texts)), [len(x) for x in terms])
    out = np.bincount(row * dimensions + h % dimensions, np.where(h & 0x10000, 1.0, -1.0), len(texts) * dimensions).reshape(-1, dimensions)
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(n > 0, n, 1)


def embedded(text: Column) -> Column:
    """A column of vectors, made in Arrow batches; a stand-in for a model's, null for a null text."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        some = s.notna().to_numpy()
        out = np.full(len(s), None, object)
        for i, v in zip(np.flatnonzero(some), vectors(s[some].tolist())):
            out[i] = v
        return pd.Series(out)

    return run(text)
