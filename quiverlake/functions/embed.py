"""Embedding protocols: a callable from texts to vectors as an Arrow UDF; hashing embedders that need no model."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable
from hashlib import blake2b
from typing import Protocol

import pandas as pd
from pyspark.sql import functions as F


class DenseEmbedding(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class SparseEmbedding(Protocol):
    def embed(self, texts: list[str]) -> list[dict[int, float]]: ...


def _at(word: str, size: int) -> int:
    return int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little") % size


class HashingDense:
    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in t.lower().split():
                v[_at(w, self.dimension)] += 1.0 if _at("s" + w, 2) else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class HashingSparse:
    """Term frequencies, saturated as in BM25, by hashed term."""

    def __init__(self, size: int = 1 << 20, k1: float = 1.2):
        self.size, self.k1 = size, k1

    def embed(self, texts: list[str]) -> list[dict[int, float]]:
        return [{_at(w, self.size): c * (self.k1 + 1) / (c + self.k1) for w, c in Counter(t.lower().split()).items()} for t in texts]


def dense_udf(model: DenseEmbedding) -> Callable:
    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.embed([t or "" for t in texts]))

    return run


def sparse_udf(model: SparseEmbedding) -> Callable:
    @F.pandas_udf("struct<indices:array<int>,vals:array<float>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        maps = [dict(sorted(m.items())) for m in model.embed([t or "" for t in texts])]
        return pd.DataFrame({"indices": [list(m) for m in maps], "vals": [list(m.values()) for m in maps]})

    return run
