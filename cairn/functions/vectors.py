"""Vector expressions and the embedder hook.  Products are summed as doubles."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """null where a vector is null, of other length or zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dim: int = 64) -> Embedder:
    """Deterministic default: hashed words, unit length.  A model's embedder has the same form."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for k, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % dim] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    return embed


def embed(df: DataFrame, text: str, out: str = "embedding", make: Callable[[], Embedder] = hashing_embedder) -> DataFrame:
    """Add an embedding; ``make`` builds the embedder once per Python worker, batches come over Arrow."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            yield pd.Series(list(model(s.fillna("").tolist())))

    return df.withColumn(out, run(F.col(text)))
