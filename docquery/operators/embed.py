"""Embedders: signed feature hashing of tokens and neighbours, or any batch function."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import q_normal, q_tokens

DIMENSION = 512


def hashed(text: str, dimension: int = DIMENSION) -> list[float]:
    """Unit vector of a text: each token and pair of neighbours goes to a hashed place with a hashed sign; zeros without tokens."""
    words = q_tokens(q_normal(text, collapse=False), 2)
    if not words:
        return [0.0] * dimension
    terms = Counter(words)
    terms.update(map(" ".join, zip(words, words[1:])))
    hashes = [hashlib.blake2b(t, digest_size=16).digest() for t in "\n".join(terms).encode().split(b"\n")]  # terms have no line feeds
    h = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 16)
    weights = (1.0 - 2.0 * (h[:, 4] & 1)) * [1 + math.log(n) if n > 1 else 1 for n in terms.values()]
    v = np.bincount(h[:, :4].copy().view(">u4").ravel() % dimension, weights, dimension)
    size = math.sqrt(float(v @ v))
    return (v / size if size else v).tolist()


def embedding(text: Column, dimension: int = DIMENSION) -> Column:
    if dimension <= 0:
        raise ValueError("dimension must be positive")
    return with_function(text, lambda batch: [hashed(t, dimension) for t in batch], dimension)


def with_function(text: Column, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]], dimension: int | None = None) -> Column:
    """Vectors by a function of a batch of texts; a vector of another dimension is an error; null for null."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        given = texts.to_pylist()
        vectors = iter(embed([t for t in given if t is not None]))
        out = [None if t is None else [float(x) for x in next(vectors)] for t in given]
        for v in out:
            if v is not None and dimension is not None and len(v) != dimension:
                raise ValueError(f"a vector has {len(v)} dimensions, not {dimension}")
        return pa.array(out, pa.list_(pa.float64()))

    return run(text)


def checked_dimension(df, column: str = "embedding"):
    """One row with the vectors' dimension; an error if they differ or one is empty."""
    n = F.size(column)
    return df.agg(F.when((F.min(n) == F.max(n)) & (F.min(n) > 0), F.max(n)).otherwise(F.raise_error(F.lit("embeddings are empty or differ in dimension")).cast("int")).alias("dimension"))
