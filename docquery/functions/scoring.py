"""Similarity and fusion scores as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; vectors of different lengths are an error."""
    ok = F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("boolean"))
    return F.when(ok & (norm(a) * norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def cosine_to(a: Column, query: Sequence[float]) -> Column:
    """Cosine to one query; the dot product is unrolled over its elements, so that code is generated for it."""
    size = math.sqrt(sum(x * x for x in query))
    ok = F.when(F.size(a) == len(query), F.lit(True)).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("boolean"))
    if size == 0:
        return F.when(ok, F.lit(0.0))
    n = norm(a)
    literal = F.array(*(F.lit(float(x)) for x in query))
    return F.when(ok & (n > 0), dot(a, literal) / (n * F.lit(size))).otherwise(0.0)


def is_close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))


def min_max(score: Column, low: Column, high: Column) -> Column:
    """Over a pool with these bounds; if they are equal, 1 for positive scores and 0 for others."""
    return F.when(is_close(low, high), F.when(score > 0, 1.0).otherwise(0.0)).otherwise((score - low) / (high - low))


def weighted_sum(dense: Column, keyword: Column, dense_weight: Column, keyword_weight: Column) -> Column:
    return dense * dense_weight + keyword * keyword_weight


def reciprocal_rank(rank: Column, constant: int = 60) -> Column:
    return F.coalesce(1.0 / (constant + rank), F.lit(0.0))
