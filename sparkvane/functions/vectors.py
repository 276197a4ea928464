"""Distances, scores and vector arithmetic as columns, and the same as numpy kernels for Arrow batches.

Arithmetic is in double precision, terms added from the first component on. A query given as numbers and of at most
UNROLLED components becomes one generated expression; other vectors use higher-order functions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = ("l2", "ip", "cosine")
UNROLLED = 128
TINY = 1e-30


def _sum(terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column | Sequence[float]) -> Column:
    if not isinstance(b, Column):
        if len(b) <= UNROLLED:
            out = F.lit(0.0)
            for i, x in enumerate(b):
                out = out + F.get(a, F.lit(i)).cast("double") * F.lit(float(x))
            return out
        b = F.array(*[F.lit(float(x)) for x in b])
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column | Sequence[float]) -> Column:
    if not isinstance(b, Column):
        if len(b) <= UNROLLED:
            out = F.lit(0.0)
            for i, x in enumerate(b):
                d = F.get(a, F.lit(i)).cast("double") - F.lit(float(x))
                out = out + d * d
            return out
        b = F.array(*[F.lit(float(x)) for x in b])
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def squared_l2_integers(a: Column, b: Column) -> Column:
    """Squared L2 of small unsigned integers, in integers."""
    return F.aggregate(F.zip_with(a.cast("array<int>"), b.cast("array<int>"), lambda x, y: (x - y) * (x - y)), F.lit(0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def normalise(v: Column) -> Column:
    """v over its length; a zero vector stays."""
    return F.transform(doubles(v), lambda x: x / (norm(v) + F.lit(TINY)))


def distance(space: str, a: Column, b: Column | Sequence[float]) -> Column:
    """l2: squared; ip: 1 - dot; cosine: 1 - dot of the normalised, rounding below zero taken for zero."""
    if space == "l2":
        return squared_l2(a, b)
    if space == "ip":
        return F.lit(1.0) - dot(a, b)
    if space == "cosine":
        lengths = norm(a) * (norm(b) if isinstance(b, Column) else F.lit(float(np.linalg.norm(np.asarray(b, np.float64)))))
        d = F.lit(1.0) - dot(a, b) / (lengths + F.lit(TINY))
        return F.when((d < 0) & (d > -1e-6), F.lit(0.0)).otherwise(d)
    raise ValueError(f"space must be one of {SPACES}, not {space!r}")


def score(d: Column) -> Column:
    """1 / (1 + distance); 0 for a distance that is negative, infinite or not a number."""
    bad = d.isNull() | F.isnan(d) | (d < 0) | (d == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + d))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 where a vector has no length or the lengths of the lists differ."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def reshape(flat: Column, dimension: int) -> Column:
    """A flat list of numbers as rows of a dimension."""
    rows = F.size(flat).cast("int") / F.lit(dimension)
    return F.when(
        F.size(flat) > 0, F.transform(F.sequence(F.lit(0), rows.cast("int") - 1), lambda i: F.slice(flat, i * dimension + 1, F.lit(dimension)).cast("array<float>"))
    ).otherwise(F.array().cast("array<array<float>>"))


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + TINY)


def distances(space: str, rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Distances of all rows (down) to all queries (across)."""
    if space == "cosine":
        rows, queries = unit_rows(rows), unit_rows(queries)
    products = rows @ queries.T
    if space == "l2":
        return np.maximum((rows**2).sum(axis=1)[:, None] - 2 * products + (queries**2).sum(axis=1)[None, :], 0)
    d = 1 - products
    return np.where((d < 0) & (d > -1e-6), 0, d) if space == "cosine" else d
