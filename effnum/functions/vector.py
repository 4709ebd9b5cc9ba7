"""Vector columns held as ``ARRAY<DOUBLE>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: str | Column) -> Column:
    """Sum of squares."""
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x * x)


def divisor(a: str | Column) -> Column:
    """Euclidean length, one for the zero vector."""
    norm = F.sqrt(squared_norm(a))
    return F.when(norm == 0, F.lit(1.0)).otherwise(norm)


def unit(a: str | Column) -> Column:
    """The vector at length one; the zero vector stays as it is.

    The length is computed once per row and spread, not recomputed per element.
    """
    c = _col(a)
    return F.zip_with(c, F.array_repeat(divisor(c), F.size(c)), lambda x, n: x / n)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of the angle; zero if either vector is zero."""
    return dot(a, b) / (divisor(a) * divisor(b))


def scale(a: str | Column, factors: Sequence[float]) -> Column:
    """Element-wise product with fixed factors."""
    return F.zip_with(_col(a), F.array(*[F.lit(float(f)) for f in factors]), lambda x, f: x * f)


def squared_distance(a: str | Column, b: str | Column) -> Column:
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda s, x: s + x)


def manhattan(a: str | Column, b: str | Column) -> Column:
    diffs = F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda s, x: s + x)


def chebyshev(a: str | Column, b: str | Column) -> Column:
    return F.array_max(F.zip_with(_col(a), _col(b), lambda x, y: F.abs(x - y)))


def hamming_distance(a: str | Column, b: str | Column) -> Column:
    """Share of positions that differ."""
    differing = F.filter(F.zip_with(_col(a), _col(b), lambda x, y: x != y), lambda d: d)
    return F.size(differing) / F.size(_col(a))


def hamming_similarity(a: str | Column, b: str | Column) -> Column:
    """Share of positions that agree."""
    return F.lit(1.0) - hamming_distance(a, b)
