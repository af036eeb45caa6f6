"""Vector arithmetic on array columns, as built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def minus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def plus(a, b) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scaled(a, k) -> Column:
    return F.transform(a, lambda x: x * k)


def unit(a, floor: float = 1e-12) -> Column:
    return scaled(a, F.lit(1.0) / F.greatest(norm(a), F.lit(floor)))


def cosine(a, b, eps: float = 1e-12) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))
