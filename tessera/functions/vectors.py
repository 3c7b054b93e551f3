"""Vector arithmetic on array columns, in DOUBLE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v) -> Column:
    """The vector with DOUBLE elements."""
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    """Inner product."""
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def l1(a, b) -> Column:
    """City-block distance."""
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: F.abs(x - y)))


def squared(a, b) -> Column:
    """Squared Euclidean distance, 0 at least."""
    return F.greatest(_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))), F.lit(0.0))


def norm(v, add: float = 0.0) -> Column:
    """Euclidean length of the vector, each element plus `add`."""
    return F.sqrt(_sum(F.transform(as_double(v), lambda x: (x + add) * (x + add))))


def normalize(v, add: float = 0.0) -> Column:
    """The vector, each element plus `add`, at length 1; a zero vector stays zero."""
    n = norm(v, add)
    return F.when(n > 0, F.transform(as_double(v), lambda x: (x + add) / n)).otherwise(F.transform(as_double(v), lambda x: x + add))


def weighted_concat(a, b, beta: float) -> Column:
    """beta times a, followed by 1 - beta times b."""
    return F.concat(F.transform(as_double(a), lambda x: x * beta), F.transform(as_double(b), lambda x: x * (1 - beta)))


def squash(x: Column, gamma: float) -> Column:
    """2 / (1 + exp(-gamma x)) - 1."""
    return F.lit(2.0) / (1 + F.exp(-gamma * x)) - 1
