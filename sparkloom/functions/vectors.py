"""Array expressions inside the JVM: dot products, norms, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-7
#: Digits by which results are ranked and cut: beyond them sums depend on the order of their terms. What is shown has fewer.
EXACT = 12


def literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def distance(a: Column, b: Column) -> Column:
    """Euclidean; null where the dimensions differ."""
    return F.when(F.size(a) == F.size(b), F.sqrt(squared_distance(a, b)))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is under TINY."""
    na, nb = norm(a), norm(b)
    return F.when((na < TINY) | (nb < TINY), 0.0).otherwise(dot(a, b) / (na * nb))


def fitted(a: Column, dim: int) -> Column:
    """Cut or padded with zeros to `dim` entries."""
    return F.slice(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(0.0), dim)), 1, dim)


def root_sift(a: Column) -> Column:
    """Square roots of the entries over the sum of their absolute values."""
    total = F.greatest(_sum(F.transform(a, lambda x: F.abs(x.cast("double")))), F.lit(TINY))
    return F.transform(a, lambda x: F.sqrt(x.cast("double") / total))
