"""Column expressions over vectors, computed in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(vector: Column) -> Column:
    return vector.cast("array<double>")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(vector), lambda x: x * x)))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def cosine_distance(a: Column, b: Column) -> Column:
    """In [0, 2]; NaN where a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.lit(1.0) - F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(float("nan")))


def distance_to_score(distance: Column) -> Column:
    """One less the distance, not below 0; NaN counts as 0."""
    return F.nanvl(F.greatest(F.lit(1.0) - distance, F.lit(0.0)), F.lit(0.0))


def l2_normalize(vector: Column) -> Column:
    """To length 1; lengths below 1e-12 count as that."""
    length = F.greatest(norm(vector), F.lit(1e-12))
    return F.transform(_double(vector), lambda x: x / length)


def mean_pool(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1, over at least one."""
    kept = F.greatest(F.aggregate(mask, F.lit(0), lambda n, m: n + m.cast("int")).cast("double"), F.lit(1.0))
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(_double(v), lambda x: x * m.cast("double")))
    zero = F.transform(_double(F.element_at(vectors, 1)), lambda x: x * 0.0)
    total = F.aggregate(weighted, zero, lambda t, v: F.zip_with(t, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / kept)
