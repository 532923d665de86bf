"""Row-level vector expressions on ``ARRAY<FLOAT>`` / ``ARRAY<DOUBLE>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """Cosine distance d in [0, 2] mapped to 1 - d / 2, that is (1 + cos) / 2."""
    return (F.lit(1.0) + cosine(a, b)) / 2


def l2_normalize(v: Column) -> Column:
    """v / |v|; NULL for a zero vector.

    The norm enters as the variable of an outer lambda: a plain column expression would
    be evaluated again for every element.
    """
    scaled = F.transform(
        F.array(norm(v)), lambda n: F.when(n > 0, F.transform(as_double(v), lambda x: x / n))
    )
    return F.get(scaled, F.lit(0))
