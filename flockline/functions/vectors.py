"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO_TOLERANCE = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays zero.

    The norm is bound once through a one-element array; written inside the
    inner lambda it would be evaluated again for every element.
    """
    scaled = F.transform(
        F.array(norm(v)),
        lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))),
    )
    return F.element_at(scaled, 1)


def is_nonzero(v: Column) -> Column:
    return F.exists(v, lambda x: F.abs(x) > ZERO_TOLERANCE)


def round6(x: Column) -> Column:
    """Six decimals, never a negative zero."""
    rounded = F.round(x, 6)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)
