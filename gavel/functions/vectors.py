"""Vectors as array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The inner product; vectors of different lengths give null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    """The vector at length 1; null for null, all-zero and not-finite ones."""
    norm = F.sqrt(dot(v, v))
    good = (norm > 0) & ~F.isnan(norm) & (norm < float("inf"))
    # The norm is repeated as an array: inside a lambda it would be computed for every element.
    return F.when(good, F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: x.cast("double") / n))


def distance(a: Column, b: Column) -> Column:
    """Cosine distance of two unit vectors."""
    return 1.0 - dot(a, b)
