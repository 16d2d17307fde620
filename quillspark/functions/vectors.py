"""Vector expressions over array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision; null if either is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    """Euclidean norm; null for a null array."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; null for null or zero vectors."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(length > 0, dot(a, b) / length)
