"""Dense vectors as column expressions (double precision, summed left to right)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    """Euclidean norm."""
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Cosine of two vectors with known norms; null if one is zero."""
    return F.when((na > 0) & (nb > 0), dot(a, b) / (na * nb))
