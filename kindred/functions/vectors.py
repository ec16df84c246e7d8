"""Vector arithmetic on arrays of numbers, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions.cleaning import as_column


def doubles(c: Column | str) -> Column:
    return as_column(c).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(doubles(a), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; null when one has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
