"""Vectors as array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalise(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(double(v), lambda x: x / length)).otherwise(double(v))


def discount(rank: Column) -> Column:
    """Discount of a 1-based rank."""
    return 1.0 / F.log2(rank + 1.0)


def gain(grade: Column, exponential: bool = False) -> Column:
    """Gain of a grade: itself, or 2 ** grade - 1."""
    return F.pow(F.lit(2.0), grade) - 1.0 if exponential else grade.cast("double")
