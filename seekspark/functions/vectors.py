"""Vector functions as column expressions over arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _double(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: _double(x) * _double(x))))


def cosine(a: Column, b: Column) -> Column:
    """0 for unlike lengths and for zero vectors."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def checked_cosine(a: Column, b: Column) -> Column:
    """The job stops at vectors of unlike lengths."""
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unlike lengths")).cast("double")).otherwise(cosine(a, b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: F.pow(_double(x) - _double(y), 2))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(_double(x) - _double(y))))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: _double(x) / n)).otherwise(F.transform(a, _double))
