"""Distances and scores of two vector columns, computed in doubles; higher scores are nearer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import metric_name

MISMATCH = "Vectors must have same length"


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).when(a.isNull() | b.isNull(), None).otherwise(F.raise_error(F.lit(MISMATCH)))


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(v), lambda x: x * x)))


def dot(a: Column, b: Column) -> Column:
    return _same_size(a, b, _dot(a, b))


def cosine(a: Column, b: Column) -> Column:
    """The cosine, 0 if a vector is zero."""
    both = norm(a) * norm(b)
    return _same_size(a, b, F.when(both == 0, F.lit(0.0)).otherwise(_dot(a, b) / both))


def cosine_to_unit(a: Column, b: Column) -> Column:
    """The cosine where ``b`` has length 1 or 0."""
    n = norm(a)
    return _same_size(a, b, F.when(n == 0, F.lit(0.0)).otherwise(_dot(a, b) / n))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _same_size(a, b, _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def euclidean_score(a: Column, b: Column) -> Column:
    return 1 / (1 + euclidean(a, b))


def _hamming(a: Column, b: Column) -> Column:
    """Components whose signs (x >= 0) differ."""
    return _sum(F.zip_with(a, b, lambda x, y: F.when((x >= 0) != (y >= 0), 1.0).otherwise(0.0)))


def binary_squared_euclidean(a: Column, b: Column) -> Column:
    return _same_size(a, b, _hamming(a, b))


def binary_euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(binary_squared_euclidean(a, b))


def binary_dot(a: Column, b: Column) -> Column:
    """Components that are non-negative in both."""
    return _same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: F.when((x >= 0) & (y >= 0), 1.0).otherwise(0.0))))


def binary_cosine(a: Column, b: Column) -> Column:
    """2 (1 - h / n) - 1 for h differing signs of n; 0 for empty vectors."""
    return _same_size(a, b, F.when(F.size(a) == 0, 0.0).otherwise(1 - 2 * F.try_divide(_hamming(a, b), F.size(a).cast("double"))))


def score(a: Column, b: Column, metric: str | None = None, binary: bool = False) -> Column:
    """The score under a metric: cosine, dot, or 1 / (1 + euclidean)."""
    metric = metric_name(metric)
    if binary:
        return {"cosine": binary_cosine, "dot": binary_dot, "euclidean": lambda a, b: 1 / (1 + binary_euclidean(a, b))}[metric](a, b)
    return {"cosine": cosine, "dot": dot, "euclidean": euclidean_score}[metric](a, b)


def index_distance(a: Column, b: Column, metric: str | None = None) -> Column:
    """What an index walks by, lower is nearer: 1 less the cosine or the dot product, or the Euclidean distance."""
    name = metric_name(metric)
    return euclidean(a, b) if name == "euclidean" else 1 - (dot(a, b) if name == "dot" else cosine(a, b))
