"""The distance functions for SQL users: temporary SQL functions, which Catalyst inlines as expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (p, x) -> p + x)"
_SQUARE = "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (p, x) -> p + x)"
_NORM = "sqrt(aggregate(transform({0}, x -> x * x), 0D, (p, x) -> p + x))"
_HAMMING = "aggregate(zip_with(a, b, (x, y) -> if((x >= 0) <> (y >= 0), 1D, 0D)), 0D, (p, x) -> p + x)"
_CHECK = "if(size(a) = size(b), {0}, cast(raise_error('Vectors must have same length') as double))"

FUNCTIONS = {
    "vec_dot": _DOT,
    "vec_cosine": f"coalesce(try_divide({_DOT}, {_NORM.format('a')} * {_NORM.format('b')}), 0D)",
    "vec_l2": f"sqrt({_SQUARE})",
    "vec_l2_squared": _SQUARE,
    "vec_l2_score": f"1 / (1 + sqrt({_SQUARE}))",
    "vec_binary_cosine": f"coalesce(1 - 2 * try_divide({_HAMMING}, size(a)), 0D)",
    "vec_hamming": _HAMMING,
}


def register(spark: SparkSession) -> None:
    """Adds ``vec_*(a, b)`` over ARRAY<DOUBLE> to the session."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {_CHECK.format(body)}")
