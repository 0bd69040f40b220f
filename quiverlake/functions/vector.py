"""Column functions on vectors (arrays of floats). All arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quiverlake.functions.constants import TINY_NORM


def as_double(v) -> Column:
    return F.col(v).cast("array<double>") if isinstance(v, str) else v.cast("array<double>")


def vec_dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vec_norm(v) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def vec_normalize(v, norm: Column | None = None) -> Column:
    """v / its norm; vectors shorter than 1e-10 become zero."""
    n = vec_norm(v) if norm is None else norm
    return F.transform(as_double(v), lambda x: F.when(n < TINY_NORM, F.lit(0.0)).otherwise(x / n))


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def vec_codes(v, bounds: Sequence[float], above: bool = False) -> Column:
    """Number of boundaries that each coordinate reaches; with above, exceeds."""
    b = literal(bounds)
    return F.transform(as_double(v), lambda x: F.size(F.filter(b, (lambda y: x > y) if above else (lambda y: x >= y))))


def vec_rotate(v, matrix) -> Column:
    """Product of a dense matrix (rows of numbers) and v; for few rows and small dimensions, else rotate in Arrow batches."""
    rows = F.array(*(literal(r) for r in matrix))
    return F.transform(rows, lambda r: vec_dot(r, as_double(v)))


def round6(c) -> Column:
    return F.round(c, 6) + F.lit(0.0)
