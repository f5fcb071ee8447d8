"""Vector functions as Spark columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(_doubles(v), lambda x: x / n)).otherwise(_doubles(v))


def is_finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def is_unit(v: Column) -> Column:
    """Norm 1 within 1e-3 and 1e-5 of it."""
    return F.abs(norm(v) - 1) <= 1e-3 + 1e-5
