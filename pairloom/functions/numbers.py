"""Numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round to an integer, halves upward."""
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low, high) -> Column:
    """x held between low and high; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def digitize(score: Column, t1: Column, t2: Column) -> Column:
    """0 below t1, 1 from t1, 2 from t2."""
    return (score >= t1).cast("int") + (score >= t2).cast("int")


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n in double precision, and 0 for n = 0, without a sum over n.

    The asymptotic series is taken 16 places further on, where its error is below the rounding error, and the places between are taken off.
    """
    x = n + F.lit(16.0)
    y = 1 / (x * x)
    series = F.log(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - y * (F.lit(1 / 12) - y * (F.lit(1 / 120) - y * (F.lit(1 / 252) - y * F.lit(1 / 240))))
    between = F.lit(0.0)
    for i in range(16, 0, -1):
        between = between + 1 / (n + F.lit(float(i)))
    return series - between
