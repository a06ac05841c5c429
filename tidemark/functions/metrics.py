"""Error measures as aggregate expressions over truth and prediction columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8  # fixed value: keeps ratios finite


def rmse(y: Column, y_hat: Column) -> Column:
    return F.sqrt(F.avg((y - y_hat) * (y - y_hat)))


def mae(y: Column, y_hat: Column) -> Column:
    return F.avg(F.abs(y - y_hat))


def smape(y: Column, y_hat: Column) -> Column:
    """Fraction in [0, 2]."""
    return F.avg(2.0 * F.abs(y_hat - y) / (F.abs(y) + F.abs(y_hat) + EPS))


def mape(y: Column, y_hat: Column) -> Column:
    return F.avg(F.abs((y - y_hat) / (F.abs(y) + EPS)))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)
