"""Covariates for regression: cleaning and scaling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.calendar import calendar_columns
from tidemark.functions.metrics import finite_or_null
from tidemark.operators.features import align_columns
from tidemark.operators.series import ITEM, TS, by_item

MIN_SIGMA = 1e-12  # fixed value: below this spread a column counts as constant


def clean_exog(df: DataFrame, columns: list[str], add_calendar: bool = True, drop_constant: bool = True,
               required: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """Infinite to null, forward fill, rest 0, constants out, calendar in.

    A text column that is no number becomes 0 after the fill, as a bad value would.  ``required``
    columns stay when they are constant.
    """
    casts = {}
    for c in columns:
        text = isinstance(df.schema[c].dataType, T.StringType)
        casts[c] = F.col(c) if text else finite_or_null(F.col(c).cast("double"))
    past = by_item().rowsBetween(W.unboundedPreceding, 0)
    out = df.withColumns(casts)
    out = out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(past).try_cast("double"), F.lit(0.0))
                           for c in columns})
    keep = list(columns)
    if drop_constant and columns:
        spread = out.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
        keep = [c for c in columns if c in required or (spread[c] or 0.0) > MIN_SIGMA]
    out = out.drop(*[c for c in columns if c not in keep])
    if add_calendar:
        calendar = {k: v.cast("double") for k, v in calendar_columns(F.col(TS)).items()}
        out, keep = out.withColumns(calendar), keep + list(calendar)
    return out, keep


@dataclass(frozen=True)
class Scaling:
    """Mean and population deviation of the training rows, in column order."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    sigma: tuple[float, ...]


def fit_scaling(train: DataFrame, columns: list[str]) -> Scaling:
    row = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    return Scaling(tuple(columns), tuple(row[f"m{i}"] or 0.0 for i in range(len(columns))),
                   tuple((row[f"s{i}"] or 0.0) or 1.0 for i in range(len(columns))))


def apply_scaling(df: DataFrame, scaling: Scaling, keep: list[str] = (ITEM, TS)) -> DataFrame:
    """Standardised columns in training order; a missing column counts as 0."""
    aligned = align_columns(df, list(scaling.columns), 0.0, list(keep))
    return aligned.select(*keep, *[((F.col(c) - F.lit(m)) / F.lit(s)).alias(c)
                                   for c, m, s in zip(scaling.columns, scaling.mean, scaling.sigma)])
