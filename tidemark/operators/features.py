"""Features of a gridded series: lags, rolling means, calendar, covariates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import FeatureConfig
from tidemark.functions.calendar import CALENDAR_NAMES, calendar_columns
from tidemark.operators.series import ITEM, TS, Y, by_item


def lag_columns(lags: tuple[int, ...], y: str = Y) -> dict[str, Column]:
    return {f"lag_{k}": F.lag(y, k).over(by_item()) for k in lags}


def rolling_columns(windows: tuple[int, ...], y: str = Y) -> dict[str, Column]:
    """Mean of the ``w`` rows before the current one; null unless all ``w`` are there."""
    out = {}
    for w in windows:
        frame = by_item().rowsBetween(-w, -1)
        out[f"roll_mean_{w}"] = F.when(F.count(y).over(frame) == w, F.avg(y).over(frame))
    return out


def feature_names(cfg: FeatureConfig, exog: list[str] | None = None) -> list[str]:
    names = [f"lag_{k}" for k in cfg.lags] + [f"roll_mean_{w}" for w in cfg.roll_windows]
    return names + (list(CALENDAR_NAMES) if cfg.add_calendar else []) + list(exog or [])


def feature_matrix(df: DataFrame, cfg: FeatureConfig | None = None, exog: DataFrame | None = None,
                   y: str = Y) -> DataFrame:
    """All feature columns on the rows of ``df``; lags and windows share one sort per item."""
    cfg = cfg or FeatureConfig()
    out = df.withColumns({**lag_columns(cfg.lags, y), **rolling_columns(cfg.roll_windows, y)})
    if cfg.add_calendar:
        out = out.withColumns(calendar_columns(F.col(TS)))
    if exog is not None:
        out = out.join(exog, [ITEM, TS], "left")
    return out


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.dropna(subset=columns)


def align_columns(df: DataFrame, names: list[str], fill: float | None = 0.0, keep: list[str] = ()) -> DataFrame:
    """Exactly ``names`` in order: missing ones become ``fill``, extra ones go."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(f"`{c}`") if c in have else F.lit(fill).cast("double").alias(c)
                              for c in names])
