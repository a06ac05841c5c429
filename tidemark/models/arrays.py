"""Models that read a whole gridded series: ARIMA-type regression.

One row per item carries the series as an array (bounded by the calendar, see
``operators.series``); a pandas UDF forecasts every asked cut-off of every item in the batch,
so a backtest with many folds is still one pass over the items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_columns
from tidemark.models.base import HAT, ITEM, STEP, TS, Forecaster
from tidemark.models.ets import smoothed
from tidemark.operators.future import expand_future, repeat_last_covariates
from tidemark.operators.series import Y, series_arrays


class ArrayForecaster(Forecaster):
    def step_function(self):
        """(y, x or None, future x or None, horizon) -> forecasts."""
        raise NotImplementedError

    def with_inputs(self, df: DataFrame) -> DataFrame:
        return df.withColumn("x", F.array().cast("array<double>"))

    def forecast(self, history: DataFrame, horizon: int, future: DataFrame | None = None) -> DataFrame:
        packed = series_arrays(self.with_inputs(history), [Y, "x"])
        packed = packed.withColumn("cuts", F.array(F.size(Y)))
        if self.uses_exog:
            if future is None:
                future = repeat_last_covariates(history, list(self.exog), horizon, self.freq) if self.exog \
                    else expand_future(history.groupBy(ITEM).agg(F.max(TS).alias("last_ts")), horizon, self.freq)
            ahead = self.with_inputs(future).groupBy(ITEM).agg(
                F.array_sort(F.collect_list(F.struct(TS, "x"))).alias("f"))
            packed = packed.join(ahead, ITEM, "left").withColumn(
                "x", F.concat("x", F.coalesce(F.col("f")["x"], F.array().cast("array<array<double>>"))))
        made = packed.withColumn("made", self.udf(horizon)(F.col(Y), F.col("x"), F.col("cuts")))
        grid = expand_future(made.select(ITEM, "last_ts", F.col("made")[0].alias("v")), horizon, self.freq)
        return grid.select(ITEM, TS, STEP, F.element_at("v", F.col(STEP)).alias(HAT))

    def forecast_folds(self, indexed: DataFrame, plan) -> DataFrame:
        """(item, fold, h, y_hat) for all cut-offs."""
        made = candidate_folds(indexed, plan, [(0, self)])
        failed = made.where(F.col("error").isNotNull()).select("error").first()
        if failed:
            raise ValueError(failed["error"])
        return made.select(ITEM, "fold", F.posexplode("v").alias("h0", HAT)).select(
            ITEM, "fold", (F.col("h0") + 1).alias(STEP), HAT)

    def udf(self, horizon: int):
        one, use_x = self.step_function(), self.uses_exog

        @F.pandas_udf("array<array<double>>")
        def run(ys: pd.Series, xs: pd.Series, cuts: pd.Series) -> pd.Series:
            out = []
            for y, x, cs in zip(ys, xs, cuts):
                y = np.asarray(y, dtype=float)
                table = np.vstack([np.asarray(r, dtype=float) for r in x]) if use_x and len(x) else None
                folds = []
                for c in cs:
                    past = None if table is None else table[:c]
                    ahead = None if table is None else table[c:c + horizon]
                    folds.append(one(y[:c], past, ahead, horizon).tolist())
                out.append(folds)
            return pd.Series(out)

        return run


def candidate_folds(indexed: DataFrame, plan, models: list[tuple[int, "ArrayForecaster"]]) -> DataFrame:
    """(candidate, item, fold, v, error): all cut-offs of all models in one pass over the series.

    The models share their covariates.  A model that fails on an item gives a row with the error
    instead of forecasts, and the others go on.
    """
    first, horizon = models[0][1], plan.horizon
    ends = indexed.groupBy(ITEM).agg(F.first(plan.cutoffs(F.col("n"))).alias("cuts"), F.first(plan.first(F.col("n"))).alias("k0"))
    packed = series_arrays(first.with_inputs(indexed), [Y, "x"]).join(ends, ITEM).where(F.size("cuts") > 0)

    @F.pandas_udf("array<struct<candidate:int,fold:int,v:array<double>,error:string>>")
    def run(ys: pd.Series, xs: pd.Series, cuts: pd.Series, k0: pd.Series) -> pd.Series:
        out = []
        for y, x, cs, k in zip(ys, xs, cuts, k0):
            y = np.asarray(y, dtype=float)
            table = np.vstack([np.asarray(r, dtype=float) for r in x]) if len(x) and len(x[0]) else None
            made = []
            for number, model in models:
                try:
                    one, use_x = model.step_function(), model.uses_exog and table is not None
                    for at, c in enumerate(cs):
                        past, ahead = (table[:c], table[c:c + horizon]) if use_x else (None, None)
                        made.append({"candidate": number, "fold": int(k) + at, "v": one(y[:c], past, ahead, horizon).tolist(), "error": None})
                except Exception as e:  # a candidate's own failure
                    made.append({"candidate": number, "fold": -1, "v": None, "error": f"{type(e).__name__}: {e}"})
            out.append(made)
        return pd.Series(out)

    return (packed.select(ITEM, F.explode(run(F.col(Y), F.col("x"), F.col("cuts"), F.col("k0"))).alias("m"))
                  .select(F.col("m.candidate").alias("candidate"), ITEM, F.col("m.fold").alias("fold"), F.col("m.v").alias("v"),
                          F.col("m.error").alias("error")))


# --- ARIMA by two-stage least squares ------------------------------------------------


def _difference(v: np.ndarray, lags: list[int]) -> np.ndarray:
    for k in lags:
        v = v[k:] - v[:-k]
    return v


def _lagged(v: np.ndarray, lags: list[int], start: int) -> np.ndarray:
    return np.column_stack([v[start - k:len(v) - k] for k in lags]) if lags else np.zeros((len(v) - start, 0))


def regress_arima(y, past, ahead, horizon, order, seasonal) -> np.ndarray | None:
    """Differenced regression on own lags, lagged residuals of a long autoregression and
    covariates; None when the series is too short or the forecast runs away."""
    p, d, q = order
    sp, sd, sq, m = seasonal
    diffs = [1] * d + [m] * sd
    w = _difference(y, diffs)
    own = sorted(set(range(1, p + 1)) | {m * k for k in range(1, sp + 1)})
    shocks = sorted(set(range(1, q + 1)) | {m * k for k in range(1, sq + 1)})
    long_ar = max([*own, *shocks, 1]) + 2
    start = long_ar + max(shocks, default=0)
    x = None if past is None else _difference(past, diffs)
    width = len(own) + len(shocks) + (0 if x is None else x.shape[1]) + 1
    if len(w) < start + 2 * width:
        return None
    # residuals of the long autoregression stand in for the shocks
    lags = list(range(1, long_ar + 1))
    design = np.column_stack([np.ones(len(w) - long_ar), _lagged(w, lags, long_ar)])
    beta, *_ = np.linalg.lstsq(design, w[long_ar:], rcond=None)
    e = np.zeros(len(w))
    e[long_ar:] = w[long_ar:] - design @ beta
    parts = [np.ones((len(w) - start, 1)), _lagged(w, own, start), _lagged(e, shocks, start)]
    if x is not None:
        parts.append(x[start:])
    beta, *_ = np.linalg.lstsq(np.column_stack(parts), w[start:], rcond=None)
    x_all = None if x is None else _difference(np.vstack([past, ahead]), diffs)
    wx, ex = list(w), list(e)
    for s in range(horizon):
        row = [1.0, *[wx[-k] for k in own], *[ex[-k] for k in shocks]]
        if x_all is not None:
            row += list(x_all[len(w) + s])
        wx.append(float(np.dot(beta, row)))
        ex.append(0.0)
    # undo the differences, innermost last
    levels = [y]
    for k in diffs:
        levels.append(levels[-1][k:] - levels[-1][:-k])
    out = np.array(wx[len(w):])
    for k, base in zip(reversed(diffs), reversed(levels[:-1])):
        full = list(base)
        for v in out:
            full.append(v + full[-k])
        out = np.array(full[len(base):])
    bound = 10 * (np.abs(y).max() + 1)
    return out if np.isfinite(out).all() and np.abs(out).max() < bound else None


class Sarimax(ArrayForecaster):
    """Seasonal ARIMA with standardised covariates and calendar."""

    name = "sarimax"
    allowed = ("order", "seasonal_order")
    with_calendar = True

    @property
    def uses_exog(self) -> bool:
        return True

    def with_inputs(self, df: DataFrame) -> DataFrame:
        values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.exog]
        if self.with_calendar:
            values += [v.cast("double") for v in calendar_columns(F.col(TS)).values()]
        return df.withColumn("x", F.array(*values).cast("array<double>"))

    def orders(self):
        return (tuple(self.params.get("order", (1, 1, 1))),
                tuple(self.params.get("seasonal_order", (0, 1, 1, self.season))))

    def step_function(self):
        order, seasonal = self.orders()

        def one(y, past, ahead, horizon):
            y = np.nan_to_num(y)
            if past is not None:
                mu, sigma = past.mean(0), past.std(0)
                keep = sigma > 1e-12
                past, ahead = (past - mu)[:, keep] / sigma[keep], (ahead - mu)[:, keep] / sigma[keep]
                if past.shape[1] == 0 or len(ahead) < horizon:
                    past = ahead = None
            m = seasonal[3]
            for s in (seasonal, (0, 1, 0, m)):
                out = regress_arima(y, past, ahead, horizon, order, s)
                if out is not None:
                    return out
            return smoothed(y, m, horizon)

        return one


class Arima(Sarimax):
    """The same without seasonal part, covariates or calendar."""

    name = "arima"
    allowed = ("order",)
    with_calendar = False

    @property
    def uses_exog(self) -> bool:
        return bool(self.exog)

    def orders(self):
        return tuple(self.params.get("order", (2, 1, 1))), (0, 0, 0, self.season)
