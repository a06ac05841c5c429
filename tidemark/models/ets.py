"""Additive exponential smoothing as one forward pass per item.

Rows come sorted by item and time; a task walks them once, carries the smoothing states of the item it
is in from one Arrow batch to the next, and writes a forecast at each cut-off it passes.  All
candidate rates run side by side; a forecast takes those with the least one-step error so far.  A
backtest costs one pass however many folds it has, and no item is ever held whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.models.base import HAT, ITEM, STEP, TS, Forecaster
from tidemark.operators.cuts import cut_table
from tidemark.operators.future import expand_future
from tidemark.operators.series import Y

RATES = (0.1, 0.3, 0.6)


class Smoother:
    """States of all candidate rates after the values pushed so far.

    The first two seasons give the first level, slope and season; before they are whole, and without
    a season, a forecast smooths without one.  A missing value is passed over: each candidate takes its
    own forecast for it.
    """

    def __init__(self, m: int, rates: tuple[float, ...] = RATES):
        self.m, self.rates = m if m > 1 else 1, tuple(rates)
        self.seasonal = self.m > 1
        grid = np.array(list(itertools.product(rates, (0.0, *rates[:2]), rates if self.seasonal else (0.0,))))
        self.a, self.b, self.g = grid.T
        self.early: list[float] = []
        self.n = 0
        self.level = None

    def _begin(self) -> None:
        m, early = self.m, np.array(self.early)
        if self.seasonal:
            known = early[np.isfinite(early)]
            early = np.where(np.isfinite(early), early, known.mean() if len(known) else 0.0)
            first = early[:m].mean()
            self.level = np.full(len(self.a), first)
            self.slope = np.full(len(self.a), (early[m:2 * m].mean() - first) / m)
            self.season = np.tile((early[:m] - first)[:, None], (1, len(self.a)))
        else:
            self.level = np.full(len(self.a), early[0] if np.isfinite(early[0]) else 0.0)
            self.slope, self.season = np.zeros(len(self.a)), np.zeros((1, len(self.a)))
        self.error = np.zeros(len(self.a))
        rest = early[m:]
        self.n = m
        for v in rest:
            self._step(float(v))

    def _step(self, y: float) -> None:
        place = self.n % self.m
        season, ahead = self.season[place], self.level + self.slope
        self.n += 1
        if not np.isfinite(y):
            self.level = ahead
            return
        miss = y - (ahead + season)
        self.error += miss * miss
        level = self.a * (y - season) + (1 - self.a) * ahead
        self.slope = self.b * (level - self.level) + (1 - self.b) * self.slope
        self.level = level
        if self.seasonal:
            self.season[place] = self.g * (y - level) + (1 - self.g) * season

    def push(self, y: float) -> None:
        if self.level is not None:
            self._step(y)
            return
        self.early.append(y)
        if len(self.early) == (2 * self.m if self.seasonal else 1):
            self._begin()

    def forecast(self, horizon: int) -> np.ndarray:
        if self.level is None:
            if not self.early:
                return np.zeros(horizon)
            plain = Smoother(1, self.rates)
            for v in self.early:
                plain.push(v)
            return plain.forecast(horizon)
        k, steps = int(np.argmin(self.error)), np.arange(1, horizon + 1)
        return self.level[k] + self.slope[k] * steps + self.season[(self.n - 1 + steps) % self.m, k]


def smoothed(y: np.ndarray, m: int, horizon: int, rates: tuple[float, ...] = RATES) -> np.ndarray:
    """Forecast of one series."""
    states = Smoother(m, rates)
    for v in y.tolist():
        states.push(v)
    return states.forecast(horizon)


class Ets(Forecaster):
    name = "ets"
    allowed = ("rates",)

    def _scan(self, rows: DataFrame, step: int, horizon: int) -> DataFrame:
        """(item, cut, v): forecasts after the first ``lo`` rows of an item and every ``step`` rows on, up to ``hi`` rows.

        ``rows``: item, time, target, lo, hi.
        """
        m, rates = self.season, tuple(self.params.get("rates", RATES))
        ordered = rows.select(ITEM, TS, F.col(Y).cast("double").alias(Y), "lo", "hi").repartition(ITEM).sortWithinPartitions(ITEM, TS)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            item, states, done = None, None, 0
            for batch in batches:
                items, cuts, made = [], [], []
                values = batch.column(1).to_numpy(zero_copy_only=False)
                for name, y, lo, hi in zip(batch.column(0).to_pylist(), values, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    if states is None or name != item:
                        item, states, done = name, Smoother(m, rates), 0
                    states.push(float(y))
                    done += 1
                    if lo <= done <= hi and (done - lo) % step == 0:
                        items.append(name)
                        cuts.append(done)
                        made.append(states.forecast(horizon).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(cuts, pa.int32()),
                                                  pa.array(made, pa.list_(pa.float64()))], [ITEM, "cut", "v"])

        return ordered.select(ITEM, Y, "lo", "hi").mapInArrow(run, f"{ITEM} string, cut int, v array<double>")

    def forecast(self, history: DataFrame, horizon: int, future: DataFrame | None = None) -> DataFrame:
        ends = history.groupBy(ITEM).agg(F.max(TS).alias("last_ts"), F.count(F.lit(1)).cast("int").alias("n"))
        rows = history.join(ends.select(ITEM, F.col("n").alias("lo"), F.col("n").alias("hi")), ITEM)
        made = self._scan(rows, 1, horizon).join(ends, ITEM).select(ITEM, "last_ts", "v")
        grid = expand_future(made, horizon, self.freq)
        return grid.select(ITEM, TS, STEP, F.element_at("v", F.col(STEP)).alias(HAT))

    def forecast_folds(self, indexed: DataFrame, plan) -> DataFrame:
        """(item, fold, h, y_hat) for all cut-offs, from one pass over each item's rows before the last of them."""
        ends = cut_table(indexed, plan).groupBy(ITEM).agg(F.min("cut").alias("lo"), F.max("cut").alias("hi"))
        rows = indexed.join(ends, ITEM).where(F.col("rn") < F.col("hi"))
        made = self._scan(rows, plan.step, plan.horizon)
        folds = made.select(ITEM, ((F.col("cut") - plan.initial) / plan.step).cast("int").alias("fold"), F.posexplode("v").alias("h0", HAT))
        return folds.select(ITEM, "fold", (F.col("h0") + 1).alias(STEP), HAT)
