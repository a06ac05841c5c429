"""Non-parametric forecasts: past values of the same season phase, newer ones weighing more.

Weights fall by a constant factor per season, so the weighted quantiles of a phase do not
change with the step: they are computed once per (item, phase) and joined to the grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.models.base import HAT, ITEM, STEP, TS, Forecaster
from tidemark.operators import cuts
from tidemark.operators.future import expand_future
from tidemark.operators.series import Y, by_item

QUANTILES = (0.1, 0.5, 0.9)


def quantile_name(q: float) -> str:
    return f"p{round(q * 100):02d}"


class Npts(Forecaster):
    name = "npts"
    allowed = ("decay", "quantiles")

    def forecast(self, history: DataFrame, horizon: int, future: DataFrame | None = None) -> DataFrame:
        decay, m = float(self.params.get("decay", 0.9)), self.season
        levels = tuple(self.params.get("quantiles", QUANTILES))
        n = F.count(F.lit(1)).over(W.partitionBy(ITEM))
        rows = (history.select(ITEM, TS, Y)
                .withColumn("t", F.row_number().over(by_item()) - 1).withColumn("n", n)
                .where(F.col(Y).isNotNull()))
        age = F.floor((F.col("n") - 1 - F.col("t")) / m)
        rows = rows.select(ITEM, TS, "n", Y, (F.col("t") % m).alias("phase"), F.pow(F.lit(decay), age).alias("w"))
        values = W.partitionBy(ITEM, "phase").orderBy(Y, TS).rowsBetween(W.unboundedPreceding, 0)
        share = F.sum("w").over(values) / F.sum("w").over(W.partitionBy(ITEM, "phase"))
        ranked = rows.withColumn("share", share)
        phases = ranked.groupBy(ITEM, "phase").agg(
            (F.sum(F.col("w") * F.col(Y)) / F.sum("w")).alias(HAT),
            # the epsilon keeps a share that should equal the level on its near side
            *[F.min(F.when(F.col("share") >= q - 1e-9, F.col(Y))).alias(quantile_name(q)) for q in levels])
        last = history.groupBy(ITEM).agg(F.max(TS).alias("last_ts"), F.count(F.lit(1)).alias("n"))
        grid = expand_future(last, horizon, self.freq)
        phase = F.pmod(F.col("n") - 1 + F.col(STEP), F.lit(m))
        return (grid.withColumn("phase", phase).join(phases, [ITEM, "phase"], "left")
                    .select(ITEM, TS, STEP, HAT, *[quantile_name(q) for q in levels]))

    def forecast_folds(self, indexed: DataFrame, plan) -> DataFrame:
        """(item, fold, h, y_hat) for all cut-offs, from fading sums per season phase."""
        decay, m = float(self.params.get("decay", 0.9)), self.season
        phase, cut = F.col("phase"), F.col(cuts.CUT)
        rows = cuts.segments(indexed, plan).withColumn("phase", F.col("rn") % m)
        # values of a phase are numbered; a cut-off sees them up to the newest before it
        newest = F.floor((cut - 1 - phase) / m)
        weight = F.when(F.col(Y).isNotNull(), F.pow(F.lit(decay), newest - F.floor(F.col("rn") / m)))
        parts = rows.groupBy(ITEM, cuts.FOLD, "phase").agg(F.sum(weight).alias("w"), F.sum(weight * F.col(Y)).alias("wy"))
        full = cuts.phases(cuts.cut_table(indexed, plan), m).join(parts, [ITEM, cuts.FOLD, "phase"], "left")
        full = full.withColumn("newest", newest)
        gap = plan.step // m
        total = {c: cuts.decayed(c, "newest", decay, gap, ITEM, "phase").alias(c) for c in ("w", "wy")}
        means = full.select(ITEM, cuts.FOLD, cuts.CUT, "phase", *total.values())
        means = means.select(ITEM, cuts.FOLD, cuts.CUT, "phase", F.when(F.col("w") > 0, F.col("wy") / F.col("w")).alias(HAT))
        steps = F.explode(F.filter(F.sequence(F.lit(1), F.lit(plan.horizon)), lambda h: F.pmod(cut - 1 + h, F.lit(m)) == phase))
        return means.withColumn(STEP, steps).select(ITEM, cuts.FOLD, STEP, HAT)
