"""Theta: mean of a linear trend and simple smoothing of the doubled deviations.

All in aggregates: the trend is a regression on the row number, and the smoothed level is a
sum weighted by powers of (1 - alpha).  Seasonal means are taken out first, put back last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.models.base import HAT, ITEM, STEP, TS, Forecaster
from tidemark.operators import cuts
from tidemark.operators.future import expand_future
from tidemark.operators.series import Y, by_item


class Theta(Forecaster):
    name = "theta"
    allowed = ("alpha", "seasonal")

    def forecast(self, history: DataFrame, horizon: int, future: DataFrame | None = None) -> DataFrame:
        alpha, m = float(self.params.get("alpha", 0.2)), self.season
        seasonal = self.params.get("seasonal", True) and m > 1
        rows = (history.select(ITEM, TS, Y).withColumn("t", F.row_number().over(by_item()) - 1)
                       .withColumn("phase", F.col("t") % m))
        item = W.partitionBy(ITEM)
        shift = (F.avg(Y).over(W.partitionBy(ITEM, "phase")) - F.avg(Y).over(item)) if seasonal else F.lit(0.0)
        rows = rows.withColumn("s", shift).withColumn("v", F.col(Y) - F.col("s"))
        lines = rows.groupBy(ITEM).agg(
            F.count(F.lit(1)).alias("n"), F.max(TS).alias("last_ts"),
            F.regr_slope("v", "t").alias("b"), F.regr_intercept("v", "t").alias("a"),
            F.map_from_entries(F.array_distinct(F.collect_list(F.struct("phase", "s")))).alias("season"),
            # level of smoothing v and t, to be combined into that of 2v - (a + bt)
            F.max(F.when(F.col("t") == 0, F.col("v"))).alias("v0"),
            F.array_sort(F.collect_list(F.struct("t", "v"))).alias("series"))
        n = F.col("n")
        weight = lambda t: alpha * F.pow(F.lit(1 - alpha), n - 1 - t)
        slope, cut = F.coalesce("b", F.lit(0.0)), F.coalesce("a", "v0")
        level = F.aggregate("series", F.lit(0.0), lambda acc, e: acc + weight(e["t"]) * (
            2 * e["v"] - (cut + slope * e["t"])))
        level = level + F.pow(F.lit(1 - alpha), n) * (2 * F.col("v0") - cut)
        fitted = lines.select(ITEM, "last_ts", "n", "season", slope.alias("b"), cut.alias("a"), level.alias("level"))
        out = expand_future(fitted, horizon, self.freq)
        trend = F.col("a") + F.col("b") * (F.col("n") - 1 + F.col(STEP))
        phase = F.pmod(F.col("n") - 1 + F.col(STEP), F.lit(m)).cast("int")
        back = F.coalesce(F.element_at("season", phase), F.lit(0.0))
        return out.select(ITEM, TS, STEP, ((trend + F.col("level")) / 2 + back).alias(HAT))

    def forecast_folds(self, indexed: DataFrame, plan) -> DataFrame:
        """(item, fold, h, y_hat) for all cut-offs: the same sums as above, as running ones per season phase."""
        alpha, m = float(self.params.get("alpha", 0.2)), self.season
        seasonal, keep = self.params.get("seasonal", True) and m > 1, 1 - alpha
        t, y = F.col("rn"), F.col(Y)
        rows = cuts.segments(indexed, plan).withColumn("phase", t % m)
        parts = rows.groupBy(ITEM, cuts.FOLD, "phase").agg(
            F.count(Y).cast("double").alias("n"), F.sum(Y).alias("sy"), F.sum(F.when(y.isNotNull(), t)).cast("double").alias("st"),
            F.sum(F.when(y.isNotNull(), t.cast("double") * t)).alias("stt"), F.sum(t * y).alias("sty"),
            F.sum(alpha * F.pow(F.lit(keep), F.col(cuts.CUT) - 1 - t) * y).alias("dy"),
            F.count_if(y.isNull()).cast("double").alias("gone"), F.max(F.when(t == 0, y)).alias("y0"))
        full = cuts.phases(cuts.cut_table(indexed, plan), m).join(parts, [ITEM, cuts.FOLD, "phase"], "left")
        sums = ("n", "sy", "st", "stt", "sty", "gone")
        full = full.select(ITEM, cuts.FOLD, cuts.CUT, "phase", F.coalesce("dy", F.lit(0.0)).alias("dy"), "y0",
                           *[cuts.running(c, ITEM, "phase").alias(c) for c in sums])
        cut, phase = F.col(cuts.CUT), F.col("phase")
        # weight of the rows of a phase in the smoothed level
        newest = F.pmod(cut - 1 - phase, F.lit(m))
        times = F.greatest(F.lit(0), F.floor((cut - 1 - phase) / m) + 1)
        weight = alpha * F.pow(F.lit(keep), newest) * (1 - F.pow(F.lit(keep ** m), times)) / (1 - keep ** m)
        by_phase = F.collect_list(F.struct("phase", "n", "sy", "st", F.when(times > 0, weight).otherwise(0.0).alias("e")))
        one = full.groupBy(ITEM, cuts.FOLD, cuts.CUT).agg(
            by_phase.alias("p"), F.max("y0").alias("y0"), F.sum("dy").alias("dy"), *[F.sum(c).alias(c) for c in sums])
        one = one.withColumns({"y0": F.first("y0", ignorenulls=True).over(W.partitionBy(ITEM).orderBy(cuts.FOLD)),
                               "dy": cuts.decayed("dy", cuts.CUT, keep, plan.step, ITEM)})
        shift = lambda e: F.when(e["n"] > 0, e["sy"] / e["n"] - F.col("sy") / F.col("n")).otherwise(0.0) if seasonal else F.lit(0.0)
        one = one.withColumn("season", F.map_from_entries(F.transform("p", lambda e: F.struct(e["phase"], shift(e)))))
        over = lambda c: F.aggregate("p", F.lit(0.0), lambda total, e: total + e[c] * shift(e))
        sv, stv, n = F.col("sy") - over("n"), F.col("sty") - over("st"), F.col("n")
        below = n * F.col("stt") - F.col("st") * F.col("st")
        one = one.withColumn("b", F.when(below != 0, (n * stv - F.col("st") * sv) / below).otherwise(0.0))
        one = one.withColumn("a", (sv - F.col("b") * F.col("st")) / n)
        last = F.pow(F.lit(keep), cut)
        behind = keep * (1 - cut * F.pow(F.lit(keep), cut - 1) + (cut - 1) * last) / alpha
        trend = F.col("a") * (1 - last) + F.col("b") * ((cut - 1) * (1 - last) - behind)
        v0 = F.col("y0") - F.coalesce(F.element_at("season", F.lit(0)), F.lit(0.0))
        level = 2 * (F.col("dy") - over("e")) - trend + last * (2 * v0 - F.col("a"))
        fitted = one.select(ITEM, cuts.FOLD, cuts.CUT, "a", "b", "season", F.when(F.col("gone") == 0, level).alias("level"),
                            F.explode(F.sequence(F.lit(1), F.lit(plan.horizon))).alias(STEP))
        ahead = F.col(cuts.CUT) - 1 + F.col(STEP)
        back = F.coalesce(F.element_at("season", F.pmod(ahead, F.lit(m)).cast("int")), F.lit(0.0))
        return fitted.select(ITEM, cuts.FOLD, STEP, ((F.col("a") + F.col("b") * ahead + F.col("level")) / 2 + back).alias(HAT))
