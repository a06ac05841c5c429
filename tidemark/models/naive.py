"""Seasonal naive: the value one season ago, repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.models.base import HAT, ITEM, STEP, TS, Forecaster
from tidemark.operators.future import expand_future
from tidemark.operators.series import Y


class SeasonalNaive(Forecaster):
    name = "seasonal_naive"
    allowed = ("season",)

    @property
    def reach(self) -> int:
        return self.season

    def forecast(self, history: DataFrame, horizon: int, future: DataFrame | None = None) -> DataFrame:
        m = self.season
        back = F.row_number().over(W.partitionBy(ITEM).orderBy(F.desc(TS)))
        tail = history.select(ITEM, TS, Y, back.alias("back")).where(F.col("back") <= m)
        last = tail.groupBy(ITEM).agg(
            F.max(TS).alias("last_ts"),
            F.map_from_entries(F.collect_list(F.struct("back", Y))).alias("season"))
        rows = expand_future(last, horizon, self.freq)
        source = F.lit(m) - F.pmod(F.col(STEP) - 1, F.lit(m))
        # an item shorter than a season repeats its last value
        value = F.coalesce(F.element_at("season", source.cast("int")), F.element_at("season", F.lit(1)))
        return rows.select(ITEM, TS, STEP, value.alias(HAT))
