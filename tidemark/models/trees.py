"""Tree forecasters over all items: recursive (forest or boosted) and direct (boosted).

Fits and predictions are Spark ML's.  The recursive forecast needs earlier predictions as inputs:
an item is one row with its last ``reach`` values and the known inputs of its steps; a step
appends the model's prediction to those values.  Steps run in blocks, a block being one job, and
the rows between two blocks are checkpointed.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, RandomForestRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.calendar import CALENDAR_NAMES, calendar_columns, plus_steps
from tidemark.models.base import HAT, ITEM, STEP, TS, Forecaster
from tidemark.operators.features import complete_cases, feature_matrix, feature_names
from tidemark.operators.future import expand_future, future_exog
from tidemark.operators.series import Y, by_item
from tidemark.session import cut_lineage

MAX_DEPTH = 30  # the deepest tree Spark grows
DEFAULT_DEPTH = 12  # the deepest of the search grids
# A step broadcasts the model once more: a block holds this many nodes in all its copies, and one step at least.
BLOCK_NODES = 5_000_000
BLOCK_STEPS = 7


class _TreeForecaster(Forecaster):
    pooled = True
    allowed = ("n_estimators", "max_depth", "min_samples_leaf", "random_state", "learning_rate")
    boosted = False
    model = None

    @property
    def uses_exog(self) -> bool:
        return bool(self.exog)

    @property
    def reach(self) -> int:
        return self.features.reach

    def estimator(self, **defaults):
        p = {**defaults, **self.params}
        depth = int(p.get("max_depth") or DEFAULT_DEPTH)
        if depth > MAX_DEPTH:
            raise ValueError(f"max_depth {depth} is more than {MAX_DEPTH}")
        common = dict(featuresCol="features", labelCol=Y, predictionCol=HAT,
                      maxDepth=depth,
                      minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=int(p.get("random_state", 42)))
        if self.boosted:
            return GBTRegressor(maxIter=int(p.get("n_estimators", 50)), stepSize=float(p.get("learning_rate", 0.1)),
                                **common)
        return RandomForestRegressor(numTrees=int(p.get("n_estimators", 400)), featureSubsetStrategy="all", **common)

    def save_state(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")

    def load_state(self, spark, path: str) -> None:
        loader = GBTRegressionModel if self.boosted else RandomForestRegressionModel
        self.model = loader.load(f"{path}/model")

    def future_rows(self, history: DataFrame, horizon: int, future: DataFrame | None) -> DataFrame:
        if future is None:
            if self.exog:
                return future_exog(history, list(self.exog), horizon, self.freq)
            return expand_future(history.groupBy(ITEM).agg(F.max(TS).alias("last_ts")), horizon, self.freq)
        return future


class RecursiveForest(_TreeForecaster):
    """Random forest on lags, rolling means, calendar and covariates."""

    name = "rf"

    def fit(self, train: DataFrame) -> "RecursiveForest":
        names = feature_names(self.features, list(self.exog))
        rows = train if all(c in train.columns for c in names) else feature_matrix(train, self.features)
        clean = complete_cases(rows, [*names, Y]).select(Y, *[F.col(c).cast("double").alias(c) for c in names])
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(clean).select(Y, "features")
        self.model = self.estimator().fit(vectors)
        return self

    def inputs(self, past: Column, known: Column) -> Column:
        """Model inputs of the step after ``past``; what the past does not reach is 0."""
        lags = [F.try_element_at(past, F.lit(-k)) for k in self.features.lags]
        means = [F.when(F.size(past) >= w, F.aggregate(F.slice(past, -w, w), F.lit(0.0), lambda a, b: a + b) / w)
                 for w in self.features.roll_windows]
        own = [F.coalesce(c, F.lit(0.0)) for c in lags + means]
        return array_to_vector(F.concat(F.array(*own), known) if own else known)

    def block_steps(self) -> int:
        return max(1, min(BLOCK_STEPS, BLOCK_NODES // max(1, self.model.totalNumNodes)))

    def forecast(self, history: DataFrame, horizon: int, future: DataFrame | None = None) -> DataFrame:
        """All steps of all items; a missing or NaN value of the past counts as missing."""
        cfg = self.features
        reach, block = max(cfg.reach, 1), self.block_steps()
        back = F.row_number().over(W.partitionBy(ITEM).orderBy(F.desc(TS)))
        value = F.when(~F.isnan(Y), F.col(Y)).alias(Y)
        tail = history.select(ITEM, TS, value, back.alias("__b")).where(F.col("__b") <= reach)
        past = tail.groupBy(ITEM).agg(F.array_sort(F.collect_list(F.struct(TS, Y)))[Y].alias("p"))
        rows = self.future_rows(history, horizon, future)
        inputs = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.exog]
        if cfg.add_calendar:
            inputs = [v.cast("double") for v in calendar_columns(F.col(TS)).values()] + inputs
        ahead = rows.groupBy(ITEM).agg(F.array_sort(F.collect_list(
            F.struct(STEP, TS, F.array(*inputs).cast("array<double>").alias("x")))).alias("f"))
        state = ahead.join(past, ITEM).select(ITEM, "f", "p", F.array().cast("array<double>").alias("v"))
        steps = horizon
        if future is not None:
            state = cut_lineage(state)
            steps = state.agg(F.max(F.size("f"))).first()[0] or 0
        for step in range(steps):
            if step and step % block == 0:
                state = cut_lineage(state)
            known = F.element_at("f", F.least(F.size("v") + 1, F.size("f")))["x"]
            made = self.model.transform(state.withColumn("features", self.inputs(F.col("p"), known)))
            newest = F.array(HAT)
            state = made.select(ITEM, "f", F.slice(F.concat("p", newest), F.greatest(F.lit(1), F.size("p") + 2 - reach), reach)
                                .alias("p"), F.concat("v", newest).alias("v"))
        rows = F.slice(F.arrays_zip(F.col("f")[TS].alias("ts"), F.col("f")[STEP].alias("h"), F.col("v").alias("v")),
                       F.lit(1), F.size("f"))
        pairs = state.select(ITEM, F.explode(rows).alias("r"))
        return pairs.select(ITEM, F.col("r.ts").alias(TS), F.col("r.h").alias(STEP), F.col("r.v").alias(HAT))


class RecursiveBoosted(RecursiveForest):
    """Boosted trees on the same features, recursive."""

    name = "recursive_tabular"
    boosted = True

    def estimator(self, **defaults):
        return super().estimator(max_depth=5, **defaults)


class DirectBoosted(_TreeForecaster):
    """One boosted model for all steps: features at the origin, calendar of the target, the step."""

    name = "direct_tabular"
    boosted = True

    def origin_names(self) -> list[str]:
        return [f"lag_{k}" for k in self.features.lags] + [f"roll_mean_{w}" for w in self.features.roll_windows]

    def origins(self, df: DataFrame) -> DataFrame:
        """Lags and means seen from the row itself: lag 1 is the row's own value."""
        cols = {f"lag_{k}": F.lag(Y, k - 1).over(by_item()) for k in self.features.lags}
        for w in self.features.roll_windows:
            frame = by_item().rowsBetween(-w + 1, 0)
            cols[f"roll_mean_{w}"] = F.when(F.count(Y).over(frame) == w, F.avg(Y).over(frame))
        return df.withColumns(cols)

    def input_names(self) -> list[str]:
        calendar = list(CALENDAR_NAMES) if self.features.add_calendar else []
        return self.origin_names() + [STEP] + calendar + list(self.exog)

    def assemble(self, df: DataFrame, keep: list[str]) -> DataFrame:
        if self.features.add_calendar:
            df = df.withColumns(calendar_columns(F.col(TS)))
        names = self.input_names()
        slim = df.select(*keep, *[F.col(c).cast("double").alias(f"in_{c}") for c in names])
        inputs = [f"in_{c}" for c in names]
        return VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(
            slim.fillna(0.0, subset=inputs)).select(*keep, "features")

    def fit(self, train: DataFrame) -> "DirectBoosted":
        ahead = [F.struct(F.lit(h).alias(STEP), F.lead(Y, h).over(by_item()).alias("y"),
                          *[F.lead(c, h).over(by_item()).alias(c) for c in self.exog])
                 for h in range(1, self.horizon + 1)]
        rows = self.origins(train).withColumn("__a", F.array(*ahead))
        rows = complete_cases(rows, self.origin_names())
        rows = (rows.select(ITEM, F.col(TS).alias("__origin"), *self.origin_names(), F.inline("__a"))
                    .where(F.col("y").isNotNull()).withColumnRenamed("y", Y)
                    .withColumn(TS, plus_steps(F.col("__origin"), F.col(STEP), self.freq)))
        self.model = self.estimator(max_depth=5).fit(self.assemble(rows, [Y]))
        return self

    def forecast(self, history: DataFrame, horizon: int, future: DataFrame | None = None) -> DataFrame:
        if horizon > self.horizon:
            raise ValueError(f"fitted for {self.horizon} steps; refit or roll forward for {horizon}")
        latest = F.row_number().over(W.partitionBy(ITEM).orderBy(F.desc(TS)))
        tail = history.withColumn("__b", latest).where(F.col("__b") <= max(self.reach, 1)).drop("__b")
        newest = self.origins(tail).groupBy(ITEM).agg(
            F.max_by(F.struct(*self.origin_names()), TS).alias("__o"))
        rows = self.future_rows(history, horizon, future).join(newest, ITEM)
        rows = rows.select(ITEM, TS, STEP, *self.exog, "__o.*")
        out = self.model.transform(self.assemble(rows.select(ITEM, TS, F.col(STEP), *self.exog, *self.origin_names())
                                                 .withColumn("step_no", F.col(STEP)), [ITEM, TS, "step_no"]))
        return out.select(ITEM, TS, F.col("step_no").alias(STEP), HAT)
