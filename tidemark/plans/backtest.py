"""Rolling-origin backtests, parameter search and leaderboards.

Fold ``k`` of an item trains on its first ``initial + k * step`` rows and is tested on the
next ``horizon``.  Folds are columns of the data, not driver loops: models that can answer all
cut-offs in one pass over the rows do, models of short reach see each fold as a series of its
own, and only pooled tree models are fitted once per fold.  Candidates of a search are rows too.
"""

from __future__ import annotations

import itertools
import json
import time
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.errors import first_line
from tidemark.config import SEASON, FeatureConfig
from tidemark.functions import metrics as M
from tidemark.models.arrays import ArrayForecaster, candidate_folds
from tidemark.models.base import HAT, STEP, Forecaster, make
from tidemark.models.registry import MODELS
from tidemark.operators.evaluate import error_columns, mase, naive_scale
from tidemark.operators.features import feature_matrix
from tidemark.operators.series import ITEM, TS, Y, by_item
from tidemark.plans.budget import time_box

FOLD, RN = "fold", "rn"
_MARK = "\u0001"


@dataclass(frozen=True)
class FoldPlan:
    initial: int
    step: int
    horizon: int
    last: int | None = None  # keep only the last folds

    def count(self, n: Column) -> Column:
        k = F.floor((n - self.horizon - self.initial) / self.step) + 1
        return F.greatest(F.lit(0), k).cast("int")

    def first(self, n: Column) -> Column:
        return F.lit(0) if self.last is None else F.greatest(F.lit(0), self.count(n) - self.last)

    def cutoffs(self, n: Column) -> Column:
        """Training length of each fold, in order."""
        ks = F.sequence(self.first(n), self.count(n) - 1)
        empty = F.array().cast("array<int>")
        return F.when(self.count(n) > 0, F.transform(ks, lambda k: (F.lit(self.initial) + k * self.step)
                                                     .cast("int"))).otherwise(empty)


def index_rows(df: DataFrame) -> DataFrame:
    """0-based row number and length per item."""
    return df.withColumn(RN, F.row_number().over(by_item()) - 1).withColumn(
        "n", F.count(F.lit(1)).over(W.partitionBy(ITEM)))


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / b).cast("int")


def _explode_folds(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
    lo = F.greatest(lo, F.col("__k0"))
    hi = F.least(hi, F.col("__k1"))
    folds = F.when(lo <= hi, F.sequence(lo, hi))
    return df.withColumn(FOLD, F.explode(folds))


def _with_range(indexed: DataFrame, plan: FoldPlan) -> DataFrame:
    n = F.col("n")
    return indexed.withColumn("__k0", plan.first(n).cast("int")).withColumn("__k1", plan.count(n) - 1)


def test_rows(indexed: DataFrame, plan: FoldPlan) -> DataFrame:
    """Rows of every test window, with ``fold`` and ``h``; folds overlap when step < horizon."""
    rn = F.col(RN)
    lo = _ceil_div(rn - plan.horizon + 1 - plan.initial, plan.step)
    hi = F.floor((rn - plan.initial) / plan.step).cast("int")
    rows = _explode_folds(_with_range(indexed, plan), lo, hi)
    return rows.withColumn(STEP, (rn - plan.initial - F.col(FOLD) * plan.step + 1).cast("int")).drop("__k0", "__k1")


def train_rows(indexed: DataFrame, plan: FoldPlan, reach: int | None = None) -> DataFrame:
    """Training rows of every fold; ``reach`` keeps the newest rows of each only."""
    rn = F.col(RN)
    lo = (F.floor((rn - plan.initial) / plan.step) + 1).cast("int")
    hi = F.col("__k1") if reach is None else F.floor((rn + reach - plan.initial) / plan.step).cast("int")
    return _explode_folds(_with_range(indexed, plan), lo, hi).drop("__k0", "__k1")


def fold_cutoffs(indexed: DataFrame, plan: FoldPlan) -> DataFrame:
    """(item, fold, train_rows, cutoff): last training time of each fold."""
    ends = train_rows(indexed, plan, reach=1)
    return ends.select(ITEM, FOLD, (F.col(RN) + 1).alias("train_rows"), F.col(TS).alias("cutoff"))


def rolling_backtest(df: DataFrame, model: Forecaster, plan: FoldPlan, threads: int = 4) -> DataFrame:
    """``item_id, fold, timestamp, h, target, y_hat`` over all folds."""
    indexed = index_rows(df)
    truth = test_rows(indexed, plan)
    if hasattr(model, "forecast_folds"):
        made = model.forecast_folds(indexed, plan)
    elif model.pooled:
        made = _pooled_folds(indexed, truth, model, plan, threads)
    else:
        name = F.concat(F.col(ITEM), F.lit(_MARK), F.col(FOLD).cast("string"))
        history = train_rows(indexed, plan, model.reach).withColumn(ITEM, name)
        made = _split_name(model.forecast(history.select(ITEM, TS, Y), plan.horizon))
    return _with_truth(truth, made.select(ITEM, FOLD, STEP, HAT))


def _with_truth(truth: DataFrame, made: DataFrame) -> DataFrame:
    return truth.select(ITEM, FOLD, TS, STEP, Y).join(made, [ITEM, FOLD, STEP])


def _split_name(df: DataFrame) -> DataFrame:
    parts = F.split(F.col(ITEM), _MARK)
    last = F.element_at(parts, -1)
    return (df.withColumn(FOLD, last.cast("int"))
              .withColumn(ITEM, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), _MARK)))


def _pooled_folds(indexed: DataFrame, truth: DataFrame, model: Forecaster, plan: FoldPlan, threads: int) -> DataFrame:
    """One fit per fold over all items that have it; features are built once for all folds.

    Folds are counted from an item's first one, or from its last one when only the last are
    asked for, so items of any length meet in a fit and each is cut at its own place.  A fit
    sees the rows before the cut of items that are tested in it.
    """
    base = feature_matrix(indexed, model.features) if model.name != "direct_tabular" else indexed
    n = F.col("n")
    base = base.withColumn("__count", plan.count(n)).persist()
    most = base.agg(F.max("__count")).first()[0]
    if not most:
        raise ValueError("series too short for a single fold")
    from_end = plan.last is not None
    folds = range(min(plan.last, most) if from_end else most)

    def one(k: int) -> DataFrame:
        number = F.col("__count") - 1 - k if from_end else F.lit(k)
        train = base.where((F.col("__count") > k) & (F.col(RN) < plan.initial + number * plan.step))
        fitted = make(model.name, freq=model.freq, season=model.season, exog=model.exog, features=model.features,
                      params=dict(model.params), horizon=plan.horizon).fit(train)
        tested = truth.where((plan.count(n) > k) & (F.col(FOLD) == (plan.count(n) - 1 - k if from_end else F.lit(k))))
        ahead = tested.select(ITEM, TS, STEP, *model.exog)
        made = fitted.forecast(train.select(ITEM, TS, Y, *model.exog), plan.horizon, ahead)
        numbers = tested.select(ITEM, FOLD).distinct()
        return made.join(numbers, ITEM)

    with ThreadPool(min(threads, len(folds))) as pool:
        parts = pool.map(inheritable_thread_target(indexed.sparkSession)(one), folds)
    return reduce(DataFrame.unionByName, parts)


# --- scores --------------------------------------------------------------------------


def pooled_metrics(backtest: DataFrame, df: DataFrame, plan: FoldPlan, m: int,
                   denominator: str = "seasonal") -> DataFrame:
    """One row: RMSE, sMAPE, MAE, MAPE over all folds, and MASE scaled by the first training rows."""
    clean = backtest.where(M.is_finite(F.col(Y)) & M.is_finite(F.col(HAT)))
    insample = index_rows(df).where(F.col(RN) < plan.initial)
    scaled = mase(clean, insample, m, denominator).agg(F.avg("mase").alias("mase"))
    return clean.agg(F.count(F.lit(1)).alias("n"), *error_columns()).withColumn("mase", scaled.scalar())


# --- search --------------------------------------------------------------------------


def candidates(space: dict | list | None) -> list[dict]:
    """Full grid of a dict of lists (keys sorted, last key fastest), or the given list.

    A dict whose values are plain settings is one candidate; ``order`` and
    ``seasonal_order`` may be lists or {p, d, q} maps.
    """
    if not space:
        return [{}]
    if isinstance(space, list):
        return [_tuples(d) for d in space]
    # an option of fixed length is one setting, not a list of choices, when its values are plain
    fixed = [k for k, letters in _LENGTHS.items() if k in space]
    if fixed and all(isinstance(space[k], dict) or _is_setting(k, space[k]) for k in fixed):
        return [_tuples(space)]
    keys = sorted(space)
    choices = [v if isinstance(v, (list, tuple)) else [v] for v in (space[k] for k in keys)]
    return [_tuples(dict(zip(keys, values))) for values in itertools.product(*choices)]


_LENGTHS = {"order": "pdq", "seasonal_order": "PDQm"}


def _is_setting(name: str, value) -> bool:
    """Is this one value of an option of fixed length (as many whole numbers as it has letters)?"""
    return (isinstance(value, (list, tuple)) and len(value) == len(_LENGTHS[name])
            and all(isinstance(x, int) for x in value))


def _tuples(d: dict) -> dict:
    out = dict(d)
    for key, letters in _LENGTHS.items():
        v = out.get(key)
        if isinstance(v, dict):
            low = {k.lower() if k != "m" else "m": x for k, x in v.items()}
            v = [low.get(x.lower(), low.get("s", 7) if x == "m" else 0) for x in letters]
        if isinstance(v, (list, tuple)) and len(v) == len(letters):
            out[key] = tuple(v)
    return out


@dataclass
class SearchResult:
    params: dict
    scores: list[dict]
    backtest: DataFrame
    board: DataFrame  # candidate, params (JSON), rank, n, rmse, mae, mape, smape, mase, error: one row per candidate


CANDIDATE = "candidate"
BOARD = ("candidate int, params string, rank int, n bigint, rmse double, mae double, mape double, smape double, mase double, "
         "error string")


def candidate_backtests(df: DataFrame, models: dict[int, Forecaster], plan: FoldPlan) -> tuple[DataFrame, DataFrame | None]:
    """Predictions of all candidates with a column ``candidate``, and failures (candidate, error) that only the data show.

    Candidates are rows of one job: array models see every candidate in one pass over the series,
    the others are united.
    """
    indexed = index_rows(df)
    truth = test_rows(indexed, plan)
    if all(isinstance(m, ArrayForecaster) for m in models.values()):
        made = candidate_folds(indexed, plan, sorted(models.items())).persist()
        values = made.where(F.col("error").isNull()).select(CANDIDATE, ITEM, FOLD, F.posexplode("v").alias("h0", HAT))
        made_rows = values.select(CANDIDATE, ITEM, FOLD, (F.col("h0") + 1).alias(STEP), HAT)
        rows = truth.select(ITEM, FOLD, TS, STEP, Y).join(made_rows, [ITEM, FOLD, STEP])
        failures = made.where(F.col("error").isNotNull()).groupBy(CANDIDATE).agg(F.min("error").alias("error"))
        return rows, failures
    parts = [rolling_backtest(df, m, plan).withColumn(CANDIDATE, F.lit(k)) for k, m in sorted(models.items())]
    return reduce(DataFrame.unionByName, parts), None


def candidate_metrics(rows: DataFrame, df: DataFrame, plan: FoldPlan, m: int, failures: DataFrame | None = None) -> DataFrame:
    """One row per candidate: number of pairs, pooled errors, MASE, and its rank by RMSE (the first of equals).

    Candidates that failed on an item, or have no pair, have no rank.
    """
    clean = rows.where(M.is_finite(F.col(Y)) & M.is_finite(F.col(HAT)))
    insample = index_rows(df).where(F.col(RN) < plan.initial)
    per_item = clean.groupBy(CANDIDATE, ITEM).agg(M.mae(F.col(Y), F.col(HAT)).alias("mae"))
    scaled = (per_item.join(naive_scale(insample, m), ITEM).groupBy(CANDIDATE)
                      .agg(F.avg(F.col("mae") / F.col("scale")).alias("mase")))
    found = clean.groupBy(CANDIDATE).agg(F.count(F.lit(1)).alias("n"), *error_columns()).join(scaled, CANDIDATE, "left")
    if failures is None:
        found = found.withColumn("error", F.lit(None).cast("string"))
    else:
        found = found.join(failures, CANDIDATE, "full")
    place = F.row_number().over(W.orderBy(F.col("error").isNotNull(), F.asc_nulls_last("rmse"), CANDIDATE))  # one row per candidate
    return found.withColumn("rank", F.when(F.col("error").isNull() & F.col("rmse").isNotNull(), place))


def grid_search(df: DataFrame, model_name: str, space, plan: FoldPlan, freq: str = "D",
                features: FeatureConfig | None = None, exog: tuple[str, ...] = (), season: int | None = None,
                threads: int = 2) -> SearchResult:
    """Candidate with the lowest pooled RMSE, the first one on ties; failing ones are skipped.

    All candidates are rows of one table and are scored and ranked by one aggregation.  Pooled trees are
    fitted on the way, candidate by candidate.
    """
    allowed = MODELS[model_name].allowed
    tries = [{k: v for k, v in c.items() if k in allowed} for c in candidates(space)]
    season = season or SEASON.get(freq, 1)
    df = df.persist()
    spark = df.sparkSession
    errors: dict[int, str] = {}
    models: dict[int, Forecaster] = {}
    for k, params in enumerate(tries):
        try:
            models[k] = make(model_name, freq=freq, season=season, exog=tuple(exog), params=params,
                             features=features or FeatureConfig(), horizon=plan.horizon)
        except Exception as e:  # a failing candidate must not end the search
            errors[k] = first_line(e)
    if any(m.pooled for m in models.values()):
        rows, failures, late = _fitted_candidates(df, models, plan, threads)
        errors |= late
    else:
        rows, failures = candidate_backtests(df, models, plan) if models else (None, None)
    scored: dict[int, dict] = {}
    if rows is not None:
        rows = rows.persist()
        try:
            found = candidate_metrics(rows, df, plan, season, failures).collect()  # one row per candidate
        except Exception as e:
            if len(models) == 1:
                errors |= {k: first_line(e) for k in models}
                found = []
            else:  # something only one of them does not survive: find out which
                rows, late = _one_by_one(df, models, plan)
                errors |= late
                found = candidate_metrics(rows, df, plan, season).collect() if rows is not None else []
        scored = {r[CANDIDATE]: r.asDict() for r in found}
    scores = []
    for k, params in enumerate(tries):
        row = scored.get(k, {})
        error = errors.get(k) or row.get("error") or (None if row.get("n") and row.get("rmse") is not None
                                                      else "series too short for a single fold")
        own = {c: row.get(c) for c in ("n", "rmse", "mae", "mape", "smape", "mase")} if error is None else {"rmse": None}
        scores.append({"params": params, **own, "error": error})
    ok = [k for k, s in enumerate(scores) if s["error"] is None]
    if not ok:
        raise RuntimeError(f"all candidates failed for {model_name}: {scores[0]['error']}")
    best = min(ok, key=lambda k: scored[k]["rank"])
    order = {k: i + 1 for i, k in enumerate(sorted(ok, key=lambda k: scored[k]["rank"]))}
    board = spark.createDataFrame(
        [(k, json.dumps(s["params"], default=str), order.get(k), s.get("n"), s["rmse"], s.get("mae"), s.get("mape"), s.get("smape"),
          s.get("mase"), s["error"]) for k, s in enumerate(scores)], BOARD)
    return SearchResult(tries[best], scores, rows.where(F.col(CANDIDATE) == best).drop(CANDIDATE), board)


def _fitted_candidates(df: DataFrame, models: dict[int, Forecaster], plan: FoldPlan, threads: int):
    """Backtests of models that fit on the way, a few at a time, and what failed."""
    def attempt(k: int):
        try:
            rows = rolling_backtest(df, models[k], plan).withColumn(CANDIDATE, F.lit(k)).persist()
            rows.count()
            return k, rows, None
        except Exception as e:
            return k, None, first_line(e)

    with ThreadPool(min(threads, len(models))) as pool:
        done = pool.map(inheritable_thread_target(df.sparkSession)(attempt), sorted(models))
    good = [rows for _, rows, _ in done if rows is not None]
    return reduce(DataFrame.unionByName, good) if good else None, None, {k: e for k, _, e in done if e}


def _one_by_one(df: DataFrame, models: dict[int, Forecaster], plan: FoldPlan):
    rows, _, late = _fitted_candidates(df, models, plan, 2)
    return rows, late


@dataclass
class Leaderboard:
    """Models best first: the table, its rows, and the predictions of those that were scored."""

    table: DataFrame
    rows: list[dict]
    backtests: dict[str, DataFrame]

    def __iter__(self):  # table, rows
        return iter((self.table, self.rows))

    def __getitem__(self, k):
        return (self.table, self.rows)[k]


def leaderboard(df: DataFrame, names: list[str], plan: FoldPlan, metric: str = "mape", freq: str = "D",
                features: FeatureConfig | None = None, exog: tuple[str, ...] = (), season: int | None = None,
                options: dict[str, dict] | None = None, threads: int = 4,
                time_limit: float | None = None) -> Leaderboard:
    """Models ranked on the validation folds, best first; failing ones come last with the error.

    After ``time_limit`` seconds running models are cancelled and no further one is started; the first
    one always runs to its end.  Predictions are kept, so the winner need not be tested again.
    """
    season = season or SEASON.get(freq, 1)
    df = df.persist()
    spark = df.sparkSession
    kept: dict[str, DataFrame] = {}
    deadline = None if time_limit is None else time.monotonic() + time_limit

    def attempt(name: str) -> dict:
        limit = None if name == names[0] else deadline
        if limit is not None and time.monotonic() > limit:
            return {"model": name, "score": None, "error": "not started: the time limit was reached"}
        try:
            with time_box(spark, limit):
                model = make(name, freq=freq, season=season, exog=tuple(exog), features=features or FeatureConfig(),
                             params=dict((options or {}).get(name, {})), horizon=plan.horizon)
                result = rolling_backtest(df, model, plan).persist()
                got = pooled_metrics(result, df, plan, season).first().asDict()
            kept[name] = result
            return {"model": name, "score": got[metric.lower()], **got, "error": None}
        except Exception as e:  # a failing model is reported, not fatal
            return {"model": name, "score": None, "error": first_line(e)}

    with ThreadPool(min(threads, len(names))) as pool:
        rows = pool.map(inheritable_thread_target(spark)(attempt), names)
    rows.sort(key=lambda r: (r["score"] is None, r["score"] or 0.0))
    for row in rows[1:]:
        if row["model"] in kept:
            kept.pop(row["model"]).unpersist()
    table = spark.createDataFrame(
        [(i + 1, r["model"], r["score"], r.get("rmse"), r.get("smape"), r.get("mae"), r.get("mape"), r.get("mase"),
          r["error"]) for i, r in enumerate(rows)],
        "rank int, model string, score double, rmse double, smape double, mae double, mape double, mase double, "
        "error string")
    return Leaderboard(table, rows, kept)
