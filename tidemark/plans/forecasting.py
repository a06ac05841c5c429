"""Forecast runs: one searched model, or several models over many series."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import SEASON, FeatureConfig, MultiSeriesConfig, RunConfig
from tidemark.functions.calendar import check_freq
from tidemark.models.base import HAT, STEP, Forecaster, make
from tidemark.models.npts import quantile_name
from tidemark.operators import evaluate, profile, series, split
from tidemark.operators.dates import parse_times
from tidemark.operators.future import future_exog, repeat_last_covariates
from tidemark.operators.series import ITEM, TS, Y
from tidemark.plans.backtest import (FOLD, FoldPlan, fold_cutoffs, grid_search, index_rows, leaderboard, pooled_metrics,
                                     rolling_backtest)
from tidemark.session import cut_lineage
from tidemark.sources import sinks
from tidemark.sources.results import RunStore, first_rows

QUANTILE_FOLDS = 3  # last folds whose residuals, over all steps, give the quantiles of a multi-series run
SHOWN_SKIPPED = 1000  # skipped items named in a result document; the frame has all


def parse_key(df: DataFrame, ts_col: str | None) -> tuple[DataFrame, str]:
    """Table with a time-typed key column; text is parsed, and must parse whole."""
    ts_col = ts_col or profile.time_column(df)
    if ts_col not in df.columns:
        raise ValueError(f"time column {ts_col!r} not in table")
    if isinstance(df.schema[ts_col].dataType, T.StringType):
        parsed = parse_times(df, ts_col, "__ts")
        bad = parsed.where(F.col("__ts").isNull() & F.col(f"`{ts_col}`").isNotNull()).limit(1).count()
        if bad:
            raise ValueError(f"time column {ts_col!r} holds values that are no times")
        df = parsed.withColumn(ts_col, F.col("__ts")).drop("__ts")
    return df, ts_col


def prepare_series(df: DataFrame, target: str | None = None, ts_col: str | None = None,
                   exog_cols: list[str] | None = None, item_col: str | None = None, freq: str | None = None,
                   max_ffill_steps: int | None = None) -> tuple[DataFrame, str, list[str]]:
    """Regular long series, its frequency and its covariates."""
    df, ts_col = parse_key(df, ts_col)
    exog = list(exog_cols or [])
    missing = [c for c in exog if c not in df.columns]
    if missing:
        raise ValueError(f"covariate columns not in table: {missing}")
    target = profile.strict_target(df, target, exog)
    exog = [c for c in exog if c != target]
    long = series.to_long_series(df, ts_col, [target, *exog], item_col, target=target)
    freq = check_freq(freq) if freq else series.lone_frequency(long)
    return series.regular_grid(long, freq, 0.0, max_ffill_steps, exog).drop("step"), freq, exog


def require_length(df: DataFrame, cfg: RunConfig) -> DataFrame:
    """Items that cannot be backtested, with the reason; an error when none can."""
    reach = cfg.feature_config.reach if cfg.model_name == "rf" else 0
    report = series.length_report(df, cfg.initial_train, cfg.horizon, reach)
    row = report.agg(F.count_if(F.col("problem").isNull()).alias("ok"), F.max("problem").alias("why")).first()
    if not row["ok"]:
        raise ValueError(f"no series can be backtested: {row['why']}")
    return report.where(F.col("problem").isNotNull())


@dataclass
class ForecastRun:
    model_name: str
    best_params: dict
    scores: list[dict]
    metrics: dict
    backtest: DataFrame
    cutoffs: DataFrame
    residual_summary: DataFrame
    ljung_box: DataFrame
    forecast: DataFrame
    model: Forecaster
    config: RunConfig
    skipped: DataFrame  # items without a fold: item_id, n, problem
    board: DataFrame    # candidates of the search: see backtest.SearchResult

    def write(self, store: RunStore) -> None:
        """All rows of the run as frames of ``store``; the two tables people open by hand are CSV too."""
        pairs = self.backtest.select(ITEM, FOLD, TS, STEP, Y, HAT)
        per_item = evaluate.error_table(pairs, [ITEM])
        store.write("forecast", self.forecast)
        store.write("backtest", pairs)
        store.write("residual_summary", self.residual_summary)
        store.write("ljung_box", self.ljung_box)
        store.write("item_errors", per_item)
        store.write("candidates", self.board)
        store.write("skipped", self.skipped)
        store.write("backtest.csv", pairs)
        store.write("per_item_smape.csv", per_item.select(ITEM, "smape"))

    def result(self, store: RunStore | None = None) -> dict:
        """Nested result document with at most INLINE_ROWS rows of each part; the optional thinning picks them evenly.

        With a store all rows are written to it, and the document says under ``frames`` where.
        """
        if store is not None:
            self.write(store)
        k = self.config.max_serialize_points
        stamp = F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss")
        shown = series.thin(self.backtest.withColumn("ts", stamp), k, FOLD, STEP)
        rows = first_rows(shown.select(ITEM, FOLD, STEP, "ts", Y, HAT), ITEM, FOLD, STEP)
        several = self.forecast.select(ITEM).distinct().limit(2).count() > 1
        key = (lambda r: {"item_id": r[ITEM]}) if several else (lambda r: {})
        ahead = first_rows(self.forecast.withColumn("ts", stamp).select(ITEM, TS, "ts", HAT), ITEM, TS)
        return {
            "model_name": self.model_name, "best_params": self.best_params,
            "backtest": {"metrics": self.metrics,
                         "preds": [{**key(r), "ts": r["ts"], "y_hat": r[HAT]} for r in rows],
                         "trues": [{**key(r), "ts": r["ts"], "y": r[Y]} for r in rows],
                         "horizon": self.config.horizon, "step": self.config.step,
                         "initial_train": self.config.initial_train,
                         "skipped": first_rows(self.skipped, ITEM, most=SHOWN_SKIPPED),
                         "skipped_count": store.frames["skipped"]["rows"] if store else self.skipped.count()},
            "diagnostics": {"residuals": {"summary": first_rows(self.residual_summary, ITEM),
                                          "ljung_box": first_rows(self.ljung_box, ITEM)}},
            "final_forecast": [{**key(r), "ts": r["ts"], "y_hat": r[HAT]} for r in ahead],
        }


def run_forecasting(df: DataFrame, config: RunConfig | None = None, target: str | None = None,
                    ts_col: str | None = None, exog_cols: list[str] | None = None, freq: str | None = None,
                    item_col: str | None = None, max_folds: int | None = None) -> ForecastRun:
    """Prepare, search with a rolling backtest, check residuals, fit on everything, forecast."""
    cfg = config or RunConfig()
    use = list(exog_cols or []) if (cfg.use_exog or exog_cols) else []
    y, freq, exog = prepare_series(df, target, ts_col, use, item_col, freq, cfg.max_ffill_steps)
    y = y.persist()
    skipped = require_length(y, cfg)
    season = cfg.mase_m or SEASON.get(freq, 1)
    plan = FoldPlan(cfg.initial_train, cfg.step, cfg.horizon, max_folds)
    found = grid_search(y, cfg.model_name, cfg.search_space, plan, freq, cfg.feature_config, tuple(exog), season)
    pairs = found.backtest.select(ITEM, TS, FOLD, STEP, Y, HAT)
    metrics = pooled_metrics(found.backtest, y, plan, season).first().asDict()
    model = make(cfg.model_name, freq=freq, season=season, exog=tuple(exog), features=cfg.feature_config,
                 params=found.params, horizon=cfg.horizon).fit(y)
    future = future_exog(y, exog, cfg.horizon, freq) if exog else None
    return ForecastRun(cfg.model_name, found.params, found.scores, metrics, found.backtest,
                       fold_cutoffs(index_rows(y), plan), evaluate.residual_summary(pairs),
                       evaluate.ljung_box(pairs), model.forecast(y, cfg.horizon, future), model, cfg, skipped, found.board)


# --- many series ---------------------------------------------------------------------


def with_quantiles(forecast: DataFrame, backtest: DataFrame, levels: tuple[float, ...],
                   by_step: bool = True) -> DataFrame:
    """Quantile columns from backtest residuals of the same item, added to the mean.

    ``by_step`` takes the residuals of the same step only, which wants many folds; without it
    all steps of an item are pooled.  ``n_residuals`` is the number a quantile rests on.  Models that
    bring quantiles of their own keep them.
    """
    names = [quantile_name(q) for q in levels]
    if all(c in forecast.columns for c in names):
        return forecast
    keys = [ITEM, STEP] if by_step else [ITEM]
    spread = (evaluate.residuals(backtest).groupBy(*keys)
              .agg(F.percentile("residual", F.array(*[F.lit(q) for q in levels])).alias("__q"),
                   F.count(F.lit(1)).alias("n_residuals")))
    out = forecast.drop(*names).join(spread, keys, "left")
    return out.withColumns({c: F.col(HAT) + F.col("__q")[i] for i, c in enumerate(names)}).drop("__q")


def roll_forward(model: Forecaster, history: DataFrame, days_ahead: int, block: int,
                 future: DataFrame | None = None) -> DataFrame:
    """Forecast any length in blocks, each block's forecast extending the history.

    Every block is checkpointed: its plan would otherwise grow with the number of blocks.
    """
    keep = [ITEM, TS, Y, *model.exog]
    past, parts, done = history.select(*keep), [], 0
    while done < days_ahead:
        take = min(block, days_ahead - done)
        ahead = future.where(F.col(STEP).between(done + 1, done + take)).withColumn(STEP, F.col(STEP) - done) \
            if future is not None else None
        made = model.forecast(past, take, ahead)
        if model.exog:
            covs = ahead if ahead is not None else repeat_last_covariates(past, list(model.exog), take, model.freq)
            made = made.join(covs.select(ITEM, TS, *model.exog), [ITEM, TS], "left")
        made = cut_lineage(made)
        parts.append(made.withColumn(STEP, (F.col(STEP) + done).cast("int")))
        past = past.unionByName(made.withColumnRenamed(HAT, Y).select(*keep))
        done += take
    out = reduce(DataFrame.unionByName, parts)
    return out.drop(*model.exog)


@dataclass
class MultiSeriesRun:
    best_model: str
    best_score: float | None
    board: DataFrame
    holdout: DataFrame
    metrics: dict | None
    per_item: DataFrame
    meta: dict
    forecast: DataFrame
    covariates_used: bool
    model: Forecaster
    config: MultiSeriesConfig


def run_multi_series(df: DataFrame, config: MultiSeriesConfig | None = None, target: str | None = None,
                     ts_col: str | None = None, item_col: str | None = None, exog_cols: list[str] | None = None,
                     how: str = "mean", item_fallback: str = series.LONE,
                     features: FeatureConfig | None = None, options: dict | None = None,
                     save_dir: str | None = None, keys: list[str] | None = None) -> MultiSeriesRun:
    """Resample, hold out the tail, rank models on it, forecast with the best from all rows.

    ``keys`` names the key columns where it is not known which of them is the time
    (``series.series_keys`` finds out).  A null time is an error.
    """
    cfg = config or MultiSeriesConfig()
    freq, season = check_freq(cfg.freq), SEASON.get(check_freq(cfg.freq), 1)
    if keys:
        df, _ = series.series_keys(df, list(keys))
        ts_col, item_col = TS, ITEM
    else:
        df, ts_col = parse_key(df, ts_col)
        df = series.require_times(df, ts_col)
    exog = list(exog_cols or [])
    target = target or profile.lenient_target(df, exog)
    long = series.to_long_series(df, ts_col, [target, *exog], item_col, target=target)
    long = series.single_series_name(long, item_fallback)
    grid = series.resample(long.select(ITEM, TS, Y), freq, how)
    # models need a value on every step
    grid = series.fill_covariates(grid, [Y])
    if cfg.cap_quantile:
        grid = series.cap_outliers(grid, cfg.cap_quantile)
    if exog:
        covs = series.fill_covariates(series.resample(long, freq, "mean", exog), exog, zero=True)
        grid = grid.join(covs, [ITEM, TS], "left")
    grid = grid.persist()

    parts = split.tail_split(grid, cfg.horizon, cfg.short_series).persist()
    meta = split.split_meta(parts).first().asDict()
    # the hold-out is the last fold: everything before the last ``horizon`` rows trains
    lengths = grid.groupBy(ITEM).count().agg(F.min("count").alias("lo")).first()
    scored = parts.where(F.col("part") == "val").limit(1).count() > 0
    plan = None
    if scored:
        plan = FoldPlan(1, 1, cfg.horizon, 1)
    else:
        raise ValueError(f"no series is longer than the horizon ({lengths['lo']} rows at least)")
    usable = parts.drop("part")
    ranked = leaderboard(usable, list(cfg.models), plan, cfg.eval_metric, freq, features, tuple(exog), season,
                         options, time_limit=cfg.time_limit)
    board, rows = ranked
    best = rows[0]["model"]
    if rows[0]["score"] is None:
        raise RuntimeError(f"every model failed: {rows[0]['error']}")
    model = make(best, freq=freq, season=season, exog=tuple(exog), features=features or FeatureConfig(),
                 params=dict((options or {}).get(best, {})), horizon=cfg.horizon)
    holdout = ranked.backtests[best]  # what the winner was ranked on
    pairs = holdout.select(ITEM, TS, Y, HAT)
    metrics = evaluate.error_table(pairs).first().asDict()
    train = parts.where(F.col("part") == "train")
    metrics["mase"] = evaluate.mase(pairs, train.select(ITEM, TS, Y), season).agg(F.avg("mase")).first()[0]
    model = model.fit(grid)
    future = repeat_last_covariates(grid, exog, cfg.horizon, freq) if exog else None
    forecast = with_quantiles(model.forecast(grid, cfg.horizon, future),
                              rolling_backtest(usable, model, FoldPlan(1, cfg.horizon, cfg.horizon, QUANTILE_FOLDS)),
                              cfg.quantiles, by_step=False)
    if save_dir:
        model.save(df.sparkSession, save_dir)
    return MultiSeriesRun(best, rows[0]["score"], board, holdout, metrics, evaluate.worst_items(pairs), meta,
                          forecast, bool(exog) and model.uses_exog, model, cfg)


def multi_result(run: MultiSeriesRun, store: RunStore | None = None) -> dict:
    """Result document with at most INLINE_ROWS rows of each part; with a store all rows are written to it."""
    if store is not None:
        pairs = run.holdout.select(ITEM, FOLD, TS, STEP, Y, HAT)
        per_item = evaluate.error_table(pairs, [ITEM])
        store.write("forecast", sinks.forecast_export(run.forecast))
        store.write("backtest", pairs)
        store.write("item_errors", per_item)
        store.write("leaderboard", run.board)
        store.write("backtest.csv", pairs)
        store.write("per_item_smape.csv", per_item.select(ITEM, "smape"))
    several = run.forecast.select(ITEM).distinct().limit(2).count() > 1

    def rows(frame: DataFrame, column: str, name: str) -> list[dict]:
        stamp = F.date_format(TS, "yyyy-MM-dd'T'HH:mm:ss").alias("ts")
        got = first_rows(frame.select(ITEM, F.col(TS).alias("__at"), stamp, column), ITEM, "__at")
        return [{**({"item_id": r[ITEM]} if several else {}), "ts": r["ts"], name: r[column]} for r in got]

    return {
        "model_name": run.best_model, "best_model": run.best_model, "best_score": run.best_score,
        "final_forecast": rows(run.forecast, HAT, "y_hat"),
        "summary": {**asdict(run.config), "multi_series": several, "covariates_supported": run.model.uses_exog,
                    "covariates_used": run.covariates_used},
        "backtest": {"metrics": run.metrics, "preds": rows(run.holdout, HAT, "y_hat"),
                     "trues": rows(run.holdout, Y, "y"), "horizon": run.config.horizon, "step": run.config.horizon,
                     "initial_train": int(run.meta["mean_train_length"] or 0)},
    }
