"""Whole runs with an exact twin, and fitted models by what must hold for every row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.catalog import forecasts
from tidemark.catalog.classify import _CFG
from tidemark.catalog.common import (HORIZON, INITIAL, SHIPMENTS, STEP, rounded, shipments, shipments_raw, spread_table,
                                     table)
from tidemark.catalog.unsupervised import _DIMS, points
from tidemark.config import FeatureConfig, MultiSeriesConfig, RunConfig
from tidemark.models.base import HAT, make
from tidemark.operators import series
from tidemark.operators.series import ITEM, TS, Y
from tidemark.plans import backtest as bt
from tidemark.plans import classification, dispatch, forecasting
from tidemark.plans import unsupervised as runs
from tidemark.session import fresh_path
from tidemark.sources import readers, results, sinks

QUERIES, ORACLES = {}, {}


def register(name, sql):
    def keep(fn):
        QUERIES[name], ORACLES[name] = fn, sql
        return fn
    return keep


def _naive(horizon: int) -> str:
    """Seasonal naive forecast of the shipments as common table expressions."""
    return f"""{SHIPMENTS}, k AS (SELECT item_id, max(n) AS n, max(ts) AS last_ts FROM mi GROUP BY 1),
  f AS (SELECT item_id, n, last_ts, unnest(range(1, {horizon + 1})) AS h FROM k),
  p AS (SELECT f.item_id, f.last_ts + INTERVAL 1 DAY * h AS ts, h::INTEGER AS h, mi.y AS y_hat FROM f
        JOIN mi ON mi.item_id = f.item_id AND mi.rn = f.n - 7 + (h - 1) % 7)"""


@register("roll_forward_naive", f"""WITH {_naive(100)}
  SELECT item_id, ts AS "timestamp", h, round(y_hat, 6) AS y_hat FROM p""")
def roll_forward_naive(spark, d):
    """100 days in blocks of 28, each block's forecast being the next one's history."""
    return rounded(forecasting.roll_forward(make("seasonal_naive", horizon=28), shipments(spark, d), 100, 28))


@register("arima_drift", f"""WITH {SHIPMENTS}, w AS (SELECT item_id, rn, n, ts, y,
    y - lag(y) OVER (PARTITION BY item_id ORDER BY rn) AS w FROM mi),
  b AS (SELECT item_id, max(n) AS n, max(ts) AS last_ts, avg(w) FILTER (rn >= 4) AS b, max(y) FILTER (rn = n - 1) AS y FROM w GROUP BY 1),
  f AS (SELECT *, unnest(range(1, {HORIZON + 1})) AS h FROM b)
  SELECT item_id, last_ts + INTERVAL 1 DAY * h AS "timestamp", h::INTEGER AS h, round(y + h * b, 4) AS y_hat FROM f""")
def arima_drift(spark, d):
    """Order (0, 1, 0): the last value and the mean step."""
    m = shipments(spark, d).persist()
    model = make("arima", params={"order": (0, 1, 0)}, horizon=HORIZON).fit(m)
    return rounded(model.forecast(m, HORIZON), 4)


_SPREAD = """SELECT p.item_id, p.ts AS "timestamp", p.h, round(p.y_hat, 6) AS y_hat, round(p.y_hat + s.a, 6) AS p10,
  round(p.y_hat + s.b, 6) AS p50, round(p.y_hat + s.c, 6) AS p90, s.n AS n_residuals FROM p JOIN s USING (item_id)"""
_OF_E = "quantile_cont(e, 0.1) AS a, quantile_cont(e, 0.5) AS b, quantile_cont(e, 0.9) AS c, count(*) AS n"


@register("residual_quantiles_naive", f"""WITH {_naive(HORIZON)},
  t AS (SELECT item_id, n, unnest(range(0, (n - {HORIZON} - {INITIAL}) // {STEP} + 1)) AS fold FROM k),
  e AS (SELECT t.item_id, a.y - b.y AS e FROM t
        JOIN mi a ON a.item_id = t.item_id AND a.rn >= {INITIAL} + fold * {STEP} AND a.rn < {INITIAL} + fold * {STEP} + {HORIZON}
        JOIN mi b ON b.item_id = t.item_id AND b.rn = {INITIAL} + fold * {STEP} - 7 + (a.rn - {INITIAL} - fold * {STEP}) % 7),
  s AS (SELECT item_id, {_OF_E} FROM e GROUP BY 1) {_SPREAD}""")
def residual_quantiles_naive(spark, d):
    """Quantiles from the residuals of all folds and steps of an item."""
    m = shipments(spark, d).persist()
    model = make("seasonal_naive", horizon=HORIZON)
    past = bt.rolling_backtest(m, model, bt.FoldPlan(INITIAL, STEP, HORIZON))
    return rounded(forecasting.with_quantiles(model.forecast(m, HORIZON), past, (0.1, 0.5, 0.9), by_step=False))


@register("multi_series_naive", f"""WITH {_naive(HORIZON)},
  t AS (SELECT item_id, unnest(range((n - {HORIZON} - 1) // {HORIZON} - 2, (n - {HORIZON} - 1) // {HORIZON} + 1)) AS fold FROM k),
  c AS (SELECT item_id, 1 + fold * {HORIZON} AS cut FROM t),
  e AS (SELECT c.item_id, a.y - b.y AS e FROM c
        JOIN mi a ON a.item_id = c.item_id AND a.rn >= cut AND a.rn < cut + {HORIZON}
        JOIN mi b ON b.item_id = c.item_id AND b.rn = cut - 7 + (a.rn - cut) % 7),
  s AS (SELECT item_id, {_OF_E} FROM e GROUP BY 1) {_SPREAD}""")
def multi_series_naive(spark, d):
    """A whole multi-series run with one model: resampling, hold-out, leaderboard, forecast, quantiles."""
    cfg = MultiSeriesConfig(horizon=HORIZON, eval_metric="sMAPE", models=("seasonal_naive",), quantiles=(0.1, 0.5, 0.9))
    run = forecasting.run_multi_series(shipments_raw(spark, d), cfg, Y, TS, ITEM, how="sum")
    return rounded(run.forecast)


@register("backtest_coverage", """WITH u AS (SELECT user_id::VARCHAR AS item_id, date_diff('day', min(ts)::DATE, max(ts)::DATE) + 1 AS n
    FROM events GROUP BY 1),
  c AS (SELECT item_id, (n - 3 - 10) // 3 + 1 AS folds FROM u WHERE n >= 13)
  SELECT item_id, unnest(range(greatest(0, folds - 2), folds))::INTEGER AS fold, 3::BIGINT AS n FROM c""")
def backtest_coverage(spark, d):
    """Predictions of a pooled forest per item and fold, items being users of unequal history.

    Only which rows are predicted is looked at, so the forest is small (two trees).
    """
    e = table(spark, d, "events")
    days = series.resample(e.select(F.col("user_id").cast("string").alias(ITEM), F.col("ts").alias(TS), F.col("value").alias(Y)),
                           "D", "sum")
    model = make("rf", features=FeatureConfig((1,), (3,), True), params={"n_estimators": 2, "max_depth": 3}, horizon=3)
    made = bt.rolling_backtest(days, model, bt.FoldPlan(10, 3, 3, 2))
    return made.groupBy(ITEM, "fold").agg(F.count(HAT).alias("n"))


@register("kmeans_nearest", "SELECT count(*) AS n, 5::BIGINT AS clusters, 0::BIGINT AS elsewhere FROM embeddings")
def kmeans_nearest(spark, d):
    """Every standardised point belongs to the centre nearest to it."""
    run = runs.run_clustering(points(spark, d), 5, keep=["vec_id", "label"], measure="none")
    centres = np.array(run.model.clusterCenters())

    @F.pandas_udf("int")
    def nearest(*columns: pd.Series) -> pd.Series:
        x = np.column_stack(columns)
        return pd.Series(((x[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1).astype("int32"))

    return run.rows.select("cluster", nearest(*_DIMS).alias("near")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("clusters"),
        F.count_if(F.col("cluster") != F.col("near")).alias("elsewhere"))


@register("clf_scored_rows", "SELECT count(*) AS n, 0::BIGINT AS outside, 0::BIGINT AS against_threshold FROM documents")
def clf_scored_rows(spark, d):
    """A saved classifier (15 trees) on all documents: one score each, in range, labelled by the threshold."""
    docs = spread_table(spark, d, "documents")
    path = fresh_path(spark, "classifier")
    train = docs.join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    run = classification.run_classification(train, "toxic", keys=["doc_id"], cfg=_CFG, export_path=path)
    scored = classification.predict_classification_df(docs, path)
    cut = float(run.model.threshold)
    return scored.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("proba").between(0, 1)).alias("outside"),
                      F.count_if(F.col("pred") != (F.col("proba") >= cut).cast("int")).alias("against_threshold"))


# --- grids with a time of day, and texts through CSV ---------------------------------

# all months, stamped at 05:00 on the month's last or first day, then a time beside the grid, a gap behind them
_MONTHS = """m AS (SELECT date_trunc('month', o_orderdate) AS month, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1)"""


def _month_series(spark, d, freq):
    day = F.trunc(F.to_date("o_orderdate"), "month")
    months = table(spark, d, "orders").groupBy(day.alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias(Y))
    stamp = F.last_day("month") if freq == "M" else F.col("month")
    rows = months.select(F.lit("orders").alias(ITEM), (stamp.cast("timestamp_ntz") + F.expr("INTERVAL 5 HOURS")).alias(TS), Y)
    late = rows.agg(F.max(TS).alias("t")).select(F.lit("orders").alias(ITEM), (F.col("t") + F.expr("INTERVAL 40 DAYS")).alias(TS),
                                                 F.lit(-1.0).alias(Y))
    return rows.union(late)


def _month_grid(stamp: str) -> str:
    return f"""WITH {_MONTHS}, s AS (SELECT {stamp} + INTERVAL 5 HOUR AS ts, y, month FROM m),
  b AS (SELECT min(month) AS a, max(ts) + INTERVAL 40 DAY AS z FROM s),
  g AS (SELECT month FROM (SELECT unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS month FROM b)),
  p AS (SELECT {stamp} + INTERVAL 5 HOUR AS ts FROM g)
  SELECT 'orders' AS item_id, ts AS "timestamp", CASE WHEN ts = z THEN -1.0 ELSE s.y END AS target
  FROM p CROSS JOIN b LEFT JOIN s USING (ts) WHERE ts <= z"""


@register("grid_month_end", _month_grid("last_day(month)::TIMESTAMP"))
def grid_month_end(spark, d):
    """Month ends at 05:00, and a last time that is no month end, a gap behind the others."""
    return series.as_freq(_month_series(spark, d, "M"), "M")


@register("grid_month_start", _month_grid("month::TIMESTAMP"))
def grid_month_start(spark, d):
    return series.as_freq(_month_series(spark, d, "MS"), "MS")


def _step_grid(width: str) -> str:
    return f"""WITH e AS (SELECT event_type AS item_id, date_trunc('minute', min(ts)) AS a, date_trunc('minute', max(ts)) AS z FROM events GROUP BY 1)
  SELECT item_id, unnest(generate_series(a, z, INTERVAL {width})) AS "timestamp" FROM e"""


def _event_ends(spark, d):
    e = table(spark, d, "events").groupBy(F.col("event_type").alias(ITEM)).agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    ends = e.select(ITEM, F.explode(F.array("a", "z")).alias(TS))
    return ends.select(ITEM, F.date_trunc("minute", TS).cast("timestamp_ntz").alias(TS), F.lit(1.0).alias(Y))


@register("grid_hourly", _step_grid("1 HOUR"))
def grid_hourly(spark, d):
    """Hours from each event type's first minute to its last."""
    return series.as_freq(_event_ends(spark, d), "H").select(ITEM, TS)


@register("grid_weekly", _step_grid("7 DAY"))
def grid_weekly(spark, d):
    return series.as_freq(_event_ends(spark, d), "W").select(ITEM, TS)


@register("csv_texts", """SELECT 'd' || doc_id AS id, md5(text) AS digest FROM documents
  UNION ALL SELECT 'p' || page_id, md5(html) FROM pages""")
def csv_texts(spark, d):
    """Texts with quotes, commas and line feeds, written as CSV and read back."""
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    path = fresh_path(spark, "texts") + ".csv"
    sinks.write_csv(docs.union(pages), path)
    return readers.read_csv(spark, path, multi_line=True).select("id", F.md5(F.col("text").cast("string")).alias("digest"))


# --- runs whose rows are files --------------------------------------------------------

_LINES = """f0 AS (SELECT l_returnflag AS item_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts, avg(l_quantity) AS y FROM lineitem GROUP BY ALL),
  fg AS (SELECT item_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM f0 GROUP BY item_id),
  fs AS (SELECT fg.item_id, fg.ts, last_value(f0.y IGNORE NULLS) OVER (PARTITION BY fg.item_id ORDER BY fg.ts
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM fg LEFT JOIN f0 USING (item_id, ts)),
  fi AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC) AS back FROM fs)"""


def _stored_lines(spark, d):
    """A run from a config on the table's own file; its folder."""
    root = fresh_path(spark, "runs")
    config = {"type": "forecasting", "model_name": "multi", "models": ["seasonal_naive"], "target": "l_quantity", "ts_col": "l_shipdate",
              "item_id_col": "l_returnflag", "horizon": HORIZON, "freq": "D"}
    done = dispatch.run_config(spark, f"{d.rstrip('/')}/lineitem.parquet", config, root, 1)
    if "error" in done:
        raise RuntimeError(done["error"])
    return root


@register("stored_forecast", f"""WITH {_LINES}, h AS (SELECT unnest(range(1, {HORIZON + 1})) AS h)
  SELECT a.item_id, a.ts + INTERVAL 1 DAY * h AS "timestamp", round(b.y, 6) AS mean FROM fi a, h
  JOIN fi b ON b.item_id = a.item_id AND b.back = 7 - (h - 1) % 7 WHERE a.back = 1""")
def stored_forecast(spark, d):
    """The forecast of a run by config, read back from its files."""
    return rounded(results.read_frame(spark, _stored_lines(spark, d), 1, "forecast").select(ITEM, TS, "mean"))


@register("stored_item_errors", f"""WITH {_LINES}, e AS (SELECT a.item_id, a.y, b.y AS y_hat FROM fi a
    JOIN fi b ON b.item_id = a.item_id AND a.back <= {HORIZON} AND b.back = {HORIZON} + 7 - ({HORIZON} - a.back) % 7)
  SELECT item_id, round(avg(2 * abs(y_hat - y) / (abs(y) + abs(y_hat) + 1e-8)), 6) AS smape FROM e GROUP BY 1""")
def stored_item_errors(spark, d):
    """Errors per item of the same run's hold-out, read back from its CSV file."""
    return rounded(results.read_frame(spark, _stored_lines(spark, d), 1, "per_item_smape.csv"))


def _stored_shipments(spark, d, name):
    root = fresh_path(spark, "runs")
    cfg = RunConfig(horizon=HORIZON, initial_train=INITIAL, step=STEP, model_name="seasonal_naive")
    store = results.RunStore(spark, root, 2)
    run = forecasting.run_forecasting(shipments(spark, d), cfg, Y, TS, freq="D", item_col=ITEM)
    store.commit(run.result(store))
    return results.read_frame(spark, root, 2, name)


@register("stored_backtest", f"""WITH {forecasts._FOLDS} SELECT item_id, fold, ts AS "timestamp", h, y AS target, y_hat FROM bt""")
def stored_backtest(spark, d):
    """All folds of a run, read back from its files."""
    return _stored_shipments(spark, d, "backtest")


@register("stored_residuals", forecasts.ORACLES["residual_summary"])
def stored_residuals(spark, d):
    """Residual summary of the same run, read back from its files."""
    return rounded(_stored_shipments(spark, d, "residual_summary"))
