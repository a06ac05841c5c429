"""Forecast, backtest and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import (HORIZON, INITIAL, ORDERS_FILLED, SHIPMENTS, SHIPMENTS_EXOG, STEP, orders_daily,
                                     orders_filled, r, rounded, shipments, shipments_exog, shipments_raw)
from tidemark.config import FeatureConfig, MultiSeriesConfig, RunConfig
from tidemark.models.base import HAT, make
from tidemark.operators import evaluate, series, split
from tidemark.operators.features import feature_names
from tidemark.operators.series import ITEM, TS, Y
from tidemark.plans import backtest as bt
from tidemark.plans import forecasting

QUERIES, ORACLES = {}, {}
_SMALL = {"n_estimators": 20, "max_depth": 6}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


# --- seasonal naive and its errors ---------------------------------------------------

_NAIVE = f"""{SHIPMENTS}, k AS (SELECT item_id, max(n) AS n, max(ts) AS last_ts FROM mi GROUP BY 1),
  f AS (SELECT item_id, n, last_ts, unnest(range(1, 29)) AS h FROM k),
  p AS (SELECT f.item_id, f.last_ts + INTERVAL 1 DAY * h AS ts, h, mi.y AS y_hat FROM f
        JOIN mi ON mi.item_id = f.item_id AND mi.rn = f.n - 7 + (h - 1) % 7)"""
# truth and prediction of the last 28 rows of every item
_HOLD = f"""{SHIPMENTS}, hold AS (SELECT a.item_id, a.ts, a.y, b.y AS y_hat FROM mi a JOIN mi b
    ON a.item_id = b.item_id AND a.rn >= a.n - 28 AND b.rn = a.n - 28 - 7 + (a.rn - (a.n - 28)) % 7)"""
_ERRORS = """round(sqrt(avg((y - y_hat) ** 2)), 6) AS rmse, round(avg(abs(y - y_hat)), 6) AS mae,
  round(avg(2 * abs(y_hat - y) / (abs(y) + abs(y_hat) + 1e-8)), 6) AS smape"""


@register("seasonal_naive", f"""WITH {_NAIVE} SELECT item_id, ts AS "timestamp", h::INTEGER AS h, y_hat FROM p""")
def seasonal_naive(spark, d):
    return make("seasonal_naive").forecast(shipments(spark, d), 28)


def _holdout(spark, d):
    parts = split.tail_split(shipments(spark, d), 28)
    train, val = parts.where("part = 'train'"), parts.where("part = 'val'")
    return train, evaluate.align(val, make("seasonal_naive").forecast(train, 28))


@register("naive_holdout_metrics", f"""WITH {_HOLD} SELECT count(*) AS n, {_ERRORS} FROM hold""")
def naive_holdout_metrics(spark, d):
    _, pairs = _holdout(spark, d)
    return rounded(evaluate.error_table(pairs).drop("mape"))


@register("holdout_mape", f"""WITH {_HOLD} SELECT item_id, round(avg(abs((y - y_hat) / (abs(y) + 1e-8))), 6) AS mape
  FROM hold WHERE y > 0 GROUP BY 1""")
def holdout_mape(spark, d):
    """MAPE per item over the days with shipments."""
    _, pairs = _holdout(spark, d)
    return rounded(evaluate.error_table(pairs.where(F.col(Y) > 0), [ITEM]).select(ITEM, "mape"))


@register("per_item_smape_top5", f"""WITH {_HOLD} SELECT item_id,
  round(avg(2 * abs(y_hat - y) / (abs(y) + abs(y_hat) + 1e-8)), 6) AS smape FROM hold GROUP BY 1
  ORDER BY 2 DESC, 1 LIMIT 5""")
def per_item_smape_top5(spark, d):
    return rounded(evaluate.worst_items(_holdout(spark, d)[1]))


def _mase_sql(step):
    return f"""WITH {_HOLD}, s AS (SELECT item_id, avg(abs(dd)) + 1e-8 AS scale FROM
      (SELECT item_id, {step} AS dd FROM mi WHERE rn < n - 28 WINDOW w AS (PARTITION BY item_id ORDER BY ts))
      GROUP BY 1)
    SELECT h.item_id, round(avg(abs(y - y_hat)) / max(scale), 6) AS mase FROM hold h JOIN s USING (item_id) GROUP BY 1"""


@register("mase_seasonal", _mase_sql("y - lag(y, 7) OVER w"))
def mase_seasonal(spark, d):
    train, pairs = _holdout(spark, d)
    return rounded(evaluate.mase(pairs, train, 7))


@register("mase_order", _mase_sql("y - 2 * lag(y, 1) OVER w + lag(y, 2) OVER w"))
def mase_order(spark, d):
    train, pairs = _holdout(spark, d)
    return rounded(evaluate.mase(pairs, train, 2, "order"))


# --- backtests -----------------------------------------------------------------------

_PLAN = bt.FoldPlan(INITIAL, STEP, HORIZON)
_FOLDS = f"""{SHIPMENTS}, fd AS (SELECT item_id, max(n) AS n FROM mi GROUP BY 1),
  ff AS (SELECT item_id, unnest(range(0, (n - {HORIZON} - {INITIAL}) // {STEP} + 1)) AS fold FROM fd
         WHERE n >= {INITIAL + HORIZON}),
  bt AS (SELECT a.item_id, fold::INTEGER AS fold, a.ts, (a.rn - {INITIAL} - fold * {STEP} + 1)::INTEGER AS h, a.y,
           b.y AS y_hat FROM ff JOIN mi a ON a.item_id = ff.item_id AND a.rn >= {INITIAL} + fold * {STEP}
             AND a.rn < {INITIAL} + fold * {STEP} + {HORIZON}
           JOIN mi b ON b.item_id = ff.item_id
             AND b.rn = {INITIAL} + fold * {STEP} - 7 + (a.rn - {INITIAL} - fold * {STEP}) % 7)"""


@register("backtest_folds", f"""WITH {_FOLDS} SELECT mi.item_id, fold::INTEGER AS fold, rn + 1 AS train_rows, ts AS cutoff
  FROM ff JOIN mi ON mi.item_id = ff.item_id AND rn = {INITIAL} + fold * {STEP} - 1""")
def backtest_folds(spark, d):
    out = bt.fold_cutoffs(bt.index_rows(shipments(spark, d)), _PLAN)
    return out.withColumn("train_rows", F.col("train_rows").cast("bigint"))


@register("backtest_naive", f"""WITH {_FOLDS} SELECT item_id, fold, ts AS "timestamp", h, y AS target, y_hat FROM bt""")
def backtest_naive(spark, d):
    return bt.rolling_backtest(shipments(spark, d), make("seasonal_naive", horizon=HORIZON), _PLAN)


@register("backtest_last_windows", f"""WITH {_FOLDS}, k AS (SELECT item_id, max(fold) AS top FROM ff GROUP BY 1)
  SELECT fold, count(*) AS n, {_ERRORS} FROM bt JOIN k USING (item_id) WHERE fold > top - 3 GROUP BY 1""")
def backtest_last_windows(spark, d):
    plan = bt.FoldPlan(INITIAL, STEP, HORIZON, 3)
    b = bt.rolling_backtest(shipments(spark, d), make("seasonal_naive", horizon=HORIZON), plan)
    return rounded(evaluate.error_table(b, [bt.FOLD]).drop("mape"))


@register("residual_summary", f"""WITH {_FOLDS}, e AS (SELECT item_id, y - y_hat AS e FROM bt)
  SELECT item_id, count(*) AS count, round(avg(e), 6) AS mean, round(stddev_samp(e), 6) AS std, min(e) AS min,
    round(quantile_cont(e, 0.25), 6) AS p25, round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.75), 6) AS p75,
    max(e) AS max FROM e GROUP BY 1""")
def residual_summary(spark, d):
    return rounded(evaluate.residual_summary(backtest_naive(spark, d)))


_LB = ", ".join(f"sum(c * lag{k}) AS s{k}" for k in range(1, 11))
_LB_LAGS = ", ".join(f"lag(c, {k}) OVER (PARTITION BY item_id ORDER BY ts) AS lag{k}" for k in range(1, 11))
_LB_SUM = " + ".join(f"(s{k} / v) ** 2 / (n - {k})" for k in range(1, 11))


@register("ljung_box", f"""WITH {_FOLDS}, e AS (SELECT item_id, ts, y - y_hat AS e FROM bt),
  c AS (SELECT item_id, ts, e - avg(e) OVER (PARTITION BY item_id) AS c FROM e),
  l AS (SELECT *, {_LB_LAGS} FROM c),
  s AS (SELECT item_id, count(*) AS n, sum(c * c) AS v, {_LB} FROM l GROUP BY 1),
  q AS (SELECT item_id, n, n * (n + 2) * ({_LB_SUM}) AS q FROM s)
  SELECT item_id, n, round(q, 4) AS lb_stat, round(exp(-q / 2) * (1 + q / 2 + (q / 2) ** 2 / 2 + (q / 2) ** 3 / 6
    + (q / 2) ** 4 / 24), 6) AS lb_pvalue FROM q""")
def ljung_box(spark, d):
    out = evaluate.ljung_box(backtest_naive(spark, d))
    return out.select(ITEM, "n", r("lb_stat", 4).alias("lb_stat"), r("lb_pvalue").alias("lb_pvalue"))


@register("grid_select", f"""WITH {_FOLDS}, b1 AS (SELECT bt.item_id, bt.y, b.y AS y_hat FROM bt JOIN mi b
    ON b.item_id = bt.item_id AND b.rn = {INITIAL} + bt.fold * {STEP} - 1),
  s AS (SELECT 1 AS season, round(sqrt(avg((y - y_hat) ** 2)), 6) AS rmse FROM b1
        UNION ALL SELECT 7, round(sqrt(avg((y - y_hat) ** 2)), 6) FROM bt)
  SELECT season, rmse, rmse = (SELECT min(rmse) FROM s) AS best FROM s""")
def grid_select(spark, d):
    """Search over naive forecasts with two seasons."""
    found = bt.grid_search(shipments(spark, d), "seasonal_naive", {"season": [1, 7]}, _PLAN)
    season = F.get_json_object("params", "$.season").cast("int")
    return found.board.select(season.alias("season"), r("rmse").alias("rmse"), (F.col("rank") == 1).alias("best"))


# every cut-off of every item: number of rows before it
_CUTS = f"""{SHIPMENTS}, fd AS (SELECT item_id, max(n) AS n FROM mi GROUP BY 1),
  ct AS (SELECT item_id, fold, {INITIAL} + fold * {STEP} AS cut FROM (
    SELECT item_id, unnest(range(0, (n - {HORIZON} - {INITIAL}) // {STEP} + 1)) AS fold FROM fd WHERE n >= {INITIAL + HORIZON}))"""
_TRUTH = f"""tr AS (SELECT ct.item_id, fold, cut, ts, rn - cut + 1 AS h, y FROM ct JOIN mi ON mi.item_id = ct.item_id
    AND rn >= cut AND rn < cut + {HORIZON})"""


@register("arima_grid", f"""WITH {_CUTS}, {_TRUTH}, w AS (SELECT *, y - lag(y) OVER (PARTITION BY item_id ORDER BY rn) AS w FROM mi),
  f AS (SELECT ct.item_id, fold, avg(y) FILTER (rn >= 3) AS mean, avg(w) FILTER (rn >= 4) AS drift, max(y) FILTER (rn = cut - 1) AS y
        FROM ct JOIN w ON w.item_id = ct.item_id AND rn < cut GROUP BY ALL),
  s AS (SELECT sqrt(avg((tr.y - mean) ** 2)) AS flat, sqrt(avg((tr.y - f.y - h * drift) ** 2)) AS walk FROM tr JOIN f USING (item_id, fold))
  SELECT 0 AS candidate, CASE WHEN flat <= walk THEN 1 ELSE 2 END AS rank, round(flat, 3) AS rmse, false AS failed FROM s
  UNION ALL SELECT 1, CASE WHEN flat <= walk THEN 2 ELSE 1 END, round(walk, 3), false FROM s
  UNION ALL SELECT 2, NULL, NULL, true FROM s""")
def arima_grid(spark, d):
    """Three ARIMA candidates as rows of one job, all folds; the last one has no valid order."""
    space = [{"order": (0, 0, 0)}, {"order": (0, 1, 0)}, {"order": "none"}]
    found = bt.grid_search(shipments(spark, d), "arima", space, _PLAN)
    return found.board.select("candidate", "rank", r("rmse", 3).alias("rmse"), F.col("error").isNotNull().alias("failed"))


def _fold_query(name, params=None, digits=6):
    def run(spark, d):
        made = bt.rolling_backtest(shipments(spark, d), make(name, params=params or {}, horizon=HORIZON), _PLAN)
        return rounded(made.select(ITEM, bt.FOLD, TS, "h", HAT), digits)
    return run


def _fold_sql(forecast, digits=6):
    return f"""SELECT tr.item_id, tr.fold::INTEGER AS fold, tr.ts AS "timestamp", tr.h::INTEGER AS h, round({forecast}, {digits}) AS y_hat"""


_NPTS_AT = """sp AS (SELECT ct.item_id, fold, rn % 7 AS phase, sum(power(0.9, (cut - 1 - rn) // 7) * y) / sum(power(0.9, (cut - 1 - rn) // 7)) AS y_hat
    FROM ct JOIN mi ON mi.item_id = ct.item_id AND rn < cut GROUP BY ALL)"""
QUERIES["npts_backtest"] = _fold_query("npts")
ORACLES["npts_backtest"] = f"""WITH {_CUTS}, {_TRUTH}, {_NPTS_AT}
  {_fold_sql("sp.y_hat")} FROM tr JOIN sp ON sp.item_id = tr.item_id AND sp.fold = tr.fold AND sp.phase = (cut - 1 + h) % 7"""

_THETA_AT = """tp AS (SELECT ct.item_id, fold, cut, rn, y, rn % 7 AS phase,
    avg(y) OVER (PARTITION BY ct.item_id, fold, rn % 7) - avg(y) OVER (PARTITION BY ct.item_id, fold) AS s
    FROM ct JOIN mi ON mi.item_id = ct.item_id AND rn < cut),
  tl AS (SELECT item_id, fold, cut, regr_slope(y - s, rn) AS b, regr_intercept(y - s, rn) AS a, max(y - s) FILTER (rn = 0) AS v0
         FROM tp GROUP BY ALL),
  tz AS (SELECT item_id, fold, max(tl.a) AS a, max(tl.b) AS b,
           sum(0.2 * power(0.8, tp.cut - 1 - rn) * (2 * (y - s) - (tl.a + tl.b * rn))) + max(power(0.8, tp.cut) * (2 * v0 - tl.a)) AS level
         FROM tp JOIN tl USING (item_id, fold) GROUP BY ALL),
  ts AS (SELECT item_id, fold, phase, max(s) AS s FROM tp GROUP BY ALL)"""
_THETA_HAT = "(tz.a + tz.b * (cut - 1 + h) + tz.level) / 2 + ts.s"
_THETA_FROM = """FROM tr JOIN tz USING (item_id, fold)
  JOIN ts ON ts.item_id = tr.item_id AND ts.fold = tr.fold AND ts.phase = (cut - 1 + h) % 7"""
QUERIES["theta_backtest"] = _fold_query("theta")
ORACLES["theta_backtest"] = f"""WITH {_CUTS}, {_TRUTH}, {_THETA_AT} {_fold_sql(_THETA_HAT)} {_THETA_FROM}"""

# level and trend at rate 0.3 or no trend rate, season at 0.3; the one of less one-step error answers
QUERIES["ets_backtest"] = _fold_query("ets", {"rates": (0.3,)}, 4)
ORACLES["ets_backtest"] = f"""WITH RECURSIVE {_CUTS}, {_TRUTH},
  e0 AS (SELECT item_id, list(y ORDER BY rn) FILTER (rn < 7) AS a, avg(y) FILTER (rn < 7) AS la,
           avg(y) FILTER (rn >= 7 AND rn < 14) AS lb FROM mi GROUP BY 1),
  st AS (SELECT item_id, 6::BIGINT AS rn, b, la AS level, (lb - la) / 7 AS slope, list_transform(a, lambda v: v - la) AS season, 0.0::DOUBLE AS err
         FROM e0, (SELECT unnest([0.0, 0.3])::DOUBLE AS b)
    UNION ALL SELECT item_id, rn, b, l, b * (l - level) + (1 - b) * slope,
      list_concat(list_concat(season[1:rn % 7], [0.3 * (y - l) + 0.7 * s]), season[rn % 7 + 2:7]), err + (y - level - slope - s) ** 2
    FROM (SELECT st.item_id, mi.rn, b, level, slope, season, err, y, season[mi.rn % 7 + 1] AS s,
            0.3 * (y - season[mi.rn % 7 + 1]) + 0.7 * (level + slope) AS l
          FROM st JOIN mi ON mi.item_id = st.item_id AND mi.rn = st.rn + 1)),
  pk AS (SELECT ct.item_id, fold, cut, level, slope, season FROM ct JOIN st ON st.item_id = ct.item_id AND st.rn = cut - 1
         QUALIFY row_number() OVER (PARTITION BY ct.item_id, fold ORDER BY err, b) = 1)
  {_fold_sql("level + slope * h + season[(pk.cut - 1 + h) % 7 + 1]", 4)} FROM tr JOIN pk USING (item_id, fold)"""

_LAST = f"""{SHIPMENTS}, ct AS (SELECT item_id, 0 AS fold, max(n) - {HORIZON} AS cut FROM mi GROUP BY 1), {_TRUTH}, {_NPTS_AT}, {_THETA_AT},
  al AS (SELECT 'seasonal_naive' AS model, tr.y, b.y AS y_hat FROM tr JOIN mi b ON b.item_id = tr.item_id AND b.rn = cut - 7 + (h - 1) % 7
    UNION ALL SELECT 'npts', tr.y, y_hat FROM tr JOIN sp ON sp.item_id = tr.item_id AND sp.phase = (cut - 1 + h) % 7
    UNION ALL SELECT 'theta', tr.y, {_THETA_HAT} {_THETA_FROM})"""


@register("leaderboard_exact", f"""WITH {_LAST}, e AS (SELECT model, count(*) AS n, sqrt(avg((y - y_hat) ** 2)) AS rmse, avg(abs(y - y_hat)) AS mae,
    avg(2 * abs(y_hat - y) / (abs(y) + abs(y_hat) + 1e-8)) AS smape FROM al GROUP BY 1)
  SELECT row_number() OVER (ORDER BY smape)::INTEGER AS rank, model, round(smape, 6) AS score, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM e""")
def leaderboard_exact(spark, d):
    """Three models that SQL can follow, ranked on the last rows of every item."""
    board = bt.leaderboard(shipments(spark, d), ["theta", "npts", "seasonal_naive"], bt.FoldPlan(1, 1, HORIZON, 1), "smape").table
    return rounded(board.select("rank", "model", "score", "rmse", "mae"))


# --- models with a SQL twin ----------------------------------------------------------


@register("npts_quantiles", f"""WITH {SHIPMENTS},
  w AS (SELECT item_id, ts, y, rn % 7 AS phase, power(0.9, (n - 1 - rn) // 7) AS w FROM mi),
  s AS (SELECT *, sum(w) OVER (PARTITION BY item_id, phase ORDER BY y, ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
          / sum(w) OVER (PARTITION BY item_id, phase) AS share FROM w),
  q AS (SELECT item_id, phase, round(sum(w * y) / sum(w), 6) AS y_hat, min(y) FILTER (share >= 0.1 - 1e-9) AS p10,
          min(y) FILTER (share >= 0.5 - 1e-9) AS p50, min(y) FILTER (share >= 0.9 - 1e-9) AS p90 FROM s GROUP BY ALL),
  f AS (SELECT item_id, max(n) AS n, max(ts) AS last_ts, unnest(range(1, 15)) AS h FROM mi GROUP BY 1)
  SELECT f.item_id, last_ts + INTERVAL 1 DAY * h AS "timestamp", h::INTEGER AS h, y_hat, p10, p50, p90
  FROM f JOIN q ON q.item_id = f.item_id AND q.phase = (f.n - 1 + h) % 7""")
def npts_quantiles(spark, d):
    return rounded(make("npts").forecast(shipments(spark, d), 14))


@register("theta_forecast", f"""WITH {SHIPMENTS},
  a AS (SELECT *, rn % 7 AS phase, avg(y) OVER (PARTITION BY item_id, rn % 7) - avg(y) OVER (PARTITION BY item_id) AS s FROM mi),
  v AS (SELECT *, y - s AS v FROM a),
  l AS (SELECT item_id, max(n) AS n, max(ts) AS last_ts, regr_slope(v, rn) AS b, regr_intercept(v, rn) AS a,
          max(v) FILTER (rn = 0) AS v0 FROM v GROUP BY 1),
  z AS (SELECT v.item_id, sum(0.2 * power(0.8, l.n - 1 - rn) * (2 * v - (l.a + l.b * rn))) AS level
        FROM v JOIN l USING (item_id) GROUP BY 1),
  sp AS (SELECT item_id, phase, max(s) AS s FROM a GROUP BY ALL),
  f AS (SELECT l.*, z.level + power(0.8, l.n) * (2 * v0 - l.a) AS level, unnest(range(1, 15)) AS h FROM l JOIN z USING (item_id))
  SELECT f.item_id, last_ts + INTERVAL 1 DAY * h AS "timestamp", h::INTEGER AS h,
    round((f.a + f.b * (n - 1 + h) + level) / 2 + sp.s, 6) AS y_hat
  FROM f JOIN sp ON sp.item_id = f.item_id AND sp.phase = (n - 1 + h) % 7""")
def theta_forecast(spark, d):
    return rounded(make("theta").forecast(shipments(spark, d), 14))


# --- models checked by rows ----------------------------------------------------------


def _forecast(name, params=None):
    def run(spark, d):
        m = shipments(spark, d).persist()
        return make(name, params=params or {}, horizon=HORIZON).fit(m).forecast(m, HORIZON)
    return run


QUERIES["ets_forecast"] = _forecast("ets")
QUERIES["arima_forecast"] = _forecast("arima")
QUERIES["sarimax_forecast"] = _forecast("sarimax")
QUERIES["rf_recursive"] = _forecast("rf", _SMALL)
QUERIES["gbt_recursive"] = _forecast("recursive_tabular", {"n_estimators": 10})
QUERIES["gbt_direct"] = _forecast("direct_tabular", {"n_estimators": 10})


@register("rf_with_covariates")
def rf_with_covariates(spark, d):
    """Forest with covariates; the future ones are built from the last known values."""
    x = shipments_exog(spark, d)
    m = shipments(spark, d).join(x.select(ITEM, TS, "disc", "first_line"), [ITEM, TS], "left")
    m = series.fill_covariates(m, ["disc", "first_line"]).persist()
    return make("rf", params=_SMALL, exog=("disc", "first_line"), horizon=HORIZON).fit(m).forecast(m, HORIZON)


@register("rf_backtest")
def rf_backtest(spark, d):
    """Pooled forest fitted again for each of the last two folds."""
    plan = bt.FoldPlan(INITIAL, STEP, HORIZON, 2)
    return bt.rolling_backtest(shipments(spark, d), make("rf", params=_SMALL, horizon=HORIZON), plan)


@register("sarimax_search")
def sarimax_search(spark, d):
    """Default orders on the filled series of all orders, three last folds each."""
    run = forecasting.run_forecasting(
        orders_daily(spark, d), RunConfig(horizon=HORIZON, model_name="sarimax"), target=Y, ts_col=TS, freq="D",
        max_folds=3)
    return run.forecast


@register("leaderboard")
def leaderboard(spark, d):
    plan = bt.FoldPlan(1, 1, HORIZON, 1)
    return bt.leaderboard(shipments(spark, d), ["seasonal_naive", "ets", "npts", "theta", "arima"], plan, "smape")[0]


@register("roll_forward")
def roll_forward(spark, d):
    """100 days in blocks of 28."""
    return forecasting.roll_forward(make("npts", horizon=28), shipments(spark, d), 100, 28)


@register("multi_series_run")
def multi_series_run(spark, d):
    li = shipments_raw(spark, d)
    cfg = MultiSeriesConfig(horizon=HORIZON, eval_metric="sMAPE", models=("seasonal_naive", "ets", "npts"))
    return forecasting.run_multi_series(li, cfg, Y, TS, ITEM, how="sum").forecast


@register("residual_quantiles")
def residual_quantiles(spark, d):
    """Theta forecast with quantiles from its backtest residuals."""
    m = shipments(spark, d).persist()
    model = make("theta", horizon=HORIZON)
    b = bt.rolling_backtest(m, model, bt.FoldPlan(INITIAL, HORIZON, HORIZON, 20))
    return forecasting.with_quantiles(model.forecast(m, HORIZON), b, (0.1, 0.5, 0.9))
