"""Series preparation and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import (ORDERS_DAILY, ORDERS_FILLED, SHIPMENTS, SHIPMENTS_EXOG, events_raw, orders_daily,
                                     orders_filled, r, rounded, shipments, shipments_exog, table)
from tidemark.config import FeatureConfig
from tidemark.functions.calendar import calendar_columns, expand_datetime, is_holiday
from tidemark.operators import exog, features, future, series, split
from tidemark.operators.series import ITEM, TS, Y

QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


@register("daily_summary", """WITH s AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts, count(*)::DOUBLE AS request_cnt,
    round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey)::DOUBLE AS distinct_users FROM orders GROUP BY ALL),
  g AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM s)
  SELECT 'orders' AS item_id, ts AS "timestamp", coalesce(request_cnt, 0) AS request_cnt, coalesce(total, 0) AS total,
    coalesce(distinct_users, 0) AS distinct_users FROM g LEFT JOIN s USING (ts)""")
def daily_summary(spark, d):
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate").cast("timestamp_ntz")
    s = o.groupBy(F.lit("orders").alias(ITEM), day.alias(TS)).agg(
        F.count(F.lit(1)).cast("double").alias("request_cnt"), F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.countDistinct("o_custkey").cast("double").alias("distinct_users"))
    return series.resample(s, "D", "sum", ["request_cnt", "total", "distinct_users"])


@register("dedup_series", """SELECT event_type AS item_id, date_trunc('minute', ts)::TIMESTAMP AS "timestamp",
  round(sum(value), 6) AS target, max_by(user_id, event_id) AS user_id FROM events GROUP BY 1, 2""")
def dedup_series(spark, d):
    e = events_raw(spark, d)
    minute = F.to_date(TS).cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(TS), mins=F.minute(TS))
    return rounded(series.merge_duplicates(e.withColumn(TS, minute), [Y], {"user_id": "event_id"}))


@register("regular_grid_ffill", f"""WITH {ORDERS_FILLED} SELECT item_id, ts AS "timestamp", y AS target FROM df""")
def regular_grid_ffill(spark, d):
    return orders_filled(spark, d)


@register("series_keys", """SELECT o_orderpriority AS item_id, o_orderdate::TIMESTAMP AS "timestamp", o_orderkey, o_totalprice
  FROM orders""")
def series_keys(spark, d):
    """Dates as text in two orders, ahead of the item: which key is the time is found, and that days come first."""
    o = table(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.date_format("o_orderdate", "dd/MM/yyyy"))
    return series.series_keys(o.select(day.alias("day"), "o_orderpriority", "o_orderkey", "o_totalprice"),
                              ["day", "o_orderpriority"])[0]


_SPARSE = """s AS (SELECT o_orderpriority || '/' || o_orderstatus AS item_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
    round(sum(o_totalprice), 2) AS y FROM orders GROUP BY ALL),
  g AS (SELECT item_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM s GROUP BY item_id)"""


def _order_kinds(spark, d):
    """Order value per day for each priority and status: series with gaps."""
    o = table(spark, d, "orders")
    item = F.concat("o_orderpriority", F.lit("/"), "o_orderstatus")
    return (o.groupBy(item.alias(ITEM), F.to_date("o_orderdate").cast("timestamp_ntz").alias(TS))
             .agg(F.round(F.sum("o_totalprice"), 2).alias(Y)))


@register("ffill_capped", f"""WITH {_SPARSE},
  j AS (SELECT g.item_id, g.ts, s.y, row_number() OVER (PARTITION BY g.item_id ORDER BY g.ts) AS rn
        FROM g LEFT JOIN s USING (item_id, ts)),
  f AS (SELECT *, last_value(y IGNORE NULLS) OVER w AS v,
          last_value(CASE WHEN y IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS vr FROM j
        WINDOW w AS (PARTITION BY item_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
  SELECT item_id, ts AS "timestamp", CASE WHEN rn - vr <= 2 THEN v ELSE 0.0 END AS target FROM f""")
def ffill_capped(spark, d):
    return series.regular_grid(_order_kinds(spark, d), "D", 0.0, 2).select(ITEM, TS, Y)


@register("resample_mean", """WITH s AS (SELECT event_type AS item_id, date_trunc('hour', ts)::TIMESTAMP AS ts, avg(value) AS y
    FROM events GROUP BY ALL),
  g AS (SELECT item_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM s GROUP BY item_id)
  SELECT g.item_id, g.ts AS "timestamp", round(s.y, 6) AS target FROM g LEFT JOIN s USING (item_id, ts)""")
def resample_mean(spark, d):
    return rounded(series.resample(events_raw(spark, d), "H", "mean"))


@register("resample_sum", f"""WITH {SHIPMENTS} SELECT item_id, ts AS "timestamp", y AS target FROM m""")
def resample_sum(spark, d):
    return shipments(spark, d)


@register("resample_weekly", """WITH s AS (SELECT l_returnflag || l_linestatus AS item_id,
    (date_trunc('week', l_shipdate) + INTERVAL 6 DAY)::TIMESTAMP AS ts, sum(l_quantity) AS y FROM lineitem GROUP BY ALL),
  g AS (SELECT item_id, unnest(generate_series(min(ts), max(ts), INTERVAL 7 DAY)) AS ts FROM s GROUP BY item_id)
  SELECT g.item_id, g.ts AS "timestamp", coalesce(y, 0.0) AS target FROM g LEFT JOIN s USING (item_id, ts)""")
def resample_weekly(spark, d):
    from tidemark.catalog.common import shipments_raw
    return series.resample(shipments_raw(spark, d), "W", "sum")


@register("asfreq", f"""WITH {_SPARSE} SELECT g.item_id, g.ts AS "timestamp", s.y AS target
  FROM g LEFT JOIN s USING (item_id, ts)""")
def asfreq(spark, d):
    return series.as_freq(_order_kinds(spark, d), "D")


@register("covariate_fill", f"""WITH {_SPARSE},
  j AS (SELECT g.item_id, g.ts, s.y AS v FROM g LEFT JOIN s USING (item_id, ts))
  SELECT item_id, ts AS "timestamp", coalesce(
    last_value(v IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(v IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    AS v FROM j""")
def covariate_fill(spark, d):
    grid = series.as_freq(_order_kinds(spark, d), "D")
    return series.fill_covariates(grid.withColumnRenamed(Y, "v"), ["v"])


@register("align_covariates", f"""WITH {SHIPMENTS_EXOG},
  j AS (SELECT xg.item_id, xg.ts, x.disc FROM xg LEFT JOIN x USING (item_id, ts))
  SELECT item_id, ts AS "timestamp", round(coalesce(
    last_value(disc IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(disc IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
    0.0), 6) AS disc FROM j""")
def align_covariates(spark, d):
    x = shipments_exog(spark, d)
    return rounded(series.align_covariates(series.step_grid(x, "D"), x, ["disc"]))


@register("infer_freq", """WITH s AS (
    SELECT 'hourly' AS item_id, date_trunc('hour', ts)::TIMESTAMP AS ts FROM events
    UNION SELECT 'daily', date_trunc('day', ts)::TIMESTAMP FROM events
    UNION SELECT 'weekly', date_trunc('week', o_orderdate)::TIMESTAMP FROM orders
    UNION SELECT 'monthly', date_trunc('month', o_orderdate)::TIMESTAMP FROM orders
    UNION SELECT 'month_end', last_day(o_orderdate)::TIMESTAMP FROM orders
    UNION SELECT o_orderpriority || '/' || o_orderstatus, date_trunc('day', o_orderdate)::TIMESTAMP FROM orders),
  p AS (SELECT item_id, ts, lag(ts) OVER (PARTITION BY item_id ORDER BY ts) AS prev FROM s),
  f AS (SELECT item_id, count(*) AS n, min(ts - prev) AS lo, max(ts - prev) AS hi,
      bool_and(prev IS NULL OR ts = prev + INTERVAL 1 MONTH) AS ms, bool_and(day(ts) = 1) AS first,
      bool_and(last_day(ts) = ts) AS last,
      bool_and(prev IS NULL OR (year(ts) * 12 + month(ts)) - (year(prev) * 12 + month(prev)) = 1) AS consecutive
      FROM p GROUP BY item_id)
  SELECT item_id, CASE WHEN n >= 3 AND lo = hi AND lo = INTERVAL 1 HOUR THEN 'H'
    WHEN n >= 3 AND lo = hi AND lo = INTERVAL 1 DAY THEN 'D' WHEN n >= 3 AND lo = hi AND lo = INTERVAL 7 DAY THEN 'W'
    WHEN n >= 3 AND last AND consecutive THEN 'M' WHEN n >= 3 AND first AND ms THEN 'MS' ELSE 'D' END AS freq FROM f""")
def infer_freq(spark, d):
    e, o = table(spark, d, "events"), table(spark, d, "orders")
    day = F.to_date("o_orderdate")

    def one(df, name, ts):
        return df.select(F.lit(name).alias(ITEM), ts.cast("timestamp_ntz").alias(TS))

    hour = F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour("ts"))
    parts = [one(e, "hourly", hour), one(e, "daily", F.to_date("ts")), one(o, "weekly", F.trunc(day, "week")),
             one(o, "monthly", F.trunc(day, "month")), one(o, "month_end", F.last_day(day)),
             _order_kinds(spark, d).select(ITEM, TS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return series.infer_frequency(out)


# --- splits --------------------------------------------------------------------------

_TAIL = {"drop": ("WHERE n > 28", "CASE WHEN back <= 28 THEN 'val' ELSE 'train' END"),
         "val": ("", "CASE WHEN back <= 28 THEN 'val' ELSE 'train' END"),
         "train": ("", "CASE WHEN n > 28 AND back <= 28 THEN 'val' ELSE 'train' END")}


def _users(spark, d):
    """Daily value per user: many short series beside long ones."""
    e = table(spark, d, "events")
    return (e.groupBy(F.col("user_id").cast("string").alias(ITEM), F.to_date("ts").cast("timestamp_ntz").alias(TS))
             .agg(F.round(F.sum("value"), 4).alias(Y)))


_USERS = """u AS (SELECT user_id::VARCHAR AS item_id, date_trunc('day', ts)::TIMESTAMP AS ts, round(sum(value), 4) AS y
    FROM events GROUP BY ALL),
  ui AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC) AS back,
           count(*) OVER (PARTITION BY item_id) AS n FROM u)"""

for _policy, (_where, _part) in _TAIL.items():
    def _run(spark, d, policy=_policy):
        return split.tail_split(_users(spark, d), 28, policy)
    QUERIES[f"tail_split_{_policy}"] = _run
    ORACLES[f"tail_split_{_policy}"] = f"""WITH {_USERS}
      SELECT item_id, ts AS "timestamp", y AS target, {_part} AS part FROM ui {_where}"""


@register("split_meta", f"""WITH {SHIPMENTS}, p AS (SELECT *, rn >= n - 28 AS val FROM mi)
  SELECT count(DISTINCT item_id) AS n_series, count(*) FILTER (NOT val) AS n_train_rows, count(*) FILTER (val) AS n_val_rows,
    min(ts) FILTER (NOT val) AS train_start, max(ts) FILTER (NOT val) AS train_end, min(ts) FILTER (val) AS val_start,
    max(ts) FILTER (val) AS val_end, round(count(*) FILTER (NOT val) / count(DISTINCT item_id)::DOUBLE, 6)
    AS mean_train_length FROM p""")
def split_meta(spark, d):
    return rounded(split.split_meta(split.tail_split(shipments(spark, d), 28)))


# --- after the end -------------------------------------------------------------------


@register("future_grid", f"""WITH {SHIPMENTS}, l AS (SELECT item_id, max(ts) AS last_ts FROM m GROUP BY 1),
  h AS (SELECT *, unnest(range(1, 29)) AS h FROM l)
  SELECT item_id, last_ts + INTERVAL 1 DAY * h AS "timestamp", h::INTEGER AS h FROM h""")
def future_grid(spark, d):
    return future.future_grid(shipments(spark, d), 28, "D")


@register("future_exog", f"""WITH {SHIPMENTS_EXOG},
  l AS (SELECT item_id, max(ts) AS last_ts, max_by(disc, ts) AS disc FROM x GROUP BY 1),
  h AS (SELECT *, unnest(range(1, 15)) AS h FROM l)
  SELECT item_id, last_ts + INTERVAL 1 DAY * h AS "timestamp", h::INTEGER AS h, round(disc, 6) AS disc,
    0.0::DOUBLE AS first_line FROM h""")
def future_exog(spark, d):
    return rounded(future.future_exog(shipments_exog(spark, d), ["disc", "first_line"], 14, "D"))


@register("future_covariates", f"""WITH {SHIPMENTS_EXOG},
  l AS (SELECT item_id, max(ts) AS last_ts, max_by(disc, ts) AS disc, max_by(first_line, ts) AS first_line
        FROM x GROUP BY 1), h AS (SELECT *, unnest(range(1, 15)) AS h FROM l)
  SELECT item_id, last_ts + INTERVAL 1 DAY * h AS "timestamp", h::INTEGER AS h, round(disc, 6) AS disc, first_line FROM h""")
def future_covariates(spark, d):
    return rounded(future.repeat_last_covariates(shipments_exog(spark, d), ["disc", "first_line"], 14, "D"))


@register("covariates_on_grid", f"""WITH {SHIPMENTS_EXOG},
  l AS (SELECT item_id, max(ts) AS last_ts, max_by(disc, ts) AS disc FROM x GROUP BY 1),
  h AS (SELECT *, unnest(range(1, 8)) AS h FROM l)
  SELECT item_id, last_ts + INTERVAL 1 DAY * h AS "timestamp", h::INTEGER AS h, round(disc, 6) AS disc FROM h""")
def covariates_on_grid(spark, d):
    x = shipments_exog(spark, d)
    return rounded(future.covariates_on_grid(x, ["disc"], future.future_grid(x, 7, "D")))


# --- covariate cleaning --------------------------------------------------------------


@register("exog_clean", f"""WITH {SHIPMENTS_EXOG},
  j AS (SELECT xg.item_id, xg.ts, x.disc, x.first_line FROM xg LEFT JOIN x USING (item_id, ts))
  SELECT item_id, ts AS "timestamp",
    round(coalesce(last_value(disc IGNORE NULLS) OVER w, 0.0), 6) AS disc,
    coalesce(last_value(first_line IGNORE NULLS) OVER w, 0.0) AS first_line,
    (isodow(ts) - 1)::DOUBLE AS dow, month(ts)::DOUBLE AS month
  FROM j WINDOW w AS (PARTITION BY item_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def exog_clean(spark, d):
    x = shipments_exog(spark, d).fillna(0.0, ["first_line"])  # an unknown line number is not the first
    joined = series.step_grid(x, "D").drop("step").join(x, [ITEM, TS], "left")
    # level is constant on the days that have rows, all it can be carried from; a null item has none in the join
    out, _ = exog.clean_exog(joined.drop(Y), ["disc", "first_line", "level"], required=("disc", "first_line"))
    return rounded(out.select(ITEM, TS, "disc", "first_line", "dow", "month"))


@register("exog_standardize", f"""WITH {SHIPMENTS_EXOG}, c AS (SELECT max(ts) - INTERVAL 365 DAY AS cut FROM x),
  s AS (SELECT avg(disc) AS dm, stddev_pop(disc) AS ds, avg(first_line) AS fm, stddev_pop(first_line) AS fs
        FROM x, c WHERE ts < cut)
  SELECT item_id, ts AS "timestamp", round((disc - dm) / ds, 6) AS disc,
    round((first_line - fm) / CASE WHEN fs = 0 THEN 1 ELSE fs END, 6) AS first_line FROM x, c, s WHERE ts >= cut""")
def exog_standardize(spark, d):
    x = shipments_exog(spark, d).persist()
    last = x.agg(F.max(TS)).first()[0]
    cut = F.lit(last).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(365))
    scaling = exog.fit_scaling(x.where(F.col(TS) < cut), ["disc", "first_line"])
    return rounded(exog.apply_scaling(x.where(F.col(TS) >= cut), scaling))


# --- trimming ------------------------------------------------------------------------


@register("cap_p99", f"""WITH {SHIPMENTS}, c AS (SELECT item_id, quantile_cont(y, 0.99) AS cap FROM m GROUP BY 1)
  SELECT item_id, ts AS "timestamp", round(least(y, cap), 6) AS target FROM m JOIN c USING (item_id)""")
def cap_p99(spark, d):
    return rounded(series.cap_outliers(shipments(spark, d), 0.99))


@register("history_window", """WITH l AS (SELECT event_type, max(ts) AS last_ts FROM events GROUP BY 1)
  SELECT event_type AS item_id, ts AS "timestamp", value AS target, event_id FROM events JOIN l USING (event_type)
  WHERE ts >= last_ts - INTERVAL 10 DAY""")
def history_window(spark, d):
    return series.recent_history(events_raw(spark, d).drop("user_id"), 10)


@register("longest_item", """SELECT user_id::VARCHAR AS item_id, count(*) AS count FROM events
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def longest_item(spark, d):
    e = table(spark, d, "events")
    return series.longest_item(e.select(F.col("user_id").cast("string").alias(ITEM)))


@register("thin_series", f"""WITH {SHIPMENTS} SELECT item_id, ts AS "timestamp", y AS target FROM mi
  WHERE n <= 200 OR rn % greatest(1, n // 200) = 0""")
def thin_series(spark, d):
    return series.thin(shipments(spark, d), 200)


@register("length_report", f"""WITH {_USERS} SELECT item_id, count(*) AS n,
  CASE WHEN count(*) < 29 THEN 'fewer than 29 rows' END AS problem FROM u GROUP BY 1""")
def length_report(spark, d):
    return series.length_report(_users(spark, d), 22, 7, 14)


# --- features ------------------------------------------------------------------------

_LAGS = ", ".join(f"lag(y, {k}) OVER w AS lag_{k}" for k in (1, 7, 14, 28))
_ROLLS = ", ".join(
    f"CASE WHEN count(y) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING) = {w} "
    f"THEN round(avg(y) OVER (PARTITION BY item_id ORDER BY ts ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 6) END "
    f"AS roll_mean_{w}" for w in (7, 14, 28))
_HOLIDAYS = "(101, 102, 208, 427, 501, 502, 625, 815, 1031, 1101, 1225, 1226)"
_CALENDAR = f"""(isodow(ts) - 1)::INTEGER AS dow, weekofyear(ts)::INTEGER AS weekofyear, month(ts)::INTEGER AS month,
  quarter(ts)::INTEGER AS quarter, day(ts)::INTEGER AS day, (day(ts) = 1)::INTEGER AS is_month_start,
  (last_day(ts) = ts::DATE)::INTEGER AS is_month_end, (isodow(ts) >= 6)::INTEGER AS is_weekend, year(ts)::INTEGER AS year,
  (month(ts) * 100 + day(ts) IN {_HOLIDAYS} AND ts = date_trunc('day', ts))::INTEGER AS is_holiday"""


@register("lag_features", f"""WITH {SHIPMENTS} SELECT item_id, ts AS "timestamp", {_LAGS} FROM m
  WINDOW w AS (PARTITION BY item_id ORDER BY ts)""")
def lag_features(spark, d):
    m = shipments(spark, d)
    return m.withColumns(features.lag_columns((1, 7, 14, 28))).drop(Y)


@register("rolling_features", f"""WITH {SHIPMENTS} SELECT item_id, ts AS "timestamp", {_ROLLS} FROM m""")
def rolling_features(spark, d):
    m = shipments(spark, d)
    return rounded(m.withColumns(features.rolling_columns((7, 14, 28))).drop(Y))


@register("calendar_features", f"""SELECT DISTINCT ts AS "timestamp", {_CALENDAR} FROM
  (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS ts FROM orders)""")
def calendar_features(spark, d):
    o = table(spark, d, "orders").select(F.to_date("o_orderdate").cast("timestamp_ntz").alias(TS)).distinct()
    return o.withColumns(calendar_columns(F.col(TS)))


@register("holiday_flag", f"""SELECT o_orderkey, (month(o_orderdate) * 100 + day(o_orderdate) IN {_HOLIDAYS}
  AND o_orderdate = date_trunc('day', o_orderdate))::INTEGER AS is_holiday FROM orders""")
def holiday_flag(spark, d):
    return table(spark, d, "orders").select("o_orderkey", is_holiday(F.col("o_orderdate")).alias("is_holiday"))


@register("feature_matrix", f"""WITH {SHIPMENTS}, {SHIPMENTS_EXOG},
  f AS (SELECT item_id, ts, y, {_LAGS}, {_ROLLS}, {_CALENDAR} FROM m WINDOW w AS (PARTITION BY item_id ORDER BY ts)),
  j AS (SELECT f.*, round(x.disc, 6) AS disc FROM f LEFT JOIN x USING (item_id, ts))
  SELECT * EXCLUDE (ts, y), ts AS "timestamp", y AS target FROM j
  WHERE lag_28 IS NOT NULL AND roll_mean_28 IS NOT NULL AND disc IS NOT NULL""")
def feature_matrix(spark, d):
    x = shipments_exog(spark, d).select(ITEM, TS, "disc")
    cfg = FeatureConfig()
    fm = features.feature_matrix(shipments(spark, d), cfg, x)
    return rounded(features.complete_cases(fm, [*features.feature_names(cfg, ["disc"]), Y]))


@register("datetime_expand", """SELECT event_id, year(ts)::INTEGER AS ts__year, month(ts)::INTEGER AS ts__month,
  (isodow(ts) - 1)::INTEGER AS ts__dow, hour(ts)::INTEGER AS ts__hour, (day(ts) = 1)::INTEGER AS ts__month_start,
  (last_day(ts) = ts::DATE)::INTEGER AS ts__month_end FROM events""")
def datetime_expand(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", *[v.alias(k) for k, v in expand_datetime("ts", F.col("ts")).items()])


@register("filled_orders_exog", f"""WITH {ORDERS_DAILY} SELECT dg.item_id, dg.ts AS "timestamp",
  coalesce(last_value(d.y IGNORE NULLS) OVER (ORDER BY dg.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0)
  AS target, d.n_orders FROM dg LEFT JOIN d USING (item_id, ts)""")
def filled_orders_exog(spark, d):
    return series.regular_grid(orders_daily(spark, d), "D", exog=["n_orders"]).drop("step")
