"""Shared inputs of the queries: series cut from the test tables, and their SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import series
from tidemark.operators.series import ITEM, TS, Y
from tidemark.sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """For work that is heavy per row: the needed columns over all cores."""
    t = table(spark, sf_dir, name)
    return spread(t.select(*columns) if columns else t)


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to a fixed number of digits: sums of floats depend on their order."""
    return df.select(*[r(f"`{f.name}`", digits).alias(f.name)
                       if f.dataType.typeName() == "double" and f.name not in skip else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# --- the daily series of all orders --------------------------------------------------


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series with gaps: order value per day."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate").cast("timestamp_ntz")
    return (o.groupBy(F.lit("orders").alias(ITEM), day.alias(TS))
             .agg(F.round(F.sum("o_totalprice"), 2).alias(Y), F.count(F.lit(1)).cast("double").alias("n_orders")))


ORDERS_DAILY = """d AS (
  SELECT 'orders' AS item_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts,
         round(sum(o_totalprice), 2) AS y, count(*)::DOUBLE AS n_orders
  FROM orders GROUP BY ALL),
dg AS (SELECT item_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM d GROUP BY item_id)"""

# filled by carrying the last value forward
ORDERS_FILLED = ORDERS_DAILY + """,
df AS (SELECT dg.item_id, dg.ts, coalesce(last_value(d.y IGNORE NULLS) OVER (PARTITION BY dg.item_id ORDER BY dg.ts
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS y
       FROM dg LEFT JOIN d USING (item_id, ts)),
dfi AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts) - 1 AS rn,
               count(*) OVER (PARTITION BY item_id) AS n FROM df)"""


def orders_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.regular_grid(orders_daily(spark, sf_dir), "D").select(ITEM, TS, Y)


# --- six daily series of shipped quantities ------------------------------------------


def shipments_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat("l_returnflag", "l_linestatus").alias(ITEM),
                     F.to_date("l_shipdate").cast("timestamp_ntz").alias(TS),
                     F.col("l_quantity").alias(Y), (F.col("l_discount") * 100).cast("int").cast("double").alias("disc"),
                     (F.col("l_linenumber") == 1).cast("double").alias("first_line"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete daily grid, quantity summed per day."""
    return series.resample(shipments_raw(spark, sf_dir), "D", "sum")


SHIPMENTS = """m0 AS (
  SELECT l_returnflag || l_linestatus AS item_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
         sum(l_quantity) AS y FROM lineitem GROUP BY ALL),
mg AS (SELECT item_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM m0 GROUP BY item_id),
m AS (SELECT mg.item_id, mg.ts, coalesce(m0.y, 0.0) AS y FROM mg LEFT JOIN m0 USING (item_id, ts)),
mi AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts) - 1 AS rn,
              count(*) OVER (PARTITION BY item_id) AS n FROM m)"""

# --- covariates on the shipments: mean discount, any first line ----------------------


def shipments_exog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and covariates on days that have rows only."""
    return shipments_raw(spark, sf_dir).groupBy(ITEM, TS).agg(
        F.sum(Y).alias(Y), F.avg("disc").alias("disc"), F.max("first_line").alias("first_line"),
        F.lit(1.0).alias("level"))


SHIPMENTS_EXOG = """x AS (
  SELECT l_returnflag || l_linestatus AS item_id, date_trunc('day', l_shipdate)::TIMESTAMP AS ts,
         sum(l_quantity) AS y, avg(CAST(trunc(l_discount * 100) AS DOUBLE)) AS disc,
         max(CASE WHEN l_linenumber = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS first_line
  FROM lineitem GROUP BY ALL),
xg AS (SELECT item_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM x GROUP BY item_id)"""


# --- hourly event values -------------------------------------------------------------


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias(ITEM), F.col("ts").alias(TS), F.col("value").alias(Y),
                    "event_id", "user_id")


# fold plans used by queries and SQL alike
INITIAL, STEP, HORIZON = 360, 28, 14
