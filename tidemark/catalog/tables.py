"""Profile, roles, SQL and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import rounded, spread_table, table
from tidemark.functions.text import sanitize_name, storage_key
from tidemark.operators import dates, profile, query
from tidemark.session import fresh_path
from tidemark.sources import readers, sinks

QUERIES, ORACLES = {}, {}


def _profile(name, columns):
    def run(spark, d):
        return rounded(profile.quick_profile(spread_table(spark, d, name)))
    sql = " UNION ALL ".join(
        f"SELECT '{c}' AS name, '{t}' AS dtype, '{role}' AS role, "
        f"round(count(*) FILTER ({c} IS NULL) / greatest(count(*), 1)::DOUBLE, 6) AS missing_rate, "
        f"(count(DISTINCT {c}) + coalesce(max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0))::BIGINT AS nunique, "
        f"count(*) AS rows FROM {name}" for c, t, role in columns)
    QUERIES[f"profile_{name}"], ORACLES[f"profile_{name}"] = run, sql


_profile("lineitem", [
    ("l_orderkey", "bigint", "numeric"), ("l_partkey", "bigint", "numeric"), ("l_suppkey", "bigint", "numeric"),
    ("l_linenumber", "int", "numeric"), ("l_quantity", "double", "numeric"), ("l_extendedprice", "double", "numeric"),
    ("l_discount", "double", "numeric"), ("l_tax", "double", "numeric"), ("l_returnflag", "string", "categorical"),
    ("l_linestatus", "string", "categorical"), ("l_shipdate", "timestamp_ntz", "datetime")])
_profile("events", [
    ("event_id", "bigint", "numeric"), ("ts", "timestamp_ntz", "datetime"), ("user_id", "bigint", "numeric"),
    ("event_type", "string", "categorical"), ("value", "double", "numeric"), ("props", "string", "categorical")])


def preview(spark, d):
    shown = profile.preview(table(spark, d, "supplier").orderBy("s_suppkey"))
    return shown if shown is not None else table(spark, d, "supplier").limit(0)


QUERIES["preview"] = preview
ORACLES["preview"] = """SELECT * FROM supplier WHERE (SELECT count(*) FROM supplier) <= 200000
  ORDER BY s_suppkey LIMIT 50"""


def infer_columns(spark, d):
    """Time and target columns of an order table whose times are text."""
    t = table(spark, d, "orders").select(
        F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("order_no"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"), F.col("o_custkey").alias("cust"),
        F.col("o_totalprice").alias("value"))
    found = (profile.time_column(t), profile.lenient_target(t, ["cust"]),
             profile.strict_target(t, None, ["cust"]), profile.by_name(t, ("request_cnt", "y", "target", "value")))
    return t.agg(*[F.max(F.lit(v)).alias(k) for k, v in zip(("ts_col", "lenient", "strict", "by_name"), found)],
                 F.count(F.lit(1)).alias("rows"))


QUERIES["infer_columns"] = infer_columns
ORACLES["infer_columns"] = """SELECT
  CASE WHEN bool_and(try_strptime('n' || o_orderkey, '%Y-%m-%d') IS NOT NULL) THEN 'order_no'
       WHEN bool_and(try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') IS NOT NULL) THEN 'placed' END AS ts_col,
  'value' AS lenient, 'value' AS strict, 'value' AS by_name, count(*) AS rows FROM orders"""


# --- read-only SQL -------------------------------------------------------------------


def _sql(name, source, text, limit=None, ordered=None):
    def run(spark, d):
        t = table(spark, d, source)
        return query.select(t, text) if limit is None else query.capped(t, text, limit)
    QUERIES[name] = run
    oracle = text.replace(" t ", f" {source} ").replace(" t\n", f" {source}\n")
    ORACLES[name] = oracle + (f" LIMIT {limit}" if limit else "")


_sql("sql_select_topk", "orders",
     "SELECT o_orderkey, o_totalprice FROM t WHERE o_orderpriority = '1-URGENT' "
     "ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
_sql("sql_grouping_sets", "lineitem",
     "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM t "
     "GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
_sql("sql_cube_rollup", "lineitem",
     "SELECT l_returnflag, l_linestatus, count(*) AS n FROM t GROUP BY CUBE (l_returnflag, l_linestatus) "
     "UNION ALL SELECT l_returnflag, l_linestatus, count(*) AS n FROM t GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("sql_window", "orders",
     "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk, "
     "round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
     "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM t ")
_sql("sql_setops", "orders",
     "SELECT o_custkey FROM t WHERE o_orderstatus = 'F' INTERSECT "
     "SELECT o_custkey FROM t WHERE o_orderstatus = 'O' EXCEPT "
     "SELECT o_custkey FROM t WHERE o_orderstatus = 'P' AND o_totalprice > 400000")
_sql("sql_semi_anti", "orders",
     "WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM t GROUP BY o_custkey) "
     "SELECT b.o_custkey, b.top FROM big b "
     "WHERE EXISTS (SELECT 1 FROM t WHERE o_custkey = b.o_custkey AND o_orderpriority = '1-URGENT') "
     "AND NOT EXISTS (SELECT 1 FROM t WHERE o_custkey = b.o_custkey AND o_orderpriority = '5-LOW')")
_sql("sql_self_join", "events",
     "SELECT a.event_type AS first_type, b.event_type AS next_type, count(*) AS n FROM "
     "(SELECT event_type, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM t ) a "
     "JOIN t AS b ON a.nxt = b.event_id GROUP BY a.event_type, b.event_type")
_sql("sql_capped", "customer",
     "SELECT c_custkey, c_acctbal FROM t ORDER BY c_acctbal DESC, c_custkey", limit=500)

# --- files and keys ------------------------------------------------------------------


def csv_roundtrip(spark, d):
    """Orders written as CSV and read back with types from the first rows."""
    path = fresh_path(spark, "orders") + ".csv"
    sinks.write_csv(table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"),
        "o_orderpriority"), path)
    t = readers.load_table(spark, path)
    return t.select(F.col("o_orderkey").cast("bigint"), F.col("o_custkey").cast("bigint"), "o_orderstatus",
                    "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz"), "o_orderpriority")


QUERIES["csv_roundtrip"] = csv_roundtrip
ORACLES["csv_roundtrip"] = """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  date_trunc('day', o_orderdate)::TIMESTAMP AS o_orderdate, o_orderpriority FROM orders"""


def json_result(spark, d):
    return sinks.json_rows(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"))


QUERIES["json_result"] = json_result
ORACLES["json_result"] = """SELECT CAST(json_object('p_partkey', p_partkey, 'p_name', p_name, 'p_brand', p_brand,
  'p_size', p_size) AS VARCHAR) AS value FROM part"""


def storage_keys(spark, d):
    """Keys from page addresses taken as file names; the page id stands for the unique part."""
    t = table(spark, d, "pages")
    return t.select("page_id", storage_key(F.col("url"), F.col("page_id").cast("string")).alias("key"),
                    sanitize_name(F.col("url")).alias("clean"))


QUERIES["storage_key"] = storage_keys
ORACLES["storage_key"] = r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '(\.[^.]*)$', 1) AS ext,
    trim(regexp_replace(regexp_replace(url, '\.[^.]*$', ''), '[^A-Za-z0-9._-]+', '_', 'g'), '._-') AS stem FROM pages)
  SELECT page_id, 'uploads/' || page_id || '_' || CASE WHEN stem = '' THEN 'file' ELSE stem END || ext AS key,
    replace(regexp_replace(url, '[^0-9a-zA-Z_]+', '_', 'g'), '__', '_') AS clean FROM p"""


# --- text to time --------------------------------------------------------------------


def parse_mixed_dates(spark, d):
    t = table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("a"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("b"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("c"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
         .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
         .otherwise(F.lit("n/a")).alias("e"))
    for c in "abce":
        t = dates.parse_times(t, c)
    return t


QUERIES["parse_mixed_dates"] = parse_mixed_dates
ORACLES["parse_mixed_dates"] = """SELECT o_orderkey, day AS a, day AS b, day AS c,
  CASE o_orderkey % 3 WHEN 0 THEN date_trunc('minute', o_orderdate)::TIMESTAMP WHEN 1 THEN day END AS e
  FROM (SELECT *, date_trunc('day', o_orderdate)::TIMESTAMP AS day FROM orders)"""


def name_based_datetime(spark, d):
    t = table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.col("o_custkey").alias("runtime"), F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("update_note"))
    return dates.coerce_named_times(t)


QUERIES["name_based_datetime"] = name_based_datetime
ORACLES["name_based_datetime"] = """SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS order_date,
  o_custkey AS runtime, 'v' || o_custkey AS update_note FROM orders"""
