"""Label, column, encoding, split and classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.common import rounded, spread_table, table
from tidemark.config import NO_WORDS, YES_WORDS, ClassifyConfig
from tidemark.functions.text import numeric_like
from tidemark.operators import binary, columns, encode, keyed, labels, split
from tidemark.plans import classification
from tidemark.session import fresh_path

QUERIES, ORACLES = {}, {}
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


# --- a dirty table rendered from orders ----------------------------------------------


def dirty_orders(spark, d):
    o = spread_table(spark, d, "orders")
    whole = F.col("o_totalprice").cast("bigint")
    k = F.col("o_orderkey")
    price = (F.when(k % 4 == 0, F.concat(F.lit("$"), F.format_number(whole, 0)))
              .when(k % 4 == 1, F.concat((whole / 1000).cast("bigint").cast("string"), F.lit("k")))
              .when(k % 4 == 2, F.concat((k % 100).cast("string"), F.lit("%")))
              .otherwise(F.concat(F.lit(" € "), whole.cast("string"))))
    return o.select(
        "o_orderkey", F.concat(F.lit("order-"), k.cast("string")).alias("order_code"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("placed"), price.alias("price"),
        F.lit("same").alias("channel"), F.when(k < 0, F.lit("x")).alias("gone"), "o_orderpriority", "o_orderdate",
        F.concat(F.lit("customer account number "), F.col("o_custkey").cast("string")).alias("note"),
        F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("No").alias("default"))


_DIRTY = """t AS (SELECT o_orderkey, 'order-' || o_orderkey AS order_code, strftime(o_orderdate, '%d/%m/%Y') AS placed,
    CASE o_orderkey % 4 WHEN 0 THEN '$' || format('{:,}', trunc(o_totalprice)::BIGINT)
      WHEN 1 THEN (trunc(o_totalprice)::BIGINT // 1000) || 'k' WHEN 2 THEN (o_orderkey % 100) || '%'
      ELSE ' € ' || trunc(o_totalprice)::BIGINT END AS price,
    'same' AS channel, CASE WHEN o_orderkey < 0 THEN 'x' END AS gone, o_orderpriority, o_orderdate,
    'customer account number ' || o_custkey AS note, CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS "default"
  FROM orders)"""


@register("coerce_numeric_like", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN trunc(o_totalprice)
    WHEN 1 THEN (trunc(o_totalprice)::BIGINT // 1000) * 1000.0 WHEN 2 THEN (o_orderkey % 100) / 100.0::DOUBLE
    ELSE trunc(o_totalprice) END::DOUBLE AS price FROM orders""")
def coerce_numeric_like(spark, d):
    return dirty_orders(spark, d).select("o_orderkey", numeric_like(F.col("price")).alias("price"))


def _facts(spark, d):
    t = dirty_orders(spark, d).persist()
    return t, columns.profile_columns(t)


def _report(t, rows, schema):
    """Findings as a table that also carries the number of rows they were read from."""
    made = t.sparkSession.createDataFrame(rows, schema)
    return made.withColumn("rows", t.agg(F.count(F.lit(1))).scalar())


@register("detect_datetime", f"""WITH {_DIRTY},
  c AS (SELECT 'order_code' AS "column", avg((try_strptime(order_code, '%d/%m/%Y') IS NOT NULL)::INT) AS ok, count(*) AS rows FROM t
    UNION ALL SELECT 'placed', avg((try_strptime(placed, '%d/%m/%Y') IS NOT NULL)::INT), count(*) FROM t
    UNION ALL SELECT 'price', avg((try_strptime(price, '%d/%m/%Y') IS NOT NULL)::INT), count(*) FROM t
    UNION ALL SELECT 'note', avg((try_strptime(note, '%d/%m/%Y') IS NOT NULL)::INT), count(*) FROM t)
  SELECT "column", (ok >= 0.7)::INT AS is_datetime, rows FROM c""")
def detect_datetime(spark, d):
    t, facts = _facts(spark, d)
    cfg = ClassifyConfig()
    rows = [(c, int(columns.is_datetime(facts[c], cfg))) for c in ("order_code", "placed", "price", "note")]
    return _report(t, rows, "column string, is_datetime int")


@register("is_textual", f"""WITH {_DIRTY},
  c AS (SELECT 'order_code' AS "column", count(DISTINCT order_code) AS k, avg(length(order_code)) AS len, count(*) AS rows FROM t
    UNION ALL SELECT 'note', count(DISTINCT note), avg(length(note)), count(*) FROM t
    UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), avg(length(o_orderpriority)), count(*) FROM t)
  SELECT "column", k AS distinct_values, round(len, 6) AS mean_length, (k >= 30 AND len >= 15)::INT AS is_text, rows FROM c""")
def is_textual(spark, d):
    t, facts = _facts(spark, d)
    cfg = ClassifyConfig()
    rows = [(c, facts[c].distinct, round(facts[c].mean_length, 6), int(columns.is_textual(facts[c], cfg)))
            for c in ("order_code", "note", "o_orderpriority")]
    return _report(t, rows, "column string, distinct_values long, mean_length double, is_text int")


@register("drop_bad_columns", f"""WITH {_DIRTY},
  c AS (SELECT 'order_code' AS "column", count(*) AS n, count(order_code) AS k, count(DISTINCT order_code) AS u, 0 AS parses FROM t
    UNION ALL SELECT 'placed', count(*), count(placed), count(DISTINCT placed), 1 FROM t
    UNION ALL SELECT 'price', count(*), count(price), count(DISTINCT price), 1 FROM t
    UNION ALL SELECT 'channel', count(*), count(channel), count(DISTINCT channel), 0 FROM t
    UNION ALL SELECT 'gone', count(*), count(gone), count(DISTINCT gone), 0 FROM t
    UNION ALL SELECT 'o_orderpriority', count(*), count(o_orderpriority), count(DISTINCT o_orderpriority), 0 FROM t
    UNION ALL SELECT 'note', count(*), count(note), count(DISTINCT note), 0 FROM t),
  r AS (SELECT "column", n AS rows, CASE WHEN (n - k) / n::DOUBLE > 0.98 THEN 'missing>98%' WHEN u <= 1 THEN 'constant'
      WHEN u > 2 AND u / n::DOUBLE >= 0.95 AND parses = 0 THEN 'likely_id' END AS reason FROM c)
  SELECT "column", reason, rows FROM r WHERE reason IS NOT NULL""")
def drop_bad_columns(spark, d):
    t, facts = _facts(spark, d)
    rows = [(x["column"], x["reason"]) for x in columns.dropped_columns(facts, "default")]
    return _report(t, rows, "column string, reason string")


@register("normalize_features", """SELECT o_orderkey::DOUBLE AS o_orderkey,
  year(o_orderdate)::DOUBLE AS placed__year, month(o_orderdate)::DOUBLE AS placed__month,
  (isodow(o_orderdate) - 1)::DOUBLE AS placed__dow, 0.0::DOUBLE AS placed__hour,
  (day(o_orderdate) = 1)::INT::DOUBLE AS placed__month_start,
  (last_day(o_orderdate) = o_orderdate::DATE)::INT::DOUBLE AS placed__month_end,
  CASE o_orderkey % 4 WHEN 0 THEN trunc(o_totalprice) WHEN 1 THEN (trunc(o_totalprice)::BIGINT // 1000) * 1000.0
    WHEN 2 THEN (o_orderkey % 100) / 100.0::DOUBLE ELSE trunc(o_totalprice) END::DOUBLE AS price,
  o_orderpriority, year(o_orderdate)::DOUBLE AS o_orderdate__year, month(o_orderdate)::DOUBLE AS o_orderdate__month,
  (isodow(o_orderdate) - 1)::DOUBLE AS o_orderdate__dow, hour(o_orderdate)::DOUBLE AS o_orderdate__hour,
  (day(o_orderdate) = 1)::INT::DOUBLE AS o_orderdate__month_start,
  (last_day(o_orderdate) = o_orderdate::DATE)::INT::DOUBLE AS o_orderdate__month_end,
  'customer account number ' || o_custkey AS note FROM orders""")
def normalize_features(spark, d):
    t = dirty_orders(spark, d).persist()
    return columns.normalize(t, columns.feature_spec(t, "default"))


# --- labels --------------------------------------------------------------------------


@register("map_binary", """SELECT l_orderkey, l_linenumber, l_linestatus, (lower(trim(l_linestatus)) = 'o')::INT AS y FROM lineitem""")
def map_binary(spark, d):
    li = table(spark, d, "lineitem")
    rule = labels.label_rules(li, ["l_linestatus"])["l_linestatus"]
    return li.select("l_orderkey", "l_linenumber", "l_linestatus", labels.apply_rule(F.col("l_linestatus"), rule).alias("y"))


def _words(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


@register("infer_target", f"""WITH {_DIRTY}, m AS (SELECT CASE WHEN lower(trim("default")) IN {_words(YES_WORDS)} THEN 1
    WHEN lower(trim("default")) IN {_words(NO_WORDS)} THEN 0 END AS y FROM t)
  SELECT 'default' AS "column", 'likely_name' AS reason, y::INT AS y, count(*) AS n FROM m
  WHERE (SELECT count(DISTINCT y) = 2 AND count(*) = count(y) FROM m) GROUP BY y""")
def infer_target(spark, d):
    t = dirty_orders(spark, d)
    found = labels.infer_target(t)
    y = labels.apply_rule(F.col(f"`{found.column}`"), found.rule)
    return t.groupBy(F.lit(found.column).alias("column"), F.lit(found.reason).alias("reason"), y.alias("y")).agg(
        F.count(F.lit(1)).alias("n"))


# --- encoding ------------------------------------------------------------------------


@register("impute_mode_median", """WITH j AS (SELECT doc_id, lang, source, n_chars, quality, toxic FROM documents
    LEFT JOIN labels USING (doc_id)),
  m AS (SELECT quantile_cont(quality, 0.5) AS quality, quantile_cont(n_chars, 0.5) AS n_chars FROM j),
  s AS (SELECT source FROM j GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
  l AS (SELECT lang FROM j WHERE lang IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
  SELECT doc_id, coalesce(j.lang, (SELECT lang FROM l)) AS lang, coalesce(j.source, (SELECT source FROM s)) AS source,
    coalesce(j.quality, (SELECT quality FROM m))::DOUBLE AS quality, coalesce(j.n_chars, (SELECT n_chars FROM m))::DOUBLE AS n_chars
  FROM j""")
def impute_mode_median(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    medians = keyed.quantiles(j, ["quality", "n_chars"], 0.5)
    modes = {x["column"]: x["mode"]
             for x in encode.column_modes(encode.category_counts(j, ["lang", "source"])).collect()}
    return j.select("doc_id", *[F.coalesce(c, F.lit(modes[c])).alias(c) for c in ("lang", "source")],
                    *[F.coalesce(F.col(c).cast("double"), F.lit(medians[c])).alias(c) for c in ("quality", "n_chars")])


_RARE = """c AS (SELECT 'p_name' AS "column", p_name AS value, count(*) AS n FROM part GROUP BY 2
    UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY 2
    UNION ALL SELECT 'p_size', p_size::VARCHAR, count(*) FROM part GROUP BY 2),
  t AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total, count(*) OVER (PARTITION BY "column") AS levels FROM c),
  f AS (SELECT *, count(*) FILTER (n >= 0.01 * total) OVER (PARTITION BY "column") AS nf,
          row_number() OVER (PARTITION BY "column", n >= 0.01 * total ORDER BY n DESC, value DESC) AS place FROM t),
  b AS (SELECT "column", value, n::BIGINT AS n, CASE WHEN n >= 0.01 * total AND
      (nf + (nf < levels)::INT <= 50 OR place < 50) THEN value ELSE 'infrequent' END AS bucket FROM f)"""


@register("rare_bucket", f"""WITH {_RARE} SELECT "column", value, n, bucket FROM b""")
def rare_bucket(spark, d):
    counts = encode.category_counts(table(spark, d, "part"), ["p_name", "p_type", "p_size"])
    return encode.rare_buckets(encode.imputed_counts(counts))


@register("onehot", f"""WITH {_RARE}, x AS (SELECT bucket, row_number() OVER (ORDER BY bucket = 'infrequent', bucket) AS pos
    FROM (SELECT DISTINCT bucket FROM b WHERE "column" = 'p_name'))
  SELECT p_partkey, x.pos::INT AS position, 1.0::DOUBLE AS value FROM part
  JOIN b ON b."column" = 'p_name' AND b.value = p_name JOIN x USING (bucket)""")
def onehot(spark, d):
    """Nonzero positions of the one-hot vector of part names."""
    from pyspark.ml.functions import vector_to_array
    part = table(spark, d, "part")
    groups = {"numeric": [], "categorical": ["p_name"], "text": []}
    fitted = encode.fit_encoder(part, groups)
    rare = encode.rare_values(part, fitted, ["p_name"])
    out = encode.encode_columns(part, groups, fitted, rare, ["p_partkey"])
    return (out.select("p_partkey", F.posexplode(vector_to_array("cat_0")).alias("p", "value")).where("value > 0")
               .select("p_partkey", (F.col("p") + 1).alias("position"), "value"))


@register("tfidf", r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}') AS w FROM documents),
  t AS (SELECT doc_id, unnest(w) AS term FROM w UNION ALL
        SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w),
  tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
  n AS (SELECT count(*) AS n FROM documents),
  v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1
        HAVING count(*) >= 2 AND count(*) <= 0.98 * (SELECT n FROM n) ORDER BY total DESC, term LIMIT 3000),
  x AS (SELECT doc_id, term, tf * (ln((1 + (SELECT n FROM n)) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN v USING (term))
  SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM x""")
def tfidf(spark, d):
    return rounded(encode.tfidf(spread_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"))


# --- splits and class balance --------------------------------------------------------

_HASH = "('0x' || substr(md5(concat_ws('|', {}, '42')), 1, 15))::BIGINT"


@register("stratified_split", f"""WITH h AS (SELECT doc_id, quality, {_HASH.format('doc_id')} AS h FROM labels),
  r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h) AS rk, count(*) OVER (PARTITION BY quality) AS n FROM h)
  SELECT doc_id, quality, CASE WHEN rk <= greatest(1, floor(0.2 * n + 0.5)) THEN 'test' ELSE 'train' END AS part FROM r""")
def stratified_split(spark, d):
    return split.stratified_split(table(spark, d, "labels").drop("toxic"), "quality", ["doc_id"])


@register("cv_folds", f"""WITH h AS (SELECT doc_id, toxic, {_HASH.format('doc_id')} AS h FROM labels)
  SELECT doc_id, toxic, ((row_number() OVER (PARTITION BY toxic ORDER BY h) - 1) % 5)::INT AS fold FROM h""")
def cv_folds(spark, d):
    return split.stratified_folds(table(spark, d, "labels").drop("quality"), "toxic", ["doc_id"], 5)


@register("class_counts", "SELECT quality, count(*) AS count FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def class_counts(spark, d):
    return binary.class_counts(table(spark, d, "labels"), "quality")


@register("imbalance_weight", """SELECT count(*) FILTER (toxic = 0) AS n0, count(*) FILTER (toxic = 1) AS n1,
  round(CASE WHEN count(*) FILTER (toxic = 0) > 0 AND count(*) FILTER (toxic = 1) > 0
    AND count(*) FILTER (toxic = 0) / count(*) FILTER (toxic = 1)::DOUBLE >= 3
    THEN count(*) FILTER (toxic = 0) / count(*) FILTER (toxic = 1)::DOUBLE ELSE 1.0 END, 6) AS weight FROM labels""")
def imbalance_weight(spark, d):
    return rounded(binary.positive_weight(table(spark, d, "labels"), "toxic"))


# --- measures on a given score -------------------------------------------------------


def _scored(spark, d):
    li = table(spark, d, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"),
                     F.round(F.col("l_extendedprice") / 110000, 3).alias("s"))


_SCORED = "s AS (SELECT (l_returnflag = 'R')::INT AS y, round(l_extendedprice / 110000, 3) AS s FROM lineitem)"


@register("binary_metrics", f"""WITH {_SCORED},
  g AS (SELECT s, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY 1),
  c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(neg) OVER (ORDER BY s DESC) AS cn,
          sum(neg) OVER (ORDER BY s) AS up FROM g),
  t AS (SELECT sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n, sum(pos * (up - neg / 2.0::DOUBLE)) AS u,
          sum(pos * cp / (cp + cn)::DOUBLE) AS ap, sum(pos) FILTER (s >= 0.5)::DOUBLE AS tp,
          sum(neg) FILTER (s >= 0.5)::DOUBLE AS fp FROM c)
  SELECT round(u / (p * n), 6) AS auroc, round(ap / p, 6) AS pr_auc, round((tp + n - fp) / (p + n), 6) AS accuracy,
    round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall, round(2 * tp / (tp + fp + p), 6) AS f1 FROM t""")
def binary_metrics(spark, d):
    return rounded(binary.binary_metrics(_scored(spark, d), "y", "s"))


_THRESHOLDS = ", ".join(repr(t) for t in binary.THRESHOLDS)
_F1 = f"""{_SCORED}, th AS (SELECT unnest([{_THRESHOLDS}]::DOUBLE[]) AS t),
  f AS (SELECT t, sum((s >= t AND y = 1)::INT) AS tp, sum((s >= t AND y = 0)::INT) AS fp,
          sum((s < t AND y = 1)::INT) AS fn FROM s, th GROUP BY 1),
  q AS (SELECT t AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn,
          round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM f)"""


@register("threshold_table", f"WITH {_F1} SELECT * FROM q")
def threshold_table(spark, d):
    return rounded(binary.threshold_table(_scored(spark, d), "y", "s"), skip=("threshold",))


@register("best_threshold", f"WITH {_F1} SELECT threshold, f1 FROM q ORDER BY f1 DESC, threshold LIMIT 1")
def best_threshold(spark, d):
    return rounded(binary.best_threshold(_scored(spark, d), "y", "s"), skip=("threshold",))


@register("grouped_auroc", """WITH g AS (SELECT l_linenumber AS mode, l_extendedprice AS s, count(*) FILTER (l_returnflag = 'R') AS pos,
    count(*) FILTER (l_returnflag <> 'R') AS neg FROM lineitem GROUP BY ALL),
  c AS (SELECT *, sum(neg) OVER (PARTITION BY mode ORDER BY s) AS up FROM g)
  SELECT mode, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg,
    round(sum(pos * (up - neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auroc FROM c GROUP BY 1""")
def grouped_auroc(spark, d):
    """How well the price ranks returned lines, per line number."""
    li = table(spark, d, "lineitem").select(
        F.col("l_linenumber").alias("mode"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.col("l_extendedprice").alias("s"))
    return rounded(binary.grouped_auroc(li, "mode", "y", "s"))


# --- fitted models -------------------------------------------------------------------

_CFG = ClassifyConfig(n_estimators=15, max_depth=4)


def _order_table(spark, d):
    return dirty_orders(spark, d).drop("order_code").persist()


@register("clf_train_metrics")
def clf_train_metrics(spark, d):
    """Held-out measures of a classifier on the dirty order table."""
    run = classification.run_classification(_order_table(spark, d), "default", keys=["o_orderkey"], cfg=_CFG)
    return binary.binary_metrics(run.scored, classification.LABEL, classification.PROBA)


@register("clf_save_score")
def clf_save_score(spark, d):
    """Trained on the labelled documents, saved, loaded, applied to all documents."""
    docs = spread_table(spark, d, "documents")
    path = fresh_path(spark, "classifier")
    train = docs.join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")
    classification.run_classification(train, "toxic", keys=["doc_id"], cfg=_CFG, export_path=path)
    scored = classification.predict_classification_df(docs, path)
    return scored.select("doc_id", "proba", "pred")
