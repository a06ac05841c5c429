"""Read-only SQL over one table, known to the query as ``t``."""

from __future__ import annotations

import threading

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

DEFAULT_LIMIT, MAX_LIMIT = 500, 5000  # fixed values of the result cap
VIEW = "t"

# Functions that leave the engine, refused by name.
_OUTSIDE = {"java_method", "reflect", "try_reflect"}
_TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline",
                    "inline_outer", "stack"}


class QueryRefused(ValueError):
    pass


def _seq(scala_seq) -> list:
    return [scala_seq.apply(i) for i in range(scala_seq.size())]


def _is(node, kind: str) -> bool:
    gateway = SparkContext._active_spark_context._gateway
    return is_instance_of(gateway, node, f"org.apache.spark.sql.catalyst.{kind}")


def _visit(node, seen: dict[str, set], scope: frozenset[str]) -> None:
    """Collect node, relation and function names from what Spark parsed.

    ``scope`` has the names of the common table expressions in reach; a relation under such a
    name is none of the session's.
    """
    name = node.getClass().getSimpleName()
    seen["nodes"].add(name)
    if name == "UnresolvedRelation":
        relation = ".".join(_seq(node.multipartIdentifier())).lower()
        if relation not in scope:
            seen["relations"].add(relation)
    elif name in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
        parts = _seq(node.nameParts() if name == "UnresolvedFunction" else node.name())
        seen["functions" if name == "UnresolvedFunction" else "table_functions"].add(parts[-1].lower())
    elif name == "UnresolvedWith":
        for relation in _seq(node.cteRelations()):
            _visit(relation._2(), seen, scope)
            scope = scope | {relation._1().lower()}
    if _is(node, "plans.QueryPlan"):
        for e in _seq(node.expressions()):
            _visit(e, seen, scope)
    elif _is(node, "expressions.PlanExpression"):
        _visit(node.plan(), seen, scope)
    for child in _seq(node.children()):
        _visit(child, seen, scope)


def check_select(spark: SparkSession, sql: str) -> str:
    """The trimmed text if it is one query over ``t`` alone; QueryRefused otherwise.

    The check reads the tree Spark's parser returns, before anything is run, so words inside
    literals do not matter and commands never start.  Names that are only known once an
    expression is evaluated are refused.
    """
    text = sql.strip().rstrip(";").strip()
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    seen = {k: set() for k in ("nodes", "relations", "functions", "table_functions")}
    first = text.lstrip("( \n\t").lower()
    if not first.startswith(("select", "with")):
        raise QueryRefused("only SELECT is allowed")
    _visit(plan, seen, frozenset())
    writes = {n for n in seen["nodes"] if n.startswith(("Insert", "Create", "Drop", "Update", "Delete",
                                                       "Merge", "Alter", "Truncate", "Replace"))
              or n.endswith("Command")}
    if writes:
        raise QueryRefused("read-only SELECT only")
    if any(n.endswith("UnresolvedIdentifier") for n in seen["nodes"]):
        raise QueryRefused("names must be written out")
    if strange := seen["relations"] - {VIEW}:
        raise QueryRefused(f"unknown relation {sorted(strange)}: the table is called t")
    if banned := (seen["functions"] & _OUTSIDE) | (seen["table_functions"] - _TABLE_FUNCTIONS):
        raise QueryRefused(f"function not allowed: {sorted(banned)}")
    return text


def _sources(df: DataFrame) -> list:
    """What the analyzed plan reads, subqueries included."""
    plan = df._jdf.queryExecution().analyzed()
    found = _seq(plan.collectLeaves())
    for inner in _seq(plan.subqueriesAll()):
        found += _seq(inner.collectLeaves())
    return found


# Sources that hold no table: a SELECT without FROM, range(), VALUES, a reference to a common table expression.
_TABLELESS = {"OneRowRelation", "Range", "LocalRelation", "CTERelationRef", "UnionLoopRef"}
_NAMING = threading.Lock()


def select(df: DataFrame, sql: str) -> DataFrame:
    """The whole result of a checked query over ``df``.

    The name ``t`` holds only while the query is analyzed, one query at a time, and what the
    analyzed plan reads is compared with what ``df`` reads.
    """
    spark = df.sparkSession
    text = check_select(spark, sql)
    with _NAMING:
        before = spark.table(VIEW) if spark.catalog.tableExists(VIEW) else None
        df.createOrReplaceTempView(VIEW)
        try:
            result = spark.sql(text)
        finally:
            spark.catalog.dropTempView(VIEW)
            if before is not None and not spark.catalog.tableExists(VIEW):
                before.createOrReplaceTempView(VIEW)
    own = _sources(df)
    for leaf in _sources(result):
        if leaf.getClass().getSimpleName() not in _TABLELESS and not any(leaf.sameResult(x) for x in own):
            raise QueryRefused("the query reads something else than t")
    return result


def capped(df: DataFrame, sql: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    return select(df, sql).limit(_checked(limit))


def sql_select(df: DataFrame, sql: str, limit: int | None = None) -> dict:
    """At most ``limit`` rows as records, whether more were there, and how many came back."""
    limit = _checked(DEFAULT_LIMIT if limit is None else limit)
    rows = [r.asDict(recursive=True) for r in select(df, sql).limit(limit + 1).collect()]
    return {"rows": rows[:limit], "truncated": len(rows) > limit, "rowcount": min(len(rows), limit)}


def _checked(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must lie in [1, {MAX_LIMIT}]")
    return limit
