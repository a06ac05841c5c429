"""Building blocks that stay balanced when one key holds a large share of the rows.

* ``attach`` joins per-key facts onto rows, leaving skew to the adaptive planner.
* ``order_statistics`` / ``quantiles`` find exact ranks by narrowing a bracket, so no task
  ever holds all values of a column.
* ``hash_rank`` numbers rows in a hash order through equal-width hash buckets.
* ``running_totals`` is a cumulative sum over a sorted column without a one-task window.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def attach(df: DataFrame, facts: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``facts`` (one row per key) to every row of ``df``.

    The facts are few against the rows and nothing is copied: the adaptive planner broadcasts
    them when their measured size allows, and otherwise splits the partitions of a key that
    holds a large share of the rows, which an inner or left join permits.
    """
    return df.join(facts, keys, how)


# --- exact order statistics ----------------------------------------------------------


@dataclass
class Rank:
    """Ask for the values at ``ranks(n)`` (0-based, ascending) among non-null ``value``.

    ``share`` says about where they lie, as a fraction of n; the first pass brackets them there.
    """

    value: Column
    ranks: Callable[[int], list[int]]
    share: float = 0.5
    n: int = 0
    ask: list[int] = field(default_factory=list)
    wanted: list[int] = field(default_factory=list)
    lo: object = None
    hi: object = None
    cuts: list | None = None
    below: int = 0
    within: int = 0
    found: dict[int, object] = field(default_factory=dict)


_ACCURACY = 10_000
_KEEP = 20_000  # distinct values fetched to the driver at the end of the search


def order_statistics(df: DataFrame, asks: dict[str, Rank]) -> dict[str, list]:
    """Exact values at the asked ranks for several columns at once.

    Every pass is one aggregate over ``df``: a percentile sketch brackets the ranks and the
    next pass counts what lies below and inside, which shrinks the bracket a thousandfold
    per pass.  The search ends with a bracket of one value or of few enough rows to fetch.
    """
    names = list(asks)
    margin = 2.0 / _ACCURACY
    first = []
    for i, k in enumerate(names):
        near = [max(0.0, asks[k].share - margin), min(1.0, asks[k].share + margin)]
        first += [F.count(asks[k].value).alias(f"n{i}"), F.min(asks[k].value).alias(f"lo{i}"),
                  F.max(asks[k].value).alias(f"hi{i}"),
                  F.percentile_approx(asks[k].value, near, _ACCURACY).alias(f"q{i}")]
    row = df.agg(*first).first()
    for i, k in enumerate(names):
        a = asks[k]
        a.n = a.within = row[f"n{i}"]
        a.lo, a.hi = row[f"lo{i}"], row[f"hi{i}"]
        a.cuts = row[f"q{i}"]
        a.ask = [min(max(r, 0), a.n - 1) for r in a.ranks(a.n)] if a.n else []
        a.wanted = sorted(set(a.ask))

    pending = [a for a in asks.values() if a.wanted and a.lo != a.hi and a.within > _KEEP]
    if pending:
        _shrink(df, pending)
    while pending := [a for a in asks.values() if a.wanted and a.lo != a.hi and a.within > _KEEP]:
        _narrow(df, pending)

    small = [k for k in names if asks[k].wanted and asks[k].lo != asks[k].hi]
    for k in small:
        a = asks[k]
        inside = df.where(a.value.between(a.lo, a.hi)).groupBy(a.value.alias("v")).count()
        seen = a.below
        for v, c in sorted((r["v"], r["count"]) for r in inside.collect()):  # at most _KEEP rows
            a.found.update({w: v for w in a.wanted if seen <= w < seen + c})
            seen += c
    for a in asks.values():
        if a.lo == a.hi:
            a.found.update({w: a.lo for w in a.wanted})
    return {k: [a.found[r] for r in a.ask] for k, a in asks.items()}


def _narrow(df: DataFrame, asks: list[Rank]) -> None:
    """Shrink each bracket to what a sketch of its inside leaves possible."""
    sketches = []
    for i, a in enumerate(asks):
        inside = F.when(a.value.between(a.lo, a.hi), a.value)
        margin = 2.0 / _ACCURACY
        probs = [max(0.0, (a.wanted[0] - a.below) / a.within - margin),
                 min(1.0, (a.wanted[-1] - a.below + 1) / a.within + margin)]
        sketches.append(F.percentile_approx(inside, probs, _ACCURACY).alias(f"q{i}"))
    cuts = df.agg(*sketches).first()
    for i, a in enumerate(asks):
        a.cuts = cuts[f"q{i}"]
    _shrink(df, asks)


def _shrink(df: DataFrame, asks: list[Rank]) -> None:
    """Count around the sketched cuts; accept them, or step inside the ends of the bracket."""
    counts = []
    for i, a in enumerate(asks):
        lo, hi = a.cuts
        counts += [F.count_if((a.value >= a.lo) & (a.value < lo)).alias(f"b{i}"),
                   F.count_if(a.value.between(lo, hi)).alias(f"w{i}"),
                   F.count_if(a.value == a.lo).alias(f"l{i}"),
                   F.count_if(a.value == a.hi).alias(f"h{i}"),
                   F.min(F.when(a.value > a.lo, a.value)).alias(f"up{i}"),
                   F.max(F.when(a.value < a.hi, a.value)).alias(f"down{i}")]
    row = df.agg(*counts).first()
    for i, a in enumerate(asks):
        below, within = a.below + row[f"b{i}"], row[f"w{i}"]
        if within < a.within and below <= a.wanted[0] and a.wanted[-1] < below + within:
            a.below, a.within = below, within
            a.lo, a.hi = a.cuts
            continue
        # heavy ties sit at an end of the bracket: settle the ranks they cover, step inside
        at_lo, at_hi = a.below + row[f"l{i}"], a.below + a.within - row[f"h{i}"]
        a.found.update({w: a.lo for w in a.wanted if w < at_lo})
        a.found.update({w: a.hi for w in a.wanted if w >= at_hi})
        a.wanted = [w for w in a.wanted if at_lo <= w < at_hi]
        if a.wanted:
            a.below, a.within = at_lo, at_hi - at_lo
            a.lo, a.hi = row[f"up{i}"], row[f"down{i}"]


def quantile_ranks(p: float) -> Callable[[int], list[int]]:
    return lambda n: [int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1)] if n else []


def quantiles(df: DataFrame, columns: list[str], p: float) -> dict[str, float | None]:
    """Exact quantile with linear interpolation for each column; None when all null."""
    asks = {c: Rank(F.col(f"`{c}`").cast("double"), quantile_ranks(p), p) for c in columns}
    out = {}
    for c, pair in order_statistics(df, asks).items():
        if not pair:
            out[c] = None
            continue
        position = p * (asks[c].n - 1)
        out[c] = pair[0] + (pair[1] - pair[0]) * (position - int(position))
    return out


# --- hash order ----------------------------------------------------------------------

HASH_BITS = 60


def hash_key(columns: list[str], seed: int = 42) -> Column:
    """Whole number in [0, 2^60) from the md5 of the key columns and the seed."""
    text = F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def hash_rank(df: DataFrame, within: list[str], keys: list[str], seed: int = 42,
              name: str = "rank", buckets: int | None = None) -> DataFrame:
    """1-based rank of each row in hash order inside each ``within`` group.

    The hash is uniform, so equal-width buckets hold equal shares however large the group:
    counts per bucket give the offsets and each bucket is numbered on its own.
    ``keys`` should identify a row.
    """
    if buckets is None:
        buckets = max(256, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shift = HASH_BITS - (buckets - 1).bit_length()
    rows = (df.withColumn("__h", hash_key(keys, seed))
              .withColumn("__b", F.shiftright("__h", shift)))
    counts = rows.groupBy(*within, "__b").count()
    before = W.partitionBy(*within).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*within, "__b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o"))
    local = F.row_number().over(W.partitionBy(*within, "__b").orderBy("__h", *keys))
    return (rows.withColumn(name, local)
                .join(offsets, [*within, "__b"])
                .withColumn(name, F.col(name) + F.col("__o"))
                .drop("__h", "__b", "__o"))


# --- cumulative sums over a sorted column --------------------------------------------


def running_totals(df: DataFrame, order: str, sums: list[str], descending: bool = False,
                   buckets: int | None = None) -> DataFrame:
    """Adds ``cum_<c>`` for each column in ``sums``, inclusive, along distinct ``order``.

    ``df`` has one row per value of ``order`` (pre-aggregated).  Its range is cut at sketch
    quantiles into even buckets; bucket totals are prefix-summed (one row per bucket) and
    each bucket is summed on its own.
    """
    spark = df.sparkSession
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(order, probs, _ACCURACY)).first()[0] or []
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    cut = (Bucketizer(splits=splits, inputCol="__order", outputCol="__b")
           .transform(df.withColumn("__order", F.col(order).cast("double")))
           .drop("__order"))
    key = F.col("__b").desc() if descending else F.col("__b").asc()
    inner = F.col(order).desc() if descending else F.col(order).asc()
    totals = cut.groupBy("__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    # one row per bucket: a window over this handful needs no partitioning
    before = W.partitionBy(F.lit(0)).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("__b", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__s_{c}")
                                    for c in sums])
    local = W.partitionBy("__b").orderBy(inner).rowsBetween(W.unboundedPreceding, 0)
    return (cut.withColumns({f"cum_{c}": F.sum(c).over(local) for c in sums})
               .join(F.broadcast(starts), "__b")
               .withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"__s_{c}") for c in sums})
               .drop("__b", *[f"__s_{c}" for c in sums]))


def grouped_totals(df: DataFrame, within: str, order: str, sums: list[str], buckets: int | None = None) -> DataFrame:
    """Adds ``cum_<c>`` for each column in ``sums``, inclusive, along ascending ``order`` inside each group.

    ``df`` has one row per group and value of ``order`` (pre-aggregated, no nulls).  Each group's range is
    cut at sketch quantiles of its own, so a large group is summed in as many pieces as a small one
    has; groups x buckets rows hold the cuts and the totals.
    """
    buckets = buckets or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / buckets for i in range(1, buckets)]
    cuts = df.groupBy(within).agg(F.array_distinct(F.percentile_approx(order, probs, _ACCURACY)).alias("__cuts"))
    cut = attach(df, cuts, [within], "inner").withColumn(
        "__b", F.aggregate("__cuts", F.lit(0), lambda n, c: n + (F.col(order) > c).cast("int"))).drop("__cuts")
    totals = cut.groupBy(within, "__b").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    before = W.partitionBy(within).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(within, "__b", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__s_{c}")
                                            for c in sums])
    local = W.partitionBy(within, "__b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return (cut.withColumns({f"cum_{c}": F.sum(c).over(local) for c in sums})
               .join(starts, [within, "__b"])
               .withColumns({f"cum_{c}": F.col(f"cum_{c}") + F.col(f"__s_{c}") for c in sums})
               .drop("__b", *[f"__s_{c}" for c in sums]))
