"""Isolation forest: 100 trees on bounded samples, scores on every row."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.keyed import HASH_BITS, Rank, hash_key, order_statistics, quantiles
from tidemark.session import cut_lineage

TREES, SAMPLE, SHARE = 100, 256, 0.01  # fixed values: forest size, rows per tree, contamination
_NODES = "tree int, node int, feature int, cut double, low int, high int, size int"


def path_length(n: float) -> float:
    """Mean depth of an unsuccessful search among ``n`` rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


@dataclass
class Forest:
    columns: list[str]
    nodes: pd.DataFrame  # at most TREES * 2 * SAMPLE rows
    sample: int


def draw_sample(df: DataFrame, columns: list[str], n: int, trees: int, per_tree: int, seed: int,
                key: list[str] | None) -> DataFrame:
    """(tree, x): rows in random order, dealt out ``per_tree`` at a time.

    A table smaller than the forest needs is passed over several times, in a new order each
    time.  At most ``trees * per_tree`` rows leave the table; the draw is written down so
    that a retried tree sees the same rows.
    """
    need = trees * per_tree
    passes = -(-need // n)
    x = F.array(*[F.col(f"`{c}`") for c in columns]).alias("x")
    order = hash_key(key, seed) / float(1 << HASH_BITS) if key else F.rand(seed)
    # about a fifth more than needed passes the filter, so the sort never sees the whole table;
    # hashes of a key with few values lie in few places, so the filter widens until enough rows pass
    enough = min(1.0, (1.2 * need + 1000) / n)
    drawn = df.select(x, order.alias("o"))
    while key and enough < 1.0 and drawn.where(F.col("o") <= enough).limit(need).count() < need:
        enough = min(1.0, 4 * enough)
    rows = drawn.where(F.col("o") <= enough).orderBy("o").limit(min(n, need))
    rows = rows.select("x", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("p"), "o")
    shuffled = rows.withColumn("o", F.xxhash64("o", "p", F.lit(seed)))
    # bounded by trees * per_tree plus one pass, whatever the table holds
    place = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("p", "o")) - 1
    dealt = shuffled.withColumn("tree", F.floor(place / per_tree).cast("int")).where(F.col("tree") < trees)
    return cut_lineage(dealt.select("tree", "x"))


def fit_forest(df: DataFrame, columns: list[str], trees: int = TREES, seed: int = 42,
               key: list[str] | None = None) -> Forest:
    n = df.count()
    per_tree = min(SAMPLE, n)
    depth = ceil(log2(max(per_tree, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf.tree.iloc[0])
        rng = np.random.default_rng(seed + tree)
        x = np.vstack(pdf.x)
        out, queue, following = [], [(0, np.arange(len(x)), 0)], 1
        while queue:
            node, rows, level = queue.pop()
            spread = np.flatnonzero(np.ptp(x[rows], axis=0) > 0) if len(rows) > 1 and level < depth else []
            if len(spread) == 0:
                out.append((tree, node, -1, 0.0, -1, -1, len(rows)))
                continue
            f = int(rng.choice(spread))
            lo, hi = x[rows, f].min(), x[rows, f].max()
            cut = float(rng.uniform(lo, hi))
            left = x[rows, f] <= cut
            if left.all():
                cut = float(np.nextafter(hi, lo))
                left = x[rows, f] <= cut
            out.append((tree, node, f, cut, following, following + 1, len(rows)))
            queue += [(following, rows[left], level + 1), (following + 1, rows[~left], level + 1)]
            following += 2
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "low", "high", "size"])

    sample = draw_sample(df, columns, n, trees, per_tree, seed, key)
    nodes = sample.groupBy("tree").applyInPandas(grow, _NODES).toPandas()
    return Forest(columns, nodes, per_tree)


def score(df: DataFrame, forest: Forest, name: str = "raw_score") -> DataFrame:
    """Adds -2^(-mean depth / c): near -1 for rows that are easy to isolate."""
    tables = []
    for _, t in forest.nodes.groupby("tree"):
        t = t.sort_values("node")
        tables.append((t.feature.to_numpy(), t.cut.to_numpy(), t.low.to_numpy(), t.high.to_numpy(),
                       np.array([path_length(s) for s in t["size"]])))
    shared = df.sparkSession.sparkContext.broadcast(tables)
    scale = path_length(forest.sample) or 1.0

    @F.pandas_udf("double")
    def depth_score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        rows = np.arange(len(x))
        total = np.zeros(len(x))
        for feature, cut, low, high, rest in shared.value:
            at, deep = np.zeros(len(x), dtype=int), np.zeros(len(x))
            live = rows[feature[at] >= 0]
            while len(live):
                here = at[live]
                down = x[live, feature[here]] <= cut[here]
                at[live] = np.where(down, low[here], high[here])
                deep[live] += 1
                live = live[feature[at[live]] >= 0]
            total += deep + rest[at]
        return pd.Series(-np.power(2.0, -(total / len(shared.value)) / scale))

    return df.withColumn(name, depth_score(*[F.col(f"`{c}`").cast("double") for c in forest.columns]))


def decision(scored: DataFrame, raw: str = "raw_score", share: float = SHARE,
             offset: float | None = None) -> tuple[DataFrame, float]:
    """Score minus its ``share`` quantile: negative rows are anomalies."""
    if offset is None:
        offset = quantiles(scored, [raw], share)[raw]
    out = scored.withColumn("decision", F.col(raw) - F.lit(offset))
    return out.withColumn("anomaly", (F.col("decision") < 0).cast("int")), offset


def low_order_value(df: DataFrame, column: str, share: float = SHARE) -> float:
    """The value at position int(share * n) of the sorted column."""
    return order_statistics(df, {"v": Rank(F.col(column), lambda n: [int(share * n)], share)})["v"][0]
