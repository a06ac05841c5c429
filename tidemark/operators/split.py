"""Hold-outs: the tail of each series, and stratified rows of a labelled table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.keyed import Rank, attach, hash_key, hash_rank, order_statistics
from tidemark.operators.series import ITEM, TS, by_item

SHORT = ("drop", "val", "train")


def tail_split(df: DataFrame, n: int, short_series: str = "drop") -> DataFrame:
    """Adds ``part``: ``val`` for the last ``n`` rows of an item, ``train`` for the rest.

    Times are unique per item.  ``short_series`` says what happens to items with at most
    ``n`` rows.  The last rows come from a row-number limit, which Spark applies before the
    shuffle, so a long item never gathers in one task; the cut time is then joined back.
    """
    if short_series not in SHORT:
        raise ValueError(f"short_series must be one of {SHORT}")
    latest = W.partitionBy(ITEM).orderBy(F.desc(TS))
    tail = (df.select(ITEM, TS).withColumn("__rn", F.row_number().over(latest)).where(F.col("__rn") <= n + 1))
    cuts = tail.groupBy(ITEM).agg(F.count(F.lit(1)).alias("__seen"),
                                  F.min(F.when(F.col("__rn") <= n, F.col(TS))).alias("__cut"))
    rows = attach(df, cuts, [ITEM], "inner")
    is_short = F.col("__seen") <= n
    part = F.when(F.col(TS) >= F.col("__cut"), F.lit("val")).otherwise(F.lit("train"))
    if short_series == "drop":
        rows = rows.where(~is_short)
    elif short_series == "train":
        part = F.when(is_short, F.lit("train")).otherwise(part)
    return rows.withColumn("part", part).drop("__seen", "__cut")


def require_both_parts(split: DataFrame) -> DataFrame:
    found = {r["part"] for r in split.select("part").distinct().collect()}
    if found != {"train", "val"}:
        raise ValueError("one side of the split is empty: lower the hold-out or add history")
    return split


def split_meta(split: DataFrame) -> DataFrame:
    """One row: series, rows and time range of each part, mean training length per series."""
    train, val = F.col("part") == "train", F.col("part") == "val"
    per_item = split.groupBy(ITEM).agg(
        F.count_if(train).alias("nt"), F.count_if(val).alias("nv"),
        *[f(F.when(p, F.col(TS))).alias(a) for p, f, a in (
            (train, F.min, "t0"), (train, F.max, "t1"), (val, F.min, "v0"), (val, F.max, "v1"))])
    return per_item.agg(
        F.count(F.lit(1)).alias("n_series"),
        F.sum("nt").alias("n_train_rows"), F.sum("nv").alias("n_val_rows"),
        F.min("t0").alias("train_start"), F.max("t1").alias("train_end"),
        F.min("v0").alias("val_start"), F.max("v1").alias("val_end"),
        F.avg(F.when(F.col("nt") > 0, F.col("nt"))).alias("mean_train_length"))


def stratified_split(df: DataFrame, label: str, keys: list[str], test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``part`` (``train``/``test``) with the same share of each class in the test part.

    A row goes to test when its key hash is among the smallest ``round(share * n)`` of its
    class, at least one.  The cut hash per class is found by exact selection, so rows are
    not shuffled at all.  Rows that share the cut hash (copies of one row, or one key) are
    parted by a second hash over their place in the table, in the share that is still missing; only
    then is the number met on average and not to the row.  The test part has two rows at least.
    """
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect() if r[label] is not None}
    if len(sizes) < 2:
        return df.withColumn("part", F.lit("train"))
    share = max(test_share, 2.0 / sum(sizes.values()))
    hashed = df.select(F.col(label).alias("label"), hash_key(keys, seed).alias("key")).persist()  # read several times
    asks = {}
    for value, n in sizes.items():
        k = max(1, int(share * n + 0.5))
        asks[value] = Rank(F.when(F.col("label") == value, F.col("key")), lambda _, k=k: [k - 1], k / n)
    cuts = order_statistics(hashed, asks)
    below = hashed.agg(*[f for i, (value, (cut,)) in enumerate(cuts.items()) for f in (
        F.count_if((F.col("label") == value) & (F.col("key") < cut)).alias(f"b{i}"),
        F.count_if((F.col("label") == value) & (F.col("key") == cut)).alias(f"e{i}"))]).first()
    hashed.unpersist()
    key = hash_key(keys, seed)
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    in_test = F.lit(False)
    for i, (value, (cut,)) in enumerate(cuts.items()):
        wanted = max(1, int(share * sizes[value] + 0.5)) - below[f"b{i}"]
        ties = F.lit(True) if wanted >= below[f"e{i}"] else place < wanted / below[f"e{i}"]
        in_test = in_test | ((F.col(label) == value) & ((key < cut) | ((key == cut) & ties)))
    return df.withColumn("part", F.when(in_test, F.lit("test")).otherwise(F.lit("train")))


def stratified_folds(df: DataFrame, label: str, keys: list[str], k: int, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in [0, k): rows of each class dealt out in hash order."""
    ranked = hash_rank(df, [label], keys, seed, name="__rank")
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__rank")
