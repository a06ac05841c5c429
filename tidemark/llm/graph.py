"""Connected components of an edge table, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node of ``edges`` (a, b) that has a link.

    Alternates two steps until nothing moves: every node ties its larger neighbours to its
    smallest one, then its smaller neighbours.  Edges only ever move to smaller nodes, so each
    component ends as one star; the number of rounds grows with the logarithm of its width.
    Each round is checkpointed.  Self-links and repeated edges are ignored.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut_lineage(now)
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = cut_lineage(small.where("u <> v").distinct())
        seen, mark = mark, _mark(now)
        if seen == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
