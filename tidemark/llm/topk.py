"""Exact top-k by inner product over whole-number vectors.

Method: multi-resolution segment statistics.  A vector is cut into segments; of each only the
mean m and the deviation s are kept.  For segments of length n

    |q - c|^2  >=  sum n * ((m_q - m_c)^2 + (s_q - s_c)^2)

and since |q|^2 = sum n * (m_q^2 + s_q^2), the inner product (|q|^2 + |c|^2 - |q - c|^2) / 2 is
at most sum n * (m_q m_c + s_q s_c): a product of short vectors.  Coarse statistics (few
segments) are tried first, finer ones on what they leave, and exact products on the survivors
only.  A pair is given up when its bound is below the k-th score its query has already.

Queries and candidates are dealt over a grid of cells of bounded size, whose columns are taken in rounds:
one, then ``GROWTH`` times as many as before.  A query enters a round with the k-th score it has, so
a cell returns only what may still belong to its k best, and k * GROWTH rows are to be expected
of a round whatever its number of cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import pick
from tidemark.session import cut_lineage

SEGMENTS = (4, 8, 16)
QUERY_BLOCK = 16_384
GROWTH = 7
_STEP, _ROWS = 1024, 2048
_LONG = (-(1 << 63), (1 << 63) - 1)


def statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """sqrt(n) * mean and sqrt(n) * deviation of every segment, side by side."""
    out = []
    for part in np.array_split(vectors, min(segments, vectors.shape[1]), axis=1):
        root = np.sqrt(part.shape[1])
        out += [root * part.mean(axis=1), root * part.std(axis=1)]
    return np.stack(out, 1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond the range of a long its ends."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return q @ c.T
    return np.clip(q.astype(object) @ c.T.astype(object), *_LONG).astype(np.int64)


def best(q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query place, id, score) of the k best candidates of each query: larger score, then smaller id.

    Scores below a query's ``floor`` are left out.
    """
    order = np.argsort(-np.einsum("ij,ij->i", c.astype(np.float64), c.astype(np.float64)), kind="stable")
    ids, c = ids[order], c[order]
    fine = q.shape[1] > 0
    stats = [(statistics(q.astype(np.float64), s), statistics(c.astype(np.float64), s)) for s in SEGMENTS] if fine else []
    found: list[tuple] = []
    for low in range(0, len(q), _ROWS):
        rows = np.arange(low, min(low + _ROWS, len(q)))
        # k-th score so far
        least = np.full(len(rows), -np.inf) if floor is None else floor[rows].astype(np.float64)
        pruned = floor is not None and np.isfinite(least).any()
        top = (np.zeros(0, np.int64),) * 3
        for at in range(0, len(c), _STEP):
            columns = np.arange(at, min(at + _STEP, len(c)))
            own = np.arange(len(rows))
            alive = None
            for sq, sc in stats if at or pruned else ():
                bound = sq[rows[own]] @ sc[columns].T
                bound += 1e-6 * np.abs(bound) + 1e-3
                alive = bound >= least[own][:, None]
                keep = alive.any(axis=1)
                own, alive = own[keep], alive[keep]
                keep = alive.any(axis=0)
                columns, alive = columns[keep], alive[:, keep]
                if not alive.size:
                    break
            if not len(own) or not len(columns):
                continue
            score = products(q[rows[own]], c[columns])
            good = score >= least[own][:, None]
            if alive is not None:
                good &= alive
            i, j = np.nonzero(good)
            top = tuple(np.concatenate(x) for x in zip(top, (own[i], ids[columns[j]], score[i, j])))
            sort = np.lexsort((top[1], ~top[2], top[0]))
            top = tuple(x[sort] for x in top)
            first = np.searchsorted(top[0], np.arange(len(rows)))
            place = np.arange(len(top[0])) - first[top[0]]
            last = place == k - 1
            least[top[0][last]] = np.maximum(least[top[0][last]], top[2][last])
            top = tuple(x[place < k] for x in top)
        found.append((top[0] + low, top[1], top[2]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _cell(k: int):
    """The k best candidates of each query of a cell; a query's own vector may be among them."""
    def run(table):
        vectors = table.column("v").combine_chunks()
        ids = table.column("vec_id").to_numpy()
        asks = table.column("asks").to_numpy()
        marks = table.column("mark").to_numpy()
        floors = table.column("floor").to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
        floors = np.where(np.isnan(floors), -np.inf, floors)
        floors -= 1e-9 * np.abs(np.where(np.isfinite(floors), floors, 0))  # long to double may round up
        lengths = np.diff(vectors.offsets.to_numpy())
        flat = vectors.flatten().to_numpy()
        ends = np.cumsum(lengths)
        out = [(np.zeros(0, np.int64),) * 5]
        for n in np.unique(lengths):
            which = np.flatnonzero(lengths == n)
            matrix = flat[(ends[which] - n)[:, None] + np.arange(n)]
            ask = asks[which]
            if ask.any() and not ask.all():
                mine, others = which[ask], which[~ask]
                # places stand for the ids, in their order: equal ids may have several vectors
                order = np.argsort(ids[others], kind="stable")
                others = others[order]
                place, at, score = best(matrix[ask], np.arange(len(others)), matrix[~ask][order], k, floors[mine])
                out.append((ids[mine][place], marks[mine][place], ids[others][at], marks[others][at], score))
        query, own, vec, mark, score = (np.concatenate(x) for x in zip(*out))
        return pa.table({"query_id": pa.array(query, pa.int64()), "own": pa.array(own, pa.int64()), "vec_id": pa.array(vec, pa.int64()),
                         "mark": pa.array(mark, pa.int64()), "score": pa.array(score, pa.int64())})

    return run


FOUND = "query_id bigint, own bigint, vec_id bigint, mark bigint, score bigint"


def whole_vectors(vectors: DataFrame, scale: float = 64.0, id_column: str = "vec_id",
                  vector_column: str = "embedding") -> DataFrame:
    """vec_id, v, mark, copies: floor(scale * x) of each component of the vectors that have finite components only.

    Equal rows are one with their number; ``mark`` is a hash that tells the vectors of one id apart.
    """
    rows = pick(vectors, vec_id=id_column, x=vector_column).select(
        F.col("vec_id").cast("bigint"), F.col("x").cast("array<double>"))
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.where("vec_id IS NOT NULL AND x IS NOT NULL").where(good)
                .select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("bigint")).alias("v"))
                .groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
                .withColumn("mark", F.xxhash64("v")))


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, id_column: str = "vec_id",
          vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query, ties to smaller ids.

    ``queries`` is a condition on ``vec_id``; candidates are all other rows of the same
    length.  Vectors that are null or hold a null, NaN or infinite component, and rows without
    id, take no part.  Every row counts, also several of one id: each is a candidate, of the queries of its
    own id too but not of itself, and each that is a query has its k rows.  Scores beyond a
    long are its ends.  A query without candidates has no rows.  Other columns are not read.
    """
    whole = cut_lineage(whole_vectors(vectors, scale, id_column, vector_column))
    total, asked = whole.agg(F.count(F.lit(1)), F.count_if(queries)).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    size = min(131_072, max(2048, -(-total // (2 * cores))))
    columns, rows = max(1, -(-total // size)), max(1, -(-asked // QUERY_BLOCK))
    slot = lambda n: F.pmod(F.xxhash64("vec_id", "mark"), F.lit(n)).cast("int")
    every = lambda low, high: F.explode(F.sequence(F.lit(low), F.lit(high - 1)))
    fields = ["i", "j", "asks", "vec_id", "mark", "floor", "v"]
    placed = whole.withColumn("j", slot(columns)).withColumns({"asks": F.lit(False), "floor": F.lit(None).cast("bigint")})
    asking = whole.where(queries).withColumns({"i": slot(rows), "asks": F.lit(True)})
    # own row: as many rows as it has copies, less one, are candidates; so a cell may return one row too many
    copies = whole.select("vec_id", "mark", "copies")
    rank = F.row_number().over(W.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id", "mark"))
    top, low, high = None, 0, 1
    while low < columns:
        high = min(high, columns)
        here = asking.withColumn("floor", F.lit(None).cast("bigint"))
        if top is not None:
            floors = (top.where(F.col("place") == k + 1).select(F.col("query_id").alias("vec_id"), F.col("own").alias("mark"),
                                                                F.col("score").alias("floor")))
            here = asking.join(floors, ["vec_id", "mark"], "left")
        cells = (placed.where(F.col("j").between(low, high - 1)).withColumn("i", every(0, rows)).select(*fields)
                 .unionByName(here.withColumn("j", every(low, high)).select(*fields))
                 .groupBy("i", "j").applyInArrow(_cell(k + 1), FOUND))
        found = cells if top is None else cells.unionByName(top.drop("place"))
        top = cut_lineage(found.withColumn("place", rank).where(F.col("place") <= k + 1))
        low, high = high, high + GROWTH * (high - low)
    return _expanded(top, copies, k)


def _expanded(top: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Found pairs of different rows as pairs of rows: equal rows apart, a row's own left out."""
    own = (F.col("query_id") == F.col("vec_id")) & (F.col("own") == F.col("mark"))
    many = top.join(copies, ["vec_id", "mark"]).withColumn("n", F.col("copies") - own.cast("bigint")).drop("copies")
    before = W.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id", "mark").rowsBetween(W.unboundedPreceding, -1)
    runs = many.where("n > 0").withColumn("done", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("done") < k)
    ranked = runs.select("query_id", "own", "vec_id", "score", F.explode(F.sequence(
        F.col("done") + 1, F.least(F.lit(k), F.col("done") + F.col("n")))).alias("rank"))
    asks = copies.select(F.col("vec_id").alias("query_id"), F.col("mark").alias("own"), "copies")
    return (ranked.join(asks, ["query_id", "own"])
                  .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score",
                          F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
                  .drop("copy"))
