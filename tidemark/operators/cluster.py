"""Numeric tables: complete cases, scaling, silhouettes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import numeric_columns


def numeric_complete(df: DataFrame, keep: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """Numeric columns, rows without nulls or NaN."""
    columns = numeric_columns(df, list(keep))
    slim = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return (slim.dropna(subset=columns) if columns else slim), columns


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column is divided by 1."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns])
    row = stats.first()
    return df.withColumns({c: (F.col(c) - F.lit(row[c]["m"])) / F.lit(row[c]["s"] or 1.0) for c in columns})


PIECE_BYTES = 1 << 22  # fixed value: points that travel together
RIGHT_BYTES = 1 << 27  # fixed value: points that one task goes over for each of its own


def silhouette_points(df: DataFrame, key: str, label: str, columns: list[str], block: int = 2048) -> DataFrame:
    """(key, label, a, b, s) with Euclidean distances between all points.

    The measure is quadratic by definition.  Points are packed into pieces, and a task takes some of
    them through a large part of all by a cartesian product of the two: nothing is shuffled for it but each
    point's sums of distances per cluster, once per part.  NumPy adds them up in tiles of ``block``
    by ``block`` points, so point pairs are never rows and no task holds more than two pieces and its part.
    A point without a label belongs to no cluster.  For tables beyond what n^2 allows use ``squared_silhouette``.
    """
    points = df.select(F.col(key).alias("id"), F.col(label).alias("label"),
                       F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    sizes = {r["label"]: r["count"] for r in points.groupBy("label").count().collect()}
    labels = sorted(v for v in sizes if v is not None)
    width = len(columns)
    most = max(1, PIECE_BYTES // (8 * max(1, width)))

    def packed(batches):
        held = []

        def piece() -> pa.RecordBatch:
            ids, names = (pa.concat_arrays([h.column(i) for h in held]) for i in (0, 1))
            x = np.concatenate([h.column(2).flatten().to_numpy(zero_copy_only=False) for h in held])
            whole = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            return pa.RecordBatch.from_arrays([whole(ids), whole(names), pa.array([x.astype(float).tobytes()], pa.binary())],
                                              ["ids", "labels", "x"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, most - sum(h.num_rows for h in held))
                held, batch = [*held, part], batch.slice(part.num_rows)
                if sum(h.num_rows for h in held) == most:
                    yield piece()
                    held = []
        if held:
            yield piece()

    def distances(batches):
        done = sums = None  # the piece at hand, by its ids, labels and numbers
        for batch in batches:
            for i in range(batch.num_rows):
                mine, theirs = ([batch.column(c)[i] for c in at] for at in ((0, 1, 2), (3, 4, 5)))
                x, y = (np.frombuffer(p[2].as_buffer()).reshape(-1, width) for p in (mine, theirs))
                if done is None or not (done[2] == mine[2] and done[0] == mine[0]):
                    if done is not None:
                        yield _summed(done, sums)
                    done, sums = mine, np.zeros((len(x), len(labels)))
                code = pc.index_in(theirs[1].values, value_set=pa.array(labels, theirs[1].values.type))
                code = code.fill_null(-1).to_numpy(zero_copy_only=False)
                member = (code[:, None] == np.arange(len(labels))[None, :]).astype(float)
                add_distances(sums, x, y, member, *_codes(mine[0].values, theirs[0].values), block)
        if done is not None:
            yield _summed(done, sums)

    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    pieces = points.mapInArrow(packed, f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, x binary").persist()
    parts = max(1, -(-8 * width * sum(sizes.values()) // RIGHT_BYTES))
    right = pieces.select(*[F.col(c).alias(f"r_{c}") for c in pieces.columns]).coalesce(parts)
    tasks = min(pieces.count(), df.sparkSession.sparkContext.defaultParallelism)
    left = pieces.repartition(tasks) if pieces.rdd.getNumPartitions() < tasks else pieces  # few came, and heavy ones
    partial = left.crossJoin(right).mapInArrow(
        distances, f"id {kinds['id']}, label {kinds['label']}, sums array<double>")
    totals = partial.groupBy("id", "label").agg(*[F.sum(F.col("sums")[c]).alias(f"c{c}") for c in range(len(labels))],
                                                F.count(F.lit(1)).alias("n"))  # never without an aggregate
    none = F.lit(None).cast("double")
    own = F.coalesce(none, *[F.when(F.col("label") == v, F.col(f"c{c}") / max(1, sizes[v] - 1))
                             for c, v in enumerate(labels)])
    alone = F.col("label").isNull() | F.col("label").isin([v for v in labels if sizes[v] == 1])
    nearest = F.array_min(F.array(none, *[F.when(F.col("label") != v, F.col(f"c{c}") / sizes[v])
                                          for c, v in enumerate(labels)]))
    ab = totals.select(F.col("id").alias(key), F.col("label").alias(label), own.alias("a"), nearest.alias("b"),
                       alone.alias("alone"))
    s = F.when(F.col("alone"), 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.select(key, label, "a", "b", s.alias("s"))


def add_distances(sums: np.ndarray, x: np.ndarray, y: np.ndarray, member: np.ndarray, x_ids: np.ndarray,
                  y_ids: np.ndarray, block: int) -> None:
    """Adds to ``sums`` the distances from each x to the y of each cluster; equal ids are 0 apart."""
    xx, yy, twice = (x * x).sum(1), (y * y).sum(1), -2.0 * y.T
    shared = np.isin(x_ids, y_ids)
    for i in range(0, len(x), block):
        rows = slice(i, i + block)
        for j in range(0, len(y), block):
            others = slice(j, j + block)
            dist = x[rows] @ twice[:, others]
            dist += xx[rows, None]
            dist += yy[others]
            np.sqrt(np.maximum(dist, 0.0, out=dist), out=dist)
            if shared[rows].any():
                dist[x_ids[rows, None] == y_ids[others]] = 0.0
            sums[rows] += dist @ member[others]


def _codes(x_ids: pa.Array, y_ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where ids are; a null equals nothing."""
    code = pa.concat_arrays([x_ids, y_ids]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).copy()
    x, y = code[:len(x_ids)], code[len(x_ids):]
    y[y < 0] = -2
    return x, y


def _summed(piece: list, sums: np.ndarray) -> pa.RecordBatch:
    width = sums.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * width, pa.int32()), pa.array(sums.ravel()))
    return pa.RecordBatch.from_arrays([piece[0].values, piece[1].values, lists], ["id", "label", "sums"])


def silhouette(df: DataFrame, key: str, label: str, columns: list[str], block: int = 2048) -> DataFrame:
    """One row: mean Euclidean silhouette."""
    return silhouette_points(df, key, label, columns, block).agg(F.avg("s").alias("silhouette"))


def squared_silhouette(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """One row: mean silhouette under squared Euclidean distance, linear in the rows.

    The summed squared distance from x to a cluster is n|x|^2 + sum|y|^2 - 2 x . sum(y), so
    per-cluster sums (one row per cluster) are all that is needed.
    """
    sums = df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), sum_of_squares(columns).alias("q"),
        *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)]).orderBy(label).collect()
    names = [r[label] for r in sums]
    size = np.array([r["n"] for r in sums], dtype=float)
    square = np.array([r["q"] for r in sums], dtype=float)
    total = np.array([[r[f"s{i}"] for i in range(len(columns))] for r in sums], dtype=float)

    @F.pandas_udf("double")
    def point(own: pd.Series, *values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(dtype=float) for v in values])
        far = np.maximum(size * (x * x).sum(1)[:, None] + square - 2.0 * x @ total.T, 0.0)
        mine = own.to_numpy()[:, None] == np.asarray(names)[None, :]
        a = (far / np.maximum(size - 1, 1))[mine]
        b = np.where(mine, np.inf, far / size).min(1)
        top = np.maximum(a, b)
        s = np.where((top > 0) & np.isfinite(b), (b - a) / np.where(top > 0, top, 1.0), 0.0)
        return pd.Series(np.where((mine * size).sum(1) == 1, 0.0, s))

    scored = df.select(point(F.col(label), *[F.col(c).cast("double") for c in columns]).alias("s"))
    return scored.agg(F.avg("s").alias("silhouette_squared"))


def sum_of_squares(columns: list[str]):
    return F.sum(sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0)))
