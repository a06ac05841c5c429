"""Near-duplicate documents by word shingles.

Method: an LSH forest over MinHash signatures.  A document's set is its distinct word shingles.
Equal sets are one node from the start.  Each of ``TREES`` trees orders the nodes by ``DEPTH``
MinHash values of its own; nodes with the first ``LEAST_DEPTH`` values in common form a region.

1. In a tree's sorted order a node first meets its neighbour, the one with the longest common
   prefix.  Where neighbours tie a whole region together nothing more is done, however crowded
   it is.  In the others the nodes not yet tied meet down to the least depth.  Two nodes tie if their set
   sizes and ``SKETCH`` bytes of their signatures allow the threshold (the bound is 5.5
   standard deviations below it); ties are candidates only.
2. Nodes connected by ties are a cluster.  Each clustered node's text travels once, and all
   intersections inside a cluster are counted exactly, as a product of shingle incidence
   matrices.  Of the links found a spanning forest leaves the task.

So depth adapts to the region.  Two sets at the threshold of 0.8 share a region in no tree with
probability (1 - 0.8 ** 3) ** 20 = 6e-7.  Regions and clusters beyond ``CELL`` nodes (or ``CELL_SHINGLES``)
are dealt over cells of two blocks, so no task holds them whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ids_and_texts, spread
from tidemark.llm.graph import components
from tidemark.llm.words import SPACED, find_words, mix, parts, shingle_hashes, text_buffer
from tidemark.session import cut_lineage, fresh_path

TREES, DEPTH, LEAST_DEPTH = 20, 6, 3
SKETCH = 48
CELL = 2048  # nodes of a block
CELL_SHINGLES = 2_000_000
_MULTIPLIERS = np.random.default_rng(7).integers(0, 1 << 31, TREES * DEPTH, np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``size`` are one shingle."""
    data, bounds = text_buffer(column)
    _, _, words, edges = find_words(data, bounds, SPACED)
    codes = shingle_hashes(words, size)
    out = []
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        n = high - low
        if n >= size:
            out.append(np.unique(codes[low:high - size + 1]))
        else:
            out.append(shingle_hashes(words[low:high], n) if n else codes[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of TREES * DEPTH MinHash values per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(_MULTIPLIERS), len(sets)), np.uint32)
    at = 0
    while at < len(sets):  # about 100,000 shingles at a time stay in cache
        upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), 100_000)))
        codes = (np.concatenate(sets[at:upto]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[at:upto])[:-1]])
        for k, a in enumerate(_MULTIPLIERS):
            out[k, at:upto] = np.minimum.reduceat(codes * a, starts)
        at = upto
    return out.T.copy()


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in parts(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(first, last - first), size)
                full = [k for k, s in enumerate(sets) if len(s)]
                rows: list = [None] * len(sets)
                if full:
                    for k, sig in zip(full, signatures([sets[k] for k in full])):
                        rows[k] = sig.tobytes()
                place = [np.arange(1, len(s) + 1, dtype=np.uint64) for s in sets]
                with np.errstate(over="ignore"):
                    d1 = [int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets]
                    d2 = [int(mix(s ^ p).sum(dtype=np.uint64).view(np.int64)) for s, p in zip(sets, place)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(map(len, sets), pa.int64()),
                     pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(rows, pa.binary())],
                    ["id", "n", "d1", "d2", "sig"])

    return run


FOREST = "region bigint, deep binary, node bigint, n bigint, sketch binary"


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per node and tree: region, the deeper values as sortable bytes, node, set size, sketch."""
    for batch in batches:
        if not len(batch):
            continue
        node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(len(node), TREES * DEPTH)
        sig = values.reshape(len(node), TREES, DEPTH)
        region = mix(np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), sig.shape[:2]).copy())
        for k in range(LEAST_DEPTH):
            region = mix(region * np.uint64(31) + sig[:, :, k])
        deep = sig[:, :, LEAST_DEPTH:].astype(">u4")
        sketch = (values[:, np.linspace(0, TREES * DEPTH - 1, SKETCH).astype(int)] >> np.uint32(3)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(region.reshape(-1).view(np.int64)), _binary(deep.reshape(region.size, -1)),
             pa.array(np.repeat(node, TREES)), pa.array(np.repeat(n, TREES)), _binary(np.repeat(sketch, TREES, axis=0))],
            ["region", "deep", "node", "n", "sketch"])


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of equal width as binary values."""
    raw = np.ascontiguousarray(rows).tobytes()
    width = len(raw) // max(1, len(rows))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(raw)]).cast(pa.binary())


def _least_alike(percent: int) -> float:
    share = percent / 100
    return SKETCH * share - 5.5 * np.sqrt(SKETCH * share * (1 - share))


def _tie(n: np.ndarray, sketch: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    sizes = (100 * n[a] >= percent * n[b]) & (100 * n[b] >= percent * n[a])
    return sizes & ((sketch[a] == sketch[b]).sum(axis=1) >= _least_alike(percent))


def spanning(count: int, labels: np.ndarray, near) -> list[tuple[int, int]]:
    """Pairs that connect 0..count-1 as ``near`` does; equal ``labels`` are connected already.

    ``near(i, rest)`` says which of the places ``rest`` are next to place i.  Each place is
    asked once, about the places not reached yet.
    """
    found: list[tuple[int, int]] = []
    unseen = np.ones(count, bool)
    for root in range(count):
        if not unseen[root]:
            continue
        stack = np.flatnonzero(unseen & (labels == labels[root])).tolist()
        unseen[stack] = False
        while stack:
            k = stack.pop()
            rest = np.flatnonzero(unseen)
            if not len(rest):
                break
            for t in rest[near(k, rest)].tolist():
                if unseen[t]:
                    found.append((k, t))
                    more = np.flatnonzero(unseen & (labels == labels[t]))
                    unseen[more] = False
                    stack += more.tolist()
    return found


TIES = "a bigint, b bigint, region bigint, n bigint, sketch binary"


def _ties(percent: int):
    """Rows in order of region and depth: ties (a, b); of crowds not settled by neighbours the rows (a = node)."""
    def settle(region: int, node: np.ndarray, n: np.ndarray, sketch: np.ndarray, tied: np.ndarray):
        run = np.cumsum(~tied)
        a, b = np.flatnonzero(tied) - 1, np.flatnonzero(tied)
        pairs = [(node[a], node[b])]
        if run[-1] > run[0]:
            if len(node) > CELL:
                return pairs, (region, node, n, sketch)
            near = lambda k, rest: _tie(n, sketch, np.full(len(rest), k), rest, percent)
            more = spanning(len(node), run, near)
            if more:
                i, j = np.array(more).T
                pairs.append((node[i], node[j]))
        return pairs, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # parts of a region that goes on
        for batch in itertools.chain(batches, [None]):
            pairs, crowds = [], []
            if batch is not None and len(batch):
                region, node, n = (batch.column(k).to_numpy() for k in (0, 2, 3))
                sketch = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(len(node), SKETCH)
                edges = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
            else:
                region, edges = None, np.zeros(1, int)
            if held and (batch is None or region is None or region[0] != held[0][0]):
                if batch is None or region is not None:
                    joined = _joined(held, percent)
                    got, crowd = settle(*joined)
                    pairs += got
                    crowds += [crowd] if crowd else []
                    held = []
            if region is not None:
                first = np.arange(len(node) - 1)
                tied = np.zeros(len(node), bool)
                same = region[1:] == region[:-1]
                tied[1:][same] = _tie(n, sketch, first[same], first[same] + 1, percent)
                for k, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
                    part = (region[low], node[low:high], n[low:high], sketch[low:high], tied[low:high])
                    if high == len(node) or (k == 0 and held):
                        held.append(part)
                        if high < len(node):
                            got, crowd = settle(*_joined(held, percent))
                            held = []
                        else:
                            continue
                    elif high - low == 1:
                        continue
                    else:
                        got, crowd = settle(*part)
                    pairs += got
                    crowds += [crowd] if crowd else []
            a = np.concatenate([x for x, _ in pairs]) if pairs else np.zeros(0, np.int64)
            b = np.concatenate([y for _, y in pairs]) if pairs else np.zeros(0, np.int64)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())],
                    ["a", "b", "region", "n", "sketch"])
            for name, node_, n_, sketch_ in crowds:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node_), pa.nulls(len(node_), pa.int64()), pa.array(np.full(len(node_), name)), pa.array(n_),
                     _binary(sketch_)], ["a", "b", "region", "n", "sketch"])

    return run


def _joined(held: list[tuple], percent: int) -> tuple:
    node, n, sketch, tied = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4))
    starts = np.cumsum([len(h[1]) for h in held])[:-1]
    if len(starts):
        tied = tied.copy()
        tied[starts] = _tie(n, sketch, starts - 1, starts, percent)
    return held[0][0], node, n, sketch, tied


def _crowd_ties(percent: int):
    """Ties inside one cell of a crowded region."""
    def run(table):
        node, n, block = (table.column(c).to_numpy() for c in ("a", "n", "block"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(node), SKETCH)
        near = lambda k, rest: _tie(n, sketch, np.full(len(rest), k), rest, percent)
        pairs = np.array(spanning(len(node), np.arange(len(node)), near), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[pairs[:, 0]], pa.int64()), "b": pa.array(node[pairs[:, 1]], pa.int64())})

    return run


def cells(rows: DataFrame, key: str, node: str, blocks: Column) -> DataFrame:
    """Rows dealt over the cells (i, j) of ``blocks`` blocks of their key; every two rows meet in a cell."""
    dealt = (rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(node), F.col("blocks")))
                 .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def exact_links(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets: all intersections by incidence matrices."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) + 1 if len(column) else 0) + width, width))
    for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
        if high == low:
            continue
        rows, local = np.unique(owner[low:high], return_inverse=True)
        matrix = np.zeros((len(rows), width), np.float32)
        matrix[local, column[low:high] - k * width] = 1
        both[np.ix_(rows, rows)] += matrix @ matrix.T  # counts below 2 ** 24 are exact
    both = both.astype(np.int64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    found = spanning(len(sets), np.arange(len(sets)), lambda k, rest: linked[k, rest])
    return [(int(nodes[a]), int(nodes[b])) for a, b in found]


def _linked(size: int, percent: int):
    """Rows in order of cluster cell, with texts: the links of each cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []
        for batch in itertools.chain(batches, [None]):
            found: list[tuple[int, int]] = []
            rows = len(batch) if batch is not None else 0
            for first, last in parts(batch.column(4)) if rows else ():
                fresh = shingle_sets(batch.column(4).slice(first, last - first), size)
                names = zip(*(batch.column(k).slice(first, last - first).to_pylist() for k in range(4)))
                for (cluster, i, j, node), own in zip(names, fresh):
                    if (cluster, i, j) != key:
                        if len(nodes) > 1:
                            found += exact_links(np.array(nodes), sets, percent)
                        key, nodes, sets = (cluster, i, j), [], []
                    nodes.append(node)
                    sets.append(own)
            if batch is None and len(nodes) > 1:
                found += exact_links(np.array(nodes), sets, percent)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def find_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every input row.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id reachable.  Words are runs of anything but space, tab,
    LF, VT, FF and CR, with A-Z lower-cased.  A text of fewer words than ``shingle`` has one
    shingle, a null or wordless text none, and then no link.  Rows with the same id are one
    document for linking.  A row without id is linked with nothing: component_id is null and it
    is kept.  Ids are whole numbers; other columns are not read.
    """
    spark = docs.sparkSession
    rows = spread(ids_and_texts(docs, id_column, text_column, "bigint"))
    path = fresh_path(spark, "signatures")
    (rows.mapInArrow(_signed(shingle), "id bigint, n bigint, d1 bigint, d2 bigint, sig binary")
         .write.parquet(path))
    signed = spark.read.parquet(path)
    linkable = signed.where("id IS NOT NULL AND n > 0")

    # equal sets are one node, named by the smallest id
    nodes = linkable.groupBy("d1", "d2").agg(F.min("id").alias("node"))
    nodes = cut_lineage(nodes)
    members = linkable.select("id", "d1", "d2").join(nodes, ["d1", "d2"]).where("id <> node").select("id", "node")
    # an id under several nodes ties them
    several = (members.union(nodes.select(F.col("node").alias("id"), "node")).distinct()
                      .groupBy("id").agg(F.collect_set("node").alias("all"), F.count(F.lit(1)).alias("k")).where("k > 1"))
    tied = several.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b")

    own = (linkable.withColumnRenamed("id", "node").join(nodes, ["d1", "d2", "node"])
                   .dropDuplicates(["node", "d1", "d2"]).select("node", "n", "sig"))
    sketched = fresh_path(spark, "nodes")
    own.write.parquet(sketched)
    own = spark.read.parquet(sketched)
    forest = own.select("node", "n", "sig").mapInArrow(_tree_rows, FOREST)
    met = cut_lineage(forest.repartition("region").sortWithinPartitions("region", "deep", "node")
                            .mapInArrow(_ties(percent), TIES))
    crowd = met.where("region IS NOT NULL").drop("b")
    blocks = crowd.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("size"))
    crowd = cells(crowd.join(blocks, "region"), "region", "a", F.col("size"))
    ties = met.where("region IS NULL").select("a", "b").unionByName(
        crowd.groupBy("region", "i", "j").applyInArrow(_crowd_ties(percent), "a bigint, b bigint"))
    clusters = components(ties)

    sized = clusters.join(own.groupBy("node").agg(F.max("n").alias("n")), "node")
    blocks = sized.groupBy("label").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / CELL, F.sum("n") / CELL_SHINGLES)).alias("size"))
    dealt = cells(clusters.join(blocks, "label"), "label", "node", F.col("size")).select("label", "i", "j", "node")
    texts = rows.where("id IS NOT NULL").join(
        clusters.select(F.col("node").alias("id")), "id", "left_semi").withColumnRenamed("id", "node")
    links = (dealt.join(texts, "node").select("label", "i", "j", "node", "text")
                  .repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node")
                  .mapInArrow(_linked(shingle, percent), "a bigint, b bigint"))
    classes = components(links.unionByName(tied))
    named = (signed.select("id", "n", "d1", "d2")
                   .join(nodes.withColumn("some", F.lit(True)), ["d1", "d2"], "left")
                   .withColumn("node", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("node")))
                   .withColumn("node", F.coalesce("node", "id")))
    out = named.join(classes, "node", "left").withColumn("component_id", F.coalesce("label", "node"))
    return out.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``find_duplicates`` keeps, with all their columns.

    Of each group the rows with its smallest id stay, as many as there are; rows without id stay.
    Only ids that go are joined, so unique documents' ids are all that is compared.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    own = f"c{columns.index(id_column)}"
    gone = (find_duplicates(docs, shingle, percent, id_column, text_column).where(~F.col("kept"))
            .select(F.col(id_column).alias("gone")).distinct())
    return plain.join(gone, plain[own].cast("bigint") == gone["gone"], "left_anti").toDF(*columns)
