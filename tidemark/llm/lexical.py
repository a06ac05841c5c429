"""Ranked lexical search of many items over all documents, exact, by a dual tree.

Method: documents and items are vectors over terms: a document's coordinates are saturated term
frequencies, an item's are term weights times repeats, and a score is their inner product.  Both
sides are put into trees whose nodes hold the coordinate maxima of what is below them, so the
product of two nodes bounds every score between their documents and items.  A pair of nodes whose
bound stays below the weakest kth score of its items is dropped as a whole; the others are opened on
both sides until documents meet items and scores are exact.

One scan reads the texts: per document its length and the frequencies of terms that any item has,
written to the shared folder.  Items are taken in blocks of bounded size; for each block every task
builds trees over its own documents, a few thousand at a time, and returns at most k rows per item.
The kth scores among a bounded sample of documents come first, so that pruning starts at once; they
are scores of real documents, so no result depends on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import in_bitmap, key_bitmap, pick, spread
from tidemark.llm.words import find_words, parts, text_buffer, word_bytes
from tidemark.session import cut_lineage, discard, fresh_path

# fixed byte class: ASCII letters, digits and everything beyond ASCII
TERM = word_bytes((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
BLOCK_POSTINGS = 300_000  # item postings that are broadcast at once
DOCS_AT_ONCE, POSTINGS_AT_ONCE = 4096, 1_000_000  # documents of one tree, and their postings
LEAF, FAN = 16, 8
SEED_DOCS = 4000  # about so many documents give the first bounds
_EXACT = 1 << 53  # below this, sums of whole numbers in doubles are exact


def term_lists(column: pa.Array, keep=None) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Per text: number of terms, its distinct term hashes, their counts; ``keep`` filters hashes."""
    data, bounds = text_buffer(column)
    _, _, codes, edges = find_words(data, bounds, TERM)
    places = np.flatnonzero(keep(codes)) if keep is not None else np.arange(len(codes))
    codes, text = codes[places].view(np.int64), np.searchsorted(edges, places, "right") - 1
    order = np.lexsort((codes, text))
    codes, text = codes[order], text[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(codes)))
    offsets = pa.array(np.searchsorted(text[first], np.arange(len(column) + 1)).astype(np.int32))
    return (np.diff(edges), pa.ListArray.from_arrays(offsets, pa.array(codes[first])),
            pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int64))))


def _read_terms(docs: DataFrame, bitmap: Broadcast | None = None) -> DataFrame:
    """id, n, terms, counts of every row of (id, text) that has a term."""
    kind = docs.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if bitmap is None else lambda codes: in_bitmap(bitmap.value, codes)
        for batch in batches:
            for first, last in parts(batch.column(1)):
                n, terms, counts = term_lists(batch.column(1).slice(first, last - first), keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array(n), terms, counts], ["id", "n", "terms", "counts"])

    return docs.mapInArrow(read, f"id {kind}, n bigint, terms array<bigint>, counts array<bigint>").where("n > 0")


# --- trees over sparse vectors ---------------------------------------------------------


@dataclass
class Level:
    """Sparse vectors of the nodes of one level: node i has entries first[i]:first[i + 1]."""

    first: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def entries(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the entries of ``nodes``, and where each node's begin."""
        low, many = self.first[nodes], self.first[nodes + 1] - self.first[nodes]
        starts = np.cumsum(many) - many
        return np.repeat(low - starts, many) + np.arange(many.sum()), starts


def level_of(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, count: int) -> Level:
    """Vectors from entries; several of one row and term become their maximum."""
    order = np.lexsort((terms, rows))
    rows, terms, values = rows[order], terms[order], values[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])
    at = np.flatnonzero(fresh)
    best = np.maximum.reduceat(values, at) if len(at) else values
    return Level(np.searchsorted(rows[at], np.arange(count + 1)), terms[at], best)


def tree(leaves: Level, *fans: int) -> list[Level]:
    """Levels from the leaves up to one root: node i of a level holds fan nodes of the one below.

    The first fans are given, the last of them is used from there on.
    """
    levels, fans = [leaves], list(fans)
    while len(levels[-1]) > 1:
        below, fan = levels[-1], fans.pop(0) if len(fans) > 1 else fans[0]
        rows = np.repeat(np.arange(len(below)), np.diff(below.first)) // fan
        levels.append(level_of(rows, below.terms, below.values, -(-len(below) // fan)))
    return levels


def by_strongest(rows: np.ndarray, terms: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """An order of the rows in which those with the same strongest terms are neighbours."""
    order = np.lexsort((terms, -values, rows))
    rows, terms = rows[order], terms[order]
    first = np.searchsorted(rows, np.arange(count))
    many = np.searchsorted(rows, np.arange(count), "right") - first
    keys = [np.where(many > k, terms[np.minimum(first + k, len(terms) - 1)], -1) for k in range(3)]
    return np.lexsort(keys[::-1])


@dataclass
class Items:
    """One block of items: their keys, the tree over them, known kth scores, and the weight of each term."""

    keys: np.ndarray
    levels: list[Level]
    terms: np.ndarray     # hashes, sorted; vectors name terms by their place here
    weights: np.ndarray
    least: np.ndarray     # a document must reach this score
    exact: bool           # doubles hold all sums exactly


def item_block(keys: np.ndarray, terms: np.ndarray, repeats: np.ndarray, weights: np.ndarray) -> Items:
    names, term = np.unique(terms, return_inverse=True)
    own = np.zeros(len(names), np.int64)
    own[term] = weights
    ids, row = np.unique(keys, return_inverse=True)
    values = repeats * weights
    order = by_strongest(row, term, values, len(ids))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    most = int(np.bincount(row, values.astype(float), len(ids)).max(initial=0)) * 1_000_000
    leaves = level_of(place[row], term, values, len(ids))
    return Items(ids[order], tree(leaves, FAN), names, own, np.ones(len(ids), np.int64), most < _EXACT)


@dataclass
class Best:
    """The k best rows of each item so far, by falling score and rising id, nulls last."""

    scores: np.ndarray
    ids: np.ndarray
    nulls: np.ndarray

    @staticmethod
    def empty(items: int, k: int) -> "Best":
        return Best(np.zeros((items, k), np.int64), np.zeros((items, k), np.int64), np.zeros((items, k), bool))

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """``scores`` has a row per item of ``rows`` and a column per document."""
        k = self.scores.shape[1]
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.broadcast_to(ids, scores.shape)], axis=1)
        all_nulls = np.concatenate([self.nulls[rows], np.broadcast_to(nulls, scores.shape)], axis=1)
        order = np.lexsort((all_ids, all_nulls, -all_scores), axis=-1)[:, :k]
        self.scores[rows] = np.take_along_axis(all_scores, order, 1)
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)
        self.nulls[rows] = np.take_along_axis(all_nulls, order, 1)


class Search:
    """Walks the trees of documents, a part at a time, against the tree of one block of items."""

    def __init__(self, items: Items, k: int):
        self.items, self.best = items, Best.empty(len(items.keys), k)
        kind = np.float64 if items.exact else np.int64
        self.levels = [Level(v.first, v.terms, v.values.astype(kind)) for v in items.levels]
        self.sums = np.zeros((len(items.terms), LEAF), kind)  # a node's vectors, spread over all terms
        self.met = 0

    def need(self) -> np.ndarray:
        """The score an item's next document must reach."""
        return np.maximum(self.items.least, self.best.scores[:, -1])

    def node_need(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The weakest of a node's items."""
        need, width = self.need(), FAN ** level
        if width == 1:
            return need[nodes]
        return np.minimum.reduceat(need, np.arange(0, len(need), width))[nodes]

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return below[below < len(self.levels[level - 1])]

    def products(self, level: int, nodes: np.ndarray, width: int) -> np.ndarray:
        """Products of item nodes with the vectors spread in ``sums``: nodes x width."""
        own = self.levels[level]
        entries, starts = own.entries(nodes)
        return np.add.reduceat(self.sums[own.terms[entries], :width] * own.values[entries, None], starts, axis=0)

    def add(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        """Documents 0..len(ids) - 1 with entries (row, term, value); each has one at least."""
        order = by_strongest(rows, terms, values * self.items.weights[terms], len(ids))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        levels = tree(level_of(place[rows], terms, values, len(ids)), LEAF, FAN)
        ids, nulls = ids[order], nulls[order]
        top = len(self.levels) - 1
        # one entry per node of documents: (level, node, level of items, item nodes that are left)
        todo = [(len(levels) - 1, 0, top, np.arange(len(self.levels[top])))]
        while todo:
            level, node, at, left = todo.pop()
            if level == 0:  # a single document is left of the whole tree
                self.score(levels[0], np.array([node]), left, at, ids, nulls)
                continue
            own = levels[level]
            span = slice(own.first[node], own.first[node + 1])
            self.sums[own.terms[span], 0] = own.values[span]
            left = self.survivors(at, left)
            if level == 1:  # no documents below but leaves: open items down to single ones
                while len(left) and at:
                    left, at = self.children(at, left), at - 1
                    left = self.survivors(at, left)
            self.sums[own.terms[span], 0] = 0
            if not len(left):
                continue
            if level == 1:
                low = node * LEAF
                self.score(levels[0], np.arange(low, min(low + LEAF, len(ids))), left, 0, ids, nulls)
            else:
                if at:
                    left, at = self.children(at, left), at - 1
                low = node * FAN
                todo += [(level - 1, n, at, left) for n in range(low, min(low + FAN, len(levels[level - 1])))]

    def survivors(self, level: int, nodes: np.ndarray) -> np.ndarray:
        if not len(nodes):
            return nodes
        return nodes[self.products(level, nodes, 1)[:, 0] >= self.node_need(level, nodes)]

    def score(self, leaves: Level, docs: np.ndarray, items: np.ndarray, level: int, ids: np.ndarray, nulls: np.ndarray) -> None:
        while level:
            items, level = self.children(level, items), level - 1
        entries, starts = leaves.entries(docs)
        column = np.repeat(np.arange(len(docs)), np.diff(np.append(starts, len(entries))))
        self.sums[leaves.terms[entries], column] = leaves.values[entries]
        scores = self.products(0, items, len(docs)).astype(np.int64)
        self.sums[leaves.terms[entries], column] = 0
        self.met += scores.size
        scores[scores < self.need()[items][:, None]] = 0
        some = scores.any(axis=1)
        if some.any():
            self.best.add(items[some], scores[some], ids[docs], nulls[docs])


def impacts(n: np.ndarray, counts: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Saturated frequencies of a document's terms, in whole numbers; ``n``: its length, per entry."""
    m = 100 - 75 + (75 * n * documents) // terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def _searched(rows: DataFrame, items: Broadcast, k: int, documents: int, terms: int) -> DataFrame:
    """key, rank, doc_id, score: the best rows for each item of the block; a task sends k rows per item at most."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        run = Search(own, k)
        for batch in batches:
            lists = batch.column(2)
            edges = lists.offsets.to_numpy().astype(np.int64)
            edges -= edges[0]
            names, counts = lists.flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            n = batch.column(1).to_numpy()
            doc_ids = batch.column(0)
            nulls = doc_ids.is_null().to_numpy(zero_copy_only=False)
            ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
            low = 0
            while low < len(n):
                high = min(low + DOCS_AT_ONCE, len(n), max(low + 1, int(np.searchsorted(edges, edges[low] + POSTINGS_AT_ONCE, "right")) - 1))
                span = slice(edges[low], edges[high])
                doc = np.repeat(np.arange(high - low), np.diff(edges[low:high + 1]))
                term = np.searchsorted(own.terms, names[span])
                known = own.terms[np.minimum(term, len(own.terms) - 1)] == names[span]
                doc, term = doc[known], term[known]
                value = impacts(n[low:high][doc], counts[span][known], documents, terms)
                some, doc = np.unique(doc, return_inverse=True)
                if len(some):
                    run.add(doc, term, value, ids[low:high][some], nulls[low:high][some])
                low = high
        item, rank = np.nonzero(run.best.scores)
        yield pa.RecordBatch.from_arrays(
            [pa.array(own.keys[item]), pa.array(run.best.ids[item, rank], mask=run.best.nulls[item, rank]),
             pa.array(run.best.scores[item, rank])], ["key", "doc_id", "score"])

    found = rows.mapInArrow(search, "key bigint, doc_id bigint, score bigint")
    order = W.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return cut_lineage(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text_column: str = "text",
                   item_column: str = "item_id", item_text: str = "text", block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 of each item.

    A term is a run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.  Equal
    scores rank by rising id, null ids last.  Rows without a term (null, empty) are neither documents
    nor items; repeated documents are ranked row by row.  Items that are equal in id and text count
    once; different texts under one id, or under a null id, are items of their own.  An empty table
    gives no rows.  Other columns are not read.
    """
    spark = docs.sparkSession
    asked = pick(items, item_id=item_column, text=item_text)
    asked = asked.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))).dropDuplicates()
    key = F.xxhash64(F.col("item_id").isNull(), "item_id", "text").alias("id")
    names = asked.select(key, "item_id")
    wanted = cut_lineage(_read_terms(spread(asked.select(key, "text")))
                         .select("id", F.explode(F.arrays_zip("terms", "counts")).alias("e"))
                         .select("id", F.col("e.terms").alias("term"), F.col("e.counts").alias("repeats")))
    bitmap = spark.sparkContext.broadcast(key_bitmap(wanted, "term"))

    rows = spread(pick(docs, id=id_column, text=text_column))
    rows = rows.select(F.col("id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    path = fresh_path(spark, "terms")
    _read_terms(rows, bitmap).write.parquet(path)
    bitmap.destroy()
    read = spark.read.parquet(path)
    size = read.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    documents, length = size["n"], size["l"] or 1

    frequency = read.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1)))
    weighted = wanted.join(frequency, "term").select("id", "term", "repeats", weight.alias("weight")).where("weight > 0")
    blocks = max(1, -(-wanted.count() // block_postings))
    folder = fresh_path(spark, "items")
    (weighted.withColumn("block", F.pmod(F.col("id"), F.lit(blocks))).repartition("block", "id")
             .write.partitionBy("block").parquet(folder, mode="overwrite"))
    stored = spark.read.schema("id bigint, term bigint, repeats bigint, weight bigint, block int").parquet(folder)
    share = min(1_000_000, int(SEED_DOCS / max(1, documents) * 1_000_000) + 1)
    seeds = cut_lineage(read.where(F.pmod(F.xxhash64("id", "n"), F.lit(1_000_000)) < share))
    found = spark.createDataFrame([], "key bigint, doc_id bigint, score bigint, rank int")
    for b in range(blocks):
        part = stored.where(F.col("block") == b).toArrow()  # about block_postings rows
        if not part.num_rows:
            continue
        block = item_block(*[part.column(c).to_numpy() for c in ("id", "term", "repeats", "weight")])
        shared = spark.sparkContext.broadcast(block)
        first = _searched(seeds, shared, k, documents, length).where(F.col("rank") == k).select("key", "score").toArrow()
        shared.destroy()
        seen = dict(zip(first.column("key").to_pylist(), first.column("score").to_pylist()))
        block.least = np.array([seen.get(int(x), 1) for x in block.keys], np.int64)
        shared = spark.sparkContext.broadcast(block)
        found = found.unionByName(_searched(read, shared, k, documents, length))
        shared.destroy()
    for used in (path, folder):
        discard(spark, used)
    made = found.join(names.withColumnRenamed("id", "key"), "key")
    return made.select(F.col("item_id").alias(item_column), "rank", "doc_id", "score")
