"""Boosted trees on sparse features: the trees of Spark's GBTClassifier from histograms of what is not zero.

Spark bins a row into one number per feature and adds every feature of every row to its histograms, so
3000 terms cost 3000 steps a row, however few of them the row has.  Here a block of rows keeps, per bin,
the rows that are in it, but for the bin that holds zero: that one is the node's total less the others.
Splits, samples of rows, feature subsets per node, gains and leaves are Spark's own for the same
seed and the same partitions, so the trees are the same up to rounding.
"""

from __future__ import annotations

import json
import math
import pickle
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, SparkContext, StorageLevel, TaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import shared_dir

DENSE_CELLS = 1 << 26  # fixed value: up to so many rows times features Spark's own fit is as quick, its bins 256 MB at most
BLOCK_ROWS, BLOCK_ENTRIES = 1 << 16, 1 << 21  # fixed values: a block's rows have 16 bits, its entries fit a worker
CUT_EVERY = 10  # fixed value: trees between checkpoints, as Spark has it
EPSILON = 2.0 ** -52


# --- Spark's random numbers ----------------------------------------------------------


def _hashed(seed: int) -> int:
    """State of Spark's XORShiftRandom for a seed: two murmur hashes of its eight bytes."""
    words = struct.unpack("<2I", struct.pack(">q", (seed + 2 ** 63) % 2 ** 64 - 2 ** 63))

    def murmur(h: int) -> int:
        for k in words:
            k = k * 0xCC9E2D51 & 0xFFFFFFFF
            k = (k << 15 | k >> 17) * 0x1B873593 & 0xFFFFFFFF
            h = ((h ^ k) << 13 | (h ^ k) >> 19) & 0xFFFFFFFF
            h = h * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 8
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    low = murmur(0x3C074A61)
    return murmur(low) << 32 | low


def _moved(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map over bits, given by what it makes of each of the 64, applied to all of ``x``."""
    out = np.zeros_like(x)
    for b in range(8):
        table = np.zeros(256, np.uint64)
        for bit in range(8):
            table[1 << bit:2 << bit] = table[:1 << bit] ^ columns[8 * b + bit]
        out ^= table[(x >> np.uint64(8 * b)) & np.uint64(255)]
    return out


def uniform(seed: int, start: int, n: int) -> np.ndarray:
    """Draws ``start`` to ``start + n`` of ``XORShiftRandom(seed).nextDouble()``, two states each.

    A step of the generator is linear over bits, so its powers jump ahead and double what is known.
    """
    step = np.uint64(1) << np.arange(64, dtype=np.uint64)
    step = step ^ (step << np.uint64(21))
    step = step ^ (step >> np.uint64(35))
    step = step ^ (step << np.uint64(4))
    state, power, ahead = np.array([_hashed(seed)], np.uint64), step, 2 * start + 1
    while ahead:
        if ahead & 1:
            state = _moved(power, state)
        power, ahead = _moved(power, power), ahead >> 1
    power = step
    while len(state) < 2 * n:
        state, power = np.concatenate([state, _moved(power, state)]), _moved(power, power)
    state = state[:2 * n]
    high, low = state[0::2] & np.uint64((1 << 26) - 1), state[1::2] & np.uint64((1 << 27) - 1)
    return ((high << np.uint64(27)) + low).astype(np.float64) * 2.0 ** -53


def reservoir(n: int, k: int, seed: int) -> np.ndarray:
    """``k`` of the numbers below ``n``, in the order in which Spark's reservoir holds them."""
    kept = np.arange(min(n, k))
    if k < n:
        place = (uniform(seed, 0, n - k) * np.arange(k + 1, n + 1)).astype(np.int64)
        for item, at in zip(range(k, n), place):
            if at < k:
                kept[at] = item
    return kept


# --- bins ----------------------------------------------------------------------------


@dataclass
class Bins:
    """Thresholds of the features that can be split, in one row; their bins are numbered through."""

    n_features: int
    features: np.ndarray  # numbers of the features that have a threshold, ascending
    sizes: np.ndarray  # bins of each
    thresholds: np.ndarray

    def __post_init__(self):
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.zero = np.array([np.searchsorted(self.of(f), 0.0) for f in range(len(self.features))], np.int64)
        self.place = np.full(self.n_features, -1, np.int64)
        self.place[self.features] = np.arange(len(self.features))

    def of(self, f: int) -> np.ndarray:
        """Thresholds of the f-th feature: one less than it has bins."""
        return self.thresholds[self.starts[f] - f:self.starts[f + 1] - f - 1]


@dataclass
class Block:
    """Rows of one partition: ``rows[i]`` is in bin ``bins[i]``; bins that hold zero are left out."""

    part: int
    start: int
    label: np.ndarray
    weight: np.ndarray
    rows: np.ndarray
    bins: np.ndarray
    margin: np.ndarray | None = None
    aim: np.ndarray | None = None  # what the next tree learns
    drawn: np.ndarray | None = None  # the rows it learns from


def _entries(batch: pa.RecordBatch, bins: Bins) -> tuple[np.ndarray, np.ndarray]:
    """(row, bin) of the values of a batch that are not in their feature's bin of zero, by bin."""
    vector = batch.column(2)
    indices, values = vector.field("indices"), vector.field("values")
    count = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(batch.num_rows), count)
    value = values.flatten().to_numpy(zero_copy_only=False)
    feature = np.arange(len(value)) - np.repeat(np.cumsum(count) - count, count)
    sparse = np.repeat(vector.field("type").to_numpy(zero_copy_only=False) == 0, count)
    feature[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    place = bins.place[feature]
    known = np.flatnonzero(place >= 0)
    known = known[np.argsort(place[known], kind="stable")]
    row, value, place = row[known], value[known], place[known]
    found = np.empty(len(known), np.int64)
    edges = np.searchsorted(place, np.arange(len(bins.features) + 1))
    for f in np.unique(place):
        lo, hi = edges[f], edges[f + 1]
        found[lo:hi] = np.searchsorted(bins.of(f), value[lo:hi])
    other = np.flatnonzero(found != bins.zero[place])
    return row[other], (bins.starts[place] + found)[other]


def _blocks(train: DataFrame, label: str, weight: str | None, features: str, bins: Bins) -> RDD:
    def packed(batches):
        part, start, held = TaskContext.get().partitionId(), 0, []

        def block():
            shift = np.cumsum([0] + [len(h[0]) for h in held])
            at = np.concatenate([h[3] for h in held])
            order = np.argsort(at, kind="stable")
            rows = np.concatenate([h[2] + s for h, s in zip(held, shift)])[order]
            made = Block(part, start, np.concatenate([h[0] for h in held]) * 2 - 1, np.concatenate([h[1] for h in held]),
                         rows.astype(np.uint16), at[order].astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], ["block"]), int(shift[-1])

        for big in batches:
            for lo in range(0, big.num_rows, BLOCK_ROWS // 8):
                batch = big.slice(lo, BLOCK_ROWS // 8)
                batch = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in batch.columns], batch.schema.names)
                held.append((*(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)), *_entries(batch, bins)))
                if len(held) == 8 or sum(len(h[2]) for h in held) > BLOCK_ENTRIES:
                    made, n = block()
                    yield made
                    start, held = start + n, []
        if held:
            yield block()[0]

    slim = train.select(F.col(label).cast("double").alias("label"),
                        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
                        F.unwrap_udt(features).alias("features"))
    return slim.mapInArrow(packed, "block binary").rdd.map(lambda r: pickle.loads(r[0]))


# --- trees ---------------------------------------------------------------------------


def variance(stats: np.ndarray) -> np.ndarray:
    """Of (weight, sum, squares, rows) along the last axis, by Spark's formula."""
    w, s, q = stats[..., 0], stats[..., 1], stats[..., 2]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(w == 0, 0.0, (q - s * s / w) / w)


@dataclass
class Node:
    id: int
    stats: np.ndarray | None = None
    impurity: float = 0.0
    gain: float = 0.0
    feature: int = -1
    split: int = -1  # bins up to this one go left
    left: Node | None = None
    right: Node | None = None
    subset: np.ndarray | None = field(default=None, repr=False)

    @property
    def level(self) -> int:
        return self.id.bit_length() - 1

    @property
    def value(self) -> float:
        return float(self.stats[1] / self.stats[0]) if self.stats[0] else 0.0

    def pruned(self) -> Node:
        """Two leaves of one value are one leaf."""
        if self.left is None:
            return self
        left, right = self.left.pruned(), self.right.pruned()
        if left.left is None and right.left is None and left.value == right.value:
            return Node(self.id, self.stats, self.impurity)
        return Node(self.id, self.stats, self.impurity, self.gain, self.feature, self.split, left, right)


def _routed(block: Block, root: Node, bins: Bins) -> np.ndarray:
    """Id of the node in which each row ends."""
    at, todo = np.ones(len(block.label), np.int32), [root]
    while todo:
        node = todo.pop()
        if node.left is None:
            continue
        first, end = bins.starts[node.feature:node.feature + 2]
        lo, hi = np.searchsorted(block.bins, np.array([first, end], block.bins.dtype))
        right = np.full(len(at), bins.zero[node.feature] > node.split)
        right[block.rows[lo:hi]] = block.bins[lo:hi] > first + node.split
        here = np.flatnonzero(at == node.id)
        at[here] = 2 * node.id + right[here]
        todo += [node.left, node.right]
    return at


def _values(root: Node, at: np.ndarray) -> np.ndarray:
    known, todo = {}, [root]
    while todo:
        node = todo.pop()
        if node.left is None:
            known[node.id] = node.value
        else:
            todo += [node.left, node.right]
    ids = np.array(sorted(known))
    return np.array([known[i] for i in ids])[np.searchsorted(ids, at)]


def _sums(blocks, root: Node, nodes: list[int], bins: Bins):
    """(node, (bins + 1) x (weight, sum, squares, rows)) of a partition; the last line is the node's total."""
    total, width, ids = None, int(bins.starts[-1]) + 1, np.array(sorted(nodes))
    for block in blocks:
        at = _routed(block, root, bins)
        place = np.searchsorted(ids, at).clip(0, len(ids) - 1)
        # rows that are not drawn or have left the group go to one more node, which is dropped
        begin = np.where((ids[place] == at) & block.drawn, place, len(ids)) * width
        w, y = block.weight, block.aim
        wy = w * y
        cell = np.concatenate([begin[block.rows] + block.bins, begin + width - 1])

        def added(value: np.ndarray) -> np.ndarray:
            return np.bincount(cell, np.concatenate([value[block.rows], value]), (len(ids) + 1) * width)

        count = np.bincount(cell, minlength=(len(ids) + 1) * width).astype(np.float64)
        made = np.stack([count if (w == 1).all() else added(w), added(wy), added(wy * y), count], axis=-1)
        made = made.reshape(len(ids) + 1, width, 4)[:-1]
        total = made if total is None else np.add(total, made, out=total)
    if total is not None:
        yield from zip(ids.tolist(), total)


def best_split(sums: np.ndarray, node: Node, bins: Bins, least: tuple[int, float, float]) -> dict:
    """The split of the highest gain, the first in the order of the node's features on ties."""
    whole, n = sums[-1], len(bins.features)
    table = np.zeros((n, int(bins.sizes.max()) if n else 1, 4))
    inside = np.arange(table.shape[1])[None, :] < bins.sizes[:, None]
    table[inside] = sums[:-1]
    rest = whole - table.sum(1)
    rest[rest[:, 3] == 0] = 0.0
    table[np.arange(n), bins.zero] = rest
    order = np.arange(n) if node.subset is None else bins.place[node.subset]
    order = order[order >= 0]
    if not len(order):
        return {"stats": whole if node.stats is None else node.stats, "valid": False}
    left = np.cumsum(table[order], axis=1)
    right = left[:, -1:, :] - left
    parent = node.stats if node.stats is not None else left[0, 0] + right[0, 0]
    impurity = float(variance(parent))
    total = left[..., 0] + right[..., 0]
    gain = impurity - left[..., 0] / total * variance(left) - right[..., 0] / total * variance(right)
    rows, weight, info = least
    ok = (np.minimum(left[..., 3], right[..., 3]) >= rows) & (np.minimum(left[..., 0], right[..., 0]) >= weight)
    ok &= (gain >= info) & (np.arange(table.shape[1])[None, :] < bins.sizes[order][:, None] - 1)
    if not ok.any():
        return {"stats": parent, "valid": False}
    f, s = np.unravel_index(np.argmax(np.where(ok, gain, -np.inf)), gain.shape)
    return {"stats": parent, "valid": True, "impurity": impurity, "gain": float(gain[f, s]), "feature": int(order[f]),
            "split": int(s), "left": left[f, s], "right": right[f, s]}


class Boosting:
    """A fit that can be carried on: ``grow(n)`` gives the model of ``n`` trees, from those there are."""

    def __init__(self, gbt: GBTClassifier, train: DataFrame, dense_cells: int = DENSE_CELLS):
        self.gbt, self.train = gbt, train
        self.trees: list = []
        self.roots: list[Node] = []
        gbt._transfer_params_to_java()
        jvm, java = SparkContext._jvm, gbt._java_obj
        column = train._jdf.schema().apply(gbt.getFeaturesCol())
        nominal = jvm.org.apache.spark.ml.util.MetadataUtils.getCategoricalFeatures(column)
        kinds = jvm.org.apache.spark.mllib.tree.configuration.Algo
        rows = _module(jvm.org.apache.spark.ml.util, "DatasetUtils").extractInstances(java, train._jdf, jvm.scala.Some(2))
        strategy = java.getOldBoostingStrategy(nominal, kinds.Classification()).treeStrategy()
        strategy.setAlgo(kinds.Regression())
        plan = jvm.org.apache.spark.ml.tree.impl.DecisionTreeMetadata.buildMetadata(
            rows, strategy, 1, gbt.getFeatureSubsetStrategy())
        # Spark's own fit: little data, features that are names of categories
        self.plain = plan.numExamples() * plan.numFeatures() <= dense_cells or not nominal.isEmpty()
        if self.plain:
            return
        self.splits = _module(jvm.org.apache.spark.ml.tree.impl, "RandomForest").findSplits(rows, plan, gbt.getSeed())
        self.n_features, self.per_node = plan.numFeatures(), plan.numFeaturesPerNode()
        self.least = (plan.minInstancesPerNode(), plan.minWeightPerNode(), plan.minInfoGain())
        found = _thresholds(self.splits)
        self.n_bins = np.array([len(t) + 1 for t in found], np.int64)
        features = np.flatnonzero(self.n_bins > 1)
        self.bins = Bins(self.n_features, features, self.n_bins[features], np.array([v for t in found for v in t]))
        weight = gbt.getWeightCol() if gbt.isDefined(gbt.weightCol) and gbt.getWeightCol() else None
        shared_dir(train.sparkSession)
        self.blocks = self._aimed(_blocks(train, gbt.getLabelCol(), weight, gbt.getFeaturesCol(), self.bins), None)

    def grow(self, n: int) -> GBTClassificationModel:
        if self.plain:
            return self.gbt.copy({self.gbt.maxIter: n}).fit(self.train)
        while len(self.roots) < n:
            if self.roots:
                before = self.blocks
                self.blocks = self._aimed(before, self.roots[-1])
                if len(self.roots) % CUT_EVERY == 0:
                    self.blocks.checkpoint()
                self.blocks.count()
                before.unpersist()
            root = self._tree()
            self.roots.append(root)
            self.trees.append(self._java_tree(root))
        return self._model(n)

    def close(self) -> None:
        if not self.plain:
            self.blocks.unpersist()

    def _aimed(self, blocks: RDD, last: Node | None) -> RDD:
        """Blocks with the margin after the last tree and what the next one learns from which rows."""
        bins, m, share, seed = self.bins, len(self.roots), self.gbt.getSubsamplingRate(), self.gbt.getSeed()
        scale = self.gbt.getStepSize() if m > 1 else 1.0

        def aimed(b: Block) -> Block:
            if last is None:
                margin, aim = np.zeros(len(b.label)), b.label
            else:
                margin = b.margin + _values(last, _routed(b, last, bins)) * scale
                with np.errstate(over="ignore"):
                    aim = 4.0 * b.label / (1.0 + np.exp(2.0 * b.label * margin))
            drawn = np.ones(len(aim), bool) if share == 1.0 else uniform(seed + m + b.part + 1, b.start, len(aim)) < share
            return Block(b.part, b.start, b.label, b.weight, b.rows, b.bins, margin, aim, drawn)

        return blocks.map(aimed).persist(StorageLevel.MEMORY_AND_DISK)

    def _tree(self) -> Node:
        """One tree, in Spark's order of nodes: the last child first, as many at a time as its memory holds."""
        root = Node(1)
        stack, depth = [root], self.gbt.getMaxDepth()
        random = SparkContext._jvm.java.util.Random(self.gbt.getSeed() + len(self.roots))
        limit = self.gbt.getMaxMemoryInMB() * 1024 * 1024
        while stack:
            group, used = [], 0
            while stack and used < limit:
                node = stack[-1]
                if self.per_node < self.n_features:
                    node.subset = reservoir(self.n_features, self.per_node, random.nextLong())
                size = 24 * int(self.n_bins.sum() if node.subset is None else self.n_bins[node.subset].sum())
                if not group or used + size <= limit:
                    group.append(stack.pop())
                used += size
            found = self._found(root, group)
            for node in group:
                best = found[node.id]
                node.stats = best["stats"]
                node.impurity = best["impurity"] if best["valid"] else -1.0
                if not best["valid"] or best["gain"] <= 0 or node.level == depth:
                    continue
                node.gain, node.feature, node.split = best["gain"], best["feature"], best["split"]
                for side, at in (("left", 2 * node.id), ("right", 2 * node.id + 1)):
                    child = Node(at, best[side], float(variance(best[side])))
                    setattr(node, side, child)
                    if child.level < depth and abs(child.impurity) >= EPSILON:
                        stack.append(child)
        return root.pruned()

    def _found(self, root: Node, group: list[Node]) -> dict[int, dict]:
        bins, least, ids, by_id = self.bins, self.least, [n.id for n in group], {n.id: n for n in group}
        slim = {i: Node(i, n.stats, subset=n.subset) for i, n in by_id.items()}
        rows = self.blocks.mapPartitions(lambda blocks: _sums(blocks, root, ids, bins))
        pieces = min(len(ids), self.blocks.context.defaultParallelism)
        return dict(rows.reduceByKey(np.add, pieces).map(
            lambda kv: (kv[0], best_split(kv[1], slim[kv[0]], bins, least))).collect())

    def _java_tree(self, root: Node):
        jvm, gateway = SparkContext._jvm, SparkContext._gateway
        tree = jvm.org.apache.spark.ml.tree

        def made(node: Node):
            sums = gateway.new_array(gateway.jvm.double, 3)
            for i in range(3):
                sums[i] = float(node.stats[i])
            known = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(sums, int(node.stats[3]))
            if node.left is None:
                return tree.LeafNode(node.value, float(node.impurity), known)
            split = self.splits[int(self.bins.features[node.feature])][node.split]
            return tree.InternalNode(node.value, float(node.impurity), node.gain, made(node.left), made(node.right), split, known)

        return jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel(made(root), self.n_features)

    def _model(self, n: int) -> GBTClassificationModel:
        jvm, gateway = SparkContext._jvm, SparkContext._gateway
        trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
        weights = gateway.new_array(gateway.jvm.double, n)
        for i, tree in enumerate(self.trees[:n]):
            trees[i], weights[i] = tree, self.gbt.getStepSize() if i else 1.0
        java = jvm.org.apache.spark.ml.classification.GBTClassificationModel(
            f"{self.gbt.uid}_{n}", trees, weights, self.n_features, 2)
        made = GBTClassificationModel(self.gbt._java_obj.copyValues(java, jvm.org.apache.spark.ml.param.ParamMap()))
        made._transfer_params_from_java()
        return made


def _module(package, name: str):
    """A Scala object, with the methods it does not show to Java."""
    return getattr(getattr(package, f"{name}$"), "MODULE$")


def _thresholds(splits) -> list[list[float]]:
    """Thresholds per feature, read in one call rather than one per number."""
    jvm = SparkContext._jvm
    jackson = jvm.com.fasterxml.jackson
    shown = jackson.annotation.JsonAutoDetect.Visibility.ANY
    mapper = jackson.databind.ObjectMapper().setVisibility(jackson.annotation.PropertyAccessor.FIELD, shown)
    return [[s["threshold"] for s in feature] for feature in json.loads(mapper.writeValueAsString(splits))]
