"""Passages that occur more than once, anywhere, removed to the byte.

A byte goes when a string of ``length`` bytes that covers it also starts somewhere else.  Suffixes
are sampled so that the sort stays small: the *anchor* of a window (a string of ``length``
bytes) is the place in its first ``SPREAD`` bytes where a short hash is least.  It depends on the
window's bytes alone, so equal windows have equal anchors at equal offsets.  A run of windows
shares an anchor, and all of them hold the bytes from the anchor to the end of the first one: the
anchor's *name*.  Anchors of the same name are compared; anchors whose whole surroundings are
equal are one class with a count.

Method: deep-shallow sorting.  The classes of a name are ordered by the bytes to the right of the
anchor: multikey quicksort to a shallow depth, then blind tries for the groups with a long prefix in
common.  For every interval of that order with a common prefix of r bytes, the bytes to the
left decide: a class that shares l bytes with another one has its windows at offsets length - r
to l repeated.

A task orders at most ``CROWD`` classes.  A name with more of them (a passage in many different
surroundings) is split first, as multikey quicksort splits by the next symbols, but by Spark: its
window offsets are halved, and for a range of offsets only classes that agree in the bytes that all
windows of the range hold stay together.  Classes that agree in all bytes the range touches are one, and
settled if there are two.  Ranges are halved until a group fits a task, at most nine times.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ids_and_texts, in_bitmap, only_keys, shared_bitmap, small_batches, spread
from tidemark.llm.suffix_order import common_prefix, order
from tidemark.llm.words import _BASE, _BYTE_CODE, _tables, mix, parts, text_buffer
from tidemark.session import cut_lineage, fresh_path

CROWD = 1024
_GRAM = 32
# Bytes searched at once: some twenty arrays of eight bytes each.
_PIECE = 128 << 10
# An anchor as it is kept with its text: 24 bytes.
_PACKED = np.dtype([("name", "<i8"), ("class", "<i8"), ("at", "<u4"), ("low", "<u2"), ("high", "<u2")])
_ANCHOR = "name bigint, class bigint, at bigint, low int, high int"


def _spread_of(length: int) -> int:
    """Windows whose first bytes are searched for the anchor: most of the window, whole grams."""
    return max(1, min(length - min(_GRAM, length) + 1, 5 * length // 8))


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """text, name, class, at (byte in the text), low, high: the windows at offsets low..high before an anchor."""
    out: dict[str, list] = {k: [] for k in ("text", "name", "class", "at", "low", "high")}
    spread_, gram = _spread_of(length), min(_GRAM, length)
    # texts together up to a piece; a longer text in pieces that overlap by a window
    at, n = 0, len(bounds) - 1
    jobs: list[tuple[int, int]] = []
    while at < n:
        upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + _PIECE, "right")) - 1)
        upto = min(upto, n)
        low, high = int(bounds[at]), int(bounds[upto])
        while low == bounds[at] or low + length <= high:
            jobs.append((low, min(high, low + _PIECE + length - 1)))
            low += _PIECE
        at = upto
    for low, high in jobs:
        _piece(out, data, bounds, low, high, length, spread_, gram)
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _piece(out: dict, data: np.ndarray, bounds: np.ndarray, low: int, high: int, length: int, width: int, gram: int) -> None:
    piece = data[low:high]
    size = len(piece)
    if size < length:
        return
    first = max(0, int(np.searchsorted(bounds, low, "right")) - 1)
    last = int(np.searchsorted(bounds, high, "left"))
    edges = bounds[first:last + 1]
    starts = np.maximum(edges[:-1], low) - low
    stops = np.minimum(edges[1:], high) - low - length + 1  # first start without a whole window
    owner = np.repeat(np.arange(first, last), np.maximum(stops - starts, 0))
    if not len(owner):
        return
    some = np.flatnonzero(stops > starts)
    window = np.concatenate([np.arange(starts[k], stops[k]) for k in some])
    power, inverse = _tables(size + 1)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(_BYTE_CODE[piece] * power[:size], out=sums[1:])
    grams = size - gram + 1
    key = (sums[gram:] - sums[:grams]) * inverse[:grams]
    key = (key ^ key >> np.uint64(31)) * np.uint64(_BASE)
    key = key >> np.uint64(32) << np.uint64(32) | np.arange(grams, dtype=np.uint64)
    anchor = (_sliding_least(key, width)[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    change = np.flatnonzero((anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])) + 1
    head = np.concatenate([[0], change])
    tail = np.concatenate([change, [len(anchor)]]) - 1
    place, early, late, text = anchor[head], window[head], window[tail], owner[head]
    core = length - width + 1

    def code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))

    around = code(early, late + length) + mix((place - early).astype(np.uint64) * np.uint64(4096) + np.uint64(7))
    out["text"].append(text)
    out["name"].append(code(place, place + core).view(np.int64))
    out["class"].append(around.view(np.int64))
    out["at"].append(place + low - bounds[text])
    out["low"].append(place - late)
    out["high"].append(place - early)


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones, from running minima of blocks on both sides."""
    n = len(key)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in parts(batch.column(2)):
                data, bounds = text_buffer(batch.column(2).slice(first, last - first))
                found = anchors(data, bounds, length)
                packed = np.empty(len(found["at"]), _PACKED)
                for k in _PACKED.names:
                    packed[k] = found[k]
                count = np.searchsorted(found["text"], np.arange(last - first + 1))
                blobs = [packed[a:b].tobytes() for a, b in zip(count[:-1], count[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first),
                     pa.array(blobs, pa.binary())], ["h", "g", "anchors"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per anchor: h, g, copies and the anchor's fields."""
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            blobs = part.column(3).to_pylist()
            rows = np.frombuffer(b"".join(blobs), _PACKED)
            again = pa.array(np.repeat(np.arange(len(blobs)), [len(b) // _PACKED.itemsize for b in blobs]))
            yield pa.RecordBatch.from_arrays(
                [part.column(k).take(again) for k in range(3)]
                + [pa.array(rows[k].astype(t)) for k, t in zip(_PACKED.names, ("i8", "i8", "i8", "i4", "i4"))],
                ["h", "g", "copies", *_PACKED.names])


def _surroundings(length: int):
    """The bytes around the anchors asked for, one row each."""
    names = ["name", "class", "n", "kinds", "low", "high", "left", "right"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, asked in zip(batch.column(0), batch.column(1)):
                raw = text.as_buffer()
                for a in asked.as_py():
                    at, low, high = a["at"], a["low"], a["high"]
                    rows.append((a["name"], a["class"], a["n"], a["kinds"], low, high, raw[at - high:at].to_pybytes(),
                                 raw[at:at + length - low].to_pybytes()))
                    if len(rows) >= 5000:
                        yield _rows(rows, names)
                        rows = []
            yield _rows(rows, names)

    return run


_TYPES = {"name": pa.int64(), "class": pa.int64(), "n": pa.int64(), "kinds": pa.int64(), "low": pa.int32(), "high": pa.int32(),
          "left": pa.binary(), "right": pa.binary(), "from": pa.int32(), "upto": pa.int32()}


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[n]) for c, n in zip(columns, names)], names)


def repeated_offsets(classes: list[tuple], length: int) -> list[set[tuple[int, int]]]:
    """Per class (n, low, high, left, right) the ranges of window offsets that occur elsewhere."""
    found: list[set] = [{(low, high)} if n > 1 else set() for n, low, high, _, _ in classes]
    if len(classes) < 2 or all(found):
        return found
    rights = [c[4] for c in classes]
    lefts = [c[3][::-1] for c in classes]
    placed, shared = order(rights)
    furthest = max(c[2] for c in classes)
    # intervals of the order by common prefix, each visited once: (first, last, prefix)
    stack: list[tuple[int, int]] = []  # (first, prefix)
    shared = shared + [-1]
    stack.append((0, len(rights[placed[0]])))
    for k in range(1, len(placed) + 1):
        first, prefix = k, len(rights[placed[k]]) if k < len(placed) else 0
        while stack and stack[-1][1] > shared[k]:
            low, depth = stack.pop()
            if k - low > 1 and length - depth <= furthest:
                _by_left([placed[x] for x in range(low, k)], lefts, depth, classes, found, length)
            first = low
        if k < len(placed):
            if not stack or stack[-1][1] < shared[k]:
                stack.append((first, shared[k]))
            stack.append((k, prefix))
    return found


def _by_left(own: list[int], lefts: list[bytes], depth: int, classes: list[tuple], found: list[set], length: int) -> None:
    """Classes that share ``depth`` bytes on the right: each meets its nearest ones on the left."""
    own = sorted(own, key=lefts.__getitem__)
    shared = [common_prefix(lefts[a], lefts[b]) for a, b in zip(own, own[1:])]
    for k, x in enumerate(own):
        n, low, high, _, _ = classes[x]
        if n == 1:
            most = max(shared[k - 1] if k else 0, shared[k] if k < len(shared) else 0)
            start, stop = max(low, length - depth), min(high, most)
            if start <= stop:
                found[x].add((start, stop))


def _resolve(length: int):
    """Rows ordered by name: the repeated offsets of each class, a name at a time.

    Copies of a text bring the same classes again: each counts once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, group = None, {}
        names = ["name", "class", "from", "upto"]

        def settle() -> list[tuple]:
            ranges = repeated_offsets(list(group.values()), length)
            return [(name, kind, a, b) for kind, r in zip(group, ranges) for a, b in sorted(r)]

        for batch in batches:
            rows: list[tuple] = []
            for n, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if n != name:
                    rows += settle()
                    name, group = n, {}
                group[rest[0]] = tuple(rest[1:])
            if rows:
                yield _rows(rows, names)
        if group:
            yield _rows(settle(), names)

    return run


def _resolve_ranges(length: int):
    """Rows ordered by group: as ``_resolve`` for the offsets lo..hi of each class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, {}
        names = ["name", "class", "from", "upto"]

        def settle() -> list[tuple]:
            ranges = repeated_offsets(list(group.values()), length)
            return [(*own, a, b) for own, r in zip(group, ranges) for a, b in sorted(r)]

        for batch in batches:
            rows: list[tuple] = []
            for k, name, kind, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    rows += settle()
                    key, group = k, {}
                group[name, kind] = tuple(rest)
            if rows:
                yield _rows(rows, names)
        if group:
            yield _rows(settle(), names)

    return run


def _crowds(around: DataFrame, length: int) -> DataFrame:
    """name, class, from, upto of names with more classes than a task orders.

    ``around`` has a row per class: name, class, n, low, high, left, right.  State: classes with a range
    a..b of offsets and the group that shares what all windows of the range hold.
    """
    state = around.withColumns({"a": F.lit(0), "b": F.lit(_spread_of(length) - 1), "key": F.col("name")})
    found = []
    while True:
        state = state.withColumns({"lo": F.greatest("low", "a"), "hi": F.least("high", "b")}).where("lo <= hi")
        state = state.withColumns({"l": F.expr("substring(left, length(left) - hi + 1, hi)"), "r": F.expr(f"substring(right, 1, {length} - lo)")})
        state = cut_lineage(state.withColumn("mark", F.md5(F.concat("l", "r"))))
        same = ["key", "lo", "hi", "mark"]
        twins = cut_lineage(state.groupBy(*same).agg(F.sum("n").alias("all"), F.min(F.struct("name", "class")).alias("one")))
        sizes = twins.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        met = state.join(twins, same)
        found.append(met.where("all > 1").select("name", "class", F.col("lo").alias("from"), F.col("hi").alias("upto")))
        # one of each goes on, as a partner of the others
        rest = cut_lineage(met.where(F.struct("name", "class") == F.col("one")).join(cut_lineage(sizes), "key"))
        small = rest.where(F.col("kinds") <= CROWD).select(
            "key", "name", "class", F.col("all").alias("n"), F.col("lo").alias("low"), F.col("hi").alias("high"),
            F.col("l").alias("left"), F.col("r").alias("right"))
        found.append(small.repartition("key").sortWithinPartitions("key").mapInArrow(
            _resolve_ranges(length), "name bigint, class bigint, from int, upto int"))
        large = rest.where((F.col("kinds") > CROWD) & (F.col("a") < F.col("b")))
        if large.isEmpty():
            break
        middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("b"))))
        large = large.withColumn("half", halves).select(
            "name", "class", F.col("all").alias("n"), F.col("lo").alias("low"), F.col("hi").alias("high"), F.col("l").alias("left"),
            F.col("r").alias("right"), F.col("half.a").alias("a"), F.col("half.b").alias("b"))
        # offsets a..b need a bytes on the left and length - b on the right in common; groups that meet by chance do no harm
        state = large.where("low <= b AND high >= a").withColumn("key", F.xxhash64(
            "name", "a", "b", F.expr("substring(left, length(left) - a + 1, a)"), F.expr(f"substring(right, 1, {length} - b)")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, copies, ranges in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = text.as_buffer()
                spans = [(0, raw.size)] if copies > 1 and raw.size >= length else merged(ranges or ())
                kept, at = hashlib.sha256(), 0
                for low, high in spans:
                    kept.update(raw[at:low])
                    at = high
                kept.update(raw[at:])
                out.append((raw.size, sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans],
                            kept.hexdigest()))
            yield _cut_rows(batch.column(0), out)

    return run


def _cut_rows(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    n, removed, spans, digest = zip(*rows) if rows else ((),) * 4
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
         pa.array(digest, pa.string())], ["id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def _whole(marked: Broadcast):
    """Rows id, text, h whose text surely keeps all bytes: its hash is not in the bitmap.  The others are left out.

    It tells them apart itself: a filter ahead of it would be one more Python worker for each task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.flatnonzero(~in_bitmap(marked.value, batch.column(2).to_numpy()))
            raws = (batch.column(1)[int(k)].as_buffer() for k in own)
            yield _cut_rows(batch.column(0).take(pa.array(own)), [(r.size, 0, [], hashlib.sha256(r).hexdigest()) for r in raws])

    return run


def merged(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for r in sorted((r["start"], r["end"]) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [tuple(r) for r in out]


def remove_repeats(docs: DataFrame, length: int = 400, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, spans (removed runs of bytes, end exclusive), kept_sha256 per input row.

    Texts are their UTF-8 bytes; a null text is empty.  A match never crosses texts, may
    overlap itself and is judged on the input.  Equal rows are copies of each other: each
    loses all bytes if it has ``length`` or more.  Ids are only passed through; other columns
    are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = spread(ids_and_texts(docs, id_column, text_column))
    # a text is known by 96 bits of two hashes
    rows = rows.withColumns({"h": F.xxhash64("text"), "g": F.hash("text")})
    long = rows.where(F.octet_length("text") >= length)
    found = fresh_path(spark, "anchors")
    (long.select("h", "g", "text").mapInArrow(_find(length), "h bigint, g int, anchors binary")
         .groupBy("h", "g").agg(F.count(F.lit(1)).alias("copies"), F.first("anchors").alias("anchors")).write.parquet(found))
    texts = spark.read.parquet(found)
    each = texts.select("h", "g", F.least("copies", F.lit(2).cast("bigint")).alias("copies"), "anchors").mapInArrow(
        _unpacked, f"h bigint, g int, copies bigint, {_ANCHOR}")
    # names that occur more than once, and in how many classes; all that follows is about these
    classes = each.groupBy("name", "class").agg(F.sum("copies").alias("n"))
    # written first: then both sides of the join come straight from a shuffle, and Spark splits the hot name
    named = cut_lineage(classes.groupBy("name").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"))
                               .where("all > 1").select("name", "kinds"))
    several = cut_lineage(each.join(named, "name"))

    asked = (several.where("kinds > 1").groupBy("name", "class")
                    .agg(F.sum("copies").alias("n"), F.min(F.struct("h", "g", "at", "low", "high", "kinds")).alias("first"))
                    .select("name", "class", "n", "first.*")
                    .groupBy("h", "g").agg(F.collect_list(
                        F.struct("name", "class", "n", "at", "low", "high", "kinds")).alias("asked")))
    asked = cut_lineage(asked)
    around = (only_keys(rows.select("h", "g", "text"), shared_bitmap(asked, "h"), "h").join(asked, ["h", "g"]).select("text", "asked").mapInArrow(
        _surroundings(length),
        "name bigint, class bigint, n bigint, kinds bigint, low int, high int, left binary, right binary"))
    around = cut_lineage(around)
    columns = ["name", "class", "n", "low", "high", "left", "right"]
    quiet = (around.where(F.col("kinds") <= CROWD).select(*columns).repartition("name").sortWithinPartitions("name")
                   .mapInArrow(_resolve(length), "name bigint, class bigint, from int, upto int"))
    crowd = around.where(F.col("kinds") > CROWD).select(*columns).dropDuplicates(["name", "class"])
    if not crowd.isEmpty():
        quiet = quiet.unionByName(_crowds(crowd, length))
    # written first, as above: a class that many texts hold is split
    ranges = cut_lineage(quiet.groupBy("name", "class").agg(F.collect_list(F.struct("from", "upto")).alias("offsets")))
    own = several.where("copies = 1").select("h", "g", "name", "class", "at", "low", "high", "kinds")
    whole = F.array(F.struct(F.col("low").alias("from"), F.col("high").alias("upto")))
    hits = (own.where("kinds > 1").join(ranges, ["name", "class"])
               .unionByName(own.where("kinds = 1").withColumn("offsets", whole)))
    hits = hits.select("h", "g", F.transform("offsets", lambda o: F.struct(
        (F.col("at") - o["upto"]).alias("start"), (F.col("at") - o["from"] + length).alias("end"))).alias("r"))
    lost = cut_lineage(hits.groupBy("h", "g").agg(F.flatten(F.collect_list("r")).alias("ranges")))
    marks = lost.withColumn("copies", F.lit(1).cast("bigint")).unionByName(
        texts.where("copies > 1").select("h", "g", "copies").withColumn(
            "ranges", F.lit(None).cast("array<struct<start:bigint,end:bigint>>")))
    # texts that surely keep all bytes stay where they are; the others meet their ranges
    marked = shared_bitmap(marks, "h")
    met = (only_keys(rows, marked, "h").join(marks, ["h", "g"], "left")
                                       .select("id", "text", F.coalesce("copies", F.lit(1)).alias("copies"), "ranges"))
    kind = rows.schema["id"].dataType.simpleString()
    out = (f"id {kind}, n_bytes bigint, n_removed bigint, "
           "spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")
    return (met.mapInArrow(_cut(length), out)
               .unionByName(rows.select("id", "text", "h").mapInArrow(_whole(marked), out))
               .withColumnRenamed("id", id_column))
