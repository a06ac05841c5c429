"""Cheapest repair of conversations, with what was wrong and which edits mend it.

Method: a grammar-compressed dynamic program.  A conversation is a sequence of symbols, one per row:
the class of its role's initial with the row's fault.  Equal sequences are kept once, and Re-Pair
replaces their most frequent adjacent pairs by rules, round by round.  What a symbol does to the
repair automaton is a min-plus transfer matrix over its states; each entry holds a cost and, as a
rope, the audit of the cheapest edits (the ASCII-least of them).  A rule's matrix is the product of
its two parts, made once, bottom-up, and shared by every conversation that uses the rule.

Roles must come out as ``(s?(ua)+)?`` by their initials.  The automaton's states are the start, behind
``s``, behind ``u`` and behind ``a``; start and behind ``a`` accept.  Two audits of equal cost between the
same states never are beginnings of one another (more inserts would cost more), so the least audit of
two parts is that of the first followed by that of the second, and matrices may be multiplied in any
grouping: a conversation of any length is cut into chunks wherever rows are cut into batches.

Rows are ordered by turn (nulls first), then role, then the digest of the text.  Only the last step,
which writes repaired rows in order, takes a conversation through one task, as a stream that holds
its audit and one batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, spread
from tidemark.session import cut_lineage

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # fixed values: costs of edits, and of a truncated row that stays
OK, BLANK, DUPLICATE, CUT = range(4)
OTHER = 3  # class of an initial; s, u, a are 0, 1, 2
SPACE = " \t\n\x0b\x0c\r"  # fixed values: 0x20 and 0x09-0x0D
ROUNDS, PAIRS, RULES, LONGEST = 10, 64, 512, 1024
_FIRST, _RULE = 0x41, 0x100  # symbols of rows and of rules, as characters
_FAR = 1 << 60


# --- transfer matrices -----------------------------------------------------------------


class Rope:
    """Text put together from two parts; flat only when it is asked for or short."""

    __slots__ = ("left", "right", "size", "flat")

    def __init__(self, flat: str | None, left: "Rope | None" = None, right: "Rope | None" = None):
        self.left, self.right, self.flat = left, right, flat
        self.size = len(flat) if flat is not None else left.size + right.size

    def __add__(self, other: "Rope") -> "Rope":
        if not self.size or not other.size:
            return self if self.size else other
        if self.flat is not None and other.flat is not None and self.size + other.size <= 64:
            return Rope(self.flat + other.flat)
        return Rope(None, self, other)

    def __str__(self) -> str:
        if self.flat is None:
            out, todo = [], [self]
            while todo:
                rope = todo.pop()
                if rope.flat is not None:
                    out.append(rope.flat)
                else:
                    todo += [rope.right, rope.left]
            self.flat, self.left, self.right = "".join(out), None, None
        return self.flat


Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]
_NONE = Rope("")


def better(a: Entry | None, b: Entry | None) -> Entry | None:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if str(a[1]) <= str(b[1]) else b


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = [[None] * STATES for _ in x]
    for p, row in enumerate(x):
        for middle, a in enumerate(row):
            if a is not None:
                for q, b in enumerate(y[middle]):
                    if b is not None:
                        cost, old = a[0] + b[0], out[p][q]
                        if old is None or cost <= old[0]:
                            out[p][q] = better(old, (cost, a[1] + b[1]))
    return out


def _matrix(steps: list[tuple[int, int, int, str]]) -> Matrix:
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for p, q, cost, edit in steps:
        out[p][q] = better(out[p][q], (cost, Rope(edit)))
    return out


_STAY = [(p, p, 0, "") for p in range(STATES)]
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_ONE_INSERT = _matrix(_STAY + [(p, q, INSERT, "I") for p, q in _NEXT.items()])
INSERTS = product(_ONE_INSERT, _ONE_INSERT)  # a third one would lead round


def row_matrix(initial: int, fault: int) -> Matrix:
    """Inserts ahead of a row, then one edit of it."""
    steps = [(p, p, DELETE, "D") for p in range(STATES)]
    if fault in (OK, CUT):
        stays = TRUNCATED if fault == CUT else 0
        steps += [(p, q, REROLE + stays, "R") for p, q in _NEXT.items()]
        if initial == 0:
            steps.append((START, SYSTEM, KEEP + stays, "K"))
        elif initial == 1:
            steps += [(p, USER, KEEP + stays, "K") for p in (START, SYSTEM, ASSISTANT)]
        elif initial == 2:
            steps.append((USER, ASSISTANT, KEEP + stays, "K"))
    return product(INSERTS, _matrix(steps))


def legal(before: int, after: int) -> bool:
    return (before, after) in ((0, 1), (1, 2), (2, 1))


@dataclass
class Block:
    """Consecutive rows: initials at both ends, counts of blank, duplicate, truncated and illegal, and their matrix."""

    first: int
    last: int
    counts: tuple[int, int, int, int]
    matrix: Matrix

    def __add__(self, other: "Block") -> "Block":
        counts = [a + b for a, b in zip(self.counts, other.counts)]
        counts[3] += not legal(self.last, other.first)
        return Block(self.first, other.last, tuple(counts), product(self.matrix, other.matrix))


def row_block(code: int) -> Block:
    initial, fault = divmod(code, 4)
    return Block(initial, initial, (int(fault == BLANK), int(fault == DUPLICATE), int(fault == CUT), 0), row_matrix(initial, fault))


Rules = list[tuple[str, str]]


def blocks_of(rules: Rules) -> dict[str, Block]:
    """Blocks of all symbols, rules bottom-up: a rule's parts come before it."""
    out = {chr(_FIRST + code): row_block(code) for code in range(16)}
    for k, (left, right) in enumerate(rules):
        out[chr(_RULE + k)] = out[left] + out[right]
    return out


def evaluate(sequence: str, blocks: dict[str, Block]) -> Block:
    """The block of a sequence, put together in halves."""
    parts = [blocks[c] for c in sequence]
    while len(parts) > 1:
        parts = [a + b for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1:]
    return parts[0]


# --- Re-Pair ---------------------------------------------------------------------------


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = "\0".join(batch.column(0).to_pylist())
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        left, right = codes[:-1], codes[1:]
        inside = (left > 0) & (right > 0)
        pairs, counts = np.unique(left[inside] << 32 | right[inside], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int64))], ["pair", "n"])


def disjoint(pairs: list[str], lengths: dict[str, int], room: int) -> list[str]:
    """Pairs, best first, none of which overlaps another: no symbol ends one and begins another."""
    chosen, lefts, rights = [], set(), set()
    for pair in pairs:
        a, b = pair
        if len(chosen) < room and a not in rights and b not in lefts and (a != b or a not in lefts | rights) \
                and lengths.get(a, 1) + lengths.get(b, 1) <= LONGEST:
            chosen.append(pair)
            lefts.add(a)
            rights.add(b)
    return chosen


def compress(sequences: DataFrame) -> tuple[DataFrame, Rules]:
    """``seq, short``: distinct sequences with frequent pairs replaced by rules, and the rules.

    Each round counts pairs over all sequences and replaces the PAIRS best that don't overlap;
    there are at most RULES rules, each for at most LONGEST rows.
    """
    state = cut_lineage(sequences.select("seq").distinct().withColumn("short", F.col("seq")))
    rules: Rules = []
    lengths: dict[str, int] = {}
    for _ in range(ROUNDS):
        counted = state.select("short").where(F.length("short") > 1).mapInArrow(_pairs, "pair bigint, n bigint")
        best = (counted.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
                       .orderBy(F.desc("n"), "pair").limit(PAIRS).collect())
        chosen = disjoint([chr(r.pair >> 32) + chr(r.pair & 0xFFFFFFFF) for r in best], lengths, RULES - len(rules))
        if not chosen:
            break
        short: Column = F.col("short")
        for pair in chosen:
            name = chr(_RULE + len(rules))
            rules.append((pair[0], pair[1]))
            lengths[name] = lengths.get(pair[0], 1) + lengths.get(pair[1], 1)
            short = F.replace(short, F.lit(pair), F.lit(name))
        state = cut_lineage(state.select("seq", short.alias("short")))
    return state, rules


_CELLS = [(p, q) for p in range(STATES) for q in range(STATES)]


def _evaluated(sequences: DataFrame, rules: Rules) -> DataFrame:
    """seq and its block: ends, counts, costs and audits of the 16 entries (cost _FAR: none)."""
    shared = sequences.sparkSession.sparkContext.broadcast(rules)  # at most RULES pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = blocks_of(shared.value)
        for batch in batches:
            ends, counts, costs, audits = [], [], [], []
            for short in batch.column(1).to_pylist():
                block = evaluate(short, blocks)
                cells = [block.matrix[p][q] for p, q in _CELLS]
                ends.append([block.first, block.last])
                counts.append(list(block.counts))
                costs.append([_FAR if c is None else c[0] for c in cells])
                audits.append(["" if c is None else str(c[1]) for c in cells])
            whole = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ends, whole), pa.array(counts, whole), pa.array(costs, whole),
                 pa.array(audits, pa.list_(pa.string()))], ["seq", "ends", "counts", "costs", "audits"])

    return sequences.mapInArrow(run, "seq string, ends array<bigint>, counts array<bigint>, costs array<bigint>, audits array<string>")


# --- rows ------------------------------------------------------------------------------

KEY = ["cn", "c"]  # whether the conversation's id is null, and its text
PLACE = ["tn", "t", "role", "digest"]


def read_rows(conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
              text_column: str = "text") -> DataFrame:
    """conv_id, turn, role, text; null roles and texts are one space."""
    rows = pick(conversations, conv_id=conv_column, turn=turn_column, role=role_column, text=text_column)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role"), blank("text"))


def damage(rows: DataFrame) -> DataFrame:
    """Rows damaged by the checksum of ``conv_id:turn`` modulo 20, nulls in it being one space.

    0 drops the row, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes its role user.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return (rows.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
                                         text.alias("text"), copies.alias("copy")).drop("copy"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with keys that are never null; false comes first, so null turns do."""
    return rows.select(F.col("conv_id").isNull().alias("cn"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"),
                       F.col("turn").isNotNull().alias("tn"), F.coalesce("turn", F.lit(0)).alias("t"), "role", "text",
                       F.md5("text").alias("digest"))


def _classed(rows: DataFrame) -> DataFrame:
    """Equal rows once, without their texts: class of the initial, fault by itself, number, is it the first of its text?

    Rows are summed before they are shuffled.  Only texts that occur at several turns are looked up.
    """
    tail = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    light = rows.select(*KEY, *PLACE,
                        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER).alias("initial"),
                        F.when(tail == "", BLANK).when(~F.right(tail, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(OK).alias("fault"))
    merged = cut_lineage(light.groupBy(*KEY, *PLACE).agg(F.first("initial").alias("initial"), F.first("fault").alias("fault"),
                                                         F.count(F.lit(1)).alias("n")))
    first = (merged.where(F.col("fault") != BLANK).groupBy(*KEY, "role", "digest")
                   .agg(F.min(F.struct("tn", "t")).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1").drop("turns"))
    seen = merged.join(first, [*KEY, "role", "digest"], "left")
    again = F.coalesce(F.struct("tn", "t") > F.col("first"), F.lit(False)) & (F.col("fault") != BLANK)
    return seen.select(*KEY, *PLACE, "initial", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"), "n")


CHUNK = "cn boolean, c string, tn boolean, t bigint, role string, digest string, seq string, first_turn bigint, last_turn bigint, turns bigint"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order: one sequence per conversation and batch, with its first place and its turns."""
    for batch in batches:
        size = len(batch)
        if not size:
            continue
        null, name = batch.column(0).to_numpy(zero_copy_only=False), np.array(batch.column(1).to_pylist(), object)
        has_turn, turn = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
        initial, fault, n = (batch.column(k).to_numpy().astype(np.int64) for k in (6, 7, 8))
        begin = np.ones(size, bool)
        begin[1:] = (null[1:] != null[:-1]) | (name[1:] != name[:-1])
        starts = np.flatnonzero(begin)
        stops = np.append(starts[1:], size)
        fresh = has_turn.copy()
        fresh[1:] &= begin[1:] | ~has_turn[:-1] | (turn[1:] != turn[:-1])
        turns = np.add.reduceat(fresh.astype(np.int64), starts)
        # all but the first of equal rows are duplicates, unless blank
        code = 4 * initial + fault
        later = 4 * initial + np.where(fault == BLANK, BLANK, DUPLICATE)
        symbols = np.repeat(later, n)
        at = np.cumsum(n) - n
        symbols[at] = code
        text = (symbols + _FIRST).astype(np.uint8).tobytes().decode("ascii")
        ends = np.append(at[starts], len(symbols))
        low, high = [], []
        for a, b in zip(starts.tolist(), stops.tolist()):
            own = turn[a:b][has_turn[a:b]]
            low.append(int(own[0]) if len(own) else None)
            high.append(int(own[-1]) if len(own) else None)
        firsts = batch.take(pa.array(starts))
        yield pa.RecordBatch.from_arrays(
            [*[firsts.column(k) for k in range(6)], pa.array([text[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]),
             pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(turns)],
            ["cn", "c", "tn", "t", "role", "digest", "seq", "first_turn", "last_turn", "turns"])


SUMMARY = ("cn boolean, c string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
           "audit string")


class _Fold:
    """One conversation, chunk by chunk."""

    def __init__(self):
        self.vector: Matrix = [[(0, _NONE), None, None, None]]
        self.last, self.counts = None, [0, 0, 0, 0]
        self.turns, self.low, self.high = 0, None, None

    def add(self, row: dict) -> None:
        if self.last is not None:
            self.counts[3] += not legal(self.last, row["ends"][0])
        self.last = row["ends"][1]
        self.counts = [a + b for a, b in zip(self.counts, row["counts"])]
        cells = [None if c == _FAR else (c, Rope(a)) for c, a in zip(row["costs"], row["audits"])]
        self.vector = product(self.vector, [cells[p * STATES:(p + 1) * STATES] for p in range(STATES)])
        if row["first_turn"] is not None:
            self.turns += row["turns"] - (self.high is not None and row["first_turn"] == self.high)
            self.low = row["first_turn"] if self.low is None else self.low
            self.high = row["last_turn"]

    def summary(self) -> list:
        ends = product(self.vector, INSERTS)[0]
        cost, audit = better(ends[START], ends[ASSISTANT])
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, *self.counts, cost, str(audit)]


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a conversation come together and in order; one row for each conversation."""
    names = [f.split()[0] for f in SUMMARY.split(", ")]
    kinds = [pa.bool_(), pa.string(), *[pa.int64()] * 6, pa.string()]
    key, fold = None, None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if (row["cn"], row["c"]) != key:
                if fold is not None:
                    done.append([*key, *fold.summary()])
                key, fold = (row["cn"], row["c"]), _Fold()
            fold.add(row)
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], names)
    if fold is not None:
        last = [*key, *fold.summary()]
        yield pa.RecordBatch.from_arrays([pa.array([last[k]], t) for k, t in enumerate(kinds)], names)


def _summaries(keyed: DataFrame) -> DataFrame:
    """One row of SUMMARY for each conversation that has rows."""
    rows = _classed(keyed)
    order = [*KEY, *PLACE]
    chunks = cut_lineage(rows.select(*order, "initial", "fault", "n").repartitionByRange(*order)
                             .sortWithinPartitions(*order).mapInArrow(_chunked, CHUNK))
    short, rules = compress(chunks)
    blocks = cut_lineage(_evaluated(short, rules))
    whole = chunks.join(blocks, "seq").drop("seq")
    return cut_lineage(whole.repartition(*KEY).sortWithinPartitions(*order).mapInArrow(_folded, SUMMARY))


def audit_conversations(rows: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation of ``rows``, or of ``of``.

    ``rows`` as from ``read_rows``.  A row's first fault counts: blank, duplicate (role and text seen at
    an earlier place), truncated.  ``gaps`` leaves null turns out and is 0 without turns; ``illegal`` counts
    adjacent rows whose role initials are none of su, ua, au.  A null id is a conversation of its own;
    repeated rows are duplicates.  A conversation without rows has zeros and an empty audit.
    """
    names = (rows if of is None else of).select("conv_id").distinct()
    names = names.select("conv_id", F.col("conv_id").isNull().alias("cn"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"))
    found = names.join(_summaries(_keyed(rows)), KEY, "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return cut_lineage(found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit")))


REPAIRED = "cn boolean, c string, place bigint, role string, text string, edit string"


def repair_rows(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """cn, c, place, role, text, edit: the rows of each repaired conversation, together and in order.

    ``audits`` as from ``audit_conversations``.  ``cn, c`` name the conversation: whether its id is null, and
    its text.  Deleted rows are left out, inserted ones have an empty text.
    """
    marks = audits.where(F.col("audit") != "").select(
        F.col("conv_id").isNull().alias("cn"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"),
        F.lit(0).alias("kind"), F.lit(False).alias("tn"), F.lit(0).cast("bigint").alias("t"), F.lit("").alias("role"),
        F.col("audit").alias("text"), F.lit("").alias("digest"))
    both = marks.unionByName(_keyed(rows).withColumn("kind", F.lit(1)))
    ordered = both.repartition(*KEY).sortWithinPartitions(*KEY, "kind", *PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, place = None, "", 0, START, 0
        made: list[tuple] = []

        def inserts() -> None:
            nonlocal at, state, place
            while at < len(audit) and audit[at] == "I":
                state = _NEXT[state]
                made.append((*key, place, "user" if state == USER else "assistant", "", "I"))
                at, place = at + 1, place + 1

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            out = pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(kinds)],
                                             ["cn", "c", "place", "role", "text", "edit"])
            made.clear()
            return out

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for cn, c, kind, role, text in zip(*columns):
                if kind == 0:
                    if key is not None:
                        inserts()
                    key, audit, at, state, place = (cn, c), text, 0, START, 0
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                if edit == "R":
                    state = _NEXT[state]
                    role = "user" if state == USER else "assistant"
                else:
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                made.append((*key, place, role, text, edit))
                place += 1
            yield batch_of()
        if key is not None:
            inserts()
        yield batch_of()

    return ordered.select(*KEY, "kind", "role", "text").mapInArrow(run, REPAIRED)


def digests(repaired: DataFrame) -> DataFrame:
    """cn, c, sha256: lowercase hex of ``role:text`` of the rows of each conversation, newline-joined."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for cn, c, role, text in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if (cn, c) != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (cn, c), hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "replace"))
            yield _named(done)
        if key is not None:
            yield _named([(*key, digest.hexdigest())])

    def _named(done: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.bool_(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate(kinds)], ["cn", "c", "sha256"])

    return repaired.select("cn", "c", "role", "text").mapInArrow(run, "cn boolean, c string, sha256 string")


def repair_report(conversations: DataFrame, damaged: bool = True) -> DataFrame:
    """``audit_conversations`` of all conversations, with the digest of each repaired one.

    ``damaged`` damages the rows first.  Columns other than conv_id, turn, role and text are not read; an
    empty table gives no rows; a conversation of which nothing is left has the digest of the empty string.
    """
    original = read_rows(conversations)
    rows = damage(spread(original)) if damaged else original
    audits = audit_conversations(rows, original)
    named = audits.withColumns({"cn": F.col("conv_id").isNull(), "c": F.coalesce(F.col("conv_id").cast("string"), F.lit(""))})
    found = named.join(digests(repair_rows(rows, audits)), KEY, "left")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
