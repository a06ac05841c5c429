"""Secrets in texts: fixed patterns, and literals assigned to names that promise a secret.

Method: assignment-aware lexing.  Source and configuration lines are read as name-literal
pairs: ``name = "literal"``, ``"name": "literal"``, ``name: literal``, ``export NAME=literal``,
``<name>literal</name>`` and ``name="a" + "b"``, names and literals of any length; declared types
(``name: str = "..."``, ``char name[] = "..."``), keys in brackets (``env["NAME"] = "..."``), escaped and
triple quotes, YAML blocks (``name: |``), name and value apart (``"name": "...", "value": "..."`` in JSON, YAML
or attributes), arguments (``define("NAME", "...")``) and ``ENV NAME literal``.  Lines of a literal of several
lines are literals.  A name bound to a literal is a constant;
``target = other_name`` passes the constant on, through any number of hops and without cycles.
Each literal is scored by the most sensitive name it reaches and by how random it looks; those
at ``THRESHOLD`` or more become spans of kind ``lexed``.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ids_and_texts, map_texts, spread

KINDS = ("assign", "access", "hex", "lexed")
THRESHOLD = 1.0

# Fixed patterns of the three base kinds, in any letter case where a class holds both.
_ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"
    r"|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

# Share of a secret's score that a part of the target's name gives; fixed values of this operator.
_NAME_SCORES = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6,
    "bearer": 0.8, "signature": 0.5, "salt": 0.5, "cert": 0.4, "key": 0.5, "dsn": 0.5, "conn": 0.3,
}
# Possessive: no name or literal has a longest length, and none is scanned again after a mismatch.
_NAME = r"[A-Za-z_][\w.-]*+"
_DQ = r"\"(?P<dq>(?:[^\"\\\n]++|\\.)++)\""
_SQ = r"'(?P<sq>(?:[^'\\\n]++|\\.)++)'"
_BARE = r"(?P<bare>[^\s,;\"'{}()\[\]<>]++)"
_TRIPLE = r"\"\"\"(?P<tdq>(?:[^\"]++|\"(?!\"\"))++)\"\"\"|'{3}(?P<tsq>(?:[^']++|'(?!''))++)'{3}"
_TYPE = r"\x20*+:\x20*+[A-Za-z_][\w.]*+(?:\[[\w.,\x20]*+\]|<[\w.,\x20]*+>)?\??(?=\x20*+=(?!=))"
_PAIR = re.compile(
    rf"(?:^|[\s,;{{(\[<])(?:export\s+|const\s+|let\s+|var\s+|final\s+|static\s+)*"
    rf"(?P<q>[\"']?)(?P<name>{_NAME})(?P=q)(?:\[\d*+\]|\])?(?:{_TYPE})?\x20*(?P<op>:=|=>|=(?!=)|:(?!//))\x20*"
    rf"(?:[rRbBfFuU]{{0,2}}(?:{_TRIPLE}|{_DQ}|{_SQ})|{_BARE})", re.M)
_APART = re.compile(
    rf"\b(?:name|key)[\"']?\s*+[:=]\s*+[\"']?(?P<name>{_NAME})[\"']?\s*+,?\s*+[\"']?value[\"']?\s*+[:=]\s*+(?:{_DQ}|{_SQ}|{_BARE})")
_ARGUMENT = re.compile(rf"\(\s*+(?P<q>[\"'])(?P<name>{_NAME})(?P=q)\s*+,\s*+(?:{_DQ}|{_SQ})\s*+\)")
_WORD_PAIR = re.compile(rf"^\x20*+(?:ENV|ARG|setenv)\x20++(?P<name>{_NAME})\x20++(?:{_DQ}|{_SQ}|{_BARE})", re.M)
_BLOCK = re.compile(rf"^(?P<in>\x20*+)(?:-\x20)?(?P<name>{_NAME}):\x20*+[|>][+-]?\d?\x20*+\n"
                    r"(?P<block>(?:(?P=in)\x20++[^\n]++(?:\n|\Z))++)", re.M)
_FORMS = ("tdq", "tsq", "dq", "sq", "bare", "block")
_LINE = re.compile(r"\S(?:[^\n]*\S)?")
_MORE = re.compile(r"\x20*[+.]\x20*(?:\"([^\"\n]++)\"|'([^'\n]++)')")
_TAG = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\s]++)</(?P=name)>")
_HEX_BYTES = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_IDENTIFIER = re.compile(_NAME)
_PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|<.*>|\$\{?.*|%.*|your.*|example.*|changeme|none|null|true|false)$", re.I)


_MARKS = ("=", ":", "</", "ENV ", "ARG ", "setenv ", "(")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS) or not low.isascii() and any(w in _ascii_lower(text) for w in _WORDS):
        found += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if b"\1" * 16 in text.encode("utf-8", "replace").translate(_HEX_BYTES):
        found += [(m.start(), "hex", m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 16]
    return found


def _ascii_lower(text: str) -> str:
    return text.encode("utf-8", "replace").lower().decode("utf-8", "replace")


def name_score(name: str) -> float:
    """How much a target's name promises a secret, 0 to 1."""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)
    parts = [p.lower() for p in parts]
    pairs = ["".join(p) for p in zip(parts, parts[1:])]
    return max((_NAME_SCORES.get(p, 0.0) for p in parts + pairs), default=0.0)


def randomness(literal: str) -> float:
    """0 to 1: bits per character against a random string of the same length, mixed classes count."""
    n = len(literal)
    if n < 8 or " " in literal or _PLACEHOLDER.match(literal):
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    classes = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / math.log2(min(n, 64))) * (0.55 + 0.15 * classes)


def _form(m: re.Match) -> str:
    return next(k for k in _FORMS if m.groupdict().get(k) is not None)


def _pairs(text: str) -> Iterator[re.Match]:
    """Name-literal pairs, also those inside a quoted literal: a text of any length may be one."""
    at = 0
    while m := _PAIR.search(text, at):
        yield m
        at = m.end() if m["bare"] is not None else m.start(_form(m))
    if "value" in text:
        yield from _APART.finditer(text)
    if "(" in text:
        yield from _ARGUMENT.finditer(text)
    if "ENV" in text or "ARG" in text or "setenv" in text:
        yield from _WORD_PAIR.finditer(text)
    if "|" in text or ">" in text:
        yield from _BLOCK.finditer(text)


def lexed_spans(text: str) -> list[tuple[int, str, int]]:
    """Literals whose most sensitive target and own randomness together reach ``THRESHOLD``."""
    if not any(mark in text for mark in _MARKS):
        return []
    constants: dict[str, list[tuple[int, int]]] = {}
    targets: dict[tuple[int, int], float] = {}
    links: list[tuple[str, str]] = []
    scores: dict[str, float] = {}

    def bind(name: str, start: int, end: int) -> None:
        if name not in scores:
            scores[name] = name_score(name)
        constants.setdefault(name, []).append((start, end))
        targets[start, end] = max(targets.get((start, end), 0.0), scores[name])

    for m in _pairs(text):
        kind, name = _form(m), m["name"]
        start, end = m.span(kind)
        if kind in ("tdq", "tsq", "block"):
            for line in _LINE.finditer(text, start, end):
                bind(name, *line.span())
            continue
        bind(name, start, end)
        if kind == "bare":
            if _IDENTIFIER.fullmatch(m["bare"]):
                links.append((name, m["bare"]))
        else:
            more = _MORE.match(text, end + 1)
            while more:
                bind(name, *more.span(1 if more[1] is not None else 2))
                more = _MORE.match(text, more.end())
    for m in _TAG.finditer(text):
        bind(m["name"], *m.span("value"))

    # a name's score flows to the constants it was assigned from: the most sensitive names first, and
    # again from every name that was raised
    for name in {n for pair in links for n in pair} - scores.keys():
        scores[name] = name_score(name)
    sources: dict[str, set[str]] = {}
    for target, source in links:
        if source in constants:
            sources.setdefault(target, set()).add(source)
    waiting = sorted(sources, key=scores.__getitem__)
    while waiting:
        target = waiting.pop()
        for source in sources[target]:
            if scores[target] > scores[source]:
                scores[source] = scores[target]
                if source in sources:
                    waiting.append(source)
    references = {s for _, s in links if s in constants}
    found = []
    for name, places in constants.items():
        for start, end in places:
            literal = text[start:end]
            if literal in references:
                continue  # a name, not a literal
            if max(scores[name], targets[start, end]) + randomness(literal) >= 1.0 + THRESHOLD / 2 and \
                    randomness(literal) > 0:
                found.append((start, "lexed", end))
    return found


def find_secrets(text: str) -> list[tuple[int, str, int]]:
    """Base spans, and lexed ones that base spans do not cover whole, by start and then kind.

    A lexed span may overlap base ones: a fixed pattern often ends inside the literal.
    """
    base = base_spans(text)
    starts, ends = _union(base)
    spans = list(base)
    for start, kind, end in lexed_spans(text):
        place = bisect_right(starts, start) - 1
        if place < 0 or ends[place] < end:
            spans.append((start, kind, end))
    return sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def _union(spans: list[tuple[int, str, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover together; spans that touch are one."""
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in sorted(spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, spans (kind, start, end in code points, end exclusive) of every input row.

    A null text is empty and has no span.  Repeated rows and null ids are scanned row by row;
    columns other than id and text are not read.
    """
    rows = spread(ids_and_texts(docs, id_column, text_column))
    kind = rows.schema["id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, k, e in find_secrets(t.as_py())]
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], ["id", "spans"])

    return rows.mapInArrow(scan, f"id {kind}, spans {SPANS}").withColumnRenamed("id", id_column)


def span_text(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of the spans of those kinds, comma-joined in order."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]", text_column: str = "text") -> DataFrame:
    """The same rows and columns with every found secret replaced by ``mark``; null texts stay null.

    Overlapping spans are replaced as one.  All columns pass through, whatever their names.
    """
    columns = docs.columns
    at = columns.index(text_column)
    rows = docs.toDF(*[f"c{i}" for i in range(len(columns))])

    def clean(batch: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        own = batch.column(at)
        made = pa.array([_without(t.as_py(), mark) if there else None for t, there in zip(texts, own.is_valid().to_pylist())], pa.string())
        return batch.set_column(at, batch.schema.field(at), made.cast(own.type))

    return map_texts(rows, at, clean).toDF(*columns)


def _without(text: str, mark: str) -> str:
    out, at = [], 0
    for start, _, end in find_secrets(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:] if out else text

