"""WARC archives from legacy ARC archives.

Method: legacy archive converter.  ``arc_records`` parses version-specific ARC header lines and
takes as many bytes as they declare; ``convert`` synthesises the equivalent WARC record: an
identifier derived from file, offset and digest (the same on every run), the 14-digit date as a WARC
timestamp, a type from the media type and from whether an equal payload is archived already, and
SHA-1 digests.  Of equal payloads one record is the response; the others become revisits that
point at it and leave the payload out.

Both kinds of archive are written by Spark tasks through the text writer, which sends a string's
bytes unchanged: an ARC record ends with LF and a WARC record with CRLF CRLF, which are the
line separators given to it.  Part files are of bounded size and are read back whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import arc
from tidemark.llm.common import pick, text_or_empty
from tidemark.session import cut_lineage

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public namespace of URLs
FILE_BYTES = 32 << 20
_PAGE_ID = b"X-Page-Id"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- archives out of pages -----------------------------------------------------------


def _even(df: DataFrame, size, file_bytes: int) -> DataFrame:
    """Rows in partitions of about ``file_bytes``, one file each."""
    total = df.agg(F.sum(size)).first()[0] or 0
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))
    return df.repartition(parts)


def _write(records: DataFrame, path: str, end: str) -> None:
    """Rows as gzip files; level four takes a third of the default's time and writes 4 % more.

    The shuffle behind the rows, a copy of all payloads, leaves the disks with the write and not when
    the driver happens to collect its garbage.
    """
    conf = records.sparkSession.conf
    was = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        (records.select(F.col("value").cast("string").alias("value"))
                .write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "FOUR").text(path))
    finally:
        conf.unset(_CLEANUP) if was is None else conf.set(_CLEANUP, was)


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", id_column: str = "page_id",
              url_column: str = "url", payload_column: str = "html") -> None:
    """Pages as ARC files; even and odd parts are of version 1 and 2.

    The payload is the text in UTF-8 behind an HTTP header that carries the page's id.  A null
    payload is empty, a null or empty URL is ``-``, a null id leaves the header out.
    """
    rows = pick(pages, page_id=id_column, url=url_column, payload=payload_column).select(
        F.col("page_id").cast("bigint"), F.coalesce(F.col("url").cast("string"), F.lit("-")).alias("url"),
        text_or_empty("payload").cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = "12"[part % 2], f"part-{part:05d}.arc"
        head = [arc.file_header(name, date, version)]
        for batch in batches:
            for at in range(0, len(batch), 200):
                out = head
                head = []
                for page, url, payload in zip(*(batch.column(i).slice(at, 200).to_pylist() for i in range(3))):
                    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n" % len(payload)
                    if page is not None:
                        http += b"%s: %d\r\n" % (_PAGE_ID, page)
                    out.append(arc.record(url, "0.0.0.0", date, "text/html", http + b"\r\n" + payload, version, name=name))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
        if head:
            yield pa.RecordBatch.from_arrays([pa.array(head, pa.binary())], ["value"])

    _write(_even(rows, F.length("payload") + F.octet_length("url"), FILE_BYTES).mapInArrow(run, "value binary"), path, "\n")


# --- ARC to WARC ---------------------------------------------------------------------

RECORD = ("record_id string, page_id bigint, url string, ip string, date string, media string, http binary, "
          "payload binary, payload_bytes bigint, payload_digest string, block_digest string, source string")


def arc_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per ARC record below ``path`` (columns ``RECORD``); the file description is none.

    Without ``payloads`` the columns http and payload are null.
    """
    names = [f.strip().split()[0] for f in RECORD.split(",")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    types = [kinds[f.strip().split()[1]] for f in RECORD.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                held = 0
                for r in arc.parse(arc.inflate(content.as_buffer().to_pybytes())):
                    row = _row(file, r)
                    rows.append(row if payloads else row[:6] + (None, None) + row[8:])
                    held += len(r.body)
                    if held > 4 << 20:
                        yield _batch(rows, names, types)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names, types)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("name"), "content").mapInArrow(run, RECORD)


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def _row(file: str, r: arc.ArcRecord) -> tuple:
    http, payload = split_http(r.body)
    media, page = r.type, None
    for line in http.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == _PAGE_ID.lower() and value.strip().lstrip(b"-").isdigit():
            page = int(value)
    own = digest(r.body)
    name = f"{r.url} {r.date} {file} {r.offset} {own}"
    return (f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>", page, r.url, r.ip, timestamp(r.date), media, http, payload,
            len(payload), digest(payload), own, f"{file}:{r.offset}")


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its empty line, and payload; a body that is not HTTP has no header."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    at = body.find(b"\r\n\r\n")
    if at >= 0:
        return body[:at + 4], body[at + 4:]
    at = body.find(b"\n\n")
    return (body[:at + 2], body[at + 2:]) if at >= 0 else (body, b"")


def timestamp(date: str) -> str:
    """8 to 14 digits as a WARC date; what is missing is the start of the period."""
    d = date.ljust(8, "0")
    d = d + "000000"[len(d) - 8:] if len(d) < 14 else d
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """Write the ARC files below ``arc_path`` as WARC files below ``warc_path``.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with the largest page id
    (then record id; null ids last) is the response and the others revisit it.  Payloads that
    came without an HTTP header become ``resource`` records, or revisits.
    """
    records = arc_records(spark, arc_path)
    slim = cut_lineage(arc_records(spark, arc_path, payloads=False).select(
        "record_id", "page_id", "url", "date", "payload_digest", "payload_bytes"))
    order = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page"), "record_id", "url", "date")
    counted = (slim.where(F.col("payload_bytes") >= least_bytes)
                      .groupBy("payload_digest", "payload_bytes")
                      .agg(F.max(order).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    revisits = (slim.select("record_id", "payload_digest", "payload_bytes").join(counted, ["payload_digest", "payload_bytes"])
                    .where(F.col("record_id") != F.col("first.record_id"))
                    .select("record_id", F.col("first.record_id").alias("to_id"), F.col("first.url").alias("to_url"),
                            F.col("first.date").alias("to_date"), F.col("first.page").alias("to_page")))
    joined = records.join(revisits, "record_id", "left")
    whole = F.when(F.col("to_id").isNull(), F.col("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                rows = batch.slice(at, 200).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([warc_record(r) for r in rows], pa.binary())], ["value"])

    _write(joined.withColumn("payload", whole).mapInArrow(run, "value binary"), warc_path, "\r\n\r\n")


def warc_record(r: dict) -> bytes:
    """One WARC record without the CRLF CRLF that ends it."""
    revisit = r["to_id"] is not None
    kind = "revisit" if revisit else "response" if r["http"] else "resource"
    block = r["http"] + (b"" if revisit else r["payload"])
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}",
        f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}",
        f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
        f"WARC-Block-Digest: sha1:{digest(block) if revisit else r['block_digest']}",
        f"WARC-Source-Record: {r['source']}", f"WARC-Original-Payload-Length: {r['payload_bytes']}",
    ]
    if r["page_id"] is not None:
        head.append(f"WARC-Page-Id: {r['page_id']}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {r['to_id']}", f"WARC-Refers-To-Target-URI: {r['to_url']}",
                 f"WARC-Refers-To-Date: {r['to_date']}"]
        if r["to_page"] != -(1 << 63):
            head.append(f"WARC-Refers-To-Page-Id: {r['to_page']}")
    media = "application/http; msgtype=response" if r["http"] else r["media"]
    head += [f"Content-Type: {media}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


# --- WARC back -----------------------------------------------------------------------


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0:
            return
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines)}
        start = stop + 4
        end = start + int(headers["content-length"])
        yield headers, data[start:end]
        at = end


INDEX = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
         "record_id string, url string, date string, intact boolean")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per WARC record (columns ``INDEX``); ``intact``: block and payload have the stated digests."""
    names = [f.strip().split()[0] for f in INDEX.split(",")]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[f.strip().split()[1]] for f in INDEX.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for h, block in parse_warc(arc.inflate(content.as_buffer().to_pybytes())):
                    _, payload = split_http(block)
                    revisit = h["warc-type"] == "revisit"
                    stated = h["warc-payload-digest"].removeprefix("sha1:")
                    intact = h["warc-block-digest"] == f"sha1:{digest(block)}" and (revisit or digest(payload) == stated)
                    number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                    rows.append((number("warc-page-id"),
                                 number("warc-original-payload-length") if revisit else len(payload), stated,
                                 h["warc-type"], number("warc-refers-to-page-id"), h["warc-record-id"],
                                 h["warc-target-uri"], h["warc-date"], intact))
                if rows:
                    yield _batch(rows, names, types)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, INDEX)


def archive_pages(pages: DataFrame, arc_path: str, warc_path: str, least_bytes: int = 0) -> DataFrame:
    """Pages through legacy archives into WARC archives and back: the index of what was read."""
    spark = pages.sparkSession
    write_arc(pages, arc_path)
    convert(spark, arc_path, warc_path, least_bytes)
    return cut_lineage(read_warc(spark, warc_path))
