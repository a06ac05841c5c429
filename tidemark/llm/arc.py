"""Legacy archive files (ARC 1 and 2): written from pages, parsed record by record."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

# Fixed header fields of the two versions, in order.
FIELDS = {
    b"1": ("url", "ip", "date", "type", "length"),
    b"2": ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"),
}
NAMES = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
_DATE = re.compile(rb"\d{14}|\d{12}|\d{10}|\d{8}")
_DESCRIBES = re.compile(rb"[12] \d+ [^\n]*\nURL IP-address ")


@dataclass
class ArcRecord:
    """One record: the header's fields and the network document they declare."""

    version: str
    url: str
    ip: str
    date: str
    type: str
    body: bytes
    offset: int
    whole: bool  # False: the file ended before the declared length


def inflate(data: bytes) -> bytes:
    """All members of a gzip file; anything else as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, view = [], 0, memoryview(data)
    while view[at:at + 2] == b"\x1f\x8b":
        # slices grow with the member: what is read beyond its end is never more than the member
        member, step = zlib.decompressobj(31), 512
        while not member.eof and at < len(view):
            out.append(member.decompress(view[at:at + step]))
            at, step = min(len(view), at + step), min(2 * step, 1 << 20)
        if not member.eof:
            break
        at -= len(member.unused_data)
    return b"".join(out)


def header_fields(line: bytes, version: bytes) -> dict[str, bytes] | None:
    """The fields of a header line of this version, or None if it is none.

    A URL may hold spaces: the last fields are split off from the right.
    """
    names = FIELDS[version]
    cut = line.rsplit(b" ", len(names) - 1)
    if len(cut) != len(names):
        return None
    found = dict(zip(names, cut))
    if not found["length"].isdigit() or not _DATE.fullmatch(found["date"]):
        return None
    return found


def parse(data: bytes) -> Iterator[ArcRecord]:
    """Records of one file.  The ``filedesc`` record says which version's header lines follow.

    Header lines may have any length.  A line that is no header (damage, or bytes beyond a length
    that was declared too short) is skipped up to the next line that is one.  Files without
    ``filedesc`` are read by the number of fields.  A file description is the first record of a file,
    unless that is an HTTP response, or, where files were joined, a later record whose body states
    a version and its field names; other records whose URL begins with ``filedesc://`` are pages.
    """
    version, at, size = None, 0, len(data)
    while at < size:
        stop = data.find(b"\n", at)
        if stop < 0:
            return
        line = data[at:stop].rstrip(b"\r")
        about = line.startswith(b"filedesc://") and _describes(data, at, stop + 1)
        if about:
            found = header_fields(line, b"1") or header_fields(line, b"2")
        elif version:
            found = header_fields(line, version)
        else:
            found = header_fields(line, b"2") or header_fields(line, b"1")
        if not found:
            at = stop + 1
            continue
        start = stop + 1
        end = start + int(found["length"])
        if about:
            version = data[start:start + 1] if data[start:start + 1] in FIELDS else b"1"
        else:
            own = version or (b"2" if "result" in found else b"1")
            yield ArcRecord(own.decode(), found["url"].decode("utf-8", "replace"), found["ip"].decode("ascii", "replace"),
                            found["date"].decode(), found["type"].decode("ascii", "replace"), data[start:end], at,
                            end <= size)
        at = end


def _describes(data: bytes, at: int, start: int) -> bool:
    """Whether the ``filedesc`` record at ``at``, with its body at ``start``, is a file description."""
    return bool(_DESCRIBES.match(data, start)) or at == 0 and not data.startswith(b"HTTP/", start)


def file_header(name: str, date: str, version: str) -> bytes:
    """The ``filedesc`` record without the line feed that ends it."""
    key = version.encode()
    body = key + b" 0 tidemark\n" + NAMES[key] + b"\n"
    rest = b"%d" % len(body) if version == "1" else b"200 - - 0 %s %d" % (name.encode(), len(body))
    return b"filedesc://%s 0.0.0.0 %s text/plain %s\n%s" % (name.encode(), date.encode(), rest, body)


def record(url: str, ip: str, date: str, kind: str, body: bytes, version: str, checksum: str = "-",
           name: str = "-") -> bytes:
    """One record without the line feed that ends it; white space in the URL is percent-encoded."""
    url = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    middle = f"{len(body)}" if version == "1" else f"200 {checksum} - 0 {name} {len(body)}"
    return f"{url} {ip} {date} {kind} {middle}\n".encode() + body
