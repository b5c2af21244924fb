"""Archives of web captures: legacy ARC files read and converted, WARC files written and read back.

An ARC record is a header line and as many bytes as it declares. Version 1 lines have five
fields (url, ip, date, type, length), version 2 lines ten (and, between type and length: status, checksum,
location, offset, file). The first record of a file, ``filedesc://``, names the version in its body. A
converted record keeps its payload; id (from its content and place), date, type and digests are made up
to what a WARC crawler would have written.

The writing path: rows of a table become ARC records, packed into archive files by a hash of
their key; the files are converted to WARC, where payloads of at least ``SHARED_BYTES`` that are
equal are stored once, as the ``response`` of the record with the largest key, and referred to by
``revisit`` records; and the WARC files are read back. Files are written by the tasks of one Spark job to the
shared folder as rows of (name, content), the form in which ``binaryFile`` reads them too.

Records are gzip members of their own, so that a reader can start at any of them. A file holds about
``FILE_BYTES``; a record larger than that has a file of its own.

Defined results: a null payload is empty and a null url reads as ``unknown:``; blanks and controls in a url are percent-encoded, since
a header line has fields by blanks. Rows with equal keys are records of their own; of those with equal payloads one, by url, is the response. A header that
declares more bytes than are left, or does not parse, raises ``ValueError`` with its offset.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.llm.shared import bit_filter, in_filter, ready, stored

SHARED_BYTES = 1000
FILE_BYTES = 1 << 20
NAME_BITS = 1 << 20
PACKING = 4
STEP = 1 << 13
NAMES = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length")}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HEADER = re.compile(rb"([A-Za-z-]+): ?([^\r\n]*)")


@dataclass
class Capture:
    """One archived record: its header fields by lower-case name, and its body."""

    fields: dict[str, str]
    body: bytes = b""
    headers: dict[str, str] = field(default_factory=dict)


def safe_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "unknown:")


# ---- ARC


def arc_file(name: str, records: list[Capture], version: int = 1) -> bytes:
    """An ARC file of the given version; each record is a gzip member."""
    names = " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename", "length": "Archive-length"}[n] for n in NAMES[version])
    body = f"{version} 0 corpuslane\n{names}\n".encode()
    first = Capture({"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": "20240101000000", "type": "text/plain", "status": "200", "checksum": "-", "location": "-", "offset": "0", "file": name}, body)
    out = io.BytesIO()
    for record in [first, *records]:
        at = out.tell()
        values = {"status": "200", "checksum": "-", "location": "-", "file": name, "offset": str(at)} | record.fields | {"length": str(len(record.body))}
        line = " ".join(values[n] for n in NAMES[version]) + "\n"
        out.write(gzip.compress(line.encode() + record.body + b"\n", PACKING, mtime=0))
    return out.getvalue()


def arc_records(content: bytes) -> Iterator[tuple[int, Capture]]:
    """(offset of the record in the unpacked file, record) of every ARC record but the description."""
    data, at, version = b"".join(members(content)), 0, 1
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        parts = data[at:end].decode("utf-8", "replace").split(" ") if end >= 0 else []
        # the first record's line follows the form that its body is about to name
        form = next((v for v, n in NAMES.items() if len(n) == len(parts)), None)
        if form is None or (at and form != version) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header at {at}")
        fields = dict(zip(NAMES[form], parts))
        size = int(fields.pop("length"))
        body = data[end + 1 : end + 1 + size]
        if len(body) < size:
            raise ValueError(f"ARC record at {at} declares {size} bytes, {len(body)} are left")
        if fields["url"].startswith("filedesc://"):
            version = int(body.split(b" ", 1)[0])
            if version != form:
                raise ValueError(f"version {version} with a header line of version {form}")
        else:
            yield at, Capture(fields, body)
        at = end + 1 + size


def members(content: bytes) -> Iterator[bytes]:
    """Each gzip member unpacked; a file that is not packed is one. Input is fed in small steps, so
    that what follows a member is not copied again and again."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at == len(view):
                raise ValueError("a gzip member is cut off")
            step = view[at : at + STEP]
            parts.append(unpack.decompress(step))
            at += len(step)
        at -= len(unpack.unused_data)
        yield b"".join(parts)


# ---- WARC


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def iso_date(digits: str) -> str:
    """The 14-digit date of an ARC line as a WARC date; shorter ones are filled up, others become 1970."""
    filled = (digits + "19700101000000"[len(digits) :]) if digits.isdigit() and len(digits) >= 4 else "19700101000000"
    try:
        return datetime.strptime(filled[:14], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def converted(record: Capture, archive: str, offset: int) -> Capture:
    """The WARC record of an ARC record. Its block is the body as it stands: with HTTP headers, if the
    body starts with a status line, a ``response``; a bare payload is one too, its payload digest being the block's."""
    _, _, payload = http_parts(record.body)
    http = record.body.startswith(b"HTTP/")
    headers = {
        "WARC-Type": "response",
        "WARC-Record-ID": record_id(archive, str(offset), digest(record.body)),
        "WARC-Target-URI": record.fields["url"],
        "WARC-Date": iso_date(record.fields["date"]),
        "WARC-IP-Address": record.fields["ip"],
        "WARC-Payload-Digest": digest(payload),
        "WARC-Block-Digest": digest(record.body),
        "Content-Type": "application/http; msgtype=response" if http else record.fields["type"],
    }
    return Capture(record.fields, record.body, headers)


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Status line, header fields and payload of an HTTP block; a block that is none is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    status, _, lines = head.partition(b"\r\n")
    return status, {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(lines)}, payload


def revisit_of(record: Capture, target: dict[str, str]) -> Capture:
    """``record`` without its payload, referring to the record that holds an equal one."""
    status, _, payload = http_parts(record.body)
    head = record.body[: len(record.body) - len(payload)]
    headers = record.headers | {
        "WARC-Type": "revisit",
        "WARC-Profile": PROFILE,
        "WARC-Refers-To": target["id"],
        "WARC-Refers-To-Target-URI": target["url"],
        "WARC-Refers-To-Date": target["date"],
        "WARC-Block-Digest": digest(head),
    }
    return Capture(record.fields, head, headers)


def warc_member(record: Capture) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (record.headers | {"Content-Length": str(len(record.body))}).items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + record.body + b"\r\n\r\n", PACKING, mtime=0)


def warc_records(content: bytes) -> Iterator[Capture]:
    """Every record of a WARC file, unpacked member by member."""
    for data in members(content):
        head, sep, rest = data.partition(b"\r\n\r\n")
        if not sep or not head.startswith(b"WARC/1."):
            raise ValueError("no WARC header")
        headers = {k.decode(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(head.partition(b"\r\n")[2])}
        size = int(headers["Content-Length"])
        if len(rest) < size:
            raise ValueError(f"WARC record declares {size} bytes, {len(rest)} are left")
        yield Capture({}, rest[:size], headers)


# ---- tables


def sha1_hex(base32: str) -> str:
    return base64.b32decode(base32.removeprefix("sha1:")).hex()


def as_blocks(pages: DataFrame, key: str, url: str, payload: Column) -> DataFrame:
    """(key, url, body): each row as an HTTP capture."""
    raw = F.coalesce(payload.cast("binary"), F.lit(b""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(raw).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.concat(head.cast("binary"), raw).alias("body"))


def arc_archives(blocks: DataFrame, version: int = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """(name, content) of ARC files, each written in one piece by the task that gathers it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Capture] = []
        size = done = 0
        part = TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            # files of equal content are files of their own, and a task that runs again names them alike
            name = f"{part:06d}-{done:06d}.arc.gz"
            return pa.record_batch([pa.array([name]), pa.array([arc_file(name, held, version)], pa.binary())], ["name", "content"])

        for batch in batches:
            for url, body in zip(batch.column("url").to_pylist(), batch.column("body")):
                raw = body.as_py()
                if held and size + len(raw) > file_bytes:
                    yield close()
                    held, size, done = [], 0, done + 1
                held.append(Capture({"url": safe_url(url), "ip": "0.0.0.0", "date": "20240101000000", "type": "text/html"}, raw))
                size += len(raw)
        if held:
            yield close()

    ready(blocks.sparkSession)
    return blocks.select("url", "body").mapInArrow(run, "name string, content binary")


def convert(archives: DataFrame, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """(name, content) of WARC files from ARC files; equal large payloads are stored once.

    Only digests, keys and record ids are shuffled. The response of a digest is the record with the largest
    ``X-Page-Id``, then url, then record id.
    """

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                rows = []
                for at, record in arc_records(content.as_py()):
                    made = converted(record, name, at)
                    _, fields, payload = http_parts(record.body)
                    page = fields.get("x-page-id", "")
                    rows.append((name, at, made.headers["WARC-Payload-Digest"], len(payload), int(page) if page.lstrip("-").isdigit() else None, made.headers["WARC-Target-URI"], made.headers["WARC-Record-ID"], made.headers["WARC-Date"]))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["name", "at", "digest", "size", "page", "url", "rid", "date"])

    ready(archives.sparkSession)
    index = stored(archives.mapInArrow(heads, "name string, at long, digest string, size long, page long, url string, rid string, date string"), "arc-index")
    large = index.where(F.col("size") >= shared_bytes)
    best = F.max(F.struct("page", "url", "rid", "date"))
    owners = large.groupBy("digest").agg(best.alias("o"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "o.*")
    again = large.select("name", "at", "digest", F.col("rid").alias("_rid")).join(owners, "digest").where("_rid <> rid")
    refs = again.groupBy("name").agg(F.collect_list(F.struct("at", "rid", "url", "date")).alias("refs"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content, found in zip(batch.column("name").to_pylist(), batch.column("content"), batch.column("refs").to_pylist()):
                to = {r["at"]: {"id": r["rid"], "url": r["url"], "date": r["date"]} for r in found or []}
                out = io.BytesIO()
                for at, record in arc_records(content.as_py()):
                    made = converted(record, name, at)
                    out.write(warc_member(revisit_of(made, to[at]) if at in to else made))
                yield pa.record_batch([pa.array([name.removesuffix(".arc.gz") + ".warc.gz"]), pa.array([out.getvalue()], pa.binary())], ["name", "content"])

    # only archives with a revisit meet their references; the others stay where they are read
    refs = stored(refs, "warc-refs")
    named = in_filter(bit_filter(refs.select(F.xxhash64("name").alias("h")), "h", NAME_BITS))(F.xxhash64("name"))
    both = archives.where(named).join(refs, "name", "left").select("name", "content", "refs")
    none = F.lit(None).cast(refs.schema["refs"].dataType)
    both = both.unionByName(archives.where(~named).select("name", "content", none.alias("refs")))
    return both.mapInArrow(rewrite, "name string, content binary")


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with ``refers_to``, the page id of the record that a revisit refers to.

    Only referred records are joined; a record that very many refer to is a key that Spark splits.
    """
    asked = records.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("_rid")).distinct()
    targets = records.where("record_type = 'response'").select(F.col("record_id").alias("_rid"), F.col("page_id").alias("refers_to")).join(asked, "_rid")
    return records.join(targets, F.col("refers_to_id") == F.col("_rid"), "left").drop("_rid")


def read(archives: DataFrame) -> DataFrame:
    """One row for each WARC record: ids, target, date, type, digest, reference, page id and payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for record in warc_records(content.as_py()):
                    h = record.headers
                    _, fields, payload = http_parts(record.body)
                    page = fields.get("x-page-id", "")
                    if h["WARC-Type"] == "response" and digest(payload) != h["WARC-Payload-Digest"]:
                        raise ValueError(f"payload of {h['WARC-Record-ID']} does not match its digest")
                    rows.append((int(page) if page.lstrip("-").isdigit() else None, h["WARC-Record-ID"], h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Type"], sha1_hex(h["WARC-Payload-Digest"]), int(fields.get("content-length", len(payload))), h.get("WARC-Refers-To"), payload if h["WARC-Type"] == "response" else None))
                if rows:
                    kinds = (pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.binary())
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "record_id", "url", "date", "record_type", "payload_digest", "payload_bytes", "refers_to_id", "payload"])

    ready(archives.sparkSession)
    return archives.mapInArrow(run, "page_id long, record_id string, url string, date string, record_type string, payload_digest string, payload_bytes long, refers_to_id string, payload binary")
