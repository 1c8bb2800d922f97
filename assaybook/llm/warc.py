"""WARC archives: a writer with one gzip member a record, and a splittable reader.

Writing: every task writes its pages to files of its own in the shared folder and reports their names
and sizes; only reported files count, so what a lost or repeated task attempt leaves behind is never
read. A page whose payload another page has too becomes a revisit record that names it.

Reading: files are cut into byte ranges. The task of a range looks for the gzip magic, decodes each
candidate until its header proves a WARC record of the stated length (gzip checks the CRC), and owns
the records that start inside its range, reading past the range's end for the last one. Magic bytes
that occur inside compressed data fail that proof and are passed over.

Defined cases: a null payload is empty; a null url gives no Target-URI header, control characters in
one are percent-encoded; a null page_id gets a record id of its own and is never referred to unless all
its equals are null too, then each stands as a response. Rows that repeat the largest page_id of their
payload are responses. An empty table gives no files and no records. A member with a valid WARC header
that breaks off at the end of a file raises an error; other bytes between records are passed over.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom import possibly_repeated
from .shared import batches, new_folder, partitions, stored

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 1 << 30  # a task starts its next file beyond this size
RANGE_BYTES = 32 << 20
RECORDS = (
    "path string, offset long, stored_bytes long, record_type string, record_id string, target_uri string, "
    "date string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean, payload binary"
)


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, record_id: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record, not yet compressed."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str | None, digest: str, refers_to: int | None, date: str) -> bytes:
    payload = (html or "").encode()
    headers = [] if url is None else [("WARC-Target-URI", _clean(url))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    record_id = f"urn:uuid:{uuid.uuid4()}" if page_id is None else f"urn:page:{page_id}"
    if refers_to is not None:
        headers.append(("WARC-Refers-To", f"<urn:page:{refers_to}>"))
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        return record("revisit", record_id, date, headers, b"HTTP/1.1 200 OK\r\n\r\n")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return record("response", record_id, date, [*headers, ("Content-Type", "application/http; msgtype=response")], http.encode() + payload)


def write_warc(pages: DataFrame, min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Writes pages (page_id, url, html, others ignored); returns the stored list of files: path, bytes, records.

    Payloads of at least min_revisit_bytes are compared; of equal ones the largest page_id is written.
    Pages that a Bloom pass shows to be alone are written where they are read, without a shuffle.
    """
    folder = new_folder(pages.sparkSession, "warc")
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha1")).withColumn("h", F.xxhash64("sha1"))
    maybe = possibly_repeated(rows, "h") & (F.coalesce(F.octet_length("html"), F.lit(0)) >= min_revisit_bytes)
    again = rows.filter(maybe)
    # stored, so that the join's own shuffle can split a payload that a third of all pages share
    latest = stored(again.groupBy("sha1").agg(F.max("page_id").alias("latest"), F.count("*").alias("n")).filter("n > 1").select("sha1", "latest"), "latest-pages")
    refers = F.when(F.coalesce(F.col("page_id") != F.col("latest"), F.col("latest").isNotNull()), F.col("latest"))
    told = again.join(latest, "sha1", "left").select("page_id", "url", "html", "sha1", refers.alias("refers_to"))
    alone = rows.filter(~maybe).select("page_id", "url", "html", "sha1", F.lit(None).cast("long").alias("refers_to"))

    def write(batches_):
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, size, n = None, "", 0, 0

        def told_file():
            return pa.record_batch({"path": pa.array([f"{folder}/{name}"]), "bytes": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

        try:
            for batch in batches_:
                for r in batch.to_pylist():
                    if out is not None and size > FILE_BYTES:
                        out.close()
                        yield told_file()
                        out = None
                    if out is None:
                        name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                        made = [record("warcinfo", f"urn:uuid:{uuid.uuid4()}", date, [("WARC-Filename", name)], b"format: WARC File Format 1.1\r\n")]
                    else:
                        made = []
                    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
                    made.append(page_record(r["page_id"], r["url"], r["html"], digest, r["refers_to"], date))
                    for x in made:
                        c = zlib.compressobj(level, zlib.DEFLATED, 31)
                        data = c.compress(x) + c.flush()
                        out.write(data)
                        size, n = size + len(data), n + 1
        finally:
            if out is not None:
                out.close()
        if out is not None:
            yield told_file()

    return stored(batches(alone.unionByName(told), write, "path string, bytes long, records long"), "warc-files")


def _parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a whole record, or None if it isn't one."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"WARC/1."):
        return None
    headers = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.decode("utf-8", "replace").partition(":")
        headers[k.strip().lower()] = v.strip()
    length = headers.get("content-length", "")
    if not length.isdecimal() or "warc-type" not in headers or len(rest) < int(length):
        return None
    return headers, rest[: int(length)]


class _Range:
    """Bytes of a file from `start` on, read in pieces as they are asked for."""

    PIECE = 1 << 20

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.base, self.buf = file, size, start, b""

    def at(self, pos: int, n: int = PIECE) -> memoryview:
        """Up to n bytes from pos; fewer at the end of the file. Positions only move forward by and large."""
        if pos < self.base or pos + n > self.base + len(self.buf):
            if not (self.base <= pos and min(pos + n, self.size) <= self.base + len(self.buf)):
                self.file.seek(pos)
                self.base, self.buf = pos, self.file.read(min(max(n, 4 * self.PIECE), self.size - pos))
        return memoryview(self.buf)[pos - self.base : pos - self.base + n]


def _member(src: _Range, pos: int) -> tuple[dict[str, str], bytes, int] | None:
    """The record whose gzip member starts at pos, and the member's end; None if there's none."""
    d, parts, at, proven = zlib.decompressobj(31), [], pos, False
    step = 4096
    while not d.eof:
        piece = src.at(at, step)
        if not len(piece):
            if proven:
                raise ValueError(f"the record at byte {pos} breaks off")
            return None
        try:
            parts.append(d.decompress(piece))
        except zlib.error:
            return None
        at, step = at + len(piece), 1 << 16
        if not proven and (head := b"".join(parts)):
            if not (b"WARC/1.".startswith(head[:7]) or head.startswith(b"WARC/1.")):
                return None
            proven = b"\r\n\r\n" in head
    parsed = _parse(b"".join(parts))
    return parsed and (*parsed, at - len(d.unused_data))


def records_of_range(file, size: int, start: int, end: int):
    """(offset, next offset, headers, block) of every record that starts in [start, end)."""
    src, pos = _Range(file, size, start), start
    while pos < end:
        window = bytes(src.at(pos, 1 << 16))
        found = window.find(MAGIC)
        if found < 0:
            if len(window) < 1 << 16:
                return
            pos += len(window) - 2  # magic may lie across the border
            continue
        pos += found
        if pos >= end:
            return
        if got := _member(src, pos):
            yield pos, got[2], got[0], got[1]
            pos = got[2]
        else:
            pos += 1


def read_warc(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Records of files (path, bytes), in the columns of RECORDS; payload is null unless asked for."""

    def read(batches_):
        for batch in batches_:
            for r in batch.to_pylist():
                fs, path = FileSystem.from_uri(r["path"])
                with fs.open_input_file(path) as file:
                    rows, held = [], 0
                    for offset, after, headers, block in records_of_range(file, r["bytes"], r["start"], min(r["bytes"], r["start"] + range_bytes)):
                        kind = headers["warc-type"]
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else b""
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        length = headers.get("x-payload-length", "")
                        rows.append({
                            "path": r["path"], "offset": offset, "stored_bytes": after - offset, "record_type": kind,
                            "record_id": headers.get("warc-record-id", "").strip("<>"), "target_uri": headers.get("warc-target-uri"),
                            "date": headers.get("warc-date"), "refers_to": headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None,
                            "payload_digest": digest, "payload_bytes": len(payload) if kind == "response" else int(length) if length.isdecimal() else None,
                            "digest_ok": digest == base64.b32encode(hashlib.sha1(payload).digest()).decode() if kind == "response" and digest else None,
                            "payload": payload if payloads else None,
                        })
                        held += len(payload) if payloads else 1000
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    s, i, l, b = pa.string(), pa.int64(), pa.bool_(), pa.binary()
    schema = pa.schema([("path", s), ("offset", i), ("stored_bytes", i), ("record_type", s), ("record_id", s), ("target_uri", s), ("date", s), ("refers_to", s), ("payload_digest", s), ("payload_bytes", i), ("digest_ok", l), ("payload", b)])
    ranges = files.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    return batches(ranges.repartition(max(1, partitions(spark)), "path", "start"), read, RECORDS)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the page records."""
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    as_long = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return records.filter(F.col("record_type").isin("response", "revisit")).select(
        as_long("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_long("refers_to").alias("refers_to"),
    )
