"""WARC: exact round trips at every range size, false magic, broken files, defined cases."""

import base64
import gzip
import hashlib
import io
import zlib
from collections import Counter

import pytest

from assaybook.llm import warc


def member(data, level=6):
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def test_every_range_size_reads_each_record_once():
    records = [warc.record("resource", f"urn:x:{i}", "d", [("A", "ü")], bytes(range(256)) * (i % 7)) for i in range(25)]
    # magic bytes inside of stored (uncompressed) members, and a gzip member that is no WARC record
    tricky = [warc.record("resource", "urn:x:m", "d", [], warc.MAGIC * 50 + member(b"no record")), b"not a record"]
    data = b"".join(member(r, level) for r, level in [*[(r, 6) for r in records], (tricky[0], 0), (tricky[1], 6), (records[3], 0)]) + b"\0" * 40
    whole = [(o, h["warc-record-id"], b) for o, _, h, b in warc.records_of_range(io.BytesIO(data), len(data), 0, len(data))]
    assert len(whole) == 27 and whole[25][2] == warc.MAGIC * 50 + member(b"no record")
    for size in (1, 7, 100, 999, 5000):
        got = [(o, h["warc-record-id"], b) for s in range(0, len(data), size) for o, _, h, b in warc.records_of_range(io.BytesIO(data), len(data), s, min(len(data), s + size))]
        assert got == whole
    with pytest.raises(ValueError, match="breaks off"):
        cut = member(warc.record("resource", "urn:x:l", "d", [], hashlib.sha256(b"x").digest() * 3000), 0)[:5000]
        list(warc.records_of_range(io.BytesIO(cut), len(cut), 0, len(cut)))


def test_pages(spark):
    rows = [(1, "http://a/é x\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", "<p>É</p>"), (4, "u", None), (5, "u", ""), (6, "u", "x" * 300_000), (None, "u", "<p>é</p>"), (None, "n", "lone"), (None, "n", "lone"), (2, "again", "<p>é</p>"), (-7, "u", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as h", "2 as sha1").repartition(3)
    latest = {}
    for i, _, h in rows:
        latest[h or ""] = max((x for x in (latest.get(h or ""), i) if x is not None), default=None)
    files = warc.write_warc(df)
    assert sum(r.records for r in files.collect()) == len(rows) + files.count()
    for size in (1000, 1 << 20):
        records = warc.read_warc(spark, files, range_bytes=size)
        got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.page_records(records).collect())
        want = Counter()
        for i, _, h in rows:
            data, best = (h or "").encode(), latest[h or ""]
            again = best is not None and i != best
            want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", best if again else None] += 1
        assert got == want
        assert all(r.digest_ok for r in records.filter("record_type = 'response'").collect())
    pages = {r.record_id: r for r in records.filter("record_type = 'response'").collect()}
    assert pages["urn:page:6"].payload == b"x" * 300_000 and pages["urn:page:3"].target_uri == "u"
    few = warc.page_records(warc.read_warc(spark, warc.write_warc(df, min_revisit_bytes=5)))
    assert few.filter("record_type = 'revisit' and payload_bytes < 5").count() == 0
    assert warc.read_warc(spark, warc.write_warc(df.limit(0))).count() == 0


def test_files_are_plain_gzip(spark):
    files = warc.write_warc(spark.createDataFrame([(1, "u", "é")], "page_id long, url string, html string")).collect()
    text = gzip.open(files[0].path.removeprefix("file:")).read().decode()
    assert text.count("WARC/1.1\r\n") == 2 and text.endswith("é\r\n\r\n")
