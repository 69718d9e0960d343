"""WARC round trips: verified payloads, exact headers, revisits, odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quillframe.llm import warc
from quillframe.session import scratch_path

PAGE = "page_id long, url string, html string"
BIG = "<p>é\r\n\r\nWARC/1.1\r\n\r\n</p>" * 20
ROWS = [
    (1, "http://a/ b\r\nX: y", BIG), (2, None, BIG), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "", ""),
    (7, "u", "x" * 99), (8, "u", "x" * 99), (9, "u", "x" * 100), (10, "u", "x" * 100), (12, "u", "\r\n\r\n" * 40), (11, "u", "\r\n\r\n" * 40), (13, "u", "z" * 3_000_000),
]


def test_query(spark):
    got = {r["page_id"]: tuple(r)[1:] for r in warc.op2_warc(spark.createDataFrame(ROWS, PAGE).repartition(3)).collect()}
    least = {}
    for i, _, h in sorted(ROWS, key=lambda r: r[0]):
        raw = (h or "").encode()
        first = least.setdefault(raw, i) if len(raw) >= 100 else i
        want = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first)
        assert got[i] == want, i
    assert len(got) == len(ROWS)


def test_store(spark):
    rows = [(i, u, (h or "").encode()) for i, u, h in ROWS] + [(20, "bin", bytes(range(256))), (21, "bin", bytes(range(256))), (9, "u", b"x" * 100)]
    docs = spark.createDataFrame(rows, "page_id long, url string, payload binary")
    path = scratch_path(spark, "warc-test")
    warc.write_warc(docs, path)
    headers, payloads = warc.store(spark, path)
    assert payloads.count() == len({p for _, _, p in rows}) and headers.count() == len(rows)
    assert payloads.where(F.sha2("payload", 256) != F.col("digest")).count() == 0
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    import gzip

    written = b"".join(gzip.decompress(f["content"]) for f in files)
    records = [r["record"] for r in warc.restored(headers, payloads).collect()]
    assert sum(map(len, records)) == len(written) and all(bytes(r) in written for r in records)


def test_rows(spark):
    rows = [(None, "u", "n" * 200), (None, "u", "n" * 200), (None, "u", BIG), (4, "u", BIG), (4, "u", BIG), (5, "u", BIG)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], PAGE + ", digest string")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.op2_warc(docs).collect()), key=str)
    want = [(4, "response", None)] * 2 + [(5, "revisit", 4), (None, "response", None), (None, "response", None), (None, "revisit", 4)]
    assert got == sorted(want, key=str)
    assert warc.op2_warc(docs.limit(0)).count() == 0


def test_damage():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 2\r\n\r\n"
    assert list(warc.records_in(iter([good[:9], good[9:] + b"a", b"b\r\n\r\n"]))) == [(good, b"ab")]
    for bad in (good + b"a", good + b"ab\r\n", good[:20], good + b"abc\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records_in(iter([bad])))
    with pytest.raises(ValueError):
        warc._parsed(good, b"ab")


def _foreign(i, kind, block, extra=()):
    head = [f"WARC/1.0\r\nWARC-Type:{kind}", f"WARC-Record-ID: <urn:uuid:{i}>", "WARC-Date: 2020-01-31T00:00:00Z", *extra, f"content-length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """A gzip member per record, other record types and digests: every record comes back byte for byte."""
    import base64
    import gzip

    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>\r\n\r\n\xff\x00\r\n</p>\r\r\n\r\n\r"
    sha1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
    digests = (f"WARC-Payload-Digest: {sha1(http.split(chr(13).encode() + b'\n\r\n', 1)[1])}", f"WARC-Block-Digest: {sha1(http)}", "Content-Type: application/http; msgtype=response")
    records = [_foreign(0, "warcinfo", b"software: x\r\n"), _foreign(1, "request", b"GET / HTTP/1.1\r\n\r\n"), _foreign(2, "response", http, digests),
               _foreign(3, "revisit", b"", (f"WARC-Payload-Digest: {sha1(b'x')}", f"WARC-Profile: {warc.PROFILE}")), _foreign(4, "resource", b"y" * 300_000), _foreign(5, "metadata", b"")]
    folder = tmp_path / "archives"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (folder / "b.warc.gz").write_bytes(gzip.compress(b"".join(records[:3])))
    headers, payloads = warc.store(spark, str(folder))
    got = sorted(bytes(r["record"]) for r in warc.restored(headers, payloads).collect())
    assert got == sorted(records + records[:3])
    damaged = tmp_path / "damaged"
    damaged.mkdir()
    for name, bad in (("digest", records[2].replace(b"<p>", b"<q>")), ("short", records[4][:-9]), ("cut", records[0][:20]), ("more", records[1] + b"trailing")):
        (damaged / name).mkdir()
        (damaged / name / "x.gz").write_bytes(gzip.compress(bad))
        (damaged / name / "y.gz").write_bytes(gzip.compress(records[0]))
        with pytest.raises(Exception, match="WARC|digest"):
            warc.read_warc(spark, str(damaged / name)).collect()


def test_records_are_valid(spark):
    """Every record states the format's mandatory fields; revisits their profile."""
    docs = spark.createDataFrame([(i, u, (h or "").encode()) for i, u, h in ROWS], "page_id long, url string, payload binary")
    path = scratch_path(spark, "warc-valid")
    warc.write_warc(docs, path, "2020-01-31T00:00:00Z")
    for r in warc.read_warc(spark, path).collect():
        f = warc._fields(bytes(r["header"]))
        assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= f.keys() and f["warc-date"] == "2020-01-31T00:00:00Z"
        assert (f.get("warc-profile") == warc.PROFILE) == (r["record_type"] == "revisit")
