"""WARC archives over a content-addressed payload store.

``write_warc`` writes one WARC/1.1 record per row.  Of records with equal
payloads of at least ``MIN_REVISIT`` bytes, the one with the least id is a
response and the others are revisits without a block; smaller payloads are all
responses.  The records go through Spark's text sink with the record end
(CR LF CR LF) as line separator, so the part files are gzipped WARC files.

``read_warc`` streams such files, and those of other writers, with a gzip
member a record or one a file: Spark's text source inflates them and hands over
the pieces between record ends, which a task puts together record by record
(Content-Length, not the separator, ends a block).  No file is held whole, so
files may have any size; a record must fit into memory.  ``store`` verifies
each block against the SHA-256 or SHA-1 that its record states, keeps every
block once under its SHA-256 and the exact header bytes in a table of their
own; ``restored`` joins both and returns the original records byte for byte,
``payloads_of`` the payload behind each record.

Only digests and ids are shuffled to find revisits; the table of repeated
digests is broadcast while small, else it is a shuffle join that AQE splits on
a hot payload.

Null payloads are empty.  Rows that repeat the least id of a payload are
responses too (the store still holds the payload once).  A null id never is
the least; a payload held by null ids only is a response in each of them.
Header values have line breaks and spaces percent-encoded.  Records of other
writers have no page_id unless they are named ``<urn:page:N>``; their revisits
that state no SHA-256 have no digest and no payload.  Damaged files (short or
wrong blocks, missing record ends) raise an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import sized, written
from quillframe.session import scratch_path

MIN_REVISIT = 100
END = "\r\n\r\n"
#: Records, and bytes of blocks, handed on at a time.
BATCH = 500
BATCH_BYTES = 8 << 20
#: What a revisit without a block states (a fixed value of the format).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "header binary, payload binary, page_id long, digest string, record_type string, refers_to long, block_bytes long"


def revisits(rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, url, payload) with ``digest`` and ``keeper``: the id of the response a row revisits, else null."""
    keyed = rows.withColumn("digest", F.sha2("payload", 256))
    large = keyed.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
    groups = large.agg(F.min("page_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1 AND _least IS NOT NULL").drop("_n")
    marked = keyed.join(sized(written(groups, "warc-repeats")), "digest", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("_least"))
    return marked.withColumn("keeper", F.when(F.col("_least").isNotNull() & other, F.col("_least"))).drop("_least")


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def record(length: Column, date: str) -> Column:
    """The header block of a row of ``revisits``, up to and with its empty line; ``date``: as in 2020-01-31T00:00:00Z."""
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\\x00-\\x20]", "%20")
    revisit = F.col("keeper").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    refers = F.when(revisit, _header("WARC-Refers-To", urn(F.col("keeper")))).otherwise("")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _header("WARC-Record-ID", urn(F.col("page_id"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", url),
        refers,
        F.when(revisit, _header("WARC-Profile", F.lit(PROFILE))).otherwise(""),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _header("Content-Length", F.when(revisit, F.lit(0)).otherwise(length).cast("string")),
        F.lit("\r\n"),
    )


def write_warc(rows: DataFrame, path: str, date: str | None = None) -> None:
    """``rows`` (page_id long, url string, payload binary) as gzipped WARC files in the new folder ``path``; ``date``: now."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.when(F.col("keeper").isNull(), F.col("payload").cast("string")).otherwise("")
    lines = revisits(rows).select(F.concat(record(F.octet_length("payload"), date), body).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").text(path)


def records_in(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header block, content block) of each record of one WARC file."""
    buffer, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        del buffer[:at]
        at = 0
        part = next(chunks, None)
        buffer.extend(part or b"")
        return part is not None

    while True:
        while (end := buffer.find(b"\r\n\r\n", at)) < 0:
            if not more():
                if buffer[at:].strip():
                    raise ValueError("truncated WARC header")
                return
        header = bytes(buffer[at : end + 4])
        stated = _fields(header)
        if not {"warc-type", "content-length"} <= stated.keys():
            raise ValueError("WARC header cut short, or other bytes between records")
        size = int(stated["content-length"])
        at = end + 4
        while len(buffer) < at + size + 4:
            if not more():
                raise ValueError("truncated WARC block")
        yield header, bytes(buffer[at : at + size])
        if buffer[at + size : at + size + 4] != b"\r\n\r\n":
            raise ValueError("WARC block without its end")
        at += size + 4


def _fields(header: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in header.decode("utf-8", "replace").split("\r\n")[1:] if line)
    return {k.lower(): v.strip() for k, _, v in pairs}


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.isascii() and digits.isdigit() or digits[:1] == "-" and digits[1:].isdigit() else None


def _agrees(block: bytes, stated: str | None) -> bool:
    """Whether a block has the digest that is stated (none, or of another algorithm: nothing to say)."""
    name, _, value = (stated or "").partition(":")
    if name.lower() not in ("sha256", "sha1"):
        return True
    raw = hashlib.new(name.lower(), block).digest()
    return value.lower() == raw.hex() or value.upper() == base64.b32encode(raw).decode()


def _parsed(header: bytes, block: bytes) -> tuple:
    f = _fields(header)
    kind, stated = f["warc-type"], f.get("warc-payload-digest")
    # of a captured reply the payload is what follows its own headers
    payload = block.partition(b"\r\n\r\n")[2] if f.get("content-type", "").lower().startswith("application/http") else block
    whole = kind == "revisit" or _agrees(payload, stated)
    if not whole or not _agrees(block, f.get("warc-block-digest")):
        raise ValueError(f"block of {f.get('warc-record-id')} does not have its digest")
    if kind == "revisit" and not block:
        digest = stated.partition(":")[2].lower() if (stated or "").lower().startswith("sha256:") else None
        return header, None, _number(f.get("warc-record-id")), digest, kind, _number(f.get("warc-refers-to")), 0
    return header, block, _number(f.get("warc-record-id")), hashlib.sha256(block).hexdigest(), kind, _number(f.get("warc-refers-to")), len(block)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the WARC files (``*.gz``) in ``path``, blocks verified; without ``payload`` that column is null."""

    def pieces(batches: Iterator[pa.RecordBatch], files: list[str]) -> Iterator[bytes]:
        """The bytes of one file after the other; an empty piece ends a file, whose name ``files`` then holds."""
        for b in batches:
            for name, value in zip(b.column(1).to_pylist(), b.column(0), strict=True):
                if files[0] not in ("", name):
                    yield b""
                files[0] = name
                yield value.as_py() + END.encode()  # what the source took away
        yield b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        files, rows, held = [""], [], 0
        stream = pieces(batches, files)
        for first in stream:
            if not first:
                continue
            for header, block in records_in(_one_file(first, stream)):
                row = _parsed(header, block)
                rows.append(row if payload else (row[0], None, *row[2:]))
                held += len(block) if payload else 0
                if len(rows) >= BATCH or held >= BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    # gzip can't be split: a file's lines come in order in one partition
    lines = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", END).text(path)
    return lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file")).mapInArrow(run, RECORD)


def _one_file(first: bytes, stream: Iterator[bytes]) -> Iterator[bytes]:
    """``first`` and the pieces up to the next empty one."""
    yield first
    for piece in stream:
        if not piece:
            return
        yield piece


def store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, payloads) of the archives in ``path`` as two written tables: exact headers, and each payload once by digest."""
    headers = written(read_warc(spark, path, payload=False).drop("payload"), "warc-headers")
    blocks = read_warc(spark, path).where("payload IS NOT NULL").select("digest", "payload")
    payloads = written(blocks.groupBy("digest").agg(F.first("payload").alias("payload")), "warc-payloads")
    return headers, payloads


def payloads_of(headers: DataFrame, payloads: DataFrame, **columns: Column) -> DataFrame:
    """``headers`` with ``columns`` (over ``payload``) of the payload behind each record, revisits included."""
    return headers.join(payloads.select("digest", *[c.alias(n) for n, c in columns.items()]), "digest", "left")


def restored(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """``headers`` with ``record``: the original bytes, header, block and record end."""
    full = headers.join(payloads, "digest", "left")
    block = F.when(F.col("block_bytes") > 0, F.col("payload")).otherwise(F.lit(b""))
    return full.withColumn("record", F.concat("header", block, F.lit(END.encode()))).drop("payload")


def op2_warc(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back into the store, and report every record's full payload."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")), path)
    headers, payloads = store(spark, path)
    size, digest = F.octet_length("payload").cast("long"), F.sha2("payload", 256)
    full = payloads_of(headers.drop("header", "block_bytes"), payloads, payload_bytes=size, payload_digest=digest)
    return full.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = f"""
    WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    m AS (SELECT *, CASE WHEN payload_bytes >= {MIN_REVISIT} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS least FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN least <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN least <> page_id THEN least END AS refers_to FROM m"""
