"""Exact repeats of ``LENGTH`` bytes, removed after the first occurrence, over a prefix-free parse.

A rolling hash over ``TRIGGER`` bytes fires about every ``EVERY`` bytes; the
text between two firings, with the second trigger, is a phrase.  Every string
of LENGTH bytes that starts inside a phrase lies in the phrase's context (the
phrase and what the parse goes on with), and whether a trigger fires depends on
the bytes alone, so equal strings are parsed alike wherever they stand.  Hence

1. a phrase whose context stood in an earlier document is repeated at each of its starts;
2. a string is not repeated if it holds HEAD bytes from a phrase's start on (or,
   where no phrase starts early enough in it, up to a trigger's end) that occur
   once in the corpus;
3. only what is left (first contexts, all such parts known twice) is put in
   corpus order by the digest of its truncated suffix: each class of equal
   suffixes keeps its first start.

So highly repetitive text costs an entry per phrase, not per byte.  Entries of
both steps are dealt by hash in packed columns, a row per batch and bucket, and
go through one shuffle each; a bucket is grouped in one task.  Equality is that
of 128-bit digests.  Only the first copy of equal texts is parsed; later
copies of LENGTH bytes or more go whole.

A start is earlier if its doc_id is smaller, or in the same text; null ids come
last.  Rows that share an id (or have none) stand side by side: what repeats
between them only stays.  A repeated row (same id and text) is the same
document and repeats its result.  Null and empty texts have no bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import sized, written

LENGTH = 100
TRIGGER = 8
EVERY = 20
#: Bytes of a phrase's head or tail; a string whose phrases start in its first LENGTH - HEAD bytes holds their heads.
HEAD = 54
LAST = (1 << 63) - 1
MIX = np.uint64(0x9E3779B97F4A7C15)


def cuts(raw: np.ndarray, every: int = EVERY) -> np.ndarray:
    """Starts of the phrases of ``raw`` (uint8): 0 and every trigger."""
    n = len(raw) - TRIGGER + 1
    if n <= 0:
        return np.zeros(1, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(TRIGGER):
        h |= raw[k : k + n].astype(np.uint64) << np.uint64(8 * k)
    h *= MIX
    h ^= h >> np.uint64(29)
    h *= MIX
    fired = np.flatnonzero((h >> np.uint64(33)) % np.uint64(every) == 0)
    return np.concatenate(([0], fired[fired > 0]))


def _ends(starts: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate((starts[1:], [size]))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


#: Digests that are taken at a time, entries that are packed at a time (about), and buckets that they are dealt to (a power of two).
ROWS = 200_000
ENTRIES = 1_000_000
BITS = 9


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit integers, equally long; the hashes first, then what is in order in most places, as gaps."""
    body = b"".join([c.tobytes() for c in columns[:2]] + [np.diff(c, prepend=0).tobytes() for c in columns[2:]])
    return np.array([len(columns[0]), len(columns)], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data, np.int64, 2).tolist()
    columns = np.frombuffer(pa.decompress(pa.py_buffer(data).slice(16), 8 * n * width, codec="zstd", asbytes=True), np.int64).reshape(width, n)
    return np.concatenate((columns[:2], np.cumsum(columns[2:], axis=1)))


PACKED = "bucket int, doc long, tie long, data binary"


def _batch(bucket, doc, tie, data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    bucket = pa.array(np.broadcast_to(np.asarray(bucket, np.int32), n))
    doc, tie = (pa.array(np.broadcast_to(np.asarray(x, np.int64), n)) for x in (doc, tie))
    return pa.RecordBatch.from_arrays([bucket, doc, tie, pa.array(data, pa.binary())], ["bucket", "doc", "tie", "data"])


def _dealt(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Tuples of equally long arrays, dealt by the first one: a row per bucket for about ``ENTRIES`` entries."""
    held, n = [], 0

    def rows() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        bucket = (columns[0].view(np.uint64) >> np.uint64(64 - BITS)).astype(np.uint16)
        by = np.argsort(bucket, kind="stable")
        columns, bucket = [c[by] for c in columns], bucket[by]
        edges = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1, append=1 << 20))
        return _batch(bucket[edges[:-1]], 0, 0, [_packed([c[lo:hi] for c in columns]) for lo, hi in zip(edges[:-1], edges[1:], strict=True)])

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= ENTRIES:
            yield rows()
            held, n = [], 0
    if n:
        yield rows()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray | None, pa.RecordBatch | None]]:
    """Rows sorted by bucket -> the entries of each bucket; rows without a bucket (null) as they are."""
    now, held = None, []
    for b in batches:
        if b.column(0).null_count:
            yield None, b.filter(b.column(0).is_null())
            b = b.filter(b.column(0).is_valid())
        for bucket, data in zip(b.column(0).to_pylist(), b.column(3), strict=True):
            if bucket != now and held:
                yield np.concatenate(held, axis=1), None
                held = []
            now = bucket
            held.append(_unpacked(data.as_py()))
    if held:
        yield np.concatenate(held, axis=1), None


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where another value of the ordered columns begins."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _least(by: np.ndarray, new: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The first document of each entry's group, entries in the order ``by``, a group's documents in order."""
    return doc[by][np.flatnonzero(new)][np.cumsum(new) - 1]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for b in batches:
        for row in zip(*b.columns, strict=True):
            yield [x.values.to_numpy() if isinstance(x, pa.ListScalar) and x.is_valid and pa.types.is_integer(x.type.value_type) else x.as_py() for x in row]


def _phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text) -> an entry per phrase: its head's and its context's hash, and where it starts; after a long one also the tail up to its trigger (~ where)."""
    hashed = xxhash.xxh3_64_intdigest

    def parts() -> Iterator[tuple]:
        for doc, tie, text in _texts(batches):
            starts = cuts(np.frombuffer(text, np.uint8))
            ends, at, n = _ends(starts, len(text)).tolist(), starts.tolist(), len(starts)
            head = _signed([hashed(text[s : s + HEAD]) for s in at])
            # seeded by the length: a context cut short by the text's end is no other's
            context = _signed([hashed(text[s : e + LENGTH - 1], seed=e - s) for s, e in zip(at, ends, strict=True)])
            yield head, context, np.full(n, doc), np.full(n, tie), starts
            after = starts[1:][np.diff(starts) > LENGTH - HEAD]
            tail = _signed([hashed(text[s + TRIGGER - HEAD : s + TRIGGER], seed=1) for s in after.tolist()])
            yield tail, np.zeros(len(after), np.int64), np.full(len(after), doc), np.full(len(after), tie), ~after

    return _dealt(parts())


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of phrases by bucket -> (doc, tie, mark) of the heads and tails that occur twice."""
    for entries, _ in _grouped(batches):
        head, context, doc, tie, pos = entries
        by = np.lexsort((doc, context, head))
        n = np.diff(np.append(np.flatnonzero(_new(head[by])), len(by)))
        twice = np.repeat(n, n) > 1
        mark = np.where(pos[by] < 0, pos[by], pos[by] * 2 + (doc[by] > _least(by, _new(head[by], context[by]), doc)))
        yield pa.RecordBatch.from_arrays([pa.array(c[twice]) for c in (doc[by], tie[by], mark)], ["doc", "tie", "mark"])


def _flags(starts: np.ndarray, marks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which phrases' heads are known to occur twice, which stand in an earlier document's context, and which tails before them occur twice; a mark is 2 * start + gone, or ~start."""
    known, gone, tails = (np.zeros(len(starts), bool) for _ in range(3))
    if marks is not None and len(marks):
        tails[np.searchsorted(starts, ~marks[marks < 0])] = True
        marks = marks[marks >= 0]
        at = np.searchsorted(starts, marks >> 1)
        known[at] = True
        gone[at] = marks & 1
    return known, gone, tails


def _open_starts(size: int, starts: np.ndarray, known: np.ndarray, gone: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Starts left to step 3: valid, not in a phrase that is gone, holding no head (without heads, no tail) that occurs once."""
    p = np.arange(max(0, size - LENGTH + 1))
    if not len(p):
        return p
    once = ~known
    once[:1] = False  # no trigger before it
    before = np.concatenate(([0], np.cumsum(once)))
    first = np.searchsorted(starts, p, "left")
    full = np.searchsorted(starts, p + LENGTH - HEAD, "right")  # the heads of the phrases from first on and before this one are in the string
    tail = np.append(tails, True)[first] | (np.append(starts, size)[first] > p + LENGTH - TRIGGER)
    own = np.searchsorted(starts, p, "right") - 1
    return p[(before[full] == before[first]) & ((first < full) | tail) & ~gone[own]]


def _places(places: np.ndarray) -> bytes:
    return np.array([len(places)], np.int64).tobytes() + pa.compress(np.diff(places, prepend=0).tobytes(), codec="zstd", asbytes=True)


def _read_places(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    return np.cumsum(np.frombuffer(pa.decompress(pa.py_buffer(data).slice(8), 8 * n, codec="zstd", asbytes=True), np.int64))


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, tie, text, marks) -> entries of the open starts' digests in two halves; without a bucket, those that stood in this text before."""
    digest = xxhash.xxh3_128_digest
    again_in: list[tuple[int, int, bytes]] = []

    def parts() -> Iterator[tuple]:
        for doc, tie, text, marks in _texts(batches):
            starts = cuts(np.frombuffer(text, np.uint8))
            open_ = _open_starts(len(text), starts, *_flags(starts, marks))
            n = len(open_)
            halves = np.empty((n, 2), np.int64)
            for lo in range(0, n, ROWS):
                raw = b"".join([digest(text[s : s + LENGTH]) for s in open_[lo : lo + ROWS].tolist()])
                halves[lo : lo + ROWS] = np.frombuffer(raw, np.int64).reshape(-1, 2)
            by = np.lexsort((open_, halves[:, 1], halves[:, 0]))  # this text's suffixes in order
            again = np.zeros(n, bool)
            again[by[1:]] = (halves[by[1:]] == halves[by[:-1]]).all(axis=1)
            if again.any():
                again_in.append((doc, tie, _places(open_[again])))
            once = ~again
            yield halves[once, 0], halves[once, 1], np.full(n, doc)[once], np.full(n, tie)[once], open_[once]

    for rows in _dealt(parts()):
        yield rows
        if again_in:
            yield _hits_batch(again_in)
            again_in.clear()
    if again_in:
        yield _hits_batch(again_in)


def _hits_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    doc, tie, data = (list(c) for c in zip(*rows, strict=True))
    out = _batch(0, doc, tie, data)
    return out.set_column(0, "bucket", pa.nulls(len(rows), pa.int32()))


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of suffixes by bucket -> (doc, tie, places) of those that stood in an earlier document; rows without a bucket as they are."""
    for entries, rest in _grouped(batches):
        if rest is not None:
            yield rest
            continue
        h1, h2, doc, tie, pos = entries
        by = np.lexsort((doc, h2, h1))
        hit = by[doc[by] > _least(by, _new(h1[by], h2[by]), doc)]
        hit = hit[np.lexsort((pos[hit], tie[hit], doc[hit]))]
        if len(hit):
            firsts = np.flatnonzero(_new(doc[hit], tie[hit]))
            ends = np.append(firsts[1:], len(hit))
            yield _hits_batch([(int(doc[hit[lo]]), int(tie[hit[lo]]), _places(pos[hit[lo:hi]])) for lo, hi in zip(firsts.tolist(), ends.tolist(), strict=True)])


def runs_of(size: int, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (start, end) of the bytes covered by LENGTH bytes from each of ``repeated``."""
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, repeated, 1)
    np.add.at(change, repeated + LENGTH, -1)
    covered = np.concatenate(([0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]))
    edges = np.diff(covered)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


OUT = "doc long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, marks, hits) -> the counts and the bytes that stay."""
    names = [c.split()[0] for c in OUT.split(", ")]
    types = [pa.int64()] * 4 + [pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    rows, held = [], 0
    for doc, text, marks, hits in _texts(batches):
        starts = cuts(np.frombuffer(text, np.uint8))
        _, gone, _ = _flags(starts, marks)
        ends = np.minimum(_ends(starts, len(text)), len(text) - LENGTH + 1)
        spans = [np.arange(s, e) for s, e in zip(starts[gone].tolist(), ends[gone].tolist(), strict=True)]
        lo, hi = runs_of(len(text), np.unique(np.concatenate([np.empty(0, np.int64), *map(_read_places, hits or ()), *spans])))
        kept = b"".join(text[s:e] for s, e in zip([0, *hi.tolist()], [*lo.tolist(), len(text)], strict=True))
        rows.append((doc, len(text), len(text) - len(kept), len(lo), kept))
        held += len(kept)
        if len(rows) >= 1000 or held >= 1 << 23:
            yield batch(rows)
            rows, held = [], 0
    if rows:
        yield batch(rows)


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc: id, n_bytes, n_removed, n_spans, kept: the bytes that stay), one row per input row."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    base = docs.select(F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(LAST)).alias("doc"), body.alias("text")).withColumn("digest", F.sha2("text", 256))
    ids = written(base.select("doc", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "repeat-ids")
    copies = written(ids.groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeat-copies")
    shared = written(ids.distinct().groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.lit(True).alias("is_shared")), "repeat-shared-ids")

    first = base.join(sized(copies), "digest", "left").where("least IS NULL OR least = doc").join(sized(shared), "doc", "left")
    tie = F.when(F.col("is_shared"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    texts = first.select("doc", tie.alias("tie"), "digest", "text")

    long_texts = texts.where(F.octet_length("text") >= LENGTH)
    phrases = long_texts.select("doc", "tie", "text").mapInArrow(_phrases, PACKED)
    known = phrases.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_marks, "doc long, tie long, mark long")
    marks = written(known.groupBy("doc", "tie").agg(F.array_sort(F.collect_set("mark")).alias("marks")), "repeat-marks")

    # both uses of ``marked`` read the same columns and rows, so the texts are shuffled once
    marked = texts.select("doc", "tie", "text").join(marks, ["doc", "tie"], "left")
    suffixes = marked.select("doc", "tie", "text", "marks").mapInArrow(_suffixes, PACKED)
    # rows without a bucket are dealt by document
    dealt = suffixes.repartition(F.coalesce("bucket", "doc")).sortWithinPartitions("bucket")
    hits = dealt.mapInArrow(_classes, PACKED).groupBy("doc", "tie").agg(F.collect_list("data").alias("hits"))

    cut = marked.join(hits, ["doc", "tie"], "left").select("doc", "text", "marks", "hits").mapInArrow(_cut, OUT)
    later = ids.join(sized(copies), "digest").where("least < doc")
    whole = F.col("n_bytes") >= LENGTH
    short = base.join(sized(copies), "digest").where(F.octet_length("text") < LENGTH).where("least < doc").select("doc", "text")
    gone = later.where(whole).select("doc", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(b"").alias("kept"))
    zero = F.lit(0).cast("long")
    stays = short.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("text").alias("kept"))
    rows = cut.unionByName(gone).unionByName(stays)
    return rows.withColumn("doc", F.when(F.col("doc") != LAST, F.col("doc")))


def op5_suffix_dedup(docs: DataFrame) -> DataFrame:
    done = deduplicated(docs)
    return done.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """The same result for rows of distinct, non-null ids, by a dictionary of all strings."""
    seen, out = set(), []
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        repeated = []
        for s in range(len(raw) - LENGTH + 1):
            if raw[s : s + LENGTH] in seen:
                repeated.append(s)
            seen.add(raw[s : s + LENGTH])
        lo, hi = runs_of(len(raw), np.array(repeated, np.int64))
        kept = b"".join(raw[s:e] for s, e in zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True))
        out.append((doc, len(raw), len(raw) - len(kept), len(lo), hashlib.sha256(kept).hexdigest()))
    return out
