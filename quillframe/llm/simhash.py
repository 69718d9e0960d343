"""SimHash near-duplicates linked through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments A, B, C (22, 21, 21 bits), each
read as a word of the perfect binary Golay code [23, 12, 7].  A word's keys are
the 12-bit indices of all codewords within distance 4: one index if its coset
leader weighs at most 2, else six.  Two words at most 2 bits apart share a key,
since the codeword nearest to a word half way lies within 4 of both.

At most 4 bits differ in all, so (pigeonhole over the segments' errors)
either two segments X, Y hold (0 errors, at most 2 errors), or every segment
has one or two.  Keys are therefore, for the ordered pairs X, Y, the exact X
with each key of Y (33 bits), and the triples of keys of A, B, C (36 bits).
Candidates share a key and are verified by the number of differing bits.

Copies collapse first: links are searched between distinct fingerprints.  Keys
are dealt by hash and each bucket is compared in one sorted stream; a bucket of
more than ``BUCKET`` fingerprints goes to a second pass that cuts it into
blocks by hash and compares all pairs of blocks in separate tasks.  Tight
families are linked by chains, so the links written stay linear in the rows.

A text without words (empty, null) has fingerprint zero and is linked like any
other.  ``component_id`` is the least doc_id reachable; null ids never name a
component (a component of null ids only has a null id).  Repeated rows share
their fingerprint, hence their component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import fresh, sized, written
from quillframe.llm.components import connected

SHINGLE = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints of one key that a single task compares.
BUCKET = 8192
BLOCK = 1 << 16

#: Generator polynomial of the Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.  Fixed value.
GENERATOR = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64; words are runs without ASCII white space, A-Z lower-cased."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        cut = zip(starts[at : min(at + BLOCK, n)].tolist(), last[at : at + BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in cut], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc, fp): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc", "fp"])

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc long, fp long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the 12 message bits; per syndrome, the error patterns of weight at most 4 (padded) and their number."""
    remainder = np.zeros(1 << 12, np.int64)
    for bit in range(12):
        r = 1 << (bit + 11)
        for k in range(bit + 11, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        step = 1 << bit
        remainder[step : 2 * step] = remainder[:step] ^ r
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            patterns[(e & 0x7FF) ^ int(remainder[e >> 11])].append(e)
    number = np.array([len(p) for p in patterns])
    table = np.array([p + [p[0]] * (6 - len(p)) for p in patterns], np.int64)
    return remainder, table, number


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Six columns of 12-bit indices of the codewords within distance 4 of each 23-bit word, and which are meant."""
    remainder, table, number = _golay()
    syndrome = (words & 0x7FF) ^ remainder[words >> 11]
    return (words[:, None] ^ table[syndrome]) >> 11, np.arange(6) < number[syndrome][:, None]


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, fingerprints): every key of every uint64 fingerprint."""
    segments = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [golay_keys(s) for s in segments]
    keys, owners = [], []
    for kind, (x, y) in enumerate((x, y) for x in range(3) for y in range(3) if x != y):
        index, meant = near[y]
        key = (np.int64(kind) << 58) | (segments[x][:, None] << 12) | index
        keys.append(key[meant])
        owners.append(np.broadcast_to(fps[:, None], meant.shape)[meant])
    for i, j, k in product(range(6), repeat=3):
        meant = near[0][1][:, i] & near[1][1][:, j] & near[2][1][:, k]
        key = (np.int64(6) << 58) | (near[0][0][:, i] << 24) | (near[1][0][:, j] << 12) | near[2][0][:, k]
        keys.append(key[meant])
        owners.append(fps[meant])
    return np.concatenate(keys), np.concatenate(owners)


def _links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what lies within ``max_bits`` under one key; rows are sorted by (key, fp)."""
    same = key[1:] == key[:-1]
    if not same.any():
        return fp[:0], fp[:0]
    near = same & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= max_bits)
    found = [(fp[:-1][near], fp[1:][near])]
    breaks = np.concatenate(([0], np.cumsum(~near)))
    at, d = np.flatnonzero(same), 2
    while len(at := at[at + d < len(key)]) and len(at := at[key[at + d] == key[at]]):
        # what a chain of links already connects needs no link of its own
        open_ = at[breaks[at + d] > breaks[at]]
        hit = open_[np.bitwise_count(fp[open_ + d] ^ fp[open_]) <= max_bits]
        found.append((fp[hit], fp[hit + d]))
        d += 1
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _compare(max_bits: int, most: int | None):
    """Stream of (key, fp) sorted by both -> (a, b, hot): links, or the rows of buckets beyond ``most`` (key, fp)."""

    def out(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
        flags = pa.array(np.full(len(a), hot))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), flags], ["a", "b", "hot"])

    def unique(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
        return out(pairs[:, 0].copy(), pairs[:, 1].copy(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp, hot_key = np.empty(0, np.int64), np.empty(0, np.uint64), None
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if hot_key is not None:
                n = int(np.searchsorted(key, hot_key, "right"))
                yield out(key[:n], fp[:n], True)
                key, fp = key[n:], fp[n:]
            if not len(key):
                continue
            hot_key = None
            n = int(np.searchsorted(key, key[-1], "left"))  # the last key's rows may go on
            yield unique(*_links(key[:n], fp[:n], max_bits))
            key, fp = key[n:], fp[n:]
            if most and len(key) > most:
                hot_key = key[-1]
                yield out(key, fp, True)
                key, fp = key[:0], fp[:0]
        yield unique(*_links(key, fp, max_bits))

    return run


def _compared(keys: DataFrame, max_bits: int, most: int | None) -> DataFrame:
    dealt = keys.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_compare(max_bits, most), "a long, b long, hot boolean")


def links(nodes: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of ``nodes``; chains stand for tight families."""
    if max_bits > 4:
        raise ValueError("the keys find all links up to 4 differing bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2000):
                key, owner = fuzzy_keys(fps[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner.view(np.int64))], ["key", "fp"])

    keys = nodes.select("fp").mapInArrow(emit, "key long, fp long")
    first = written(_compared(keys, max_bits, bucket), "simhash-links")
    hot = first.where("hot").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    # an (almost always empty) second pass over the buckets that one task should not hold
    blocks = F.ceil(F.col("n") / bucket).cast("int")
    parts = hot.join(hot.groupBy("key").agg(F.count("*").alias("n")), "key").withColumn("blocks", blocks)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = parts.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = pairs.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp")
    second = _compared(cut, max_bits, None)
    return first.where("NOT hot").select("a", "b").unionByName(second.select("a", "b")).distinct()


def grouped(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc, fp, component_id): one row per input row."""
    prints = written(fingerprints(docs, id, text, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc").alias("doc")), "simhash-nodes")
    roots = written(connected(links(nodes, max_bits)), "simhash-roots")
    linked = roots.join(nodes, roots["node"] == nodes["fp"]).select("fp", "root", "doc")
    least = linked.groupBy("root").agg(F.min("doc").alias("component_id"))
    labels = nodes.join(linked.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp", "left")
    labels = labels.select("fp", F.coalesce("component_id", "doc").alias("component_id"))
    return prints.join(labels, "fp", "left").select("doc", "fp", "component_id")


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The input rows whose id names their component.

    Rows that repeat a kept id are cut to one (``dropDuplicates`` over those
    rows only); rows with a null id can't be named as copies and stay.
    """
    gone, twice = fresh(docs, "_gone"), fresh(docs, "_twice")
    labels = written(grouped(docs, id, text, shingle, max_bits), "simhash-labels").where("doc IS NOT NULL")
    by_doc = labels.groupBy("doc").agg(F.bool_and(F.col("doc") != F.col("component_id")).alias("_g"), F.count("*").alias("_n"))
    marked = written(by_doc.where("_g OR _n > 1").select(F.col("doc").alias("_doc"), F.col("_g").alias(gone), (F.col("_n") > 1).alias(twice)), "simhash-gone")
    joined = docs.join(sized(marked.withColumnRenamed("_doc", fresh(docs, "_doc"))), F.col(f"`{id}`") == F.col(fresh(docs, "_doc")), "left")
    kept = joined.where(~F.coalesce(F.col(gone), F.lit(False)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = kept.where(~F.coalesce(F.col(twice), F.lit(False))).select(*columns)
    return single.unionByName(kept.where(F.col(twice)).select(*columns).dropDuplicates([id]))


def op6_simhash(docs: DataFrame) -> DataFrame:
    print_ = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return grouped(docs).select(F.col("doc").alias("doc_id"), print_, "component_id")
