"""Stupid-backoff language-model scores from relational n-gram counts.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, named by their XXH64.
Counts are taken over all documents.  An n-gram of two words or more that is
seen fewer than ``MIN_COUNT`` times backs off:

    S(w) = c(w) / N
    S(w | context) = c(context w) / c(context)   if c(context w) >= MIN_COUNT
                   = ALPHA * S(w | shorter)       else

An n-gram is seen only if all its parts are, so ``ln S`` is a sum over the
orders: ``ln S_1`` and, for each order k whose n-gram is seen,
``ln S_k - ln S_(k-1) - ln ALPHA`` (``ln ALPHA`` for each order above one
besides).  Every term is the logarithm of one count, and a group of all
occurrences of an n-gram g, each with the word before (p) and after it (n),
knows c(g), c(p g), c(g n) and c(p g n).  Hence one shuffle per length from two
words to ``order - 1`` gives counts and scores at once:

1. the words are counted; the ``WORDS`` most frequent ones become codes, which
   are broadcast with their counts;
2. every occurrence goes to its n-gram's bucket as codes, packed per chunk of
   texts (other words go as their hash; documents that need their counts ask for
   them afterwards, packed likewise);
3. a bucket's occurrences are grouped and counted, and their terms summed per
   chunk and document;
4. the sums meet their chunk's documents.

Words that occur once are in no seen n-gram, so the n-grams around them need no
shuffle.  They are known by being neither a code nor in a broadcast bitmap of the
other words' hashes (a few of them are taken for such words, and counted as one).  Buckets grow with the words, not with
the tasks.

Null and empty texts have no words and a null mean score.  Rows that share a
doc_id (and all rows with a null id) are scored as one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import written

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
#: Words that a task combines at a time, and words that it remembers.
BATCH_WORDS = 1_000_000
MEMO = 500_000
#: Words that have codes: 20 bytes each on every worker.
WORDS = 1 << 20
#: Bits of a hash that find its place in the bitmap of the other words that occur twice, and how many of those it is made for.
PLACE = 27
MARKED = 1 << 26
#: Occurrences of a bucket, about; buckets are a power of two, this one at least.
BUCKET = 2_000_000
LEAST_BITS = 8
#: Rare words are dealt to that power of two fewer buckets.
WORD_BITS = 3
#: Sums that a task holds before it hands them on.
HELD = 4_000_000
#: Codes of a word outside the codes, and of no word (or one that occurs once); rare words of a bucket are numbered from ``RARE_FROM``.
RARE, NONE = 0xFFFFFE, 0xFFFFFF
RARE_FROM = 1 << 24


class _Hashes:
    """Hashes of a text's words; remembers up to ``MEMO`` of them."""

    def __init__(self) -> None:
        self.memo: dict[bytes, int] = {}

    def of(self, text: bytes | None) -> np.ndarray:
        words, memo = (text or b"").lower().split(), self.memo
        if len(memo) > MEMO:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


class _Codes(_Hashes):
    """Codes of a text's words; a word without one is its hash's place in ``rare``, from ``RARE_FROM`` on."""

    def __init__(self, names: np.ndarray, codes: np.ndarray, exhaustive: bool, twice: np.ndarray | None = None) -> None:
        super().__init__()
        self.names, self.codes, self.exhaustive, self.twice, self.rare = names, codes, exhaustive, twice, []

    def of(self, text: bytes | None) -> np.ndarray:
        words, memo = (text or b"").lower().split(), self.memo
        new = [w for w in set(words) if w not in memo]
        if new:
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in new], np.uint64)
            at = np.minimum(np.searchsorted(self.names, hashes), max(0, len(self.names) - 1))
            known = self.names[at] == hashes if len(self.names) else np.zeros(len(new), bool)
            code = np.where(known, self.codes[at], NONE) if len(self.names) else np.full(len(new), NONE)
            if not self.exhaustive:
                rare = ~known
                if self.twice is not None:
                    place = hashes >> np.uint64(64 - PLACE)
                    rare &= (self.twice[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
                code[rare] = RARE_FROM + len(self.rare) + np.arange(int(rare.sum()))
                self.rare += hashes[rare].tolist()
            memo.update(zip(new, code.tolist(), strict=True))
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def forget(self) -> None:
        """Between chunks: places in ``rare`` hold for one chunk."""
        if len(self.memo) > MEMO:
            self.memo.clear()
            self.rare.clear()


def _chunks(batches: Iterator[pa.RecordBatch], hashes: _Hashes | None = None) -> Iterator[list[tuple[int | None, np.ndarray]]]:
    """Lists of (doc, word hashes or codes) of about ``BATCH_WORDS`` words."""
    hashes, held, n = hashes or _Hashes(), [], 0
    for b in batches:
        for doc, text in zip(b.column(0), b.column(1), strict=True):
            found = hashes.of(text.as_py())
            held.append((doc.as_py(), found))
            n += len(found) + 1
            if n >= BATCH_WORDS:
                yield held
                held, n = [], 0
    if held:
        yield held


def counts(docs: DataFrame) -> DataFrame:
    """(word: hash, n) of all texts of ``docs`` (doc, text), counted per chunk before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            words, n = np.unique(np.concatenate([w for _, w in chunk]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    partial = docs.mapInArrow(run, "word long, n long")
    return written(partial.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")


def _coded(vocabulary: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None], int]:
    """((hashes in order, their codes, ln count by code, bitmap of the other words that occur twice or None), least count with a code): as many words as ``most`` allows."""
    # at most the square root of twice the words: that many distinct counts
    sizes = sorted(tuple(r) for r in vocabulary.where("n > 1").groupBy("n").count().collect())
    least, n = 2, 0
    for count, words in reversed(sizes):
        n += words
        if n > most:
            least = count + 1
            break
    top = vocabulary.where(F.col("n") >= least).toArrow()
    names, n = top["word"].to_numpy().view(np.uint64), top["n"].to_numpy()
    ranked, by_name = np.lexsort((names, -n)), np.argsort(names)
    codes = np.empty(len(names), np.int32)
    codes[ranked] = np.arange(len(names))
    twice = None
    if 0 < sum(words for count, words in sizes if count < least) <= MARKED:
        place = _others(vocabulary, least).select(F.shiftrightunsigned("word", 64 - PLACE).cast("int").alias("place")).toArrow()["place"].to_numpy()
        twice = np.zeros(1 << PLACE - 3, np.uint8)
        np.bitwise_or.at(twice, place >> 3, np.left_shift(1, place & 7).astype(np.uint8))
    return (names[by_name], codes[by_name], np.log(n[ranked].astype(np.float64)), twice), least


def _others(vocabulary: DataFrame, least: int) -> DataFrame:
    """The words without a code that occur twice."""
    return vocabulary.where((F.col("n") > 1) & (F.col("n") < least))


DOC = np.dtype([("doc", "<i8"), ("n", "<i8"), ("base", "<f8")])
ADD = np.dtype([("at", "<i8"), ("value", "<f8")])
#: Stands for a null id inside the packed rows.
NO_ID = -(1 << 63)
#: Kinds of rows: a chunk's documents, sums of all its documents and of some, counts of rare words, documents that ask for their ``ln c``, occurrences.
DOCUMENTS, SUMS, ADDED, COUNTS, WANTED, OCCURRENCES = range(6)
ROW = "chunk long, kind int, name long, data binary"


def _rows(chunk, kind: int, name, data: list[bytes] | pa.Array) -> pa.RecordBatch:
    n = len(data)
    columns = [pa.array(np.broadcast_to(np.asarray(x, np.int64), n)) for x in (chunk, name)]
    data = data if isinstance(data, pa.Array) else pa.array(data, pa.binary())
    return pa.RecordBatch.from_arrays([columns[0], pa.array(np.full(n, kind, np.int32)), columns[1], data], ["chunk", "kind", "name", "data"])


def _word_buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return 1 << 32 | (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _wanted(word: np.ndarray, chunk: np.ndarray, at: np.ndarray, times: np.ndarray, bits: int) -> pa.RecordBatch:
    """A row per bucket of rare words: which documents ask for which of them, and how many times."""
    bucket = _word_buckets(word, bits)
    by = np.lexsort((at, word, chunk, bucket))
    bucket, word, chunk, at, times = (x[by] for x in (bucket, word, chunk, at, times))
    new = np.ones(len(by), bool)
    new[1:] = (word[1:] != word[:-1]) | (chunk[1:] != chunk[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(new)
    columns = [word[first].view(np.int64), chunk[first], at[first], np.add.reduceat(times, first)]
    edges = np.flatnonzero(np.diff(bucket[first], prepend=-1, append=-1))
    names = bucket[first][edges[:-1]]
    data = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        body = b"".join([c[lo:hi].astype("<i8").tobytes() for c in columns])
        data.append(np.int64(hi - lo).tobytes() + pa.compress(body, codec="zstd", asbytes=True))
    return _rows(0, WANTED, names, data)


def _counted(bits: int):
    """(word, n) -> a row per bucket and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            by = np.argsort(words.view(np.uint64))
            words, n = words[by], n[by]
            bucket = _word_buckets(words.view(np.uint64), bits)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            if len(words):
                data = [words[lo:hi].tobytes() + n[lo:hi].tobytes() for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
                yield _rows(0, COUNTS, bucket[edges[:-1]], data)

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and questions sorted by bucket and kind -> what they add to the documents; a word that isn't counted occurs once."""
    now, known, words, ln = None, [], np.empty(0, np.uint64), np.empty(0)
    for b in batches:
        for kind, name, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            raw = data.as_py()
            if name != now:
                now, known, words, ln = name, [], np.empty(0, np.uint64), np.empty(0)
            if kind == COUNTS:
                known.append(np.frombuffer(raw, np.int64).reshape(2, -1))
                continue
            if known:
                both = np.concatenate(known, axis=1)
                by = np.argsort(both[0].view(np.uint64))
                words, ln, known = both[0].view(np.uint64)[by], np.log(both[1][by].astype(np.float64)), []
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            columns = np.frombuffer(pa.decompress(pa.py_buffer(raw).slice(8), 32 * n, codec="zstd", asbytes=True), np.int64).reshape(4, n)
            word = columns[0].view(np.uint64)
            value = np.zeros(n)
            if len(words):
                place = np.minimum(np.searchsorted(words, word), len(words) - 1)
                value = np.where(words[place] == word, ln[place], 0.0) * columns[3]
            by = np.flatnonzero(value)
            by = by[np.lexsort((columns[2][by], columns[1][by]))]
            chunk, at = columns[1][by], columns[2][by]
            if not len(by):
                continue
            new = np.ones(len(by), bool)
            new[1:] = (chunk[1:] != chunk[:-1]) | (at[1:] != at[:-1])
            first = np.flatnonzero(new)
            adds = np.empty(len(first), ADD)
            adds["at"], adds["value"] = at[first], np.add.reduceat(value[by], first)
            edges = np.flatnonzero(np.concatenate(([True], chunk[first][1:] != chunk[first][:-1], [True])))
            yield _rows(chunk[first][edges[:-1]], ADDED, 0, [adds[lo:hi].tobytes() for lo, hi in zip(edges[:-1], edges[1:], strict=True)])


def _mixed(parts: list[np.ndarray], bits: int) -> np.ndarray:
    """Buckets of n-grams."""
    total = np.zeros(len(parts[0]), np.uint64)
    for k, part in enumerate(parts):
        total += (part + np.uint64(k + 1)) * np.uint64(pow(0x2545F4914F6CDD1D, k + 1, 1 << 64))
    total ^= total >> np.uint64(31)
    return ((total * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.uint16)


def _packed(codes: np.ndarray, owner: np.ndarray, rare: np.ndarray, n_docs: int) -> bytes:
    """Occurrences of a chunk: three bytes of each code (a row of ``codes`` a column), the documents as gaps, the rare words' hashes."""
    body = codes.tobytes() + np.diff(owner, prepend=0).astype("<u4").tobytes() + rare.tobytes()
    return np.array([n_docs, len(owner), len(rare), len(body)], "<i8").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    n_docs, n, n_rare, size = np.frombuffer(data, "<i8", 4).tolist()
    body = pa.decompress(pa.py_buffer(data).slice(32), size, codec="zstd", asbytes=True)
    planes = np.frombuffer(body, np.uint8, 3 * width * n).reshape(width, 3, n).astype(np.int64)
    codes = planes[:, 0] | planes[:, 1] << 8 | planes[:, 2] << 16
    owner = np.cumsum(np.frombuffer(body, "<u4", n, 3 * width * n), dtype=np.int64)
    return codes, owner, np.frombuffer(body, "<u8", n_rare, 3 * width * n + 4 * n), n_docs


def _occurrences(shared, exhaustive: bool, total: int, order: int, alpha: float, min_count: int, bits: int):
    """(doc, text) -> each chunk's documents with the terms of order one, and its n-grams by length and bucket."""
    at_total, at_alpha = math.log(max(1, total)), math.log(alpha)

    def grams(codes: np.ndarray, hashes: np.ndarray, owner: np.ndarray, left: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        there = codes != NONE
        inside = left >= length
        for k in range(length):
            inside &= np.append(there[k:], np.zeros(min(k, len(there)), bool))
        at = np.flatnonzero(inside)
        if not len(at):
            return
        key = np.where(codes == RARE, hashes, codes.astype(np.uint64))
        bucket = _mixed([key[at + k] for k in range(length)], bits)
        by = np.argsort(bucket, kind="stable")
        at, bucket = at[by], bucket[by]
        first = np.ones(len(codes), bool)
        first[1:] = owner[1:] != owner[:-1]
        around = order > length
        place = [at + k for k in range(-1, length + 1)]
        none = np.full(len(at), NONE, codes.dtype)
        columns = [codes[p] for p in place[1:-1]]
        columns.insert(0, np.where(first[at], NONE, codes[place[0]]) if around else none)
        columns.append(np.where(left[at] > length, codes[np.minimum(place[-1], len(codes) - 1)], NONE) if around else none)
        columns = np.stack(columns).astype("<u4")
        planes = np.stack([(columns >> np.uint32(s)).astype(np.uint8) for s in (0, 8, 16)], axis=1)
        is_rare = columns == RARE if not exhaustive else None
        edges = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1, append=1 << 20))
        of = owner[at]
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rare = np.empty(0, np.uint64)
            if is_rare is not None:
                some = [hashes[p[lo:hi][is_rare[c, lo:hi]]] for c, p in enumerate(place)]
                rare = np.concatenate(some)
            yield int(bucket[lo]), planes[:, :, lo:hi], of[lo:hi], rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, code_of, logs, twice = shared.value
        known, task, number = _Codes(names, code_of, exhaustive, twice if min_count > 1 else None), TaskContext.get().partitionId(), 0
        logs = np.append(logs, 0.0)
        for chunk in _chunks(batches, known):
            lengths = np.array([len(w) for _, w in chunk])
            codes = np.concatenate([w for _, w in chunk])
            out_of = codes >= RARE_FROM
            hashes = np.zeros(len(codes), np.uint64)
            if out_of.any():
                hashes[out_of] = np.array(known.rare, np.uint64)[codes[out_of] - RARE_FROM]
                codes[out_of] = RARE
            known.forget()
            owner = np.repeat(np.arange(len(chunk)), lengths)
            left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
            docs = np.empty(len(chunk), DOC)
            docs["doc"], docs["n"] = [NO_ID if d is None else d for d, _ in chunk], lengths
            words = np.bincount(owner, logs[np.where(codes < RARE, codes, len(logs) - 1)], len(chunk)) if len(codes) else np.zeros(len(chunk))
            k = np.minimum(order - 1, lengths)  # the words before each word, as far as the order goes
            docs["base"] = words - lengths * at_total + (k * (k - 1) // 2 + (lengths - k) * (order - 1)) * at_alpha
            # a chunk that is computed again is known by its documents
            name = np.int64(np.uint64(xxhash.xxh64_intdigest(docs[["doc", "n"]].tobytes() + np.array([task, number]).tobytes())).view(np.int64))
            number += 1
            yield _rows(name, DOCUMENTS, name, [docs.tobytes()])
            if out_of.any():
                n_rare = int(out_of.sum())
                yield _wanted(hashes[out_of], np.full(n_rare, name), owner[out_of], np.ones(n_rare, np.int64), bits - WORD_BITS)
            for length in range(2, max(3, order) if order > 1 else 2):
                rows = [(length << 32 | b, _packed(c, of, rare, len(chunk))) for b, c, of, rare in grams(codes, hashes, owner, left, length)]
                if rows:
                    yield _rows(name, OCCURRENCES, [b for b, _ in rows], [d for _, d in rows])

    return run


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group of each in that order, size of its group) of equal keys."""
    by = np.argsort(keys)
    ordered = keys[by]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    group = np.cumsum(new) - 1
    return by, group, np.diff(np.append(np.flatnonzero(new), len(keys)))[group]


def _terms(shared, total: int, order: int, alpha: float, min_count: int, bits: int):
    """Rows sorted by name -> the terms of the n-grams' occurrences, summed per chunk and document; other rows as they are."""
    at_total, at_alpha = math.log(max(1, total)), math.log(alpha)

    def bucket_sums(length: int, parts: list[tuple[int, bytes]], logs: np.ndarray):
        columns, owners, rare, sizes, n_rare = [], [], [], [], 0
        for _, data in parts:
            codes, owner, hashes, n_docs = _unpacked(data, length + 2)
            if len(hashes):
                codes[codes == RARE] = RARE_FROM + n_rare + np.arange(len(hashes))
                rare.append(hashes)
                n_rare += len(hashes)
            columns.append(codes)
            owners.append(owner + sum(sizes[-1:]))
            sizes.append(n_docs + sum(sizes[-1:]))
        columns, slot = np.concatenate(columns, axis=1), np.concatenate(owners)
        names = np.empty(0, np.uint64)
        if rare:
            names, place = np.unique(np.concatenate(rare), return_inverse=True)
            is_rare = columns >= RARE_FROM
            columns[is_rare] = RARE_FROM + place[columns[is_rare] - RARE_FROM]
        before, words, after = columns[0], columns[1:-1], columns[-1]
        gram = words[0]
        for k in range(1, length):
            by, group, n = _runs(gram << 32 | words[k])
            if k < length - 1:
                gram = np.empty(len(by), np.int64)
                gram[by] = group
        seen = n >= min_count
        by, gram, n = by[seen], group[seen], np.log(n[seen].astype(np.float64))
        before, after, slot = before[by], after[by], slot[by]
        terms, x = np.zeros(len(by)), words[0][by]
        x_times, y_times = np.full(len(by), -1), np.full(len(by), -1)
        if length == 2:
            y = words[1][by]
            ln_x, ln_y = (np.where(w < RARE_FROM, logs[np.where(w < RARE_FROM, w, 0)], 0.0) for w in (x, y))
            terms += n - ln_x - ln_y + (at_total - at_alpha)

        def longer(word: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Which of ``some`` are in a seen n-gram with ``word``, and its ln count."""
            if not len(some):
                return some, np.empty(0)
            order_, _, size = _runs(word[some])
            often = size >= min_count
            return some[order_[often]], np.log(size[often].astype(np.float64))

        if order > length:
            with_before, with_after = gram << 32 | before, gram << 32 | after
            at, ln_n = longer(with_before, np.flatnonzero(before != NONE))
            terms[at] += ln_n - n[at] - at_alpha
            if length == 2:
                terms[at] += ln_x[at]
                x_times[at] += 1
            after_at, _ = longer(with_after, np.flatnonzero(after != NONE))
            terms[after_at] -= n[after_at]
            if order > length + 1:
                both = np.zeros(len(by), bool)
                both[at] = True
                both[after == NONE] = False
                some = np.flatnonzero(both)
                if len(some):
                    order_, pair, _ = _runs(with_before[some])
                    around = np.empty(len(by), np.int64)
                    around[some[order_]] = pair
                    at, _ = longer(around << 32 | after, some)
                    terms[at] += n[at]
        sums = np.bincount(slot, terms, sizes[-1]).astype(np.float64)  # no occurrences give integers
        wanted = []
        if length == 2 and len(names):
            for word, times in ((x, x_times), (y, y_times)):
                at = np.flatnonzero((word >= RARE_FROM) & (times != 0))
                wanted.append((names[word[at] - RARE_FROM], slot[at], times[at]))
        return sums, np.array(sizes), wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = np.append(shared.value[2], 0.0)
        held: dict[int, np.ndarray] = {}
        asked: list[tuple] = []
        size = 0

        def done(name: int, parts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            nonlocal size
            sums, ends, wanted = bucket_sums(name >> 32, parts, logs)
            chunks = np.array([c for c, _ in parts], np.int64)
            for chunk, lo, hi in zip(chunks.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                if chunk in held:
                    held[chunk] += sums[lo:hi]
                else:
                    held[chunk] = sums[lo:hi].copy()
                    size += hi - lo
            if wanted:
                hashes, slot, times = (np.concatenate(c) for c in zip(*wanted, strict=True))
                if len(hashes):
                    part = np.searchsorted(ends, slot, "right")
                    asked.append((hashes, chunks[part], slot - np.append(0, ends)[part], times))
                    size += 4 * len(hashes)
            if size > HELD:
                yield from flushed()

        def flushed() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for lo in range(0, len(chunks := list(held)), 500):
                some = chunks[lo : lo + 500]
                yield _rows(some, SUMS, 0, [held[c].tobytes() for c in some])
            if asked:
                yield _wanted(*(np.concatenate(c) for c in zip(*asked, strict=True)), bits - WORD_BITS)
            held.clear()
            asked.clear()
            size = 0

        now, parts = None, []
        for b in batches:
            occurs = b.column(1).to_numpy() == OCCURRENCES
            if not occurs.all():
                yield b.filter(pa.array(~occurs))
            b = b.filter(pa.array(occurs))
            for chunk, name, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if name != now and parts:
                    yield from done(now, parts)
                    parts = []
                now = name
                parts.append((chunk, data.as_py()))
        if parts:
            yield from done(now, parts)
        yield from flushed()

    return run


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, kind, data) sorted by chunk and kind -> (doc, total, n)."""

    def out(docs: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(docs["doc"].copy()), pa.array(total), pa.array(docs["n"].copy())], ["doc", "total", "n"])

    now, docs, total = None, None, None
    for b in batches:
        for chunk, kind, data in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if kind == DOCUMENTS:
                if docs is not None:
                    yield out(docs, total)
                now, docs = chunk, np.frombuffer(data, DOC)
                total = docs["base"].copy()
            elif chunk != now:
                raise ValueError("the texts came in another order when a task ran again")
            elif kind == SUMS:
                total += np.frombuffer(data, np.float64)
            else:
                adds = np.frombuffer(data, ADD)
                total[adds["at"]] += adds["value"]  # a document once a row
    if docs is not None:
        yield out(docs, total)


def scored(
    docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT, words: int = WORDS
) -> DataFrame:
    """(doc, n_words, log_score): the summed ``ln S`` over the words of each id's texts."""
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("text"))
    vocabulary = counts(rows)
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    coded, least = _coded(vocabulary, min(words, RARE))
    shared = docs.sparkSession.sparkContext.broadcast(coded)
    bits = min(16, max(LEAST_BITS, math.ceil(math.log2(max(1, total) / BUCKET))))
    exhaustive = least == 2 and min_count > 1  # a word without a code occurs once and is in no seen n-gram
    found = rows.mapInArrow(_occurrences(shared, exhaustive, total, order, alpha, min_count, bits), ROW)
    terms = found.repartition("name").sortWithinPartitions("name").mapInArrow(_terms(shared, total, order, alpha, min_count, bits), ROW)
    if not exhaustive:
        terms = written(terms, "lm-terms")
        rare = _others(vocabulary, least).mapInArrow(_counted(bits - WORD_BITS), ROW)
        asked = terms.where(F.col("kind") == WANTED).unionByName(rare)
        answers = asked.repartition("name").sortWithinPartitions("name", "kind").mapInArrow(_answers, ROW)
        terms = terms.where(F.col("kind") != WANTED).unionByName(answers)
    terms = terms.select("chunk", "kind", "data")
    sums = terms.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(_totals, "doc long, total double, n long")
    by_doc = sums.groupBy("doc").agg(F.sum("n").alias("n_words"), F.sum("total").alias("log_score"))
    return by_doc.withColumn("doc", F.when(F.col("doc") != NO_ID, F.col("doc")))


def op1_lm_scores(docs: DataFrame) -> DataFrame:
    """Per document: words, summed and mean ``ln S`` (rounded to six places)."""
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return scored(docs).select(F.col("doc").alias("doc_id"), "n_words", F.round("log_score", 6).alias("log_score"), mean.alias("mean_score"))
