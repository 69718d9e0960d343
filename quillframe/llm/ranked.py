"""Ranked lexical search: best-first document intervals over range-maximum posting lists.

``build_index`` cuts the documents into shards of bounded size where they lie
(no shuffle); a shard is one row with its documents' sizes and, for every term,
a posting list (document, occurrences).  ``search`` adds up the corpus
statistics of all shards, turns them into term weights, and visits every shard
once per block of items, keeping each task's best documents so far.

Within a shard each posting list gets a sparse table of range maxima.  A
document interval's score is at most the sum of its terms' maxima; the interval
with the greatest bound is taken first, split at the document of maximum impact
(which is scored exactly) and its two halves are bounded anew.  Intervals of at
most ``LEAF`` documents are scored exactly, those bounded below the last kept
score are dropped.  Shards order documents by size class, so that maxima of
long documents are low, and by a fixed shuffle within a class, so that splits
are balanced and ties don't peel off one end.

Rows with null or empty texts, or texts without terms, hold nothing and are not
counted.  Every row is a document of its own, repeated rows too; equal scores
go by ascending id, null ids last.  Items are distinct (id, text) pairs:
repeated items answer once, items without terms not at all.  Other columns of
either table are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import sized, written

TOP = 10
#: A shard holds at most so many documents, and no further one beyond so many bytes of text.
SHARD_DOCS = 8192
SHARD_BYTES = 32 << 20
#: Items that one pass over the shards answers.
ITEM_BLOCK = 512
#: Terms of the items, in bytes, that may go to every task; beyond, all terms are indexed.
VOCABULARY_BYTES = 32 << 20
#: Intervals of so many documents are scored exactly; so many intervals are taken at a time.
LEAF = 32
BATCH = 64

INDEX_SCHEMA = (
    "docs array<long>, sizes array<long>, terms array<binary>, df array<int>, at array<int>, tf array<int>, n_docs long, n_terms long"
)


def _fold() -> bytes:
    """Byte table: A-Z to a-z, digits, letters and all bytes of non-ASCII characters stay, the rest becomes a blank."""
    table = bytearray(b" " * 256)
    for c in range(256):
        if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A:
            table[c] = c
        elif 0x41 <= c <= 0x5A:
            table[c] = c + 32
    return bytes(table)


FOLD = _fold()


def terms(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or b"").translate(FOLD).split()


class _Shard:
    """Documents gathered for one row of the index."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.local, self.term, self.doc, self.tf = [], [], {}, [], [], []
        self.bytes = self.n_docs = self.n_terms = 0

    def add(self, doc_id: int | None, text: bytes | None, vocabulary: frozenset | None) -> None:
        words = terms(text)
        if not words:
            return
        self.n_docs += 1
        self.n_terms += len(words)
        found = Counter(words if vocabulary is None else filter(vocabulary.__contains__, words))
        if not found:
            return
        at = len(self.ids)
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.bytes += len(text)
        self.term.extend(self.local.setdefault(w, len(self.local)) for w in found)
        self.doc.extend([at] * len(found))
        self.tf.extend(found.values())

    def row(self) -> pa.RecordBatch:
        sizes = np.array(self.sizes, np.int64)
        shuffle = np.random.default_rng(len(sizes)).permutation(len(sizes))
        order = np.lexsort((shuffle, np.frexp(sizes)[1]))
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        term, doc = np.array(self.term, np.int64), place[np.array(self.doc, np.int64)]
        by = np.lexsort((doc, term))
        df = np.bincount(term, minlength=len(self.local))
        ids = pa.array(self.ids, pa.int64()).take(pa.array(order))
        lists = (
            ids, pa.array(sizes[order]), pa.array(list(self.local), pa.binary()), pa.array(df.astype(np.int32)),
            pa.array(doc[by].astype(np.int32)), pa.array(np.array(self.tf, np.int32)[by]),
        )
        cells = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
        cells += [pa.array([self.n_docs], pa.int64()), pa.array([self.n_terms], pa.int64())]
        return pa.RecordBatch.from_arrays(cells, ["docs", "sizes", "terms", "df", "at", "tf", "n_docs", "n_terms"])


def build_index(
    docs: DataFrame,
    vocabulary: frozenset[bytes] | None = None,
    id: str = "doc_id",
    text: str = "text",
    shard_docs: int = SHARD_DOCS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Written shards of ``docs``; with ``vocabulary``, posting lists of those terms only (sizes and totals count all)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, wanted = _Shard(), shared.value
        for b in batches:
            for doc_id, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                shard.add(doc_id, body.as_py(), wanted)
                if len(shard.ids) >= shard_docs or shard.bytes >= shard_bytes:
                    yield shard.row()
                    shard = _Shard()
        if shard.n_docs:
            yield shard.row()

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("binary").alias("body"))
    return written(rows.mapInArrow(run, INDEX_SCHEMA), "lexical-index")


# ------------------------------------------------------------------ one shard

_POS = (1 << 32) - 1
_VALUE = 43  # value (20 bits) | tie-break (11 bits) | position (32 bits)


class _Lists:
    """A shard's posting lists with their range-maximum tables."""

    def __init__(self, row: dict, n: int, total: int) -> None:
        self.ids, self.null = row["docs"]
        self.d = len(self.ids)
        # 100-75 and 75 are the length normalisation's two parts, in hundredths
        m = 25 + (75 * row["sizes"].astype(object) * n // total).astype(np.int64) if total else row["sizes"]
        tf = row["tf"].astype(np.int64)
        self.at = row["at"].astype(np.int64)
        self.part = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.at])
        self.end = np.cumsum(row["df"], dtype=np.int64)
        self.start = self.end - row["df"]
        self.number = {t: i for i, t in enumerate(row["terms"])}
        self.key = np.repeat(np.arange(len(self.end)), row["df"]) * self.d + self.at
        p = len(self.at)
        tie = np.random.default_rng(p).integers(0, 1 << 11, self.d)[self.at]
        level = (self.part << _VALUE) | (tie << 32) | np.arange(p)
        self.table = np.zeros((max(1, int(max(row["df"], default=1)).bit_length()), p), np.int64)
        self.table[0] = level
        for k in range(1, len(self.table)):
            half = 1 << (k - 1)
            self.table[k, : p - half] = np.maximum(self.table[k - 1, : p - half], self.table[k - 1, half:])
        self.score = np.zeros(self.d, np.int64)

    def peak(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Range maxima of the posting ranges [lo, hi), 0 where empty."""
        k = np.maximum(np.frexp(hi - lo)[1] - 1, 0)
        last = len(self.at) - 1
        both = np.maximum(self.table[k, np.minimum(lo, last)], self.table[k, np.clip(hi - (1 << k), 0, last)])
        return np.where(hi > lo, both, 0)


class _Best:
    """The best (score, id) pairs so far, equal scores by ascending id, null ids last."""

    def __init__(self, top: int) -> None:
        self.top = top
        self.score, self.id, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        fit = score >= self.least
        if fit.any():
            s, i, z = (np.concatenate(x) for x in ((self.score, score[fit]), (self.id, ids[fit]), (self.null, null[fit])))
            by = np.lexsort((i, z, -s))[: self.top]
            self.score, self.id, self.null = s[by], i[by], z[by]


def _visit(lists: _Lists, number: np.ndarray, weight: np.ndarray, best: _Best) -> None:
    """Adds the shard's best documents for the terms ``number`` with ``weight``."""
    base = number * lists.d
    cols = np.arange(len(number))

    def bounded(lo: np.ndarray, hi: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
        peak = lists.peak(a, b)
        impact = (peak >> _VALUE) * weight
        bound = impact.sum(axis=1)
        split = lists.at[peak[np.arange(len(lo)), impact.argmax(axis=1)] & _POS]
        open_ = (bound >= best.least) & (hi > lo)
        return tuple(x[open_] for x in (lo, hi, a, b, bound, split))

    one = np.array([0])
    front = bounded(one, one + lists.d, lists.start[number][None, :], lists.end[number][None, :])
    while len(front[4]):
        bound = front[4]
        first = np.argpartition(-bound, BATCH)[:BATCH] if len(bound) > BATCH else np.arange(len(bound))
        rest = np.ones(len(bound), bool)
        rest[first] = False
        lo, hi, a, b, _, split = (x[first] for x in front)
        leaf = hi - lo <= LEAF
        if leaf.any():
            n = (b - a)[leaf].ravel()
            begin = np.cumsum(n) - n
            pos = np.repeat(a[leaf].ravel() - begin, n) + np.arange(n.sum())
            np.add.at(lists.score, lists.at[pos], lists.part[pos] * np.repeat(np.tile(weight, leaf.sum()), n))
            seen = np.unique(lists.at[pos])
            best.add(lists.score[seen], lists.ids[seen], lists.null[seen])
            lists.score[seen] = 0
        parts = [tuple(x[rest] for x in front)]
        wide = ~leaf
        if wide.any():
            lo, hi, a, b, d = lo[wide], hi[wide], a[wide], b[wide], split[wide]
            p = np.searchsorted(lists.key, base[None, :] + d[:, None])
            safe = np.minimum(p, len(lists.at) - 1)
            hit = (p < b) & (lists.at[safe] == d[:, None])
            best.add((lists.part[safe] * hit * weight).sum(axis=1), lists.ids[d], lists.null[d])
            parts += [bounded(lo, d, a, p), bounded(d + 1, hi, p + hit, b)]
        front = tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        keep = front[4] >= best.least
        front = tuple(x[keep] for x in front)


def _answers(items: dict, n: int, total: int, top: int):
    """Stream of index rows -> (query, doc, score): the best documents that the task has seen of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, best = items.value, {}
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {name: batch.column(name)[r].values for name in ("docs", "sizes", "terms", "df", "at", "tf")}
                if not len(cell["at"]):
                    continue
                ids = cell["docs"]
                row = {k: v.to_numpy(zero_copy_only=False) for k, v in cell.items() if k not in ("docs", "terms")}
                null = ids.is_null().to_numpy(zero_copy_only=False)
                lists = _Lists(row | {"docs": (ids.fill_null(0).to_numpy(), null), "terms": cell["terms"].to_pylist()}, n, total)
                for query, (words, weight) in asked.items():
                    number = np.array([lists.number.get(w, -1) for w in words], np.int64)
                    here = number >= 0
                    if here.any():
                        _visit(lists, number[here], weight[here], best.setdefault(query, _Best(top)))
        kept = [(q, b) for q, b in best.items() if len(b.score)]
        if kept:
            cells = [
                pa.array(np.concatenate([np.full(len(b.id), q) for q, b in kept])),
                pa.array(np.concatenate([b.id for _, b in kept]), mask=np.concatenate([b.null for _, b in kept])),
                pa.array(np.concatenate([b.score for _, b in kept])),
            ]
            yield pa.RecordBatch.from_arrays(cells, ["query", "doc", "score"])

    return run


def _item_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """(item, mark, term, qtf): the terms of each distinct item; ``mark`` tells texts of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, mark, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = Counter(terms(body))
                if found:
                    cells = [pa.array([x] * len(found), pa.int64()) for x in (item, mark)]
                    yield pa.RecordBatch.from_arrays(cells + [pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["item", "mark", "term", "qtf"])

    rows = items.select(F.col(f"`{id}`").cast("long").alias("item"), F.col(f"`{text}`").cast("binary").alias("body")).distinct()
    rows = rows.select("item", F.xxhash64("body").alias("mark"), "body")
    return written(rows.mapInArrow(run, "item long, mark long, term binary, qtf long"), "item-terms")


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shard_docs: int = SHARD_DOCS,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item by score, counted over all documents."""
    spark = docs.sparkSession
    asked = _item_terms(items, item_id, item_text)
    words = written(asked.select("term").distinct(), "item-vocabulary")
    size = words.agg(F.coalesce(F.sum(F.length("term") + 64), F.lit(0))).first()[0]
    vocabulary = frozenset(words.toArrow().column(0).to_pylist()) if size <= VOCABULARY_BYTES else None
    index = build_index(docs, vocabulary, id, text, shard_docs)
    whole = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("l")).first()
    df = index.select(F.inline(F.arrays_zip("terms", "df"))).groupBy(F.col("terms").alias("term")).agg(F.sum("df").alias("df"))
    rarity = F.log((F.lit(2.0) * whole["n"] + 2.0) / (F.lit(2.0) * F.col("df") + 1.0))
    weight = F.floor(F.lit(1000.0) * rarity).cast("long")
    weights = written(asked.join(sized(written(df.join(words, "term", "left_semi"), "lexical-df")), "term").withColumn("weight", weight), "lexical-weights")
    keys = weights.select("item", "mark").distinct()
    blocks = max(1, math.ceil(keys.count() / item_block))
    block = F.pmod(F.xxhash64("item", "mark"), F.lit(blocks))
    found = []
    for k in range(blocks):
        table = weights.where(block == k).select("item", "mark", "term", (F.col("qtf") * F.col("weight")).alias("w")).toArrow().to_pylist()
        names = list(dict.fromkeys((r["item"], r["mark"]) for r in table))
        number = {name: i for i, name in enumerate(names)}
        queries: dict[int, tuple] = {i: ([], []) for i in range(len(names))}
        for r in table:
            queries[number[r["item"], r["mark"]]][0].append(r["term"])
            queries[number[r["item"], r["mark"]]][1].append(r["w"])
        shared = spark.sparkContext.broadcast({i: (t, np.array(w, np.int64)) for i, (t, w) in queries.items()})
        hits = index.mapInArrow(_answers(shared, whole["n"], whole["l"], top), "query long, doc long, score long")
        # the block's own names, at most ``item_block`` rows
        own = spark.createDataFrame([(i, *name) for i, name in enumerate(names)], "query long, item long, mark long")
        found.append(hits.join(F.broadcast(own), "query"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    order = Window.partitionBy("item", "mark").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("doc").alias("doc_id"), "score")


def op11_ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


_TERM_LIST = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP11_SQL = f"""
WITH d AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n FROM (SELECT doc_id, {_TERM_LIST} AS t FROM documents) WHERE len(t) > 0),
c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
p AS (SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(any_value(docs) AS DOUBLE) + 2) / (2 * CAST(count(*) AS DOUBLE) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
q AS (SELECT item_id, unnest({_TERM_LIST}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // words))))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
