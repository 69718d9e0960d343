"""Hard-negative mining over segment summaries.

A vector is scaled and floored to integers, cut into 1, 4 and 16 segments, and
each segment's mean and deviation are stored beside it.  The part of an inner
product that falls into a segment of ``s`` components lies within
``s*(mean*mean' -+ dev*dev')`` (Cauchy-Schwarz on what is left of the means), so
the sums over the segments bound the score from both sides.  Pairs are bounded
segment level by segment level; only those that can still enter a list are
scored exactly, in integers.

Anchors go to the rows in blocks of ``ANCHOR_BLOCK`` (the stated query set
against all rows): every task reads its part of the stored table once per
block, keeps the best rows of each list so far, and sends on at most that many
rows a list.  Two passes a block: the anchors' positives, then for each
positive the negatives within its window of scores.

Rows with a null id, label or vector, with a null or non-finite component, or
so long (squared length of the integers beyond 2^62) that a score would not fit
64 bits, take no part.  Vectors of different lengths are never compared.  Every
row counts as it stands: repeated rows may fill several places, and an anchor
that repeats answers once a row.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import written
from quillframe.session import ship_package

SCALE = 256
LEVELS = (1, 4, 16)
ANCHOR_BLOCK = 8192
#: Rows that are bounded against a block of anchors at a time.
ROWS = 256
PAIRS = 1 << 15
#: Offers that wait before they are sorted into their lists, at least.
OFFERS = 1 << 18

STORED = "vec_id long, label long, q array<int>, mean array<double>, dev array<double>"
LOW, HIGH = -(1 << 62), 1 << 62


def _cuts(dim: int, level: int) -> np.ndarray:
    """Segment borders; shorter vectors have no more segments than components."""
    return np.linspace(0, dim, min(level, max(dim, 1)) + 1).astype(np.int64)


def summaries(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all levels, side by side, per row."""
    means, devs = [], []
    x = q.astype(np.float64)
    for level in LEVELS:
        cut = _cuts(q.shape[1], level)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            part = x[:, a:b]
            mean = part.mean(axis=1) if b > a else np.zeros(len(x))
            means.append(mean)
            devs.append(np.sqrt(((part - mean[:, None]) ** 2).mean(axis=1)) if b > a else np.zeros(len(x)))
    return np.stack(means, axis=1), np.stack(devs, axis=1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()).cast(kind))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the list column for each vector length; null lists are left out, null components NaN."""
    size = np.diff(column.offsets.to_numpy())
    there = column.is_valid().to_numpy(zero_copy_only=False)
    flat, begin = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for dim in np.unique(size[there]):
        at = np.flatnonzero(there & (size == dim))
        yield at, flat[begin[at][:, None] + np.arange(dim)]


def _rows(column: pa.Array, at: np.ndarray) -> np.ndarray:
    """The lists, all of one length, of the rows ``at``."""
    offsets = column.offsets.to_numpy()
    size = int(offsets[at[0] + 1] - offsets[at[0]])
    return column.values.to_numpy(zero_copy_only=False)[offsets[at][:, None] + np.arange(size)]


def stored(vectors: DataFrame, id: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Written table of the rows that take part: integers, segment means and deviations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_length(b.column(2)):
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * x)
                    fit = np.isfinite(x).all(axis=1) & ((x * x).sum(axis=1) < 2.0**62)
                if fit.any():
                    q = x[fit].astype(np.int64)
                    rows = pa.array(at[fit])
                    mean, dev = summaries(q)
                    cells = [b.column(0).take(rows), b.column(1).take(rows), _lists(q, pa.int32()), _lists(mean, pa.float64()), _lists(dev, pa.float64())]
                    yield pa.RecordBatch.from_arrays(cells, ["vec_id", "label", "q", "mean", "dev"])

    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    return written(rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").mapInArrow(run, STORED), "segment-summaries")


class _Lists:
    """Lists to fill, in order of their anchors (of one vector length): score windows and the best rows so far."""

    def __init__(self, ids, labels, q, mean, dev, anchor, low, high, name, size: int) -> None:
        self.ids, self.labels, self.q, self.mean, self.dev = ids, labels, q, mean, dev
        self.anchor, self.low, self.high, self.name, self.size = anchor, low, high, name, size
        self.first = np.searchsorted(anchor, np.arange(len(ids)))
        self.count = np.searchsorted(anchor, np.arange(len(ids)), "right") - self.first
        self.list, self.score, self.row = (np.empty(0, np.int64) for _ in range(3))
        self.offers, self.n_offers = [], 0
        self.weight = [np.sqrt(np.diff(_cuts(q.shape[1], level)).astype(np.float64)) for level in LEVELS]
        self.length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        #: Least score that the list still takes.
        self.least = low.copy()

    def offer(self, list_: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        if len(list_):
            self.offers.append((list_, score, row))
            self.n_offers += len(list_)
        if self.n_offers >= max(OFFERS, 2 * len(self.list)):
            self.merge()

    def merge(self) -> None:
        """Takes what was offered into the lists; ``least`` may lag behind until then, which only lets more be offered."""
        if not self.n_offers:
            return
        list_, score, row = (np.concatenate(x) for x in zip((self.list, self.score, self.row), *self.offers, strict=True))
        self.offers, self.n_offers = [], 0
        by = np.lexsort((row, -score, list_))
        list_, score, row = list_[by], score[by], row[by]
        place = np.arange(len(list_)) - np.searchsorted(list_, list_)
        keep = place < self.size
        self.list, self.score, self.row = list_[keep], score[keep], row[keep]
        full = place == self.size - 1
        self.least[list_[full]] = np.maximum(self.low[list_[full]], score[full])

    def visit(self, ids, labels, q, mean, dev, same: bool) -> None:
        """Offers the rows whose label is (not) the anchor's."""
        need = np.full(len(self.ids), HIGH)
        most = np.full(len(self.ids), LOW)
        np.minimum.at(need, self.anchor, self.least)
        np.maximum.at(most, self.anchor, self.high)
        alive = labels[:, None] == self.labels[None, :]
        alive = alive & (ids[:, None] != self.ids[None, :]) if same else ~alive
        alive &= (self.count > 0)[None, :]
        length = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
        at = 0
        for weight in self.weight:
            rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(rows):
                return
            end = at + len(weight)
            part = lambda m, which: m[which, at:end] * weight  # noqa: B023, E731
            middle = part(mean, rows) @ part(self.mean, cols).T
            spread = part(dev, rows) @ part(self.dev, cols).T
            spread += 1e-9 * length[rows][:, None] * self.length[cols][None, :] + 0.5  # rounding of the doubles
            fits = (middle + spread >= need[cols]) & (middle - spread <= most[cols])
            alive[np.ix_(rows, cols)] &= fits
            at = end
        i, j = np.nonzero(alive)
        for k in range(0, len(i), PAIRS):
            r, a = i[k : k + PAIRS], j[k : k + PAIRS]
            score = np.einsum("ij,ij->i", q[r].astype(np.int64), self.q[a].astype(np.int64))
            for n in range(int(self.count[a].max(initial=0))):
                list_ = self.first[a] + n
                ok = n < self.count[a]
                list_ = np.where(ok, list_, 0)
                ok &= (score >= self.least[list_]) & (score <= self.high[list_])
                self.offer(list_[ok], score[ok], ids[r][ok])
        self.merge()


def _filled(shared, same: bool, size: int):
    """Stream of stored rows -> (list, row, score): each list's best rows of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {dim: _Lists(**parts, size=size) for dim, parts in shared.value.items()}
        for b in batches:
            ids, labels = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            by_dim = list(_by_length(b.column(2)))
            for at, q in by_dim:
                if (own := lists.get(q.shape[1])) is None:
                    continue
                mean, dev = (_rows(b.column(k), at) for k in (3, 4))
                for s in range(0, len(at), ROWS):
                    cut = slice(s, s + ROWS)
                    own.visit(ids[at[cut]], labels[at[cut]], q[cut], mean[cut], dev[cut], same)
        for own in lists.values():
            if len(own.list):
                yield pa.RecordBatch.from_arrays([pa.array(own.name[own.list]), pa.array(own.row), pa.array(own.score)], ["list", "row", "score"])

    return run


def _ranked(table: DataFrame, lists: dict, same: bool, size: int) -> DataFrame:
    """(list, rank, row, score): each list's best rows, higher scores first, equal ones by id."""
    ship_package(table.sparkSession)
    shared = table.sparkSession.sparkContext.broadcast(lists)
    found = table.mapInArrow(_filled(shared, same, size), "list long, row long, score long")
    order = Window.partitionBy("list").orderBy(F.desc("score"), "row")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= size)


def _anchors(block: pa.Table) -> dict[int, dict]:
    """A block's anchors by vector length; each gets one list, named by its place in the block."""
    out = {}
    for b in block.to_batches():
        ids, labels = (b.column(k).to_numpy() for k in (0, 1))
        for at, q in _by_length(b.column(2)):
            n = np.arange(len(at))
            out[q.shape[1]] = {
                "ids": ids[at], "labels": labels[at], "q": q, "mean": _rows(b.column(3), at), "dev": _rows(b.column(4), at),
                "anchor": n, "low": np.full(len(at), LOW), "high": np.full(len(at), HIGH), "name": at,
            }
    return out


def _windows(anchors: dict[int, dict], best: pa.Table, low_percent: int, high_percent: int) -> tuple[dict[int, dict], list[tuple]]:
    """One list for each positive of each anchor, and (list, anchor, positive, its score)."""
    of: dict[int, list] = {}
    for r in sorted(best.to_pylist(), key=lambda r: (r["list"], r["rank"])):
        of.setdefault(r["list"], []).append((r["row"], r["score"]))
    out, names = {}, []
    for dim, own in anchors.items():
        anchor, low, high, name = [], [], [], []
        for n, place in enumerate(own["name"].tolist()):
            for row, score in of.get(place, ()):
                anchor.append(n)
                low.append(max(LOW, -(-low_percent * score // 100)))
                high.append(min(HIGH, high_percent * score // 100))
                name.append(len(names))
                names.append((len(names), int(own["ids"][n]), row, score))
        out[dim] = own | {k: np.array(v, np.int64) for k, v in (("anchor", anchor), ("low", low), ("high", high), ("name", name))}
    return out, names


def mined(
    vectors: DataFrame,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    anchor_every: int = 100,
    positives: int = 5,
    negatives: int = 5,
    low_percent: int = 80,
    high_percent: int = 100,
    scale: int = SCALE,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A positive's negatives score between ``low_percent`` and ``high_percent``
    of the positive's own score, ends included.
    """
    spark = vectors.sparkSession
    table = stored(vectors, id, label, vector, scale)
    anchors = table.where(F.col("vec_id") % anchor_every == 0)
    blocks = max(1, math.ceil(anchors.count() / anchor_block))
    found = []
    for k in range(blocks):
        block = _anchors(anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == k).toArrow().combine_chunks())
        best = _ranked(table, block, True, positives).toArrow()
        lists, names = _windows(block, best, low_percent, high_percent)
        hits = _ranked(table, lists, False, negatives)
        # the names of the block's lists: at most ``positives`` rows an anchor
        named = spark.createDataFrame(names, "list long, anchor_id long, positive_id long, positive_score long")
        found.append(hits.join(F.broadcast(named), "list"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every.select("anchor_id", "positive_id", "rank", F.col("row").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(vectors: DataFrame) -> DataFrame:
    """The contract's labels: those of ids divisible by 7 move one on, so that neighbours with another label exist."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(vectors.select("vec_id", moved.alias("label"), "embedding"))


OP12_SQL = """
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score) WHERE rank <= 5
"""
