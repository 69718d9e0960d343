"""SentencePiece encoding and decoding by a relational lattice.

Encoding: a text gets one leading space and is cut into words (a run of spaces
and what follows up to the next space or line break; a line break alone).
The distinct words of a block of texts are exploded into substrings no longer
than the longest piece and equi-joined to the broadcast piece table; the
matched edges, in order by word, are folded into the best path (Viterbi), many
words at a time.  The words' ids then take the words' places in the texts.
All of it happens in the task that read the texts: no text, word or edge is
shuffled, written or sorted by Spark.

Costs: a piece's rank in the vocabulary file under Zipf's law,
``round(1000 * ln((rank + 1) * H))``, H the harmonic number of the vocabulary,
in whole numbers so that ties are exact; of equal paths the one whose last
piece starts first wins.  Characters that no piece covers (and a literal
U+2581, which the file uses for the space) become byte pieces, so decoding
returns every text exactly.  Words are never cut: those longer than ``LONGEST``
characters, whose lattice would be too large for one row, take the same least-cost
path in one pass that keeps the costs of the last longest piece's length.

Null and empty texts have no ids and decode to the empty text.  Rows carry their
texts' ids themselves, so repeated rows and null ids are harmless.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

#: Default vocabulary; any SentencePiece file with byte pieces can be named instead.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words up to this length meet the piece table as rows of substrings.
LONGEST = 256
#: Piece tables up to this size are broadcast; vocabulary files beyond it are refused.
MOST_PIECES = 1_000_000
#: Words of a block of texts, about (a longer text is a block of its own).
BLOCK_WORDS = 1_000_000
#: Substrings are cut no longer than the pieces of their first PREFIX characters; BUCKETS is a power of two.
PREFIX = 4
BUCKETS = 1 << 16
#: Edges folded at a time, about.
EDGES = 100_000
LAYOUT = np.dtype([("key", "V32"), ("words", "<i8")])
WORD = r"(?s) *+[^ \n]++| ++|\n"


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, int, int], ...]  # text with plain spaces, id, cost
    byte_ids: tuple[int, ...]
    byte_cost: int
    longest: int


@cache
def vocabulary(model: str = MODEL) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    if n > MOST_PIECES:
        raise ValueError(f"{model} has {n} pieces; at most {MOST_PIECES} are supported")
    by_byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
    if len(by_byte) != 256:
        raise ValueError(f"{model} lacks byte pieces")
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    harmonic = sum(1 / (r + 1) for r in range(len(plain)))
    pieces = []
    for rank, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i))):
        text = sp.id_to_piece(i).replace("▁", " ")
        if " " in text.lstrip(" ") or "\n" in text:
            raise ValueError(f"piece {i} crosses words; cutting texts into words would lose it")
        pieces.append((text, i, round(1000 * math.log((rank + 1) * harmonic))))
    return Vocabulary(tuple(pieces), tuple(by_byte[b] for b in range(256)), 2 * max(c for *_, c in pieces), max(len(t) for t, *_ in pieces))


def words_of(texts: pa.Array) -> pa.Array:
    """The words of each text in order; joined, they are the text after its leading space."""
    find, parts = re.compile(WORD).findall, [pa.array([], pa.list_(pa.string()))]
    for lo in range(0, len(texts), 500):  # Python strings of a part at a time
        parts.append(pa.array([find(" " + t) if t else [] for t in texts.slice(lo, 500).to_pylist()], pa.list_(pa.string())))
    return pa.concat_arrays(parts)


def piece_table(spark: SparkSession, model: str = MODEL) -> DataFrame:
    """(name, text, id): a piece's 64-bit name for the join, no two alike, and its text to verify it."""
    rows = [(t, i) for t, i, _ in vocabulary(model).pieces]
    if len({xxhash.xxh64_intdigest(t.encode(), seed=42) for t, _ in rows}) < len(rows):
        raise ValueError(f"two pieces of {model} share a name")
    return spark.createDataFrame(rows, "text string, id int").select(F.xxhash64("text").alias("name"), "text", "id")


def _long_path(voc: Vocabulary) -> Callable[[str], np.ndarray]:
    """A word of any length -> the ids of its least-cost path, in one pass over its ends."""
    pieces = {t: (i, c) for t, i, c in voc.pieces}

    def ids_of(word: str) -> np.ndarray:
        costs, starts = [0] + [0] * voc.longest, np.zeros(len(word) + 1, np.int32)  # costs[p % len(costs)]: of the path to p
        names, ring = np.zeros(len(word) + 1, np.int32), len(costs)
        for end in range(1, len(word) + 1):
            best = (1 << 60, -1, -1)
            for start in range(max(0, end - voc.longest), end):
                part = word[start:end]
                found = pieces.get(part)
                if found is None and end == start + 1:
                    found = (-1, len(part.encode()) * voc.byte_cost)
                if found is not None and costs[start % ring] + found[1] < best[0]:
                    best = (costs[start % ring] + found[1], start, found[0])
            costs[end % ring], starts[end], names[end] = best
        out, at = [], len(word)
        while at > 0:
            start = int(starts[at])
            out += [names[at]] if names[at] >= 0 else [voc.byte_ids[b] for b in reversed(word[start:at].encode())]
            at = start
        return np.array(out[::-1], np.int32)

    return ids_of


def _reach(model: str) -> bytes:
    """By bucket of a substring's first ``PREFIX`` characters: the length beyond which it is no piece."""
    table = bytearray([PREFIX - 1]) * BUCKETS
    for text, _, _ in vocabulary(model).pieces:
        if len(text) >= PREFIX:
            bucket = xxhash.xxh64_intdigest(text[:PREFIX].encode(), seed=42) % BUCKETS
            table[bucket] = min(127, max(table[bucket], len(text)))
    if vocabulary(model).longest > 127:
        raise ValueError(f"{model} has pieces of more than 127 characters")
    return bytes(table)


def edges_of(words: DataFrame, model: str = MODEL) -> DataFrame:
    """(word, data) of ``_blocked`` -> (edge, data): the words' lattices.

    Explode, equi-join: a row per substring that is a piece, and per single
    character (without a piece its id is ~code point), in order of start and
    length.  ``edge`` is start << 48 | length << 32, plus the id; the first edge
    of a word has its data.  Rows without a word stay as they are.  Nothing is
    shuffled, so rows stay in order; two flat columns are cheap to hand to Python.
    """
    pieces = F.broadcast(piece_table(words.sparkSession, model))  # at most MOST_PIECES rows
    start = F.explode_outer(F.when(F.col("word").isNotNull(), F.sequence(F.lit(0), F.length("word") - 1))).alias("start")
    rest = F.substr("word", F.col("start") + 1, F.lit(vocabulary(model).longest)).alias("rest")
    starts = words.select("*", start).select("data", "start", rest)
    bucket = F.pmod(F.xxhash64(F.substr("rest", F.lit(1), F.lit(PREFIX))), F.lit(BUCKETS)).cast("int")
    most = F.ascii(F.substr(F.lit(_reach(model)), bucket + 1, F.lit(1)).cast("string"))
    length = F.explode_outer(F.when(F.col("start").isNotNull(), F.sequence(F.lit(1), F.least(F.length("rest"), most)))).alias("length")
    cut = starts.select("*", length).select("data", "start", "length", F.substr("rest", F.lit(1), F.col("length")).alias("piece"))
    joined = cut.join(pieces, F.xxhash64("piece") == F.col("name"), "left")
    same = F.coalesce(F.col("piece") == F.col("text"), F.lit(False))
    at = F.shiftleft("start", 16).bitwiseOR(F.col("length")).cast("long")
    id_ = F.when(same, F.col("id")).otherwise(F.bitwise_not(F.ascii("piece")))
    kept = joined.where(same | (F.col("length") == 1) | F.col("length").isNull())
    return kept.select((F.shiftleft(at, 32) + id_).alias("edge"), F.when(at.isNull() | (at == 1), F.col("data")).alias("data"))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of the runs, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _costs(voc: Vocabulary) -> np.ndarray:
    """Cost by id."""
    table = np.zeros(max(i for _, i, _ in voc.pieces) + 1, np.int64)
    for _, i, cost in voc.pieces:
        table[i] = cost
    return table


def _paths(at: np.ndarray, ids: np.ndarray, costs: np.ndarray, byte_cost: int, byte_ids: tuple[int, ...]) -> pa.ListArray:
    """Edges of words, a word's in order of start -> the ids of the words' least-cost paths.

    All words advance together, an end at a time; of equal costs the smallest
    start wins.  An edge without a piece gives the byte pieces of its character.
    """
    start, length = at >> 16, at & 0xFFFF
    first = np.flatnonzero(at == 1)
    word = np.cumsum(at == 1) - 1
    size = np.maximum.reduceat(start, first) + 1
    base = np.cumsum(size + 1) - (size + 1)
    raws = {c: chr(c).encode() for c in np.unique(~ids[ids < 0]).tolist()}
    spare = np.array(sorted(raws), np.int64)
    spare_bytes = np.array([len(raws[c]) for c in spare.tolist()], np.int64)
    cost = costs[np.maximum(ids, 0)]
    cost[ids < 0] = spare_bytes[np.searchsorted(spare, ~ids[ids < 0])] * byte_cost

    by = np.argsort((start + length).astype(np.int16), kind="stable")  # by end, then word, then start
    end, start, word, ids, cost = (start + length)[by], start[by].astype(np.int64), word[by], ids[by], cost[by]
    source, target = base[word] + start, base[word] + end
    best = np.zeros(int((size + 1).sum()), np.int64)
    from_, name = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
    bounds = np.flatnonzero(np.diff(end, prepend=0, append=1 << 30))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        to, ranked = target[lo:hi], (best[source[lo:hi]] + cost[lo:hi]) << 9 | start[lo:hi]
        groups = np.flatnonzero(np.diff(to, prepend=-1))
        least = np.minimum.reduceat(ranked, groups)
        won = np.flatnonzero(ranked == np.repeat(least, np.diff(groups, append=len(to))))
        best[to[won]], from_[to[won]], name[to[won]] = ranked[won] >> 9, start[lo:hi][won], ids[lo:hi][won]

    here, left, words, names = size.astype(np.int64), np.arange(len(size)), [], []
    while len(left):
        node = base[left] + here[left]
        words.append(left)
        names.append(name[node])
        here[left] = from_[node]
        left = left[here[left] > 0]
    words, names = np.concatenate(words[::-1]), np.concatenate(names[::-1])
    by = np.argsort(words, kind="stable")
    words, names = words[by], names[by]
    each = np.ones(len(names), np.int64)
    odd = np.flatnonzero(names < 0)
    which = np.searchsorted(spare, ~names[odd])
    each[odd] = spare_bytes[which]
    out = np.repeat(names, each)
    in_bytes = np.array([byte_ids[b] for c in spare.tolist() for b in raws[c]], np.int64)
    out[_spread((np.cumsum(each) - each)[odd], each[odd])] = in_bytes[_spread((np.cumsum(spare_bytes) - spare_bytes)[which], each[odd])]
    ends = np.cumsum(np.bincount(words, each, len(size)).astype(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out, pa.int32()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, words) -> (block, word, data): a word's places in a block of texts, as gaps; without a word, the block's keys and word counts."""
    part, block = TaskContext.get().partitionId(), 0
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < b.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK_WORDS, "right")))
            rows, lo = b.slice(lo, hi - lo), hi
            layout = np.empty(rows.num_rows, LAYOUT)
            layout["key"] = np.frombuffer(b"".join(rows.column(0).to_pylist()), "V32")
            layout["words"] = pc.list_value_length(rows.column(1)).to_numpy(zero_copy_only=False)
            flat = rows.column(1).flatten().dictionary_encode()
            index = flat.indices.to_numpy(zero_copy_only=False)
            places = np.argsort(index, kind="stable")
            counts = np.bincount(index, minlength=len(flat.dictionary))
            starts = np.cumsum(counts) - counts
            gaps = np.diff(places, prepend=0).astype(np.int32)
            gaps[starts] = places[starts]
            offsets = np.append(starts, len(places)).astype(np.int32) * 4
            data = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(gaps)])
            words = pa.concat_arrays([flat.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
            name = pa.array(np.full(len(counts) + 1, part << 32 | block))
            yield pa.RecordBatch.from_arrays([name, words, pa.concat_arrays([data, pa.array([layout.tobytes()], pa.binary())])], ["block", "word", "data"])
            block += 1


def _unblocked(block: pa.Table, long_path: Callable[[str], np.ndarray] | None = None) -> pa.Table:
    """The rows of one block with their words' ids (without ids: a long word) -> (key, ids) of its texts."""
    given = block["ids"].is_valid().to_numpy()
    is_word = block["word"].is_valid().to_numpy() | given
    layout = np.frombuffer(block["data"].to_pylist()[int(np.flatnonzero(~is_word)[0])], LAYOUT)
    n_long = int((is_word & ~given).sum())
    words = block.take(pa.array(np.concatenate([np.flatnonzero(is_word & ~given), np.flatnonzero(given)]))).combine_chunks()
    data, ids = words["data"].to_pylist(), words["ids"].combine_chunks()
    if n_long:
        long = words["word"].slice(0, n_long).to_pylist()
        if long_path is None or any(len(w) <= LONGEST for w in long):
            raise ValueError("a word of the block has no ids")
        ids = pa.concat_arrays([pa.array([long_path(w) for w in long], ids.type), ids.slice(n_long)])
    counts = np.fromiter((len(x) // 4 for x in data), np.int64, len(data))
    total = int(counts.sum())
    if total != layout["words"].sum():
        raise ValueError("a word of the block has no ids")
    sums = np.cumsum(np.frombuffer(b"".join(data), np.int32), dtype=np.int64)
    before = np.concatenate(([0], sums))[np.cumsum(counts) - counts]
    row = np.empty(total, np.int64)
    row[sums - np.repeat(before, counts)] = np.repeat(np.arange(len(data)), counts)
    out = ids.take(pa.array(row))
    cuts = out.offsets.to_numpy()[np.concatenate(([0], np.cumsum(layout["words"])))]
    return pa.table({"key": pa.array([bytes(k) for k in layout["key"]], pa.binary()), "ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), out.values)})


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _blocked(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """(row), whose field ``text`` is the text -> the words and data of ``_blocks``; without a word, last of a block: its long words and layout, and its rows."""
    held: list[pa.Array] = []

    def keyed() -> Iterator[pa.RecordBatch]:
        for b in batches:
            held.append(b.column(0))
            number = np.zeros((b.num_rows, 4), np.int64)
            number[:, 0] = np.arange(b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array([bytes(k) for k in number.view("V32").ravel()], pa.binary()), words_of(b.column(0).field(text))], ["key", "words"])

    at = 0
    for block in _blocks(keyed()):
        if len(held) > 1:  # the batch before is through
            held, at = held[-1:], 0
        n = len(block["data"][-1].as_buffer()) // LAYOUT.itemsize  # the layout comes last
        rows, at = pa.RecordBatch.from_arrays([held[0].slice(at, n)], ["row"]), at + n
        short = pc.less_equal(pc.utf8_length(block["word"]), LONGEST).fill_null(False)
        last = pickle.dumps((_packed(block.filter(pc.invert(short))), _packed(rows)))
        words = block.filter(short)
        word = pa.concat_arrays([words["word"], pa.nulls(1, pa.string())])
        yield pa.RecordBatch.from_arrays([word, pa.concat_arrays([words["data"], pa.array([last], pa.binary())])], ["word", "data"])


class _Folded:
    """The edges of a block as they come, folded ``EDGES`` at a time."""

    def __init__(self, path: Callable[[np.ndarray, np.ndarray], pa.ListArray]) -> None:
        self.path, self.edges, self.n, self.data, self.ids = path, [], 0, [], []

    def add(self, edge: pa.Array, data: pa.Array) -> None:
        self.edges.append(edge.to_numpy())
        self.data.append(data.drop_null())
        self.n += len(edge)
        if self.n >= EDGES:
            self.fold(False)

    def fold(self, ended: bool) -> None:
        if not self.n:
            return
        edges = np.concatenate(self.edges)
        ids = edges.astype(np.int32)
        at = (edges - ids) >> 32
        whole = len(at) if ended else int(np.flatnonzero(at == 1)[-1])  # the last word may go on
        if whole:
            self.ids.append(self.path(at[:whole], ids[:whole].astype(np.int64)))
        self.edges, self.n = [edges[whole:]], len(at) - whole

    def texts(self, last: bytes, long_path: Callable[[str], np.ndarray]) -> pa.RecordBatch:
        """The rows of the block and their ids."""
        self.fold(True)
        others, rows = (pa.ipc.open_stream(raw).read_all() for raw in pickle.loads(last))
        ids = pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *self.ids])
        words = pa.table({"word": pa.nulls(len(ids), pa.string()), "data": pa.concat_arrays([pa.array([], pa.binary()), *self.data]), "ids": ids})
        others = others.select(["word", "data"]).append_column("ids", pa.nulls(len(others), ids.type))
        found = _unblocked(pa.concat_tables([words, others]), long_path)["ids"].combine_chunks()
        return pa.RecordBatch.from_arrays([rows["row"].combine_chunks(), found], ["row", "ids"])


def encoded(docs: DataFrame, text: str = "text", out: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` with the array<int> column ``out``; a column of that name is replaced.

    Texts are cut in blocks of about ``BLOCK_WORDS`` words, followed by their
    rows.  The distinct words of a block become edges, which are folded and put
    together again in the task they come from: nothing is shuffled or sorted.
    """
    voc = vocabulary(model)
    costs, byte_cost, byte_ids, long_path = _costs(voc), voc.byte_cost, voc.byte_ids, _long_path(voc)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    packed = docs.select(row)
    names = [c.lower() for c in docs.columns]
    at = docs.columns.index(text) if text in docs.columns else names.index(text.lower())
    kind = packed.schema["row"].dataType
    edges = edges_of(packed.mapInArrow(lambda batches: _blocked(batches, at), "word string, data binary"), model)

    def path(at: np.ndarray, ids: np.ndarray) -> pa.ListArray:
        return _paths(at, ids, costs, byte_cost, byte_ids)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Folded(path)
        for b in batches:
            edge, data = b.columns
            lo = 0
            for hi in np.flatnonzero(edge.is_null().to_numpy(zero_copy_only=False)).tolist() if edge.null_count else []:
                block.add(edge.slice(lo, hi - lo), data.slice(lo, hi - lo))
                yield block.texts(data[hi].as_py(), long_path)
                block, lo = _Folded(path), hi + 1
            block.add(edge.slice(lo), data.slice(lo))

    done = edges.mapInArrow(put_together, StructType().add("row", kind).add("ids", ArrayType(IntegerType())))
    return done.select(*[F.col(f"row.`{c}`") for c in docs.columns if c != out], F.col("ids").alias(out))


def decoded(rows: DataFrame, ids: str = "ids", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``rows`` with the text that the ids stand for (null ids: empty); a column of that name is replaced."""
    voc = vocabulary(model)
    table: dict[int, bytes] = {i: t.encode() for t, i, _ in voc.pieces} | {i: bytes([b]) for b, i in enumerate(voc.byte_ids)}
    size = max(table) + 1
    parts = pa.array([table.get(i, b"") for i in range(size)], pa.binary())

    def joined(found: pa.BinaryArray) -> bytes:
        _, offsets, data = found.buffers()
        return data[: np.frombuffer(offsets, np.int32)[len(found)]].to_pybytes() if len(found) else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("ids")
            texts = []
            for x in b.column(at):
                raw = joined(parts.take(x.values)) if x.is_valid else b""
                texts.append((raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(1 - at), pa.array(texts, pa.string())], ["row", "decoded"])

    columns = [c for c in rows.columns if c != out]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{ids}`").alias("ids"))
    schema = f"row {packed.schema['row'].dataType.simpleString()}, decoded string"
    return packed.mapInArrow(run, schema).select("row.*", F.col("decoded").alias(out))


def op4_sentencepiece(docs: DataFrame) -> DataFrame:
    """Per document: number of ids, their digest, and whether decoding them returns the text."""
    both = decoded(encoded(docs))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.xxhash64("ids").alias("ids_digest"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
