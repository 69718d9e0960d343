"""Benchmark decontamination by template canonicalisation.

Texts become template tokens: numbers, names (capitalised inside a sentence)
and units (after a number) turn into typed placeholders, other words are
lower-cased without outer punctuation, and a run of names is one name.
Windows of five template tokens (with at least three plain words) are joined by
hash to the benchmark's windows.  In each alignment of a text with an item, the
slot values must map one to one, so a re-parameterised question still matches
while unrelated numbers in the same frame do not.  A text holds an item when
the windows of consistent alignments cover at least 80% of the item's windows.

Windows with fewer plain words (sums, lists of numbers) can't be told from their
frame.  Items that have such windows of five tokens also get a literal form, of
all their windows without regard to letter case, in which these windows are
their very words, numbers and units included: exact copies of any item of five
tokens or more are found, however few plain words it has.

An item's first word is never a name or a unit, so each word of a text that is
one is also read as the plain first word of a passage that begins with it: a
copy is found after any mark or in mid-sentence.  Texts and items have a second
reading, without regard to letter case, in which names are plain words; it finds
copies in other letter case with the item's own names.

Items that differ in slot values only are one class, named by the least
item_id, so a hot template gives one row a text.  Texts are keyed by their MD5
digest: copies share one result, and rows need no id.  The benchmark's window
hashes filter inside the scan while there are at most ``FILTER_HASHES``;
beyond that every window is shuffled to the join.

Null and empty texts hold nothing.  Items of fewer than five template tokens
are one window of their own length; those without enough plain words (one to
four numbers) can't be told from any text and match nothing.  Repeated rows give repeated pairs; rows
with a null id are judged like others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import fresh, sized, written

WINDOW = 5
SIMILARITY = 0.8
PLAIN_WORDS = 3
#: The scan filters by at most this many benchmark hashes (8 bytes each).
FILTER_HASHES = 4_000_000
#: Benchmark windows that may be broadcast: rows of a few hundred bytes.
BROADCAST_WINDOWS = 50_000
#: Benchmark windows that a task holds as Python rows, about.
ITEM_ROWS = 20_000
#: Word types whose class a worker remembers.
REMEMBERED = 300_000

PLAIN, NUMBER, UNIT, CAPITAL, NOTHING = range(5)
_NUMBER = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(%|[a-z°$€£]{1,3})?")
#: Fixed values.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million billion".split())
UNITS = frozenset(
    "km m cm mm mi ft in kg g mg lb oz l ml s ms min h hr mph kmh mb gb tb usd eur percent degrees dollars euros cents "
    "meters metres kilometers kilometres miles feet inches kilograms grams pounds liters litres seconds minutes hours days weeks months years".split()
)
_OUTER = "\"'`´“”‘’«»()[]{}<>*_#~|.,;:!?¿¡…–—-"
_PLACE = {NUMBER: 0x9E3779B97F4A7C15, UNIT: 0xC2B2AE3D27D4EB4F, CAPITAL: 0x165667B19E3779F9}
_STEP = 0x2545F4914F6CDD1D
#: Sets hashes of literal windows apart from those of template windows.
_LITERAL = 0x51ED270B
_MASK = (1 << 64) - 1


def _classify(raw: bytes) -> tuple[int, int, bool, str]:
    """(class, hash as a plain word, ends a sentence, bare word) of one word."""
    word = raw.decode("utf-8", "replace")
    core = word.strip(_OUTER)
    ends = word.rstrip("\"'”’»)]}*_")[-1:] in (".", "!", "?")
    low = core.lower()
    if not core:
        return NOTHING, 0, ends, ""
    if _NUMBER.fullmatch(low) or low in NUMBER_WORDS:
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    else:
        kind = CAPITAL if core[0].isupper() else PLAIN
    return kind, xxhash.xxh64_intdigest(low.encode("utf-8", "replace"), 7), ends, low


class _Words(dict):
    """Word -> position in the class tables, filled as words turn up."""

    def __init__(self) -> None:
        self.kinds, self.hashes, self.ends, self.cores = [], [], [], []

    def __missing__(self, raw: bytes) -> int:
        kind, digest, ends, core = _classify(raw)
        self.kinds.append(kind)
        self.hashes.append(digest)
        self.ends.append(ends)
        self.cores.append(core)
        self[raw] = at = len(self.kinds) - 1
        return at


class Tokens:
    """Words of several texts laid end to end, lone marks left out: code, class, owner, whether one starts a sentence."""

    def __init__(self, texts: list[bytes], words: _Words) -> None:
        split = [t.split() for t in texts]
        owner = np.repeat(np.arange(len(split)), [len(s) for s in split])
        code = np.fromiter((words[w] for s in split for w in s), np.int64, len(owner))
        kinds, ends = np.array(words.kinds, np.int8)[code], np.array(words.ends, bool)[code]
        first = np.ones(len(code), bool)
        first[1:] = (owner[1:] != owner[:-1]) | ends[:-1]
        real = kinds != NOTHING
        # a lone mark neither starts nor ends what its neighbours do, except at a sentence's end
        self.code, self.kinds, self.first, self.owner = code[real], kinds[real], first[real], owner[real]
        self.hash = np.array(words.hashes, np.uint64)[self.code]
        self.words, self.n_texts = words, len(texts)


def _mixed(parts: list[np.ndarray], salt: int) -> np.ndarray:
    """Hashes of windows, given the hashes of their first, second, ... tokens."""
    total = np.zeros(len(parts[0]), np.uint64)
    for k, part in enumerate(parts):
        total += part * np.uint64(pow(_STEP, k + 1, 1 << 64))
    total ^= total >> np.uint64(31)
    return total * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)


class Template:
    """Template tokens of several texts in one reading: hash, slot kind, owner, word position.  Folded: names are plain words."""

    def __init__(self, tokens: Tokens, folded: bool = False) -> None:
        kinds, size = tokens.kinds, len(tokens.code)
        same = np.zeros(size, bool)
        same[1:] = tokens.owner[1:] == tokens.owner[:-1]
        after_number = np.zeros(size, bool)
        after_number[1:] = same[1:] & (kinds[:-1] == NUMBER)
        slot = np.where(kinds == NUMBER, NUMBER, PLAIN)
        slot[(kinds == UNIT) & after_number] = UNIT
        if not folded:
            slot[(kinds == CAPITAL) & ~tokens.first] = CAPITAL
        again = np.zeros(size + 1, bool)
        again[1:size] = same[1:] & (slot[1:] == CAPITAL) & (slot[:-1] == CAPITAL)
        kept = ~again[:size]
        self.code, self.slot, self.owner, self.words = tokens.code[kept], slot[kept], tokens.owner[kept], tokens.words
        self.hash = tokens.hash[kept]
        for kind, value in _PLACE.items():
            self.hash[self.slot == kind] = value
        self.plain = np.concatenate(([0], np.cumsum(self.slot == PLAIN)))
        self.begin = np.searchsorted(self.owner, np.arange(tokens.n_texts))
        self.folded, self.tokens = folded, tokens
        #: Words that would be plain if a passage began with them; their tokens; whether the name goes on after them.
        self.heads = np.flatnonzero((slot == CAPITAL) | (slot == UNIT))
        self.at_head, self.goes_on = (np.cumsum(kept) - 1)[self.heads], again[self.heads + 1]

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of n tokens of one text that hold enough plain words."""
        size = len(self.hash) - n + 1
        if size <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        good = (self.owner[n - 1 :] == self.owner[:size]) & (self.plain[n:] - self.plain[:size] >= min(PLAIN_WORDS, n))
        total = _mixed([self.hash[k : size + k] for k in range(n)], n + WINDOW * 2 * self.folded)
        starts = np.flatnonzero(good)
        return starts, total[starts]

    def literals(self) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the folded reading's windows with too few plain words, hashed by their very words."""
        size = len(self.hash) - WINDOW + 1
        if size <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        few = self.plain[WINDOW:] - self.plain[:size] < PLAIN_WORDS
        starts = np.flatnonzero(few & (self.owner[WINDOW - 1 :] == self.owner[:size]))
        return starts, _mixed([self.tokens.hash[starts + k] for k in range(WINDOW)], _LITERAL)  # folded: a token a word

    def openings(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, bool]]:
        """(heads, hashes, 0 or 1, name goes on): first and second windows of the passages that begin with each head, the head a plain word."""
        for on in (False, True):
            heads = np.flatnonzero(self.goes_on == on)
            named = on and n > 1
            rest = n - 1 - named  # tokens after the head's own
            heads = heads[self.at_head[heads] + rest < len(self.hash)]
            t = self.at_head[heads]
            enough = 1 + self.plain[t + 1 + rest] - self.plain[t + 1] >= min(PLAIN_WORDS, n)
            heads = heads[(self.owner[t + rest] == self.owner[t]) & enough]
            if len(heads):
                t = self.at_head[heads]
                name = [np.full(len(t), _PLACE[CAPITAL], np.uint64)] if named else []
                parts = [self.tokens.hash[self.heads[heads]], *name, *(self.hash[t + 1 + k] for k in range(rest))]
                yield heads, _mixed(parts, n + WINDOW * 2 * self.folded), 0, on
        if n == WINDOW:  # shorter items are one window
            starts, hashes = self.windows(n)
            heads = np.flatnonzero(self.goes_on)
            at = np.searchsorted(starts, self.at_head[heads])
            is_window = (at < len(starts)) & (np.append(starts, -1)[at] == self.at_head[heads])
            if is_window.any():
                yield heads[is_window], hashes[at[is_window]], 1, True

    def slots(self, at: int, n: int) -> list[str]:
        """``kind:value`` of the window's placeholders, in order."""
        return [f"{self.slot[i]}:{self.words.cores[self.code[i]]}" for i in range(at, at + n) if self.slot[i] != PLAIN]

    def opening_slots(self, head: int, n: int, nth: int, on: bool) -> list[str]:
        """``slots`` of an opening."""
        named = on and n - nth > 0 and not (nth == 0 and n == 1)
        name = [f"{CAPITAL}:{self.words.cores[self.tokens.code[self.heads[head] + 1]]}"] if named else []
        return name + self.slots(int(self.at_head[head]) + 1, n - 1 - (named and nth == 0))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_ITEM), _ITEM_TYPES, strict=True)], [f.name for f in _ITEM])

    for b in batches:
        rows, words = [], _Words()
        for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            tokens = Tokens([text or b""], words)
            forms = []
            for folded in (False, True):
                t = Template(tokens, folded)
                n = min(WINDOW, len(t.hash))
                starts, hashes = t.windows(n) if n else ([], [])
                numbered: dict[str, int] = {}
                forms.append(" ".join(f"{h:x}/{numbered.setdefault(s[0], len(numbered)) if s else ''}" for i, h in enumerate(t.hash.tolist()) for s in [t.slots(i, 1)]))
                head = _signed(int(t.hash[0])) if n else 0
                windows = [(int(s), _signed(int(h)), t.slots(s, n)) for s, h in zip(starts, hashes, strict=True)]
                rows += [(item, forms[0], f"{folded:d}|" + "|".join(forms), folded, s, h, head, n, len(windows), slots) for s, h, slots in windows]
            short = list(zip(*t.literals(), strict=True))
            if short:  # t: the folded reading
                words_of = " ".join(t.words.cores[c] for c in t.code.tolist())
                windows += [(int(s), _signed(int(h)), []) for s, h in short]
                rows += [(item, forms[0], f"2|{words_of}", True, s, h, head, n, len(windows), slots) for s, h, slots in windows]
            if len(rows) >= ITEM_ROWS:
                yield batch(rows)
                rows, words = [], _Words()
        yield batch(rows)


_ITEM_TYPES = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
_ITEM = pa.schema(list(zip(("item", "class", "form", "folded", "at", "hash", "head", "length", "n_windows", "item_slots"), _ITEM_TYPES, strict=True)))


def item_windows(benchmark: DataFrame, id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(windows of each class's cased form and folded forms, members: class, item)."""
    rows = benchmark.select(F.col(f"`{id}`").cast("long").alias("item"), F.col(f"`{text}`").cast("binary").alias("text"))
    schema = "item long, class string, form string, folded boolean, at int, hash long, head long, length int, n_windows int, item_slots array<string>"
    every = rows.mapInArrow(_item_windows, schema).withColumn("class", F.sha2("class", 256)).withColumn("form", F.sha2("form", 256))
    every = written(every, "benchmark-windows")
    classes = every.groupBy("class").agg(F.min("item").alias("item"), F.count_distinct("item").alias("n_items"))
    # items of one class differ in their folded forms by their names
    form = F.when(F.col("folded"), F.col("form")).otherwise(F.col("class"))
    windows = every.withColumn("form", form).dropDuplicates(["form", "at"]).drop("item").join(classes, "class")
    return written(windows, "benchmark-classes"), every.select("class", "item").distinct()


_HIT = "key string, pos int, hash long, slots array<string>, opens int, nth int, head long, until int"
_HIT_TYPES = (pa.string(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int64(), pa.int32())


def _text_windows(lengths: list[int], wanted: np.ndarray | None):
    """(key, text) batches -> the windows whose hash is wanted (None: all), in both readings.

    ``opens`` is 0, or for openings the number of the passage's first word;
    these are the passage's window ``nth``, and it goes on with the ordinary
    windows after token ``until``.
    """
    some = None
    if wanted is not None:
        some = np.packbits(np.bincount((wanted >> np.uint64(42)).astype(np.int64), minlength=1 << 22) > 0) if len(wanted) else np.zeros(1 << 19, np.uint8)

    def hit(hashes: np.ndarray) -> np.ndarray:
        if wanted is None:
            return np.arange(len(hashes))
        top = hashes >> np.uint64(42)
        near = np.flatnonzero((some[top >> np.uint64(3)] << (top & np.uint64(7)).astype(np.uint8)) & np.uint8(128))
        return near[wanted[np.minimum(np.searchsorted(wanted, hashes[near]), len(wanted) - 1)] == hashes[near]]

    def rows_of(t: Template, keys: list) -> Iterator[pa.RecordBatch]:
        def batch(at, pos, hashes, slots, opens, nth, head, until):
            columns = ([keys[o] for o in t.owner[at].tolist()], pos, hashes.view(np.int64), slots, opens, np.full(len(at), nth), head.view(np.int64), until)
            arrays = [pa.array(c if isinstance(c, list) else c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, _HIT_TYPES, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in _HIT.split(", ")])

        word_begin = np.searchsorted(t.tokens.owner, np.arange(t.tokens.n_texts))
        for n in lengths:
            starts, hashes = t.windows(n)
            found = hit(hashes)
            if len(found):
                at, none = starts[found], np.zeros(len(found), np.int64)
                yield batch(at, at - t.begin[t.owner[at]], hashes[found], [t.slots(s, n) for s in at.tolist()], none, -1, none, none)
            if t.folded and n == WINDOW:
                starts, hashes = t.literals()
                found = hit(hashes)
                if len(found):
                    at, none = starts[found], np.zeros(len(found), np.int64)
                    yield batch(at, at - t.begin[t.owner[at]], hashes[found], [[]] * len(at), none, -1, none, none)
            for heads, hashes, nth, on in t.openings(n):
                found = hit(hashes)
                if len(found):
                    heads, at = heads[found], t.at_head[heads[found]]
                    until, word = at - t.begin[t.owner[at]], t.heads[heads]
                    slots = [t.opening_slots(h, n, nth, on) for h in heads.tolist()]
                    yield batch(at, until - (on and nth == 0), hashes[found], slots, word - word_begin[t.owner[at]] + 1, nth, t.tokens.hash[word], until)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in batches:
            if len(words) > REMEMBERED:
                words = _Words()
            keys = b.column(0).to_pylist()
            texts = [x.as_py() or b"" for x in b.column(1)]
            # bounded slices, so a batch of long texts does not hold all its tokens at once
            cuts, size = [0], 0
            for i, x in enumerate(texts):
                size += len(x)
                if size > 4_000_000:
                    cuts.append(i + 1)
                    size = 0
            for lo, hi in zip(cuts, [*cuts[1:], len(texts)], strict=True):
                if lo == hi:
                    continue
                tokens = Tokens(texts[lo:hi], words)
                for folded in (False, True):
                    yield from rows_of(Template(tokens, folded), keys[lo:hi])

    return run


def held_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", similarity: float = SIMILARITY, max_filter: int = FILTER_HASHES) -> DataFrame:
    """(key: MD5 of a text, item_id: class representative, n_items, n_matched, n_windows) of every text that holds an item."""
    windows, _ = item_windows(benchmark)
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most WINDOW values
    if not lengths:
        return docs.sparkSession.createDataFrame([], "key string, item_id long, n_items long, n_matched long, n_windows int")
    hashes = windows.select("hash").distinct()
    wanted = None
    if hashes.count() <= max_filter:
        wanted = np.sort(hashes.toArrow().column(0).to_numpy().view(np.uint64))  # 8 bytes a hash, also on the driver
    body = F.col(f"`{text}`")
    rows = docs.where(body.isNotNull()).select(F.md5(body).alias("key"), body.cast("binary").alias("text"))
    found = rows.mapInArrow(_text_windows(lengths, wanted), _HIT)
    fits = (F.col("opens") == 0) | ((F.col("nth") == F.col("at")) & (found["head"] == windows["head"]))
    met = found.join(sized(windows, BROADCAST_WINDOWS), "hash").where(fits).drop("head", "hash", "length", "class")
    hits = written(met.withColumn("diagonal", F.col("pos") - F.col("at")), "benchmark-hits")
    diagonal = ["key", "form", "diagonal"]
    openings = hits.where("opens > 0").select(*diagonal, F.col("opens").alias("o"), F.col("until").alias("u")).distinct()
    after = hits.where("opens = 0").join(openings, diagonal).where("pos > u").withColumn("opens", F.col("o")).select(*hits.columns)
    aligned = hits.unionByName(after)
    by = ["key", "form", "folded", "item", "n_items", "n_windows"]
    pairs = F.transform(F.arrays_zip("item_slots", "slots"), lambda z: F.struct(z["item_slots"].alias("i"), z["slots"].alias("d")))
    slots = aligned.select(*diagonal, "opens", F.explode(pairs).alias("p")).groupBy(*diagonal, "opens")
    off = slots.agg(
        F.count_distinct("p.i").alias("i"), F.count_distinct("p.d").alias("d"), F.count_distinct("p.i", "p.d").alias("both")
    ).where("i < both OR d < both")
    fit = aligned.join(off, [*diagonal, "opens"], "left_anti")
    cover = fit.groupBy(*by).agg(F.count_distinct("at").alias("n_matched")).where(F.col("n_matched") >= similarity * F.col("n_windows"))
    best = F.min(F.struct("folded", (-F.col("n_matched")).alias("less"), "n_windows")).alias("best")
    held = cover.groupBy("key", "item", "n_items").agg(best)
    return held.select("key", F.col("item").alias("item_id"), "n_items", (-F.col("best.less")).alias("n_matched"), "best.n_windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_items, n_matched, n_windows): one row per row of ``docs`` and item class that its text holds."""
    held = written(held_items(docs, benchmark, text), "held-items")
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.md5(F.col(f"`{text}`")).alias("key"))
    return rows.join(sized(held), "key").drop("key")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, in the input's columns."""
    held = written(held_items(docs, benchmark, text).select("key").distinct(), "held-items")
    key = fresh(docs, "_held")
    return docs.join(sized(held.withColumnRenamed("key", key)), F.md5(F.col(f"`{text}`")) == F.col(key), "left_anti")


def op9_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
