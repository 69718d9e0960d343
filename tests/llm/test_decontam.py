"""Benchmark decontamination: planted passages, re-parameterised questions, slot consistency, odd rows."""

import numpy as np
import pyarrow as pa

from quillframe.llm import decontam
from quillframe.llm.common import sized

DOC, ITEM = "doc_id long, text string", "item_id long, text string"
Q = "A farmer named {a} bought {n} apples and {m} pears at the market, then {a} sold {n} apples to the baker for {k} dollars each morning."
FILL = " ".join(f"filler{i} and more" for i in range(30))


def q(a="John", n=5, m=7, k=3):
    return Q.format(a=a, n=n, m=m, k=k)


def pairs(spark, docs, items, **kw):
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    return sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b, **kw).collect() if r["doc_id"] is not None)


def test_templates_and_slots(spark):
    items = [(1, q()), (2, "The quick brown fox jumps over the lazy dog near the old river bank while nobody is watching it."), (3, None), (4, ""), (5, "12 13 14 15 16 17"), (6, "one lonely sentence here")]
    docs = [
        (10, f"{FILL} {q()} {FILL}"),
        (11, f"{FILL} {q('Maria', 12, 90, 44)} {FILL}"),  # other parameters, used alike
        (12, f"{FILL} {q('Maria', 12, 90, 44).replace('sold 12', 'sold 13')} {FILL}"),  # the repeated number no longer agrees
        (13, f"{FILL} {items[1][1].upper()}"),  # all capitals: other template
        (14, f"{FILL} " + items[1][1].replace("while", "WHILE, indeed,")),
        (15, " ".join(items[1][1].split()[:8])),  # less than 80%
        (16, None), (17, ""), (18, "12 13 14 15 16 17"), (19, f"{q()} {items[1][1]}"), (20, "and one lonely sentence here ends"),
    ]
    got = pairs(spark, docs, items)
    assert {(10, 1), (11, 1), (18, 5), (19, 1), (19, 2)} <= set(got)
    assert not {d for d, _ in got} & {12, 15, 16, 17}
    assert (20, 6) in got


def test_classes_ids_and_repeats(spark):
    items = [(7, q("Ann", 1, 2, 9)), (3, q("Bob", 4, 8, 6)), (9, q("Bob", 4, 4, 6))]
    docs = [(1, q()), (1, q()), (None, q()), (2, "nothing of that kind")]
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    rows = decontam.contaminated(d, b).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["n_items"]) for r in rows) == [(0, 3, 2), (1, 3, 2), (1, 3, 2)]
    extra = d.selectExpr("*", "1 AS key", "2 AS _held", "'x' AS hash")
    kept = decontam.decontaminated(extra, b)
    assert kept.columns == extra.columns and [r["doc_id"] for r in kept.collect()] == [2]
    assert decontam.contaminated(d.limit(0), b).count() == 0
    assert decontam.contaminated(d, b.limit(0)).count() == 0 and decontam.decontaminated(extra, b.limit(0)).count() == 4


def test_planted_passages_against_brute_force(spark):
    """Every whole passage planted in prose is found and nothing else; the unfiltered join gives the same rows."""
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocab, n)) + "."

    items = [(i, prose(int(rng.integers(12, 50)))) for i in range(30)]
    docs, want = [], set()
    for d in range(120):
        parts = [prose(60)]
        for i in rng.choice(30, rng.integers(0, 3), replace=False):
            parts += [items[i][1], prose(30)]
            want.add((d, int(i)))
        docs.append((d, "\n".join(parts)))
    assert set(pairs(spark, docs, items)) == want
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    every = decontam.held_items(d, b, max_filter=0).join(d.selectExpr("doc_id", "md5(text) AS key"), "key")
    assert {(r["doc_id"], r["item_id"]) for r in every.collect()} == want


def test_copies_in_mid_sentence(spark):
    """A copy is found whatever stands before it, also a short item or one with a name as its second word."""
    name = "When {a} bought {n} apples at the old market and then {a} sold {n} apples to the baker who lives there."
    items = [(1, "What is the capital of France?"), (2, name.format(a="Alice", n=5)), (3, "Miles are longer than one kilometer by far."), (4, "Why do birds sing?")]
    heads = ["Question: ", "some words\n", "so we asked ", "as Doctor Smith said ", "1. ", "(a) ", "it took 5 "]
    docs, want = [], set()
    for h in heads:
        for i, t in [*items, (1, "What is the capital of Spain?"), (2, name.format(a="Maria", n=12))]:
            want.add((len(docs), i))
            docs.append((len(docs), f"{FILL} {h}{t} {FILL}"))
    wrong = name.format(a="Maria", n=12).replace("sold 12", "sold 13").replace("then Maria", "then Bob")
    docs += [(len(docs), f"{FILL} Question: {wrong} {FILL}"), (len(docs) + 1, f"{FILL} Question: What is the size of France?")]
    assert set(pairs(spark, docs, items)) == want


def test_copies_in_other_letter_case(spark):
    """Copies that differ in letter case only are found; the class gives one row."""
    items = [(1, q()), (2, q("Maria", 12, 90, 44)), (3, "The quick brown fox jumps over the lazy dog near the old river bank while nobody is watching it."), (4, "Alice Bob Carol Dan Eve Frank")]
    cases = (str.upper, str.lower, str.title, str.swapcase)
    docs = [(10 * k + i, f"{FILL} see {case(t)} {FILL}") for k, case in enumerate(cases) for i, t in items]
    docs += [(100, f"{FILL} {q().replace('sold 5', 'sold 6').upper()} {FILL}")]
    assert pairs(spark, docs, items) == sorted((10 * k + i, 1 if i == 2 else i) for k in range(len(cases)) for i, _ in items)


def test_items_with_few_plain_words(spark):
    """Exact copies of sums, number lists and measures are found, alone, in prose and in other letter case; other numbers are not."""
    items = [(1, "12 13 14 15 16 17"), (2, "Compute 12 + 7 * 3 - 45 / 9 ."), (3, "5 km 12 kg 3 lb 9 oz"), (4, "22 23 24 25 26 27"), (5, "42"), (6, "1 2"), (7, "Miles 3 4 5 6 7 8")]
    spaced = " one filler row and more "
    docs, want = [], set()
    for i, t in items:
        for text in (t, f"{FILL} {t} {FILL}", f"Numbers: {t.upper()} {FILL}", f"{spaced} 7 {t.lower()} 8 {spaced}"):
            if i not in (5, 6):  # a number or two can't be told from any text
                want.add((len(docs), {4: 1}.get(i, i)))  # 1 and 4 are one class
            docs.append((len(docs), text))
    n = len(docs)
    docs += [(n, "12 13 14 15 99 17"), (n + 1, "Compute 12 + 8 * 3 - 44 / 9 ."), (n + 2, "5 km 13 kg 3 lb 8 oz"), (n + 3, "17 16 15 14 13 12"), (n + 4, "12 " * 50_000), (n + 5, "1 2 3 4 5 6 7 " * 30_000)]
    assert set(pairs(spark, docs, items)) == want


def _brute_covered(text, item):
    """Whether the word windows of five of an item of plain words are in the text to 80% (none for shorter texts)."""
    t, w = ([x.strip(".").lower() for x in s.split()] for s in (text, item))
    have = {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    mine = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    return sum(x in have for x in mine) >= 0.8 * len(mine)


def test_cut_passages_against_brute_force(spark):
    """Prefixes, infixes and copies with exchanged words: found exactly if four fifths of the windows are there."""
    rng = np.random.default_rng(8)
    vocab = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab, int(rng.integers(8, 40)))) + ".") for i in range(25)]
    docs = []
    for d in range(150):
        words = items[int(rng.integers(25))][1].split()
        if d % 3 == 0:
            lo = int(rng.integers(0, 4))
            words = words[lo : len(words) - int(rng.integers(0, 4))]
        elif d % 3 == 1:
            words[int(rng.integers(len(words)))] = "other"
        docs.append((d, " ".join([*rng.choice(vocab, 20), *words, *rng.choice(vocab, 20)])))
    docs += [(200, " ".join(rng.choice(vocab, 60_000)) + " " + items[0][1])]  # a long text
    want = {(d, i) for d, t in docs for i, x in items if _brute_covered(t, x)}
    assert set(pairs(spark, docs, items)) == want and (200, 0) in want


def test_large_benchmarks_stay_off_the_driver(spark, monkeypatch):
    """Hashes reach the driver as an array, wide rows are broadcast to a bound only, and tasks hold a bounded number of them."""
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab, 80))) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in items]), pa.array([t.encode() for _, t in items])], ["item", "text"])
    sizes = [b.num_rows for b in decontam._item_windows(iter([batch]))]
    assert sum(sizes) == 300 * 76 * 2 and max(sizes) < decontam.ITEM_ROWS + 1000

    docs = [(i, f"{FILL} {t} {FILL}") for i, t in items[:5]]
    kind = type(spark.range(1))
    collect, hinted = kind.collect, []

    def counted(self):
        assert self.columns != ["hash"], "a Python row a hash"
        return collect(self)

    monkeypatch.setattr(kind, "collect", counted)
    monkeypatch.setattr(decontam, "sized", lambda side, most=500_000: hinted.append(most) or sized(side, most))
    assert pairs(spark, docs, items) == [(i, i) for i in range(5)]
    assert hinted[0] == decontam.BROADCAST_WINDOWS
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 10)
    assert pairs(spark, docs, items) == [(i, i) for i in range(5)]
