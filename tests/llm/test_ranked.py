"""Ranked search against scores of every document, counted by hand."""

import math
import random
import re
from collections import Counter

from quillframe.llm import ranked

DOC = "doc_id long, text string"
ITEM = "item_id long, text string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top=10):
    rows = [(i, words(t)) for i, t in docs if words(t)]
    n, total = len(rows), sum(len(w) for _, w in rows)
    df = Counter(t for _, w in rows for t in set(w))
    out = []
    for item, text in sorted(set(items), key=lambda x: (x[0] is None, x)):
        scores = []
        for doc, w in rows:
            m = 100 - 75 + (75 * len(w) * n) // total
            tf = Counter(w)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in words(text) if tf[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r, None if z else d, -s) for r, (s, z, d) in enumerate(sorted(scores)[:top], 1)]
    return out


def run(spark, docs, items, **kw):
    got = ranked.search(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM), **kw)
    return [tuple(r) for r in got.collect()]


def key(row):
    return (row[0] is None, row[0] or 0, row[3] * -1, row[1])


def corpus(seed, n, vocabulary=60):
    rnd = random.Random(seed)
    names = [f"w{int(rnd.paretovariate(0.8)) % vocabulary}" for _ in range(5000)]
    return [(i, " ".join(rnd.choices(names, k=rnd.choice([1, 3, 8, 30, 200])))) for i in range(n)]


def test_equals_scores_of_every_document(spark):
    docs = corpus(3, 700)
    docs += [(1000 + i, docs[17][1]) for i in range(40)]  # copies: ties by id
    items = [(k, docs[k * 9][1] if k % 2 else "w1 w2 w2 w7 nowhere") for k in range(12)]
    for kw in ({}, {"shard_docs": 50}, {"item_block": 3}):
        assert sorted(run(spark, docs, items, **kw), key=key) == sorted(brute(docs, items), key=key)


def test_all_terms_index_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(ranked, "VOCABULARY_BYTES", -1)
    docs, items = corpus(5, 120), [(1, "w1 w3 w9"), (2, "w0")]
    assert sorted(run(spark, docs, items), key=key) == sorted(brute(docs, items), key=key)


def test_intervals_are_pruned(spark, monkeypatch):
    """Best-first search reads few leaves when few documents hold the rare words."""
    import numpy as np

    rnd = random.Random(1)
    shard = ranked._Shard()
    for i in range(4000):
        text = " ".join(rnd.choices(["a", "b", "c"], k=20)) + (" rare gem" if i % 500 == 7 else "")
        shard.add(i, text.encode(), None)
    row = shard.row()
    cells = {c: row.column(c)[0].values for c in ("docs", "sizes", "terms", "df", "at", "tf")}
    parts = {c: cells[c].to_numpy() for c in ("sizes", "df", "at", "tf")}
    lists = ranked._Lists(parts | {"docs": (cells["docs"].to_numpy(), np.zeros(4000, bool)), "terms": cells["terms"].to_pylist()}, 4000, shard.n_terms)
    calls = []
    peak = lists.peak
    lists.peak = lambda lo, hi: calls.append(len(lo)) or peak(lo, hi)
    best = ranked._Best(5)
    number = np.array([lists.number[t] for t in (b"rare", b"gem", b"a")])
    ranked._visit(lists, number, np.array([5000, 5000, 10]), best)
    assert set(best.id.tolist()) <= set(range(7, 4000, 500)) and len(best.id) == 5
    assert sum(calls) < 400


def test_edge_rows(spark):
    docs = [(None, "alpha beta"), (2, None), (3, ""), (4, "?!"), (5, "alpha beta"), (5, "alpha beta"), (1, "Alpha ÉTÉ x"), (9, "beta " * 30000)]
    items = [(1, "alpha"), (1, "alpha"), (1, "beta"), (None, "été ÉTÉ"), (7, None), (8, "")]
    assert sorted(run(spark, docs, items), key=key) == sorted(brute(docs, items), key=key)


def test_empty_tables_and_other_columns(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == []
    docs = spark.createDataFrame([(1, "a b", 3, 4.0)], "doc_id long, text string, item_id int, score double")
    items = spark.createDataFrame([(4, "b", 2)], "item_id long, text string, rank int")
    (row,) = ranked.search(docs, items).collect()
    assert (row["item_id"], row["rank"], row["doc_id"]) == (4, 1, 1) and row["score"] > 0
