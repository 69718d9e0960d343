"""Exact repeats against a dictionary of all strings; odd rows; hot groups."""

import random

import numpy as np
import pyarrow as pa

from quillframe.llm import repeats

DOC = "doc_id long, text string"


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(300)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    shared, line = make(60), make(18) + "\n"
    texts = [None, "", "short", "a" * 99, "a" * 500, "b" + "a" * 150, make(5), make(400)]
    texts += [make(30) + shared + make(rng.randint(0, 40)) for _ in range(12)]
    texts += [line * 4 + make(20) for _ in range(6)]
    base = make(200).split(" ")
    for _ in range(25):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [shared[:100], shared[:99], shared[1:102], texts[7], "short", texts[8], shared, make(50) + shared[20:130]]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_brute_force(spark):
    rows = corpus()
    got = sorted(tuple(r) for r in repeats.op5_suffix_dedup(spark.createDataFrame(rows, DOC).repartition(5)).collect())
    want = repeats.brute_force(rows)
    assert got == want
    assert sum(r[2] for r in got) > 10_000


def test_rows(spark):
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(150))
    rows = [(1, text, 1), (1, text, 1), (None, text, 2), (2, None, 3), (2, text[:120], 4), (None, "x", 5), (None, "y", 5)]
    docs = spark.createDataFrame(rows, DOC + ", kept int")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in repeats.op5_suffix_dedup(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 150, 0), (1, 150, 0), (None, 150, 150), (2, 0, 0), (2, 120, 120), (None, 1, 0), (None, 1, 0)], key=str)
    assert repeats.op5_suffix_dedup(docs.limit(0)).count() == 0


def test_packed_entries_and_few_open_starts():
    """Phrases go on as packed rows, a few dozen bytes each; prose that repeats nothing leaves few starts to compare."""
    rng = random.Random(11)
    raw = bytes(rng.choices(b"abcdefghij klmnop", k=200_000))
    starts = repeats.cuts(np.frombuffer(raw, np.uint8))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0]), pa.array([raw], pa.binary())], ["doc", "tie", "text"])
    rows = pa.Table.from_batches(list(repeats._phrases(iter([batch]))))
    assert rows.num_rows <= 1 << repeats.BITS
    assert sum(map(len, rows["data"].to_pylist())) < 60 * len(starts)  # about 20 when a batch is full
    open_ = repeats._open_starts(len(raw), starts, *repeats._flags(starts, None))
    assert len(open_) < 0.03 * len(raw)


def test_heads_and_tails(spark):
    """Repeats of little more than 100 bytes, at all offsets against the phrases, also where a phrase is long or none ends."""
    rng = random.Random(12)
    prose = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    texts = [prose(3000) for _ in range(4)]
    for k in range(60):
        source, n = texts[rng.randrange(4)], rng.choice((99, 100, 101, 120, 260))
        at = rng.randrange(len(source) - n)
        texts.append(prose(rng.randrange(3)) + source[at : at + n] + prose(rng.randrange(40)))
    rows = list(enumerate(texts))
    got = sorted(tuple(r) for r in repeats.op5_suffix_dedup(spark.createDataFrame(rows, DOC).repartition(3)).collect())
    assert got == repeats.brute_force(rows) and sum(r[2] for r in got) > 5000
