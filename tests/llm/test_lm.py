"""Stupid backoff against a dictionary version, for several orders; odd rows."""

import math
import random
from collections import Counter

from quillframe.llm import lm

DOC = "doc_id long, text string"


def brute(rows, order, alpha=lm.ALPHA, min_count=lm.MIN_COUNT):
    texts = [(d, (t or "").lower().split()) for d, t in rows]
    counts = Counter(tuple(w[i : i + k]) for _, w in texts for k in range(1, order + 1) for i in range(len(w) - k + 1))
    total = sum(len(w) for _, w in texts)

    def s(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / total)
        if counts[gram] >= min_count:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(alpha) + s(gram[1:])

    out = {}
    for d, w in texts:
        n, x = out.get(d, (0, 0.0))
        out[d] = (n + len(w), x + sum(s(tuple(w[max(0, i - order + 1) : i + 1])) for i in range(len(w))))
    return out


def corpus():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)] + ["The"] * 30
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(80)]
    return rows + [(80, None), (81, ""), (82, " \n "), (83, "the " * 500), (None, "w1 w2"), (None, "w3"), (3, "w1 w2")]


def test_scores(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], DOC + ", n_words double").repartition(3)
    for order in (1, 2, 3):
        got = {r["doc"]: (r["n_words"], r["log_score"]) for r in lm.scored(docs, order=order).collect()}
        want = brute(rows, order)
        assert got.keys() == want.keys()
        for d, (n, x) in want.items():
            assert got[d][0] == n and math.isclose(got[d][1], x, rel_tol=1e-9, abs_tol=1e-9), (order, d)


def test_query(spark):
    docs = spark.createDataFrame(corpus(), DOC)
    rows = {r["doc_id"]: r for r in lm.op1_lm_scores(docs).collect()}
    assert rows[80]["mean_score"] is None and rows[80]["n_words"] == 0
    assert rows[83]["mean_score"] > rows[0]["mean_score"]
    assert lm.op1_lm_scores(docs.limit(0)).count() == 0


def test_small_chunks(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lm, "BATCH_WORDS", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([b"a b c d e f", b"", b"g"])], ["doc", "text"])
    assert [len(c) for c in lm._chunks(iter([batch]))] == [1, 2]


def test_query_uses_trigrams(spark):
    """The registered query scores words by two words of context."""
    rows = [r for r in corpus() if r[0] is not None]
    want, pairs = brute(rows, 3), brute(rows, 2)
    got = {r["doc_id"]: r["log_score"] for r in lm.op1_lm_scores(spark.createDataFrame(rows, DOC)).collect()}
    assert all(math.isclose(got[d], x, abs_tol=1e-5) for d, (_, x) in want.items())
    assert any(not math.isclose(got[d], x, abs_tol=1e-5) for d, (_, x) in pairs.items())


def test_longer_grams_rare_words_and_counts(spark):
    """Words without a code ask for their counts; orders above three and other thresholds; empty tables."""
    rows = [(d, t if t is None else t[:90]) for d, t in corpus()]
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    for order, words, alpha, least in ((4, 1 << 20, 0.4, 2), (3, 7, 0.4, 2), (3, 0, 0.3, 1), (5, 7, 0.4, 3), (2, 7, 0.4, 2), (1, 0, 0.4, 2)):
        got = {r["doc"]: (r["n_words"], r["log_score"]) for r in lm.scored(docs, order=order, words=words, alpha=alpha, min_count=least).collect()}
        want = brute(rows, order, alpha, least)
        assert got.keys() == want.keys()
        for d, (n, x) in want.items():
            assert got[d][0] == n and math.isclose(got[d][1], x, rel_tol=1e-9, abs_tol=1e-9), (order, words, d)


def test_shuffles_less_than_the_text(spark):
    """An occurrence is a few packed bytes: what the n-grams' shuffle is given is smaller than the words' hashes."""
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(4000)], k=1500))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc long, text string").selectExpr("doc", "cast(text AS binary) AS text").coalesce(1)
    coded, least = lm._coded(lm.counts(docs), lm.WORDS)
    found = docs.mapInArrow(lm._occurrences(spark.sparkContext.broadcast(coded), least == 2, 90_000, 3, 0.4, 2, 4), lm.ROW)
    assert 0 < found.selectExpr("sum(length(data)) AS n").first()["n"] < 90_000 * 10
