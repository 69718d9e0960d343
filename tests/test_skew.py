"""Hot keys: a shingle and a term held by every document, with broadcasts
disabled and AQE's skew-join thresholds lowered so the skewed partition is
split.  Results must equal a plain-Python computation."""

import math
from collections import Counter

import pytest

from quillframe.operators import analytics as A

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


@pytest.fixture
def skew_session(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


HOT = "alpha beta gamma delta epsilon zeta eta theta"


def _docs():
    words = ["w" + chr(97 + i % 26) + chr(97 + (i // 26) % 26) for i in range(400)]
    return [(i, f"{HOT} {words[i]} {words[(i * 7) % 400]} lorem") for i in range(300)]


def test_hot_shingle_overlap(skew_session):
    spark = skew_session
    docs = spark.createDataFrame(_docs(), "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, HOT), (2, HOT + " extra"), (3, "unrelated words only here and there now ok")],
                                  "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.shared, r.own) for r in A.shingle_overlap(docs, bench, 8).collect()}
    # every document holds the hot shingle once; items 1 and 2 both contain it
    assert len(got) == 600
    for (d, i), (shared, own) in got.items():
        assert i in (1, 2) and shared == 1 and own == 4  # 11 tokens -> 4 shingles


def test_hot_term_keywords(skew_session):
    spark = skew_session
    rows = _docs()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.term): r.score for r in A.top_keywords(docs, 3).collect()}
    # brute force
    tfs = {d: Counter(t.split()) for d, t in rows}
    df = Counter(term for c in tfs.values() for term in c)
    n = len(rows)
    for d, c in tfs.items():
        scored = sorted(((-(tf * math.log(n / df[t])), t) for t, tf in c.items()))[:3]
        for s, t in scored:
            assert abs(got[(d, t)] + s) < 1e-9
    assert len(got) == 3 * n
