"""The encoder shuffles nothing, and chunks of edges, blocks and odd rows make no difference."""

import numpy as np
import pyarrow as pa

from quillframe.llm import spieces
from tests.llm.test_spieces import DOC, TEXTS, brute, want


def test_no_shuffle(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), DOC)
    plan = spieces.decoded(spieces.encoded(docs))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "Exchange hashpartitioning" not in plan and "Sort" not in plan


def test_small_chunks():
    voc = spieces.vocabulary()
    pieces = {t: i for t, i, _ in voc.pieces}
    words = [" the", " naïve", "\n", " 日本", " encoding😀", " aaaa"]
    edges = [
        (s << 48 | n << 32) + pieces.get(w[s : s + n], ~ord(w[s]))
        for w in words
        for s in range(len(w))
        for n in range(1, min(voc.longest, len(w) - s) + 1)
        if n == 1 or w[s : s + n] in pieces
    ]
    data = pa.nulls(len(edges), pa.binary())

    def path(at, ids):
        return spieces._paths(at, ids, spieces._costs(voc), voc.byte_cost, voc.byte_ids)

    for step in (1, 3, len(edges)):
        block, kept = spieces._Folded(path), spieces.EDGES
        spieces.EDGES = step
        try:
            for lo in range(0, len(edges), step):
                block.add(pa.array(np.array(edges[lo : lo + step], np.int64)), data.slice(lo, step))
            block.fold(True)
        finally:
            spieces.EDGES = kept
        got = [x for part in block.ids for x in part.to_pylist()]
        assert got == [brute(w) for w in words]


def test_rows_stay_whole(spark):
    rows = [(None, "the of", 1), (None, "the of", 1), (1, None, 2), (1, "", 3), (2, "x" * 300 + " the\n", 4)]
    docs = spark.createDataFrame(rows, DOC + ", `a.b` int").coalesce(1)
    got = sorted(((r["a.b"], r["doc_id"], r["text"], r["ids"]) for r in spieces.encoded(docs).collect()), key=lambda r: r[0])
    assert got == [(n, i, t, want(t)) for i, t, n in rows]
