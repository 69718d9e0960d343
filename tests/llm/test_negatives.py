"""Hard negatives against scores of all pairs, and the segment bounds themselves."""

import math

import numpy as np

from quillframe.llm import negatives

VEC = "vec_id long, label int, embedding array<float>"
rng = np.random.default_rng(11)


def brute(rows, every=100, k=5):
    """rows: (id, label, vector) that take part, in integers."""
    out = []
    for aid, alabel, a in rows:
        if aid % every:
            continue
        scored = [(sum(x * y for x, y in zip(a, v)), i, lab) for i, lab, v in rows if len(v) == len(a)]
        pos = sorted((-s, i) for s, i, lab in scored if lab == alabel and i != aid)[:k]
        for ps, pid in pos:
            neg = sorted((-s, i) for s, i, lab in scored if lab != alabel and 80 * -ps <= 100 * s <= 100 * -ps)[:k]
            out += [(aid, pid, r, n, -ps, -s) for r, (s, n) in enumerate(neg, 1)]
    return sorted(out)


def ints(rows):
    bad = lambda v: v is None or any(x is None or not math.isfinite(x) for x in v)
    return [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows if i is not None and lab is not None and not bad(v)]


def run(spark, rows, **kw):
    return sorted(tuple(r) for r in negatives.mined(spark.createDataFrame(rows, VEC).repartition(3), **kw).collect())


def cloud(n, dim=12, spread=0.6):
    centres = rng.normal(size=(4, dim))
    return [(i, int(rng.integers(0, 3)), (centres[i % 4] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


def test_equals_all_pairs(spark):
    rows = cloud(400)
    rows += [(1000 + i, (i + 1) % 3, rows[i % 5][2]) for i in range(30)]  # ties by id
    want = brute(ints(rows), every=10)
    assert want and run(spark, rows, anchor_every=10) == want
    assert run(spark, rows, anchor_every=10, anchor_block=7) == want


def test_edge_rows(spark):
    rows = cloud(60, dim=5)
    rows += [(None, 1, [1.0] * 5), (100, None, [1.0] * 5), (200, 1, None), (300, 1, [None, 1.0, 1.0, 1.0, 1.0]), (400, 1, [float("nan")] * 5), (500, 1, [float("inf")] * 5)]
    rows += [(600, 1, []), (601, 2, []), (602, 1, []), (700, 2, [1.0, 2.0, 3.0]), (701, 2, [1.0, 2.0, 3.0]), (702, 1, [1.0, 2.0, 2.9]), (10, 0, rows[10][2]), (800, 1, [0.0] * 5)]
    assert run(spark, rows, anchor_every=10) == brute(ints(rows), every=10)


def test_too_long_vectors_take_no_part(spark):
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (2, 1, [3e38, 0.0]), (3, 1, [0.9, 0.0])]
    assert run(spark, rows) == [(0, 1, 1, 3, 256 * 256, 256 * 230)]


def test_empty_table_and_other_columns(spark):
    assert run(spark, []) == []
    rows = [(i, 0 if i < 2 else 1, [1.0, 1.0 - i / 50], "x", 7) for i in range(5)]
    got = negatives.mined(spark.createDataFrame(rows, VEC + ", list string, score int")).collect()
    assert {r["negative_id"] for r in got} <= {2, 3, 4} and got


def test_bounds_hold_and_rule_out_pairs():
    q = rng.integers(-90, 90, (300, 33))
    mean, dev = negatives.summaries(q)
    exact = q @ q.T
    at = 0
    for level in negatives.LEVELS:
        cut = negatives._cuts(33, level)
        size, end = np.diff(cut), at + len(cut) - 1
        middle = (mean[:, at:end] * size) @ mean[:, at:end].T
        spread = (dev[:, at:end] * size) @ dev[:, at:end].T
        assert (np.abs(exact - middle) <= spread + 1e-6).all()
        at = end
    whole = np.sqrt((q * q).sum(axis=1))
    assert (spread < 0.97 * whole[:, None] * whole[None, :]).mean() > 0.9  # the finest level rules more out than lengths do


def test_lists_are_sorted_once_a_visit(monkeypatch):
    """Rows wait until there are many of them: the lists are not sorted again for every block of pairs; results stay those of brute force."""
    rng = np.random.default_rng(8)
    q = rng.integers(-60, 60, (1200, 8)).astype(np.int32)
    ids, labels = np.arange(1200), rng.integers(0, 3, 1200)
    mean, dev = negatives.summaries(q.astype(np.int64))
    anchors = np.flatnonzero(ids % 4 == 0)
    n = len(anchors)
    lists = negatives._Lists(ids[anchors], labels[anchors], q[anchors], mean[anchors], dev[anchors], np.arange(n), np.full(n, negatives.LOW), np.full(n, negatives.HIGH), np.arange(n), 5)
    sorts, lexsort = [], np.lexsort
    monkeypatch.setattr(negatives.np, "lexsort", lambda keys: sorts.append(1) or lexsort(keys))
    for s in range(0, 1200, 600):
        cut = slice(s, s + 600)
        lists.visit(ids[cut], labels[cut], q[cut], mean[cut], dev[cut], False)
    assert len(sorts) == 2
    scores = q.astype(np.int64) @ q[anchors].T.astype(np.int64)
    for k, a in enumerate(anchors.tolist()):
        want = sorted((-int(scores[r, k]), r) for r in range(1200) if labels[r] != labels[a])[:5]
        assert [(-s, r) for s, r in zip(lists.score[lists.list == k].tolist(), lists.row[lists.list == k].tolist(), strict=True)] == want
