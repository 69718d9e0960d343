"""Embedding near-duplicates against all pairs, and the parts of the index."""

import numpy as np

from quillframe.llm import embeddings

VEC = "vec_id long, embedding array<double>"
rng = np.random.default_rng(13)


def group(n, dim, noise):
    centre = rng.normal(size=dim)
    return (centre / np.linalg.norm(centre) + noise / np.sqrt(dim) * rng.normal(size=(n, dim))).tolist()


def brute(rows, least=0.95):
    """Per row: links, component (least id reachable), kept; rows are (id, vector or None)."""

    def unit(v):
        if v is None or any(x is None for x in v):
            return None
        a = np.array(v, float)
        if not np.isfinite(a).all() or not a.any():
            return None
        a = a / np.abs(a).max()
        return a / np.linalg.norm(a)

    u = [unit(v) for _, v in rows]
    link = [[j for j in range(len(rows)) if j != i and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= least] for i in range(len(rows))]
    out = []
    for i, (vec, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(ids) if ids else None
        out.append((vec, len(link[i]), component, vec == component))
    return sorted(out, key=str)


def run(spark, rows, schema=VEC, **kw):
    got = embeddings.deduplicated(spark.createDataFrame(rows, schema).repartition(3), **kw)
    return sorted((tuple(r) for r in got.collect()), key=str)


def numbered(vectors, start=0):
    return [(start + i, v) for i, v in enumerate(vectors)]


def test_groups_equal_all_pairs(spark):
    vectors = group(40, 24, 0.12) + group(25, 24, 0.1) + group(3, 24, 0.15) + rng.normal(size=(120, 24)).tolist()
    vectors += [vectors[0], vectors[0], vectors[66], vectors[150]]  # equal vectors
    rows = numbered([vectors[i] for i in rng.permutation(len(vectors))])
    want = brute(rows)
    assert run(spark, rows) == want  # crowded directions as balls
    assert run(spark, rows, crowd=1000) == want  # all through the tables
    assert run(spark, rows, crowd=1000, bucket=5) == want  # hot keys in blocks
    assert run(spark, rows, block=7) == want  # balls in blocks


def test_vectors_around_balls(spark):
    """Groups too wide for one ball: members link with some of what lies around, and balls with each other."""
    vectors = group(60, 16, 0.2) + group(40, 16, 0.24)
    near = np.array(vectors[0]) + 0.25 / 4 * rng.normal(size=(30, 16))
    rows = numbered(vectors + near.tolist())
    want = brute(rows)
    assert len({w[1] for w in want}) > 10
    assert run(spark, rows, crowd=5, max_bits=64, tables=16, block=16) == want  # 16 tables find every pair


def test_recall_at_the_threshold(spark):
    """Pairs of cosine between 0.95 and 0.96: the codes find at least nine tenths."""
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=(400, 64))
    side -= (side * base).sum(axis=1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = rng.uniform(0.9501, 0.96, 400)[:, None]
    rows = numbered(base.tolist()) + numbered((cosine * base + np.sqrt(1 - cosine**2) * side).tolist(), 1000)
    found = sum(r[1] for r in run(spark, rows)) / 800
    assert 0.9 <= found <= 1


def test_edge_rows(spark):
    v = group(3, 6, 0.01)
    rows = [(1, v[0]), (1, v[0]), (2, v[1]), (None, v[2]), (3, None), (4, []), (5, [0.0] * 6), (6, [None] + v[0][1:]), (7, [float("nan")] * 6), (8, [float("inf")] * 6)]
    rows += [(9, [1e300, 1e300]), (10, [1e-300, 1e-300]), (11, [2.0, 2.0]), (None, [1.0, -1.0]), (12, [3.0]), (13, [-0.0, 1.0]), (14, [0.0, 1.0]), (15, [9.0, 9.0, 9.0])]
    assert run(spark, rows) == brute(rows)


def test_empty_table_and_other_columns(spark):
    assert run(spark, []) == []
    rows = [(2, [1.0, 0.0], 5, "a"), (1, [1.0, 0.01], 6, None)]
    assert run(spark, rows, VEC + ", n_links int, name string") == [(1, 1, 1, True), (2, 1, 1, False)]


def test_a_pair_counts_under_one_shared_key():
    code = rng.integers(0, 1 << 63, 500, dtype=np.int64).view(np.uint64)
    other = code.copy()
    for k in range(1, 12):
        at = rng.integers(0, 64, 500).astype(np.uint64)
        other = other ^ (np.uint64(1) << at)
        (ka, oa), (kb, ob) = embeddings.table_keys(code), embeddings.table_keys(other)
        first = embeddings.first_key(code, other)
        for i in range(0, 500, 29):
            shared = set(ka[oa == i].tolist()) & set(kb[ob == i].tolist())
            assert shared and first[i] in shared


def test_learned_codes_are_balanced_and_near_vectors_agree():
    x = rng.normal(size=(2000, 32)) @ np.diag(np.linspace(0.2, 2, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    model = embeddings.learned(x)
    bits = np.unpackbits(embeddings.codes(x, model).view(np.uint8).reshape(-1, 8), axis=1)
    assert (np.abs(bits[:, :].mean(axis=0) - 0.5) < 0.1).all()
    y = x + 0.02 * rng.normal(size=x.shape)
    apart = np.bitwise_count((embeddings.codes(x, model) ^ embeddings.codes(y / np.linalg.norm(y, axis=1)[:, None], model)).view(np.uint64))
    assert apart.mean() < 5
