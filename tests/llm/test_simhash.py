"""SimHash: Golay keys, fingerprints, links and groups against brute force."""

import re
from collections import defaultdict

import numpy as np
import xxhash

from quillframe.llm import simhash
from quillframe.llm.components import connected

DOC = "doc_id long, text string"
rng = np.random.default_rng(5)


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hs = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(x) for x in range(n)]


def near(fps):
    return [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]


def test_golay_words_two_bits_apart_share_a_key():
    words = rng.integers(0, 1 << 23, 4000)
    for bits in ((), (3,), (0, 22), (5, 6), (11, 10)):
        other = words ^ sum(1 << b for b in bits)
        (a, ma), (b, mb) = simhash.golay_keys(words), simhash.golay_keys(other)
        hit = ((a[:, :, None] == b[:, None, :]) & ma[:, :, None] & mb[:, None, :]).any(axis=(1, 2))
        assert hit.all()
    assert set(ma.sum(axis=1)) == {1, 6}


def test_keys_meet_up_to_four_bits():
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            b ^= 1 << int(bit)
        ka, kb = (set(simhash.fuzzy_keys(np.array([x], np.uint64))[0].tolist()) for x in (a, b))
        assert ka & kb


def test_fingerprints(spark):
    texts = [None, "", " \n", "One two", "ONE two", "É B c\x0bd e f g h", "x " * 50, " ".join(map(str, range(70_000))), "a b c d", "İ K k s"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    got = {r["doc"]: r["fp"] & (2**64 - 1) for r in simhash.fingerprints(docs).collect()}
    assert [got[i] for i in range(len(texts))] == [brute_print(t) for t in texts]


def test_links_find_all_components(spark):
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    fps = set(base)
    for x in base[:20]:
        for _ in range(12):
            x ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            fps.add(x)
    centre = base[0]
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)}  # one dense family
    fps = sorted(fps)
    want = roots(len(fps), near(fps))
    signed = [x - 2**64 if x >> 63 else x for x in fps]
    at = {x: i for i, x in enumerate(signed)}
    for bucket in (simhash.BUCKET, 16):  # the second: dense buckets take the block pass
        nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
        rows = [(at[r["a"]], at[r["b"]]) for r in simhash.links(nodes, bucket=bucket).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in rows)
        assert roots(len(fps), rows) == want


def test_groups(spark):
    body = " ".join(f"w{i}" for i in range(400))
    texts = [body, body, body.replace("w200 ", ""), "other text entirely " * 3, None, "", "   ", body.upper(), *(" ".join(f"{chr(97 + k)}{i * k}" for i in range(60)) for k in range(8))]
    rows = [(100 - i, t, "x") for i, t in enumerate(texts)] + [(100, body, "x"), (None, body, "y"), (None, "only here null id", "z")]
    docs = spark.createDataFrame(rows, DOC + ", component_id string")
    out = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.op6_simhash(docs).collect()]
    assert len(out) == len(rows)
    prints = [brute_print(t) for _, t, _ in rows]
    member = roots(len(rows), near(prints))
    ids = defaultdict(list)
    for k, r in enumerate(member):
        ids[r].append(rows[k][0])
    want = sorted((str(rows[k][0]), f"{prints[k]:016x}", str(min((i for i in ids[member[k]] if i is not None), default=None))) for k in range(len(rows)))
    assert sorted((str(a), b, str(c)) for a, b, c in out) == want
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    named = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert named == sorted({int(c) for _, _, c in want if c != "None"})
    assert kept.where("doc_id IS NULL").count() == 2
    assert simhash.op6_simhash(docs.limit(0)).count() == 0 and simhash.representatives(docs.limit(0)).count() == 0


def test_connected_long_path_and_star(spark):
    path = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (2000, 1999)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(50)}, 1999: 1999, 2000: 1999}
