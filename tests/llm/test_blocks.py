"""Texts encoded in small blocks equal the word-by-word version."""

import random

import pyarrow as pa

from quillframe.llm import spieces
from tests.llm.test_spieces import DOC, TEXTS, want


def test_many_blocks(spark):
    rng = random.Random(3)
    words = ["the", "of", "naïve", "日本", "x" * 300, "\n", "encode", "blocks"]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randint(0, 80))) for _ in range(60)] + ["the of"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(3)
    kept = spieces.BLOCK_WORDS
    spieces.BLOCK_WORDS = 50  # read when the blocks are cut, below
    try:
        got = {r["doc_id"]: r["ids"] for r in spieces.encoded(docs.sort("doc_id")).collect()}
    finally:
        spieces.BLOCK_WORDS = kept
    assert got == {i: want(t) for i, t in enumerate(texts)}


def test_cut_and_put_together(monkeypatch):
    monkeypatch.setattr(spieces, "BLOCK_WORDS", 4)
    monkeypatch.setattr(spieces, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": lambda self: 2})())}))
    lists = [["a", "b", "a"], ["c"], ["b"] * 6, ["a", "c"]]
    keys = [bytes([i]) * 32 for i in range(4)]
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(lists, pa.list_(pa.string()))], ["key", "words"])
    blocks = [pa.Table.from_batches([b]) for b in spieces._blocks(iter([batch]))]
    assert len(blocks) == 3
    ids = {"a": [1, 2], "b": [3], "c": [4, 5, 6], None: None}
    out = {}
    for b in blocks:
        b = b.append_column("ids", pa.array([ids[w] for w in b["word"].to_pylist()], pa.list_(pa.int32())))
        out |= dict(zip(*(c.to_pylist() for c in spieces._unblocked(b.slice(0)).columns), strict=True))
    assert out == {k: [i for w in ws for i in ids[w]] for k, ws in zip(keys, lists, strict=True)}
