"""The pipeline against its operators' plain versions on the smallest tables."""

import re

import corpus_pipeline
from quillframe.llm import decontam, quality, secrets, simhash
from quillframe.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "ids", "n_ids", "round_trip"]
    assert out.where("NOT round_trip").count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in quality.judged(docs).where("kept").select("row.doc_id").collect()}
    # one text of each group, the groups found by comparing all pairs
    prints = {i: simhash.fingerprint((texts[i] or "").encode()) for i in kept}
    root = {i: i for i in kept}
    for i in sorted(kept):
        for j in sorted(kept):
            if i < j and (prints[i] ^ prints[j]).bit_count() <= simhash.MAX_BITS and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    firsts = {i for i in kept if root[i] == i}
    held = {r["doc_id"] for r in decontam.contaminated(docs, table(spark, SF, "benchmark")).collect()}
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(rows) == firsts - held and rows
    for r in rows.values():
        assert r["n_ids"] == len(r["ids"]) and r["n_chars"] == len(r["text"])
        assert not any(re.search(x.pattern, r["text"]) for x in secrets.RULES if x.name == "access")


def test_empty(spark, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
