"""Quality rules against a plain count; odd rows."""

import re

from quillframe.llm import quality

DOC = "doc_id long, text string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
    n = len(words)
    base = n < 10 or 100 * len(covered) > 20 * n
    return [n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), base]


def test_measures(spark):
    texts = [None, "", " \t\n\x0b", "one", "a b c d e " * 9, "é😀 # | <x>\n\n\nline two\nline two\n line two\r\n" * 3, "the house of the man and the dog is in that garden with him",
             " ".join(str(i % 7) for i in range(200)), " ".join(map(str, range(3000))) + " 1 2 3 4 5 6", "a b c\x1cd"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], DOC + ", kept string")
    rows = {r["doc_id"]: r for r in quality.op8_quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert [r[c] for c in quality.QUERY_COLUMNS[:6]] == brute(t), t
        assert not (r["base_failed"] and r["kept"])
    assert rows[6]["kept"]


def test_kept_documents_keep_columns_and_repeats(spark):
    good = "the house of the man and the dog is in that garden with him"
    docs = spark.createDataFrame([(None, good, 1), (1, good, 2), (1, good, 2), (2, "no", 3)], DOC + ", n_words int")
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns and kept.count() == 3
    assert quality.kept_documents(docs.limit(0)).count() == 0


def test_stop_words_are_asked_of_served_languages_only(spark):
    """Prose of other or unknown languages is not dropped for lacking the served languages' stop words; junk in them is."""
    other = " ".join(f"слово{i} книга{i}" for i in range(40))
    italian = " ".join(f"questo libro{i} della storia{i} che ho letto" for i in range(15))
    junk = " ".join(f"casino{i} pills{i}" for i in range(40))
    rows = [(1, other, "ru"), (2, italian, "it"), (3, other, None), (4, junk, "en"), (5, junk, "EN_us"), (6, junk, "enm"), (7, "", "en"), (8, junk + " the of and to" * 2, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    failed = {r["doc_id"]: r["failed_rules"] for r in quality.op8_quality_rules(docs).collect()}
    assert {i for i, f in failed.items() if "stop_words" in f} == {4, 5}
    assert sorted(r["doc_id"] for r in quality.kept_documents(docs).collect()) == [1, 2, 3, 6, 8]
    dotted = docs.withColumnsRenamed({"text": "a.text", "lang": "a.lang"})
    assert quality.judged(dotted, "a.text", lang="a.lang").where("kept").count() == 5
    assert quality.kept_documents(docs.drop("lang")).count() == 7
