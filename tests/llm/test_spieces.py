"""SentencePiece lattice: best paths against brute force, exact round trips, odd rows."""

import random
import re

import sentencepiece

from quillframe.llm import spieces

DOC = "doc_id long, text string"
VOC = spieces.vocabulary()
PIECES = {t: (i, c) for t, i, c in VOC.pieces}
TEXTS = [
    None, "", " ", "   ", "\n", "Hello  world\n x", "  a", "é\t▁b 日本 \x00 😀😀 naïve", "the quick brown fox", "x" * 700 + " " + " " * 400 + "end ",
    "def f(x):\r\n    return x\r\n", "ÉÈ de la ciónosg thth and and and", "a\n\nb \n c", "tail ", "▁", "1234567890 $%&",
]


def brute(word):
    best = [(0, [])]
    for end in range(1, len(word) + 1):
        found = []
        for start in range(max(0, end - VOC.longest), end):
            part = word[start:end]
            if part in PIECES:
                i, c = PIECES[part]
                found.append((best[start][0] + c, start, best[start][1] + [i]))
            elif end == start + 1:
                raw = part.encode()
                found.append((best[start][0] + len(raw) * VOC.byte_cost, start, best[start][1] + [VOC.byte_ids[b] for b in raw]))
        cost, _, ids = min(found)
        best.append((cost, ids))
    return best[-1][1]


def want(text):
    return [i for w in re.findall(spieces.WORD, " " + text) for i in brute(w)] if text else []


def test_paths_and_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), DOC)
    rows = {r["doc_id"]: r for r in spieces.decoded(spieces.encoded(docs)).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=spieces.MODEL)
    for i, t in enumerate(TEXTS):
        assert rows[i]["ids"] == want(t), t
        assert rows[i]["decoded"] == (t or ""), t
        if t and "▁" not in t:
            assert library.decode(rows[i]["ids"]) == t


def test_rows(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (1, "a b", 2), (1, "a b", 2), (2, None, 3)], DOC + ", decoded int")
    out = spieces.encoded(docs.withColumnRenamed("decoded", "ids"))
    assert out.count() == 4 and set(out.columns) == {"doc_id", "text", "ids"}
    again = spieces.decoded(spieces.encoded(docs))
    assert sorted(r["decoded"] for r in again.collect()) == ["", "a b", "a b", "a b"]
    assert spieces.op4_sentencepiece(docs).where("round_trip").count() == 4
    assert spieces.op4_sentencepiece(docs.limit(0)).count() == 0


def test_long_words(spark):
    """Words of any length take the least-cost path of the uncut word: no piece is lost at a bound."""
    rng = random.Random(5)
    letters = "".join(t for t in PIECES if 2 < len(t) < 9 and " " not in t)[:20_000]
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (127, 128, 129, 255, 256, 257, 1000)]
    texts += [letters[:3000], "a" + letters[500:1200] + "\n" + " " * 300 + letters[:400], "日本語の文章です。" * 60, "é\t▁😀\x00" * 100, " " * 1000, "https://example.org/" + "path/to/the/page" * 40]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    rows = {r["doc_id"]: r for r in spieces.decoded(spieces.encoded(docs)).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r" *[^ \n]+| +|\n", " " + t)
        assert "".join(words) == " " + t
        assert rows[i]["ids"] == [x for w in words for x in brute(w)], t[:50]
        assert rows[i]["decoded"] == t
