"""Text functions (T1-T8, T12-T15): the reference's example facts plus
property tests against a plain-Python statement of each rule."""

import string
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.functions import text as T
from tests.conftest import one


def test_word_count_examples(spark):
    rows = [("Hello world this is a test",), ("",), ("你好世界",), ("Hello 世界 world",), ("   ",), ("naïve 2024",)]
    assert one(spark, T.word_count("t"), rows=rows) == [6, 0, 4, 4, 0, 2]


def test_ws_word_count_is_python_split(spark):
    s = "a\tb\x1cc　d  e\r\nf"
    assert one(spark, T.ws_word_count("t"), rows=[(s,)]) == [len(s.split())]


def test_truncate_examples(spark):
    rows = [("Hello",), ("A" * 200,)]
    assert one(spark, T.truncate("t", 100), rows=rows) == ["Hello", "A" * 97 + "..."]
    out = one(spark, T.truncate("t", 50), rows=[("A" * 200,)])[0]
    assert len(out) == 50 and out.endswith("...")
    assert one(spark, T.truncate("t", 50, suffix="…"), rows=[("A" * 200,)])[0].endswith("…")


def test_truncate_below_the_suffix_length(spark):
    # fewer places than the suffix has: the cut counts from the end of the text
    wanted = ["abc...", "abcd...", "abcde...", "...", "a..."]
    assert [one(spark, T.truncate("t", n), rows=[("abcdef",)])[0] for n in range(5)] == wanted


def test_slugify_examples(spark):
    rows = [("Hello World",), ("Hello, World! @2024",), ("hello   world",), ("  hello  ",), ("snake_case -- x",)]
    assert one(spark, T.slugify("t"), rows=rows) == ["hello-world", "hello-world-2024", "hello-world", "hello", "snake_case-x"]


def test_reading_time_examples(spark):
    rows = [("Hello world",), (" ".join(["word"] * 400),), (" ".join(["word"] * 2000),), (" ".join(["w"] * 500),)]
    # 500 words / 200 = 2.5 -> 2 (half to even, as Python's round)
    assert one(spark, T.reading_time("t"), rows=rows) == ["1 min read", "2 min read", "10 min read", "2 min read"]


def test_front_matter_split_and_parse(spark):
    rows = [("---\ntitle: Test\nauthor: Me\n---\n\nContent here",), ("No frontmatter here",), ("---only one",)]
    df = spark.createDataFrame(rows, "t string").select(T.split_front_matter("t").alias("f"))
    df = df.select("f.*", T.parse_front_matter("f.header").alias("e"))
    r = df.collect()
    assert r[0].has_front_matter and r[0].body == "Content here"
    assert {e.key: e["values"] for e in r[0].e} == {"title": ["Test"], "author": ["Me"]}
    assert not r[1].has_front_matter and r[1].body == "No frontmatter here" and r[1].e == []
    assert not r[2].has_front_matter and r[2].body == "---only one"


def test_front_matter_render_roundtrip(spark):
    entries = F.array(
        F.struct(F.lit("title").alias("key"), F.lit("Test").alias("value"), F.lit(None).cast("array<string>").alias("items")),
        F.struct(F.lit("tags").alias("key"), F.lit(None).cast("string").alias("value"), F.array(F.lit("a"), F.lit("b")).alias("items")),
    )
    md = one(spark, T.render_front_matter(entries, F.lit("# Hello")), rows=[("x",)])[0]
    assert md == "---\ntitle: Test\ntags:\n  - a\n  - b\n---\n# Hello"
    df = spark.createDataFrame([(md,)], "t string").select(T.parse_front_matter(T.split_front_matter("t")["header"]).alias("e"))
    assert {e.key: e["values"] for e in df.first().e} == {"title": ["Test"], "tags": ["a", "b"]}


def test_flags_preview_join_threshold(spark):
    r = spark.createDataFrame([("Some Statistics and a QUOTE", None)], "t string, a array<string>").select(
        T.content_flags("t").alias("f"), T.preview("t", 4).alias("p"), T.join_or_default("a", "auto-detect").alias("j"),
        T.join_or_default(F.array(F.lit("x"), F.lit("y")), "-").alias("j2"), T.threshold_percent(F.lit(0.8)).alias("pct"),
    ).first()
    assert r.f.has_statistics and r.f.has_quotes and r.p == "Some..." and r.j == "auto-detect" and r.j2 == "x, y" and r.pct == 80.0


# ----------------------------------------------------------- properties

PY_WS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
alphabet = st.sampled_from(list("abcXYZ éß_-,.!?#*\t\n\r") + list(PY_WS[:12]) + ["世", "界", "😀", "\x1c"])


def counted_words(t):
    """Han characters one by one, ASCII letters by run: a scan over neighbours."""
    total, before = 0, " "
    for c in t:
        if unicodedata.name(c, "").startswith("CJK UNIFIED IDEOGRAPH"):
            total += 1
        elif c in string.ascii_letters and before not in string.ascii_letters:
            total += 1
        before = c
    return total


def joined_slug(t):
    """Words between spaces and hyphens, each without its marks, by one hyphen."""
    words = [""]
    for c in t.lower():
        if c == "-" or c.isspace():
            words.append("")
        elif c == "_" or unicodedata.category(c)[0] in "LN":
            words[-1] += c
    return "-".join(w for w in words if w)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=alphabet, max_size=30), min_size=1, max_size=8))
def test_text_rules_match_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(T.word_count("t"), T.ws_word_count("t"), T.slugify("t"), T.strip_ws("t"), T.truncate("t", 5)).collect()
    for t, r in zip(texts, got):
        assert r[0] == counted_words(t)
        assert r[1] == len(t.split())
        assert r[2] == joined_slug(t)
        assert r[3] == t.strip()
        assert r[4] == (t if len(t) <= 5 else t[:2] + "...")


def test_ws_word_count_is_python_split(spark):
    texts = ["", " ", "a", " a b c\x1c", "\x85a\xa0", "a\n\nb\t", None, "　x y ", "zé ü", "a​b"]
    got = one(spark, T.ws_word_count("t"), rows=[(x,) for x in texts])
    assert got == [None if x is None else len(x.split()) for x in texts]
    # matching runs of the negated class took ten times as long
    assert "regexp" not in str(T.ws_word_count("t")).lower()
