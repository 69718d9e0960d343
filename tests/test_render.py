"""Markdown -> HTML (T10), HTML page (T11), plain text."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.functions import render as R
from tests.conftest import one


def paired(line, mark, tag):
    """``line`` with text between two marks (at least one character) put in ``tag``."""
    out, at = "", 0
    while (start := line.find(mark, at)) >= 0:
        inner = start + len(mark)
        stop = line.find(mark, inner + 1)
        if stop < 0:
            break
        out += line[at:start] + f"<{tag}>" + line[inner:stop] + f"</{tag}>"
        at = stop + len(mark)
    return out + line[at:]


def html_lines(md):
    """Line scanner: heading by its prefix, then strong and em, else a paragraph."""
    for line in md.split("\n"):
        for level in (3, 2, 1):
            prefix = "#" * level + " "
            if line.startswith(prefix) and len(line) > len(prefix):
                line = f"<h{level}>{line[len(prefix):]}</h{level}>"
                break
        line = paired(paired(line, "**", "strong"), "*", "em")
        yield line if not line or line.startswith(("<h", "<strong", "<em")) else f"<p>{line}</p>"


def test_markdown_examples(spark):
    cases = {
        "# Title\n\n## Sub\n### Deep": "<h1>Title</h1>\n\n<h2>Sub</h2>\n<h3>Deep</h3>",
        "text with **bold** and *it*": "<p>text with <strong>bold</strong> and <em>it</em></p>",
        "**all**\n*it*": "<strong>all</strong>\n<em>it</em>",
        "<b>raw</b>\r\nlast": "<p><b>raw</b>\r</p>\n<p>last</p>",
        "#none\n#### four": "<p>#none</p>\n<p>#### four</p>",
    }
    assert one(spark, R.markdown_to_html("t"), rows=[(md,) for md in cases]) == list(cases.values())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab #*<>hem\n\r")), max_size=40), min_size=1, max_size=6))
def test_markdown_matches_line_scanner(spark, texts):
    got = one(spark, R.markdown_to_html("t"), rows=[(t,) for t in texts])
    assert got == ["\n".join(html_lines(t)) for t in texts]


def test_html_page(spark):
    page = one(spark, R.html_page(F.col("t"), F.lit("Test"), F.lit("A <test>"), date=F.lit("2024-01-01")), rows=[("# Hello World",)])[0]
    assert page.startswith("<!DOCTYPE html>")
    assert "<title>Test</title>" in page and "<h1>Hello World</h1>" in page
    assert 'content="A &lt;test&gt;"' in page and "2024-01-01" in page
    untitled = one(spark, R.html_page(F.col("t")), rows=[("x",)])[0]
    assert "<title>Untitled</title>" in untitled


def test_plain_text(spark):
    md = "# Head\n- item **b** and *i* [link](http://x) ![alt](i.png) `code`"
    assert one(spark, R.markdown_to_text("t"), rows=[(md,)])[0] == "Head\nitem b and i link alt code"
