"""Text functions as Spark Column expressions.

Everything here compiles to built-in expressions (regexp_count, split,
transform, ...), so it runs inside whole-stage codegen on the executors; no
Python runs per row.

Regex dialect notes (Java regex vs the Python rules we reproduce):
* ``WS`` below is the exact set of characters Python's ``str.split()`` /
  ``str.strip()`` / ``\\s`` treat as whitespace.  Java's ``\\s`` is ASCII-only
  and ``(?U)\\s`` misses U+001C..U+001F, so the class is spelled out.
* Python's ``\\w`` on ``str`` is letters, numbers and underscore:
  ``[\\p{L}\\p{N}_]`` (Java's ``(?U)\\w`` would also keep combining marks).
* ``(?d)`` (UNIX_LINES) makes ``.``/``^``/``$`` treat only ``\\n`` as a line
  end, like Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace characters of Python's str.split()/strip(), as a
# regex character-class body: TAB..CR, U+001C..U+0020, U+0085, U+00A0, U+1680,
# U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WS = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS_CLASS = f"[{WS}]"
# The same 29 characters as a plain string, for btrim (no regex needed).
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
WORD_CLASS = r"\p{L}\p{N}_"

# The two CJK blocks counted one word per character by
# word_count: U+4E00..U+9FFF and U+3400..U+4DBF.
CJK_CLASS = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"
ASCII_WORD = "[a-zA-Z]+"

# Our own token and sentence definitions for the corpus analytics.
TOKEN = r"\p{L}+"
SENTENCE_END = "[.!?]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_count(text: Column | str) -> Column:
    """CJK characters + runs of ASCII letters (digits and other scripts count 0)."""
    t = _c(text)
    return (F.regexp_count(t, F.lit(CJK_CLASS)) + F.regexp_count(t, F.lit(ASCII_WORD))).cast("bigint")


def ws_word_count(text: Column | str) -> Column:
    """``len(text.split())`` = number of maximal runs of non-whitespace.

    The stripped text is split at the whitespace: a tenth of the time that
    matching the runs by the negated class takes.
    """
    t = strip_ws(text)
    return F.when(t == "", 0).otherwise(F.array_size(F.split(t, f"{WS_CLASS}+"))).cast("bigint")


def char_length(text: Column | str) -> Column:
    """Length in code points."""
    return F.length(_c(text)).cast("bigint")


def strip_ws(text: Column | str) -> Column:
    """Python ``str.strip()`` (btrim over the whitespace set; no regex)."""
    return F.btrim(_c(text), F.lit(WS_CHARS))


def truncate(text: Column | str, max_chars: int = 100, suffix: str = "...") -> Column:
    """T4: unchanged when it fits, else the first ``max_chars - len(suffix)`` chars + suffix.

    A negative keep count behaves like a negative Python slice (drops chars
    from the end, floored at empty), so the result can exceed ``max_chars``
    when ``max_chars < len(suffix)``.
    """
    t = _c(text)
    keep = max_chars - len(suffix)
    n = F.lit(keep) if keep >= 0 else F.greatest(F.length(t) + F.lit(keep), F.lit(0))
    return F.when(F.length(t) <= max_chars, t).otherwise(F.concat(F.substring(t, F.lit(1), n), F.lit(suffix)))


def slugify(text: Column | str) -> Column:
    """T5: lower, strip, drop chars outside word/space/hyphen, collapse runs to '-', trim '-'."""
    t = strip_ws(F.lower(_c(text)))
    t = F.regexp_replace(t, f"[^{WORD_CLASS}{WS}-]", "")
    t = F.regexp_replace(t, f"[{WS}-]+", "-")
    return F.regexp_replace(t, r"\A-+|-+\z", "")


def reading_minutes(text: Column | str, wpm: int = 200) -> Column:
    """max(1, round_half_even(word_count / wpm))."""
    return F.greatest(F.lit(1), F.bround(word_count(text) / F.lit(float(wpm)), 0).cast("bigint")).cast("bigint")


def reading_time(text: Column | str, wpm: int = 200) -> Column:
    """``"<n> min read"``."""
    return F.concat(reading_minutes(text, wpm).cast("string"), F.lit(" min read"))


def content_flags(content: Column | str) -> Column:
    """has_statistics / has_quotes substring flags."""
    low = F.lower(_c(content))
    return F.struct(low.contains("statistics").alias("has_statistics"), low.contains("quote").alias("has_quotes"))


def preview(content: Column | str, n: int = 500) -> Column:
    """First ``n`` characters, then ``...`` always."""
    return F.concat(F.substring(_c(content), 1, n), F.lit("..."))


def join_or_default(arr: Column | str, default: str, sep: str = ", ") -> Column:
    """Join a list for a prompt slot, or a default text when empty/null."""
    a = _c(arr)
    return F.when(F.coalesce(F.size(a), F.lit(0)) > 0, F.array_join(a, sep)).otherwise(F.lit(default))


def threshold_percent(threshold: Column | str) -> Column:
    """A 0-1 threshold shown as a percentage number."""
    return _c(threshold) * F.lit(100.0)


# ---------------------------------------------------------------- front matter


def split_front_matter(text: Column | str) -> Column:
    """struct(has_front_matter, header, body).

    Only a text starting with ``---`` is split, on the first two ``---``
    anywhere (not line anchored); it needs three parts, and the body is
    stripped.  Otherwise header is null and the body is the text unchanged.
    """
    t = _c(text)
    parts = F.split(t, "---", 3)
    has = t.startswith("---") & (F.size(parts) >= 3)
    return F.struct(
        has.alias("has_front_matter"),
        F.when(has, F.try_element_at(parts, F.lit(2))).alias("header"),
        F.when(has, strip_ws(F.try_element_at(parts, F.lit(3)))).otherwise(t).alias("body"),
    )


_KEY_LINE = r"^([^\s:#-][^:]*):[ \t]*(.*)$"
_ITEM_LINE = r"^[ \t]+-[ \t]+(.*)$"


def parse_front_matter(header: Column | str) -> Column:
    """Flat YAML subset -> array<struct<key string, values array<string>>>.

    Understands ``key: value`` lines and ``key:`` followed by ``  - item``
    lines (everything :func:`render_front_matter` writes).  Values stay
    strings; a repeated key keeps its last occurrence, like YAML loaders.
    Lines matching neither form are left out (no general YAML parser);
    :func:`front_matter_errors` lists them.
    """
    lines = F.split(F.coalesce(_c(header), F.lit("")), "\n")
    entry_t = "struct<key:string,values:array<string>>"
    zero = F.struct(F.expr(f"CAST(array() AS array<{entry_t}>)").alias("entries"), F.lit(None).cast("string").alias("cur"))

    def step(acc: Column, line: Column) -> Column:
        # a fold over lambda variables only: the accumulator holds the entries
        # and the key that "  - item" lines append to
        entries = acc["entries"]
        cur = acc["cur"]
        is_key = line.rlike(_KEY_LINE)
        is_item = line.rlike(_ITEM_LINE) & cur.isNotNull()
        key = F.trim(F.regexp_extract(line, _KEY_LINE, 1))
        val = F.trim(F.regexp_extract(line, _KEY_LINE, 2))
        vals = F.when(val == "", F.expr("CAST(array() AS array<string>)")).otherwise(F.array(val))
        new_entry = F.struct(key.alias("key"), vals.alias("values"))
        # a repeated key keeps its first position and takes the new value (YAML mapping semantics)
        set_key = F.when(
            F.exists(entries, lambda e: e["key"] == key),
            F.transform(entries, lambda e: F.when(e["key"] == key, new_entry).otherwise(e)),
        ).otherwise(F.concat(entries, F.array(new_entry)))
        item = F.trim(F.regexp_extract(line, _ITEM_LINE, 1))
        add_item = F.transform(
            entries,
            lambda e: F.when(e["key"] == cur, F.struct(e["key"].alias("key"), F.concat(e["values"], F.array(item)).alias("values"))).otherwise(e),
        )
        return (
            F.when(is_key, F.struct(set_key.alias("entries"), key.alias("cur")))
            .when(is_item, F.struct(add_item.alias("entries"), cur.alias("cur")))
            .otherwise(acc)
        )

    return F.aggregate(lines, zero, step)["entries"]


def front_matter_errors(header: Column | str) -> Column:
    """array<struct<line int, text string, reason string>> of the header's lines that hold no field.

    Blank lines and ``#`` comments are no errors; ``item without a key`` is a
    ``  - item`` line before the first key, anything else is ``not a field``.
    """
    lines = F.split(F.coalesce(_c(header), F.lit("")), "\n")
    keys = F.transform(lines, lambda x: x.rlike(_KEY_LINE))
    first = F.coalesce(F.nullif(F.array_position(keys, True), F.lit(0)), F.lit(1 << 30))
    item = lambda x: x.rlike(_ITEM_LINE)
    found = F.transform(
        lines,
        lambda x, i: F.struct(
            (i + 1).cast("int").alias("line"), x.alias("text"),
            F.when(x.rlike(r"^\s*(#.*)?$") | x.rlike(_KEY_LINE) | (item(x) & (i + 1 > first)), F.lit(None))
            .when(item(x), F.lit("item without a key")).otherwise(F.lit("not a field")).alias("reason"),
        ),
    )
    return F.filter(found, lambda e: e["reason"].isNotNull())


def render_front_matter(entries: Column | str, body: Column | str) -> Column:
    """``---``, ``key: value`` / ``key:`` + ``  - item`` lines, ``---``, newline, body.

    ``entries`` is an ordered array<struct<key string, value string,
    items array<string>>>: a non-null ``items`` renders as a list.  No quoting
    or escaping, and the body follows the closing line directly.
    """
    lines = F.flatten(
        F.transform(
            _c(entries),
            lambda e: F.when(
                e["items"].isNotNull(),
                F.concat(F.array(F.concat(e["key"], F.lit(":"))), F.transform(e["items"], lambda x: F.concat(F.lit("  - "), x))),
            ).otherwise(F.array(F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))),
        )
    )
    header = F.concat(F.array(F.lit("---")), lines, F.array(F.lit("---"), F.lit("")))
    return F.concat(F.array_join(header, "\n"), _c(body))


# ------------------------------------------------------------------- tokens


def tokens(text: Column | str) -> Column:
    """Corpus token list: lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(f"({TOKEN})"), 1)


def sentence_count(text: Column | str) -> Column:
    """max(1, number of runs of sentence-ending punctuation)."""
    return F.greatest(F.lit(1), F.regexp_count(_c(text), F.lit(SENTENCE_END))).cast("bigint")
