"""Rendering as Column expressions: Markdown -> HTML body (T10), HTML page
(T11), plain-text fallback (P14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def markdown_to_html(md: Column | str) -> Column:
    """Six ordered regex passes.

    ``###``, ``##``, ``#`` headings; ``**bold**``; ``*italic*``; then every
    non-empty line that does not start with ``<h``, ``<strong`` or ``<em`` is
    wrapped in ``<p>``.  No lists, links, code or escaping.  ``(?d)`` keeps
    ``\\n`` the only line end, as in Python.
    """
    t = _c(md)
    t = F.regexp_replace(t, r"(?md)^### (.+)$", "<h3>$1</h3>")
    t = F.regexp_replace(t, r"(?md)^## (.+)$", "<h2>$1</h2>")
    t = F.regexp_replace(t, r"(?md)^# (.+)$", "<h1>$1</h1>")
    t = F.regexp_replace(t, r"(?d)\*\*(.+?)\*\*", "<strong>$1</strong>")
    t = F.regexp_replace(t, r"(?d)\*(.+?)\*", "<em>$1</em>")
    return F.regexp_replace(t, r"(?md)^(?!<h|<strong|<em)(.+)$", "<p>$1</p>")


def html_escape(text: Column | str) -> Column:
    """Escape &, <, >, double and single quotes for attribute/text use."""
    t = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def html_page(
    body_md: Column | str,
    title: Column | str | None = None,
    description: Column | str | None = None,
    author: Column | str | None = None,
    date: Column | str | None = None,
    lang: str = "en",
) -> Column:
    """A complete HTML5 page around :func:`markdown_to_html`.

    Missing title -> ``Untitled``, description -> empty, author -> ``quillframe``.
    ``date`` is a column (yyyy-MM-dd) so output is reproducible; it defaults
    to the current UTC date.  Unlike a plain f-string, title, description and
    author are HTML-escaped.
    """
    ttl = html_escape(F.coalesce(_c(title), F.lit("Untitled")) if title is not None else F.lit("Untitled"))
    desc = html_escape(F.coalesce(_c(description), F.lit("")) if description is not None else F.lit(""))
    auth = html_escape(F.coalesce(_c(author), F.lit("quillframe")) if author is not None else F.lit("quillframe"))
    day = _c(date) if date is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd")
    return F.concat(
        F.lit(f'<!DOCTYPE html>\n<html lang="{lang}">\n<head>\n<meta charset="UTF-8">\n'),
        F.lit('<meta name="viewport" content="width=device-width, initial-scale=1">\n'),
        F.lit('<meta name="description" content="'), desc, F.lit('">\n'),
        F.lit('<meta name="author" content="'), auth, F.lit('">\n'),
        F.lit('<meta property="og:title" content="'), ttl, F.lit('">\n'),
        F.lit('<meta property="og:description" content="'), desc, F.lit('">\n'),
        F.lit("<title>"), ttl, F.lit("</title>\n</head>\n<body>\n<header>\n<h1>"), ttl,
        F.lit('</h1>\n<p class="byline">'), auth, F.lit(" &middot; "), day,
        F.lit("</p>\n</header>\n<article>\n"), markdown_to_html(body_md),
        F.lit("\n</article>\n<footer><p>rendered by quillframe</p></footer>\n</body>\n</html>\n"),
    )


def markdown_to_text(md: Column | str) -> Column:
    """Plain-text fallback: drop heading marks, emphasis, images, links
    (keeping their text), inline code ticks and list bullets."""
    t = _c(md)
    t = F.regexp_replace(t, r"(?md)^#{1,6}[ \t]+", "")
    t = F.regexp_replace(t, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(?d)\*\*(.+?)\*\*", "$1")
    t = F.regexp_replace(t, r"(?d)\*(.+?)\*", "$1")
    t = F.regexp_replace(t, r"`([^`]*)`", "$1")
    return F.regexp_replace(t, r"(?md)^[ \t]*[-*+][ \t]+", "")


# ------------------------------------------------------------ U4 targets

# A publish-target renderer is fn(body_md, title, metadata_columns) -> Column.
_RENDERERS: dict = {}


def register_renderer(name: str, fn) -> None:
    """U4: add (or replace) a publish target rendered by a Column function."""
    _RENDERERS[name] = fn


def renderer_names() -> list[str]:
    return sorted(_RENDERERS)


def render_target(target: Column, body: Column, title: Column, meta: dict[str, Column] | None = None) -> Column:
    """Render ``body`` for the target named in ``target`` (null for unknown targets).

    All registered renderers become one CASE expression, evaluated per row
    on the executors.
    """
    meta = meta or {}
    out = None
    for name, fn in _RENDERERS.items():
        out = (F.when(target == name, fn(body, title, meta)) if out is None else out.when(target == name, fn(body, title, meta)))
    return out if out is not None else F.lit(None).cast("string")


def _markdown_target(body, title, meta):
    from quillframe.functions import text as T

    entries = [F.struct(F.lit("title").alias("key"), title.alias("value"), F.lit(None).cast("array<string>").alias("items"))]
    for k, v in meta.items():
        entries.append(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"), F.lit(None).cast("array<string>").alias("items")))
    return T.render_front_matter(F.array(*entries), body)


register_renderer("markdown", _markdown_target)
register_renderer("html", lambda body, title, meta: markdown_to_html(body))
register_renderer("text", lambda body, title, meta: markdown_to_text(body))
