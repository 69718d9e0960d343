"""Driver queries over ``documents``: text functions T1-T13 and renderers T7-T10.

All are narrow projections: one scan of ``documents`` reading only the
columns used, no shuffle.  Each oracle states the same rule in DuckDB SQL
(RE2 regexes; ``lambda`` list functions where Java regex features are
missing in RE2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import render as R
from quillframe.functions import text as T
from quillframe.plans.registry import query
from quillframe.sources.tables import table

# The same character classes for RE2 (DuckDB).
WS = T.WS
SQL_CJK = T.CJK_CLASS


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *cols)


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '\\A[{WS}]+|[{WS}]+\\z', '', 'g')"


def sql_word_count(x: str) -> str:
    return f"(len(regexp_extract_all({x}, '{SQL_CJK}')) + len(regexp_extract_all({x}, '[a-zA-Z]+')))"


@query(
    "word_count",
    f"SELECT doc_id, CAST({sql_word_count('text')} AS BIGINT) AS word_count FROM documents",
)
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "text").select("doc_id", T.word_count("text").alias("word_count"))


@query(
    "ws_word_count",
    f"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{WS}]+')) AS BIGINT) AS ws_word_count, "
    "CAST(length(text) AS BIGINT) AS char_length FROM documents",
)
def ws_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "text")
    return d.select("doc_id", T.ws_word_count("text").alias("ws_word_count"), T.char_length("text").alias("char_length"))


@query(
    "reading_time",
    f"""SELECT doc_id,
       CAST(greatest(1, round_even({sql_word_count('text')} / 200.0, 0)) AS BIGINT) AS minutes,
       CAST(CAST(greatest(1, round_even({sql_word_count('text')} / 200.0, 0)) AS BIGINT) AS VARCHAR) || ' min read' AS reading_time,
       CAST(greatest(1, round_even({sql_word_count('text')} / 100.0, 0)) AS BIGINT) AS minutes_at_100
FROM documents""",
)
def reading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "text")
    return d.select(
        "doc_id",
        T.reading_minutes("text").alias("minutes"),
        T.reading_time("text").alias("reading_time"),
        T.reading_minutes("text", wpm=100).alias("minutes_at_100"),
    )


@query(
    "truncate",
    """SELECT doc_id,
       CASE WHEN length(text) <= 100 THEN text ELSE substr(text, 1, 97) || '...' END AS trunc_100,
       CASE WHEN length(text) <= 50 THEN text ELSE substr(text, 1, 47) || '...' END AS trunc_50,
       CASE WHEN length(text) <= 2 THEN text ELSE substr(text, 1, greatest(length(text) - 1, 0)) || '...' END AS trunc_2
FROM documents""",
)
def truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "text")
    return d.select(
        "doc_id",
        T.truncate("text", 100).alias("trunc_100"),
        T.truncate("text", 50).alias("trunc_50"),
        T.truncate("text", 2).alias("trunc_2"),
    )


def _sql_slug(x: str) -> str:
    s = sql_strip(f"lower({x})")
    s = f"regexp_replace({s}, '[^\\pL\\pN_{WS}-]', '', 'g')"
    s = f"regexp_replace({s}, '[{WS}-]+', '-', 'g')"
    return f"regexp_replace({s}, '\\A-+|-+\\z', '', 'g')"


@query(
    "slug",
    f"SELECT doc_id, {_sql_slug('text')} AS slug, {_sql_slug('source || ' + chr(39) + ' -- ' + chr(39) + ' || lang')} AS source_slug FROM documents",
)
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "text", "source", "lang")
    return d.select(
        "doc_id",
        T.slugify("text").alias("slug"),
        T.slugify(F.concat("source", F.lit(" -- "), "lang")).alias("source_slug"),
    )


@query(
    "preview",
    "SELECT doc_id, substr(text, 1, 500) || '...' AS preview FROM documents",
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "text").select("doc_id", T.preview("text").alias("preview"))


@query(
    "flags",
    """SELECT doc_id, contains(lower(text), 'statistics') AS has_statistics,
       contains(lower(text), 'quote') AS has_quotes, CAST(length(text) AS BIGINT) AS output_length
FROM documents""",
)
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "text")
    f = T.content_flags("text")
    return d.select(
        "doc_id", f["has_statistics"].alias("has_statistics"), f["has_quotes"].alias("has_quotes"), T.char_length("text").alias("output_length")
    )


# ------------------------------------------------------------- front matter


def doc_title(text: Column) -> Column:
    """Title slot for a document: its first line reduced to letters, digits and
    single spaces (so it is a safe flat-YAML scalar)."""
    t = F.regexp_replace(F.substring_index(text, "\n", 1), r"[^\p{L}\p{N} ]", "")
    return F.trim(F.regexp_replace(t, " +", " "))


SQL_TITLE = "trim(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '[^\\pL\\pN ]', '', 'g'), ' +', ' ', 'g'))"


def front_matter_entries(title: Column, lang: Column, source: Column, tags: Column) -> Column:
    e = "struct<key:string,value:string,items:array<string>>"
    return F.array(
        F.struct(F.lit("title").alias("key"), title.alias("value"), F.lit(None).cast("array<string>").alias("items")),
        F.struct(F.lit("lang").alias("key"), lang.alias("value"), F.lit(None).cast("array<string>").alias("items")),
        F.struct(F.lit("source").alias("key"), source.alias("value"), F.lit(None).cast("array<string>").alias("items")),
        F.struct(F.lit("tags").alias("key"), F.lit(None).cast("string").alias("value"), tags.alias("items")),
    ).cast(f"array<{e}>")


@query(
    "front_matter_roundtrip",
    f"""WITH d AS (
  SELECT doc_id, text, lang, source, {SQL_TITLE} AS title
  FROM documents),
t AS (
  SELECT *, list_filter(tk, lambda x, i: list_position(tk, x) = i) AS tags
  FROM (SELECT *, regexp_extract_all(lower(title), '(\\pL+)', 1) AS tk FROM d)),
m AS (
  SELECT *, '---' || chr(10) || 'title: ' || title || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source
            || chr(10) || 'tags:' || list_aggregate(list_transform(tags, lambda x: chr(10) || '  - ' || x), 'string_agg', '')
            || chr(10) || '---' || chr(10) || text AS md
  FROM t)
SELECT doc_id,
       CAST(length(md) AS BIGINT) AS md_chars,
       true AS has_front_matter,
       CAST(4 AS BIGINT) AS n_keys,
       title AS title_back,
       array_to_string(tags, ',') AS tags_back,
       lang AS lang_back,
       {sql_strip('substr(md, 4 + instr(substr(md, 4), ' + chr(39) + '---' + chr(39) + ') + 2)')} = {sql_strip('text')} AS body_matches,
       CAST(length({sql_strip('text')}) AS BIGINT) AS body_chars
FROM m""",
)
def front_matter_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "text", "lang", "source").withColumn("title", doc_title(F.col("text")))
    # tags: distinct letter tokens of the title, in first-seen order
    d = d.withColumn("tags", F.array_distinct(T.tokens("title")))
    md = T.render_front_matter(front_matter_entries(F.col("title"), F.col("lang"), F.col("source"), F.col("tags")), F.col("text"))
    d = d.withColumn("md", md)
    fm = T.split_front_matter("md")
    d = d.withColumn("fm", fm).withColumn("entries", T.parse_front_matter(F.col("fm.header")))
    kv = F.map_from_entries(F.col("entries"))
    return d.select(
        "doc_id",
        F.length("md").cast("bigint").alias("md_chars"),
        F.col("fm.has_front_matter").alias("has_front_matter"),
        F.size("entries").cast("bigint").alias("n_keys"),
        F.coalesce(F.try_element_at(kv["title"], F.lit(1)), F.lit("")).alias("title_back"),
        F.array_join(kv["tags"], ",").alias("tags_back"),
        F.try_element_at(kv["lang"], F.lit(1)).alias("lang_back"),
        (F.col("fm.body") == T.strip_ws("text")).alias("body_matches"),
        F.length(F.col("fm.body")).cast("bigint").alias("body_chars"),
    )


# ----------------------------------------------------------------- markdown


def doc_markdown(text: Column) -> Column:
    """Markdown synthesised from a document, one rule per line (1-based i):
    line 1 -> ``# ``, i % 7 == 0 -> ``### ``, i % 5 == 0 -> ``## ``,
    i % 4 == 0 -> ``**line**``, i % 3 == 0 -> ``*line*``; empty lines stay."""
    lines = F.split(text, "\n")

    def rule(line: Column, i0: Column) -> Column:
        i = i0 + 1
        return (
            F.when(line == "", line)
            .when(i == 1, F.concat(F.lit("# "), line))
            .when(i % 7 == 0, F.concat(F.lit("### "), line))
            .when(i % 5 == 0, F.concat(F.lit("## "), line))
            .when(i % 4 == 0, F.concat(F.lit("**"), line, F.lit("**")))
            .when(i % 3 == 0, F.concat(F.lit("*"), line, F.lit("*")))
            .otherwise(line)
        )

    return F.array_join(F.transform(lines, rule), "\n")


SQL_MARKDOWN = """array_to_string(list_transform(string_split(text, chr(10)), lambda l, i:
    CASE WHEN l = '' THEN l
         WHEN i = 1 THEN '# ' || l
         WHEN i % 7 = 0 THEN '### ' || l
         WHEN i % 5 = 0 THEN '## ' || l
         WHEN i % 4 = 0 THEN '**' || l || '**'
         WHEN i % 3 = 0 THEN '*' || l || '*'
         ELSE l END), chr(10))"""


def sql_markdown_to_html(x: str) -> str:
    s = f"regexp_replace({x}, '(?m)^### (.+)$', '<h3>\\1</h3>', 'g')"
    s = f"regexp_replace({s}, '(?m)^## (.+)$', '<h2>\\1</h2>', 'g')"
    s = f"regexp_replace({s}, '(?m)^# (.+)$', '<h1>\\1</h1>', 'g')"
    s = f"regexp_replace({s}, '\\*\\*(.+?)\\*\\*', '<strong>\\1</strong>', 'g')"
    s = f"regexp_replace({s}, '\\*(.+?)\\*', '<em>\\1</em>', 'g')"
    return (
        f"array_to_string(list_transform(string_split({s}, chr(10)), lambda l: CASE WHEN l <> '' AND NOT "
        "(starts_with(l, '<h') OR starts_with(l, '<strong') OR starts_with(l, '<em')) "
        "THEN '<p>' || l || '</p>' ELSE l END), chr(10))"
    )


@query(
    "markdown_html",
    f"""WITH m AS (SELECT doc_id, {SQL_MARKDOWN} AS md FROM documents)
SELECT doc_id, {sql_markdown_to_html('md')} AS html, CAST(length(md) AS BIGINT) AS md_chars FROM m""",
)
def markdown_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "text").select("doc_id", doc_markdown(F.col("text")).alias("md"))
    return d.select("doc_id", R.markdown_to_html("md").alias("html"), F.length("md").cast("bigint").alias("md_chars"))


@query(
    "front_matter_errors",
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  - early' || chr(10) ELSE '' END || 'title: ' || {SQL_TITLE} || chr(10) || '# note' || chr(10) || '  - late' || chr(10) || chr(10) || text AS h FROM documents),
l AS (SELECT doc_id, unnest(string_split(h, chr(10))) AS x, generate_subscripts(string_split(h, chr(10)), 1) AS i FROM d),
k AS (SELECT *, regexp_matches(x, '^([^\\s:#-][^:]*):[ \\t]*(.*)$') AS is_key, regexp_matches(x, '^[ \\t]+-[ \\t]+(.*)$') AS is_item FROM l),
f AS (SELECT *, min(CASE WHEN is_key THEN i END) OVER (PARTITION BY doc_id) AS first_key FROM k)
SELECT doc_id, CAST(i AS INTEGER) AS line, md5(x) AS text_md5, CASE WHEN is_item THEN 'item without a key' ELSE 'not a field' END AS reason
FROM f WHERE NOT (regexp_matches(x, '^\\s*(#.*)?$') OR is_key OR (is_item AND i > first_key))""",
)
def front_matter_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of front matter that hold no field, with their place and what is wrong."""
    d = _docs(spark, sf_dir, "text")
    early = F.when(F.col("doc_id") % 5 == 0, F.lit("  - early\n")).otherwise(F.lit(""))
    h = F.concat(early, F.lit("title: "), doc_title(F.col("text")), F.lit("\n# note\n  - late\n\n"), F.col("text"))
    e = d.select("doc_id", F.explode(T.front_matter_errors(h)).alias("e"))
    return e.select("doc_id", "e.line", F.md5("e.text").alias("text_md5"), "e.reason")
