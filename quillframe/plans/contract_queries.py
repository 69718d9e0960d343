"""Driver queries for the JSON reply contracts.

Each query writes a contract-shaped reply per document with ``to_json``
(what a model would return), then parses and flattens it with the contract
operators.  The oracle derives the same rows straight from the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import contracts as C
from quillframe.plans.registry import query
from quillframe.plans.text_queries import SQL_TITLE, WS, doc_title
from quillframe.sources.tables import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("topic_id"), "text", "n_chars")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x != "")


def research_reply(text: Column) -> Column:
    """Research JSON: one subtopic per non-empty line; facts = its sentences,
    statistics = its numbers, a quote when the line has a comma."""
    subs = F.transform(
        _lines(text),
        lambda line: F.struct(
            line.alias("title"),
            F.split(line, r"\. ").alias("key_facts"),
            F.regexp_extract_all(line, F.lit(r"(\d+)"), 1).alias("statistics"),
            F.when(line.contains(","), F.array(line)).otherwise(F.expr("CAST(array() AS array<string>)")).alias("expert_quotes"),
        ),
    )
    lines = _lines(text)
    return F.to_json(
        F.struct(
            doc_title(text).alias("topic"), subs.alias("key_subtopics"),
            F.filter(lines, lambda x: x.contains("!")).alias("controversial_claims"),
            F.filter(lines, lambda x: x.contains("@")).alias("suggested_sources"),
            F.slice(lines, 1, 2).alias("trending_angles"),
        )
    )


_SQL_LINES = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


@query(
    "research_flatten",
    f"""WITH l AS (
  SELECT doc_id, unnest({_SQL_LINES}) AS line, generate_subscripts({_SQL_LINES}, 1) - 1 AS subtopic_pos FROM documents),
items AS (
  SELECT doc_id, subtopic_pos, line, 'fact' AS kind, unnest(string_split(line, '. ')) AS item,
         generate_subscripts(string_split(line, '. '), 1) - 1 AS item_pos FROM l
  UNION ALL
  SELECT doc_id, subtopic_pos, line, 'statistic', unnest(regexp_extract_all(line, '(\\d+)', 1)),
         generate_subscripts(regexp_extract_all(line, '(\\d+)', 1), 1) - 1 FROM l
  UNION ALL
  SELECT doc_id, subtopic_pos, line, 'quote', line, 0 FROM l WHERE contains(line, ','))
SELECT doc_id, CAST(subtopic_pos AS INTEGER) AS subtopic_pos, kind, CAST(item_pos AS INTEGER) AS item_pos,
       CAST(length(item) AS BIGINT) AS item_chars, md5(item) AS item_md5, md5(line) AS subtopic_md5
FROM items""",
)
def research_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research replies -> one row per fact / statistic / quote."""
    d = _docs(spark, sf_dir).select("topic_id", research_reply(F.col("text")).alias("content"))
    f = C.research_facts(d)
    return f.select(
        F.col("topic_id").alias("doc_id"),
        F.col("subtopic_pos").cast("int").alias("subtopic_pos"),
        "kind",
        F.col("item_pos").cast("int").alias("item_pos"),
        F.length("item").cast("bigint").alias("item_chars"),
        F.md5("item").alias("item_md5"),
        F.md5("subtopic").alias("subtopic_md5"),
    )


def _items(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("topic_id").alias("doc_id"), "kind", F.col("item_pos").cast("int").alias("item_pos"), F.md5("item").alias("item_md5"))


def _sql_items(kinds: list[tuple[str, str]], rows: str) -> str:
    parts = [f"SELECT doc_id, '{k}' AS kind, unnest({x}) AS item, generate_subscripts({x}, 1) - 1 AS item_pos FROM {rows}" for k, x in kinds]
    return f"SELECT doc_id, kind, CAST(item_pos AS INTEGER) AS item_pos, md5(item) AS item_md5 FROM ({' UNION ALL '.join(parts)})"


@query(
    "research_lists",
    f"WITH d AS (SELECT doc_id, {_SQL_LINES} AS ls FROM documents) "
    + _sql_items([("claim", "list_filter(ls, lambda x: contains(x, '!'))"), ("source", "list_filter(ls, lambda x: contains(x, '@'))"), ("angle", "ls[1:2]")], "d"),
)
def research_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims, sources and angles of research replies, one row per item."""
    return _items(C.research_lists(_docs(spark, sf_dir).select("topic_id", research_reply(F.col("text")).alias("content"))))


def outline_reply(text: Column) -> Column:
    """Outline JSON: one section per non-empty line; budget = its whitespace
    word count; subheadings = its comma parts; keywords = its distinct tokens
    of 8+ letters."""
    secs = F.transform(
        _lines(text),
        lambda line: F.struct(
            line.alias("heading"),
            F.split(line, ", ").alias("subheadings"),
            T.ws_word_count(line).alias("word_allocation"),
            F.array_distinct(F.filter(T.tokens(line), lambda t: F.length(t) >= 8)).alias("seo_keywords"),
            F.split(line, r"\. ").alias("key_points"),
            F.when(F.length(line) % 2 == 0, F.concat(F.lit("After "), F.substring_index(line, " ", 1))).alias("transition_note"),
        ),
    )
    return F.to_json(
        F.struct(
            doc_title(text).alias("title"),
            # = sum of the sections' budgets (blank lines hold no words), without building secs twice
            T.ws_word_count(text).alias("target_word_count"),
            F.substring_index(text, "\n", 1).alias("meta_description"),
            F.concat((F.length(text) % 9).cast("string"), F.lit(" min")).alias("estimated_reading_time"),
            F.lit("guide").alias("content_type"),
            secs.alias("sections"),
        )
    )


@query(
    "outline_flatten",
    f"""WITH l AS (
  SELECT doc_id, {SQL_TITLE} AS title, split_part(text, chr(10), 1) AS first, length(text) AS n, unnest({_SQL_LINES}) AS line,
         generate_subscripts({_SQL_LINES}, 1) - 1 AS section_pos FROM documents),
s AS (
  SELECT *, CAST(len(regexp_extract_all(line, '[^{WS}]+')) AS BIGINT) AS word_allocation,
         regexp_extract_all(lower(line), '(\\pL+)', 1) AS tk FROM l)
SELECT doc_id, title,
       CAST(sum(word_allocation) OVER (PARTITION BY doc_id) AS BIGINT) AS target_word_count,
       CAST(section_pos AS INTEGER) AS section_pos, md5(line) AS heading_md5, word_allocation,
       CAST(len(string_split(line, ', ')) AS INTEGER) AS n_subheadings,
       array_to_string(list_filter(tk, lambda t, i: length(t) >= 8 AND list_position(tk, t) = i), ',') AS seo_keywords,
       md5(first) AS meta_description_md5, CAST(n % 9 AS VARCHAR) || ' min' AS estimated_reading_time, 'guide' AS content_type,
       CAST(len(string_split(line, '. ')) AS INTEGER) AS n_key_points, md5(array_to_string(string_split(line, '. '), chr(10))) AS key_points_md5,
       CASE WHEN length(line) % 2 = 0 THEN 'After ' || split_part(line, ' ', 1) END AS transition_note
FROM s""",
)
def outline_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline replies -> one row per section."""
    d = _docs(spark, sf_dir).select("topic_id", outline_reply(F.col("text")).alias("content"))
    f = C.outline_sections(d)
    return f.select(
        F.col("topic_id").alias("doc_id"),
        "title",
        "target_word_count",
        F.col("section_pos").cast("int").alias("section_pos"),
        F.md5("heading").alias("heading_md5"),
        "word_allocation",
        F.col("n_subheadings").cast("int").alias("n_subheadings"),
        "seo_keywords",
        F.md5("meta_description").alias("meta_description_md5"),
        "estimated_reading_time",
        "content_type",
        F.col("n_key_points").cast("int").alias("n_key_points"),
        F.md5("key_points").alias("key_points_md5"),
        "transition_note",
    )


def seo_reply(text: Column, n_chars: Column) -> Column:
    title = doc_title(text)
    first = F.substring_index(text, "\n", 1)
    return F.to_json(
        F.struct(
            (n_chars % 101).cast("double").alias("seo_score"),
            F.struct(
                F.try_element_at(T.tokens(title), F.lit(1)).alias("primary_keyword"),
                F.slice(T.tokens(title), 2, 3).alias("secondary_keywords"),
                F.concat(((n_chars % 50) / F.lit(10.0)).cast("string"), F.lit("%")).alias("keyword_density"),
                F.array(F.concat(F.lit("use "), title)).alias("recommendations"),
            ).alias("keyword_analysis"),
            F.struct(
                title.alias("current"), F.concat(title, F.lit(": a guide")).alias("suggested"), F.when(n_chars % 2 == 0, F.lit("too short")).alias("reason")
            ).alias("title_optimization"),
            F.struct(first.alias("current"), F.upper(F.lit("better")).alias("optimized"), F.length(first).alias("char_count")).alias("meta_description"),
            F.struct(
                F.when(~text.contains("#"), F.array(F.lit("no headings"))).otherwise(F.expr("CAST(array() AS array<string>)")).alias("issues"),
                F.array_repeat(F.lit("add a heading"), (n_chars % 3).cast("int")).alias("suggestions"),
            ).alias("heading_structure"),
            F.slice(_lines(text), 1, 2).alias("featured_snippet_candidates"),
            F.array_repeat(F.lit("link home"), (n_chars % 2).cast("int")).alias("internal_link_suggestions"),
            F.array(F.concat(F.lit("image of "), title)).alias("image_alt_suggestions"),
            F.array_repeat(F.lit("tighten"), (n_chars % 4).cast("int")).alias("overall_recommendations"),
        )
    )


@query(
    "seo_flatten",
    f"""SELECT doc_id, CAST(n_chars % 101 AS DOUBLE) AS seo_score,
       regexp_extract_all(lower({SQL_TITLE}), '(\\pL+)', 1)[1] AS primary_keyword,
       (n_chars % 50) / 10.0 AS keyword_density,
       {SQL_TITLE} AS title_current, {SQL_TITLE} || ': a guide' AS title_suggested,
       CAST(length(split_part(text, chr(10), 1)) AS BIGINT) AS meta_char_count,
       CASE WHEN contains(text, '#') THEN 0 ELSE 1 END AS heading_issues,
       CAST(n_chars % 4 AS INTEGER) AS recommendations,
       CASE WHEN n_chars % 2 = 0 THEN 'too short' END AS title_reason, md5(split_part(text, chr(10), 1)) AS meta_current_md5, 'BETTER' AS meta_optimized
FROM documents""",
)
def seo_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seo replies -> one row with score, keyword analysis (density "x%" -> x), title and list sizes."""
    d = _docs(spark, sf_dir).select("topic_id", seo_reply(F.col("text"), F.col("n_chars")).alias("content"))
    f = C.seo_report(d)
    return f.select(
        F.col("topic_id").alias("doc_id"),
        "seo_score",
        "primary_keyword",
        "keyword_density",
        "title_current",
        "title_suggested",
        "meta_char_count",
        F.col("heading_issues").cast("int").alias("heading_issues"),
        F.col("recommendations").cast("int").alias("recommendations"),
        "title_reason",
        F.md5("meta_current").alias("meta_current_md5"),
        "meta_optimized",
    )


def _sql_repeat(item: str, n: int) -> str:
    return f"list_transform(range(n_chars % {n}), lambda x: '{item}')"


@query(
    "seo_lists",
    f"WITH d AS (SELECT doc_id, n_chars, text, {SQL_TITLE} AS title, regexp_extract_all(lower({SQL_TITLE}), '(\\pL+)', 1) AS tk, {_SQL_LINES} AS ls FROM documents) "
    + _sql_items([
        ("secondary_keyword", "tk[2:4]"), ("keyword_recommendation", "['use ' || title]"),
        ("heading_issue", "CASE WHEN contains(text, '#') THEN [] ELSE ['no headings'] END"), ("heading_suggestion", _sql_repeat("add a heading", 3)),
        ("featured_snippet", "ls[1:2]"), ("internal_link", _sql_repeat("link home", 2)), ("image_alt", "['image of ' || title]"), ("recommendation", _sql_repeat("tighten", 4)),
    ], "d"),
)
def seo_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list of the reviews, one row per item."""
    return _items(C.seo_lists(_docs(spark, sf_dir).select("topic_id", seo_reply(F.col("text"), F.col("n_chars")).alias("content"))))


def quality_reply(text: Column, n_chars: Column) -> Column:
    lines = _lines(text)
    return F.to_json(
        F.struct(
            n_chars.alias("overall_score"),
            F.filter(lines, lambda x: x.rlike("[0-9]")).alias("factual_issues"),
            F.slice(lines, 2, 1).alias("logical_inconsistencies"),
            F.filter(lines, lambda x: x.contains("!")).alias("bias_flags"),
            F.array_repeat(F.lit("shorten"), (n_chars % 3).cast("int")).alias("improvement_suggestions"),
            F.array(F.lit("clear")).alias("strengths"),
        )
    )


@query(
    "quality_lists",
    f"WITH d AS (SELECT doc_id, n_chars, {_SQL_LINES} AS ls FROM documents) "
    + _sql_items([
        ("factual_issue", "list_filter(ls, lambda x: regexp_matches(x, '[0-9]'))"), ("logical_inconsistency", "ls[2:2]"),
        ("bias_flag", "list_filter(ls, lambda x: contains(x, '!'))"), ("suggestion", _sql_repeat("shorten", 3)), ("strength", "['clear']"),
    ], "d"),
)
def quality_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues, inconsistencies, flags, suggestions and strengths of quality replies, one row per item."""
    return _items(C.quality_lists(_docs(spark, sf_dir).select("topic_id", quality_reply(F.col("text"), F.col("n_chars")).alias("content"))))


def publisher_reply(text: Column) -> Column:
    title = doc_title(text)
    first = F.substring_index(text, "\n", 1)
    return F.to_json(
        F.struct(
            F.create_map(
                F.lit("markdown"), F.concat(F.lit("# "), title, F.lit("\n\n"), text),
                F.lit("html_snippet"), F.concat(F.lit("<p>"), first, F.lit("</p>")),
                F.lit("social_twitter"), text,
                F.lit("social_linkedin"), first,
                F.lit("newsletter_subject"), title,
            ).alias("formats"),
            F.struct(
                title.alias("title"),
                F.array_distinct(T.tokens(title)).alias("tags"),
                T.ws_word_count(text).alias("word_count"),
                first.alias("description"),
                F.when(F.length(text) % 2 == 0, F.lit("news")).alias("category"),
                F.concat((F.length(text) % 9).cast("string"), F.lit(" min")).alias("reading_time"),
            ).alias("metadata"),
        )
    )


@query(
    "publisher_flatten",
    f"""WITH d AS (
  SELECT doc_id, text, {SQL_TITLE} AS title, split_part(text, chr(10), 1) AS first,
         regexp_extract_all(lower({SQL_TITLE}), '(\\pL+)', 1) AS tk FROM documents),
f AS (
  SELECT doc_id, title, tk, text, unnest(['markdown', 'html_snippet', 'social_twitter', 'social_linkedin', 'newsletter_subject']) AS format,
         unnest(['# ' || title || chr(10) || chr(10) || text, '<p>' || first || '</p>', text, first, title]) AS body
  FROM d)
SELECT doc_id, title, array_to_string(list_filter(tk, lambda t, i: list_position(tk, t) = i), ',') AS tags,
       CAST(len(regexp_extract_all(text, '[^{WS}]+')) AS BIGINT) AS word_count,
       format, CAST(length(body) AS BIGINT) AS text_chars, md5(body) AS text_md5,
       format <> 'social_twitter' OR length(body) <= 280 AS within_limit,
       md5(split_part(text, chr(10), 1)) AS description_md5, CASE WHEN length(text) % 2 = 0 THEN 'news' END AS category, CAST(length(text) % 9 AS VARCHAR) || ' min' AS reading_time
FROM f""",
)
def publisher_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 + P12: publisher replies -> one row per format; social post length check."""
    d = _docs(spark, sf_dir).select("topic_id", publisher_reply(F.col("text")).alias("content"))
    f = C.publisher_formats(d)
    return f.select(
        F.col("topic_id").alias("doc_id"),
        "title",
        "tags",
        "word_count",
        "format",
        F.length("text").cast("bigint").alias("text_chars"),
        F.md5("text").alias("text_md5"),
        ((F.col("format") != "social_twitter") | C.social_within_limit(F.col("text"))).alias("within_limit"),
        F.md5("description").alias("description_md5"),
        "category",
        "reading_time",
    )
