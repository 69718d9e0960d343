"""JSON reply contracts (J1-J6): schemas and flatteners.

Replies are parsed with ``from_json`` against a fixed schema (keys missing
from a reply are null, a reply that is not JSON yields null) and flattened
with generators -- JVM-side, no shuffle.  The ``*_outer`` generators plus a
null filter are used on purpose: a plain explode makes the optimizer infer a
non-empty filter and push it below the projection, which parses (and
builds) every reply twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESEARCH_SCHEMA = (
    "struct<topic:string,key_subtopics:array<struct<title:string,key_facts:array<string>,"
    "statistics:array<string>,expert_quotes:array<string>>>,trending_angles:array<string>,"
    "controversial_claims:array<string>,suggested_sources:array<string>,unique_angle:string>"
)
OUTLINE_SCHEMA = (
    "struct<title:string,meta_description:string,target_word_count:bigint,"
    "sections:array<struct<heading:string,subheadings:array<string>,word_allocation:bigint,"
    "key_points:array<string>,seo_keywords:array<string>,transition_note:string>>,"
    "estimated_reading_time:string,content_type:string>"
)
SEO_SCHEMA = (
    "struct<seo_score:double,keyword_analysis:struct<primary_keyword:string,secondary_keywords:array<string>,"
    "keyword_density:string,recommendations:array<string>>,"
    "title_optimization:struct<current:string,suggested:string,reason:string>,"
    "meta_description:struct<current:string,optimized:string,char_count:bigint>,"
    "heading_structure:struct<issues:array<string>,suggestions:array<string>>,"
    "featured_snippet_candidates:array<string>,internal_link_suggestions:array<string>,"
    "image_alt_suggestions:array<string>,overall_recommendations:array<string>>"
)
QUALITY_SCHEMA = (
    "struct<overall_score:double,pass_threshold:boolean,"
    "dimensions:map<string,struct<score:double,notes:string>>,factual_issues:array<string>,"
    "logical_inconsistencies:array<string>,bias_flags:array<string>,"
    "improvement_suggestions:array<string>,strengths:array<string>>"
)
PUBLISHER_SCHEMA = (
    "struct<formats:map<string,string>,metadata:struct<title:string,description:string,"
    "tags:array<string>,category:string,reading_time:string,word_count:bigint>>"
)


def parse(content: Column | str, schema: str) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return F.from_json(c, schema)


def research_facts(df: DataFrame, content: str = "content", keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """One row per (subtopic, item) with kind fact / statistic / quote."""
    r = df.select(*keys, parse(content, RESEARCH_SCHEMA).alias("r"))
    sub = r.select(*keys, F.posexplode_outer("r.key_subtopics").alias("subtopic_pos", "s")).where(F.col("s").isNotNull())
    items = F.concat(
        F.transform(F.coalesce(F.col("s.key_facts"), F.array()), lambda x, i: F.struct(F.lit("fact").alias("kind"), i.alias("pos"), x.alias("item"))),
        F.transform(F.coalesce(F.col("s.statistics"), F.array()), lambda x, i: F.struct(F.lit("statistic").alias("kind"), i.alias("pos"), x.alias("item"))),
        F.transform(F.coalesce(F.col("s.expert_quotes"), F.array()), lambda x, i: F.struct(F.lit("quote").alias("kind"), i.alias("pos"), x.alias("item"))),
    )
    return sub.select(*keys, "subtopic_pos", F.col("s.title").alias("subtopic"), F.explode_outer(items).alias("it")).where(
        F.col("it").isNotNull()
    ).select(
        *keys, "subtopic_pos", "subtopic", F.col("it.kind").alias("kind"), F.col("it.pos").alias("item_pos"), F.col("it.item").alias("item")
    )


def _list_items(df: DataFrame, content: str, schema: str, keys: tuple[str, ...], lists: list[tuple[str, str]]) -> DataFrame:
    """One row per item of a reply's lists: (keys, kind, item_pos, item); ``lists`` are (kind, field of the reply)."""
    r = df.select(*keys, parse(content, schema).alias("r"))

    def items(kind: str, field: str) -> Column:
        return F.transform(F.coalesce(F.col(f"r.{field}"), F.array()), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), x.alias("item")))

    stacked = F.concat(*[items(k, f) for k, f in lists])
    rows = r.select(*keys, F.explode_outer(stacked).alias("x")).where(F.col("x").isNotNull())
    return rows.select(*keys, F.col("x.kind").alias("kind"), F.col("x.pos").alias("item_pos"), F.col("x.item").alias("item"))


def research_lists(df: DataFrame, content: str = "content", keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """Claims / sources / angles, one row per list item."""
    return _list_items(df, content, RESEARCH_SCHEMA, keys, [("claim", "controversial_claims"), ("source", "suggested_sources"), ("angle", "trending_angles")])


def seo_lists(df: DataFrame, content: str = "content", keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """Every list of the review, one row per item."""
    return _list_items(df, content, SEO_SCHEMA, keys, [
        ("secondary_keyword", "keyword_analysis.secondary_keywords"), ("keyword_recommendation", "keyword_analysis.recommendations"),
        ("heading_issue", "heading_structure.issues"), ("heading_suggestion", "heading_structure.suggestions"),
        ("featured_snippet", "featured_snippet_candidates"), ("internal_link", "internal_link_suggestions"),
        ("image_alt", "image_alt_suggestions"), ("recommendation", "overall_recommendations"),
    ])


def quality_lists(df: DataFrame, content: str = "content", keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """Every list of the quality reply, one row per item."""
    return _list_items(df, content, QUALITY_SCHEMA, keys, [
        ("factual_issue", "factual_issues"), ("logical_inconsistency", "logical_inconsistencies"), ("bias_flag", "bias_flags"),
        ("suggestion", "improvement_suggestions"), ("strength", "strengths"),
    ])


def outline_sections(df: DataFrame, content: str = "content", keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """One row per section with position, budget and lists (comma-joined; key points by line), and the reply's own fields."""
    r = df.select(*keys, parse(content, OUTLINE_SCHEMA).alias("o"))
    return r.select(
        *keys,
        F.col("o.title").alias("title"),
        F.col("o.target_word_count").alias("target_word_count"),
        *[F.col(f"o.{c}").alias(c) for c in ("meta_description", "estimated_reading_time", "content_type")],
        F.posexplode_outer("o.sections").alias("section_pos", "s"),
    ).where(F.col("s").isNotNull()).select(
        *keys,
        "title",
        "target_word_count",
        "meta_description",
        "estimated_reading_time",
        "content_type",
        "section_pos",
        F.col("s.heading").alias("heading"),
        F.col("s.word_allocation").alias("word_allocation"),
        F.coalesce(F.size("s.subheadings"), F.lit(0)).alias("n_subheadings"),
        F.array_join(F.coalesce(F.col("s.seo_keywords"), F.array()), ",").alias("seo_keywords"),
        F.coalesce(F.size("s.key_points"), F.lit(0)).alias("n_key_points"),
        F.array_join(F.coalesce(F.col("s.key_points"), F.array()), "\n").alias("key_points"),
        F.col("s.transition_note").alias("transition_note"),
    )


def keyword_density_value(text: Column) -> Column:
    """``"2.5%"`` -> 2.5 (null when no number)."""
    return F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def seo_report(df: DataFrame, content: str = "content", keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """One row per reply with score, keyword analysis, before/after fields, list sizes."""
    r = df.select(*keys, parse(content, SEO_SCHEMA).alias("s"))
    return r.select(
        *keys,
        F.col("s.seo_score").alias("seo_score"),
        F.col("s.keyword_analysis.primary_keyword").alias("primary_keyword"),
        keyword_density_value(F.col("s.keyword_analysis.keyword_density")).alias("keyword_density"),
        F.col("s.title_optimization.current").alias("title_current"),
        F.col("s.title_optimization.suggested").alias("title_suggested"),
        F.col("s.title_optimization.reason").alias("title_reason"),
        F.col("s.meta_description.current").alias("meta_current"),
        F.col("s.meta_description.optimized").alias("meta_optimized"),
        F.col("s.meta_description.char_count").alias("meta_char_count"),
        F.coalesce(F.size("s.heading_structure.issues"), F.lit(0)).alias("heading_issues"),
        F.coalesce(F.size("s.overall_recommendations"), F.lit(0)).alias("recommendations"),
    )


def quality_dimensions(df: DataFrame, content: str = "content", keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """One row per (reply, dimension) with score, notes and the reply's list sizes."""
    r = df.select(*keys, parse(content, QUALITY_SCHEMA).alias("q"))
    return r.select(
        *keys,
        F.coalesce(F.size("q.factual_issues"), F.lit(0)).alias("factual_issues"),
        F.coalesce(F.size("q.logical_inconsistencies"), F.lit(0)).alias("logical_inconsistencies"),
        F.coalesce(F.size("q.bias_flags"), F.lit(0)).alias("bias_flags"),
        F.coalesce(F.size("q.improvement_suggestions"), F.lit(0)).alias("suggestions"),
        F.coalesce(F.size("q.strengths"), F.lit(0)).alias("strengths"),
        F.explode_outer("q.dimensions").alias("dimension", "d"),
    ).where(F.col("dimension").isNotNull()).select(*keys, "dimension", F.col("d.score").alias("score"), F.col("d.notes").alias("notes"),
             "factual_issues", "logical_inconsistencies", "bias_flags", "suggestions", "strengths")


def publisher_formats(df: DataFrame, content: str = "content", keys: tuple[str, ...] = ("topic_id",)) -> DataFrame:
    """One row per (reply, format) with the format text, plus metadata fields."""
    r = df.select(*keys, parse(content, PUBLISHER_SCHEMA).alias("p"))
    return r.select(
        *keys,
        F.col("p.metadata.title").alias("title"),
        F.array_join(F.coalesce(F.col("p.metadata.tags"), F.array()), ",").alias("tags"),
        F.col("p.metadata.word_count").alias("word_count"),
        *[F.col(f"p.metadata.{c}").alias(c) for c in ("description", "category", "reading_time")],
        F.explode_outer("p.formats").alias("format", "text"),
    ).where(F.col("format").isNotNull())


def social_within_limit(text: Column, limit: int = 280) -> Column:
    """The short social post fits its character limit."""
    return F.length(text) <= limit
