"""Driver queries that write documents and reports and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import render as R
from quillframe.plans.registry import query
from quillframe.plans.text_queries import SQL_MARKDOWN, SQL_TITLE, doc_markdown, doc_title, sql_markdown_to_html
from quillframe.session import scratch_path
from quillframe.sinks import documents as D
from quillframe.sinks import writers as K
from quillframe.sources.tables import table

#: Day of the pages, fixed so that runs compare.
PAGE_DATE = "2024-01-02"


def _sql_text(*parts: str) -> str:
    """SQL concatenation: parts in braces are expressions, line breaks become chr(10)."""
    out = []
    for p in parts:
        if p.startswith("{"):
            out.append(p[1:-1])
        else:
            out.append("'" + p.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
    return " || ".join(out)


def _sql_escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _sql_page(body: str, title: str, source: str) -> str:
    t, s = "{" + _sql_escape(title) + "}", "{" + _sql_escape(source) + "}"
    return _sql_text(
        '<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<meta name="description" content="',
        s, '">\n<meta name="author" content="quillframe">\n<meta property="og:title" content="', t, '">\n<meta property="og:description" content="', s, '">\n<title>', t,
        "</title>\n</head>\n<body>\n<header>\n<h1>", t, f'</h1>\n<p class="byline">quillframe &middot; {PAGE_DATE}</p>\n</header>\n<article>\n', "{" + sql_markdown_to_html(body) + "}",
        "\n</article>\n<footer><p>rendered by quillframe</p></footer>\n</body>\n</html>\n",
    )


@query(
    "document_files",
    f"""WITH d AS (SELECT doc_id, source, {SQL_TITLE} AS title, {SQL_MARKDOWN} AS md FROM documents),
f AS (SELECT source AS run_id, CAST(doc_id AS VARCHAR) AS topic_id, 'article.md' AS name, '---' || chr(10) || 'title: ' || title || chr(10) || '---' || chr(10) || md AS body FROM d
  UNION ALL SELECT source, CAST(doc_id AS VARCHAR), 'article.html', {_sql_page('md', 'title', 'source')} FROM d)
SELECT run_id, topic_id, name, CAST(length(body) AS BIGINT) AS chars, CAST(octet_length(encode(body)) AS BIGINT) AS bytes, sha256(body) AS sha256, md5(body) AS read_md5 FROM f""",
)
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a Markdown file with front matter and as an HTML
    page, one file each, read back and held against the manifest."""
    d = table(spark, sf_dir, "documents")
    a = d.select(F.col("source").alias("run_id"), F.col("doc_id").alias("topic_id"), "source", doc_title(F.col("text")).alias("topic"), doc_markdown(F.col("text")).alias("article"))
    path = scratch_path(spark, "document-files")
    K.write_markdown(a, path)
    K.write_html(a, path, description="source", date=F.lit(PAGE_DATE))
    listed = D.read_manifest(spark, path).select("run_id", "topic_id", "name", "bytes", "sha256")
    read = D.read_documents(spark, path).select("run_id", "topic_id", "name", F.length("body").cast("bigint").alias("chars"), F.md5("body").alias("read_md5"))
    return listed.join(read, ["run_id", "topic_id", "name"])


@query(
    "json_report",
    """SELECT sha256(value) AS sha256, CAST(length(value) AS BIGINT) AS chars, count(*) AS rows
FROM (SELECT to_json({'doc_id': doc_id, 'text': text, 'lang': lang, 'n_chars': n_chars}) AS value FROM documents) GROUP BY value""",
)
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: every document as one JSON text, written as lines and read back."""
    path = scratch_path(spark, "json-report")
    K.write_json_report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    lines = spark.read.text(path)
    return lines.groupBy("value").agg(F.count(F.lit(1)).alias("rows")).select(F.sha2("value", 256).alias("sha256"), F.length("value").cast("bigint").alias("chars"), "rows")


@query(
    "publish_targets",
    f"""WITH d AS (SELECT doc_id, {SQL_TITLE} AS title, {SQL_MARKDOWN} AS md FROM documents)
SELECT doc_id, 'digest' AS target, '<' || title || '> ' || CAST(length(md) AS VARCHAR) AS rendered FROM d
UNION ALL SELECT doc_id, 'unheard-of', NULL FROM d""",
)
def publish_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: a renderer that the user registers, and a target that nobody knows (null)."""
    R.register_renderer("digest", lambda body, title, meta: F.concat(F.lit("<"), title, F.lit("> "), F.length(body).cast("string")))
    d = table(spark, sf_dir, "documents").select("doc_id", doc_title(F.col("text")).alias("title"), doc_markdown(F.col("text")).alias("md"))
    e = d.select("*", F.explode(F.array(F.lit("digest"), F.lit("unheard-of"))).alias("target"))
    return e.select("doc_id", "target", R.render_target(F.col("target"), F.col("md"), F.col("title"), {}).alias("rendered"))
