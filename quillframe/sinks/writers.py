"""Sinks (K1-K7) and the run-metrics reader.

Tables are DataFrame writes keyed by (run_id, topic_id) and partitioned by run
date, so runs never overwrite each other and readers can prune by date;
documents are files of their own (:mod:`quillframe.sinks.documents`).  Writes are committed by Spark's output committer: a task lost
with its executor is rerun and only one attempt's files are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import render as R
from quillframe.functions import text as T
from quillframe.sinks import documents as D

# The shape of one saved run-metrics document.
METRICS_SCHEMA = (
    "run_id string, pipeline_duration_s double, total_tokens bigint, total_calls bigint, "
    "agents map<string,struct<agent:string,calls:bigint,prompt_tokens:bigint,completion_tokens:bigint,"
    "total_tokens:bigint,cached_tokens:bigint,avg_latency_ms:double,tokens_per_call:double,"
    "cache_hit_rate:string,errors:bigint,retries:bigint>>"
)


def _with_run_date(df: DataFrame, run_date: Column | None) -> DataFrame:
    if "run_date" in df.columns:
        return df
    return df.withColumn("run_date", run_date if run_date is not None else F.current_date())


def write_articles(articles: DataFrame, path: str, fmt: str = "parquet", run_date: Column | None = None, mode: str = "append") -> None:
    """K1: article rows (run_id, topic_id, article, ...) partitioned by run_date."""
    _with_run_date(articles, run_date).write.mode(mode).partitionBy("run_date").format(fmt).save(path)


def write_article_bodies(articles: DataFrame, path: str, name: str = "article.md") -> None:
    """K1 (body only): the article text as is, one file per (run_id, topic_id) (see ``sinks.documents``)."""
    D.write_documents(articles, path, F.col("article"), name)


def write_publisher_output(results: DataFrame, path: str, run_date: Column | None = None, mode: str = "append") -> None:
    """K2: the publisher's raw reply plus its parsed formats, per article."""
    from quillframe.operators import contracts as C

    pub = results.where(F.col("stage") == "publisher").select(
        "run_id", "topic_id", F.col("content").alias("raw"), C.parse("content", C.PUBLISHER_SCHEMA).alias("parsed")
    )
    _with_run_date(pub, run_date).write.mode(mode).partitionBy("run_date").parquet(path)


def markdown_document(body: Column, title: Column, extra: list[tuple[str, Column]] | None = None,
                      lists: list[tuple[str, Column]] | None = None) -> Column:
    """K3: Markdown with front matter (T9): title + extra scalars + list fields."""
    items = [F.struct(F.lit("title").alias("key"), title.alias("value"), F.lit(None).cast("array<string>").alias("items"))]
    for k, v in extra or []:
        items.append(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"), F.lit(None).cast("array<string>").alias("items")))
    for k, v in lists or []:
        items.append(F.struct(F.lit(k).alias("key"), F.lit(None).cast("string").alias("value"), v.alias("items")))
    return T.render_front_matter(F.array(*items), body)


def write_markdown(df: DataFrame, path: str, body: str = "article", title: str = "topic", extra: list[tuple[str, Column]] | None = None,
                   name: str = "article.md") -> None:
    """K3: one Markdown file with front matter per (run_id, topic_id)."""
    D.write_documents(df, path, markdown_document(F.col(body), F.col(title), extra), name)


def write_html(df: DataFrame, path: str, body: str = "article", title: str = "topic", description: str | None = None,
               date: Column | None = None, name: str = "article.html") -> None:
    """K4: one HTML page (T10 + T11) per (run_id, topic_id)."""
    page = R.html_page(F.col(body), F.col(title), F.col(description) if description else None, date=date)
    D.write_documents(df, path, page, name)


def write_published(final: DataFrame, publisher: DataFrame, path: str) -> DataFrame:
    """K1 + K2 of a run: the article and the publisher's reply as files, where the publisher succeeded.

    ``final`` has (run_id, topic_id, article), ``publisher`` the stage's result
    rows.  Returns ``publisher`` with the files' paths in ``output_files`` of
    its metadata: one join on (run_id, topic_id) each way.
    """
    spark = publisher.sparkSession
    ok = publisher.where(F.col("status") == "success").select("run_id", "topic_id", F.col("content").alias("_reply"))
    done = final.select("run_id", "topic_id", "article").join(ok, ["run_id", "topic_id"])
    files = F.array(
        F.struct(F.lit("article.md").alias("name"), F.col("article").alias("body")),
        F.struct(F.lit("publisher_output.json").alias("name"), F.col("_reply").alias("body")),
    )
    rows = done.select("run_id", "topic_id", F.explode(files).alias("_f")).select("run_id", "topic_id", "_f.name", "_f.body")
    D.write_documents(rows, path, F.col("body"), F.col("name"))
    written = D.read_manifest(spark, path).groupBy("run_id", "topic_id").agg(F.array_sort(F.collect_list("path")).alias("_files"))
    written = written.select("run_id", F.col("topic_id").cast(publisher.schema["topic_id"].dataType).alias("topic_id"), "_files")
    joined = publisher.join(written, ["run_id", "topic_id"], "left")
    meta = F.when(F.col("status") == "success", F.col("metadata").withField("output_files", F.col("_files"))).otherwise(F.col("metadata"))
    return joined.withColumn("metadata", meta).select(*publisher.columns)


def json_report(df: DataFrame) -> DataFrame:
    """K5: each row as one JSON document (non-ASCII kept; compact, not indented)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json_report(df: DataFrame, path: str, mode: str = "append") -> None:
    json_report(df).write.mode(mode).text(path)


def write_metrics(calls: DataFrame, path: str, mode: str = "append") -> None:
    """K6: append the calls fact partitioned by run date (event day)."""
    calls.withColumn("run_date", F.to_date("event_time")).write.mode(mode).partitionBy("run_date").parquet(path)


def write_summary_documents(summary: DataFrame, path: str, mode: str = "append") -> None:
    """K6: the per-run summary documents (A7 ``document`` column) as JSON lines."""
    summary.select(F.col("document").alias("value")).write.mode(mode).text(path)


def read_metrics(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read every saved run-metrics document under ``path`` (all runs, not
    one file) into one row per (run, agent); missing counters default to 0 and
    a missing hit rate to ``0%``."""
    docs = spark.read.schema(METRICS_SCHEMA).option("multiLine", multi_line).json(path)
    e = docs.select("run_id", "pipeline_duration_s", "total_tokens", "total_calls", F.explode_outer("agents").alias("agent", "m"))
    return e.select(
        "run_id",
        F.coalesce("pipeline_duration_s", F.lit(0.0)).alias("pipeline_duration_s"),
        F.coalesce("total_tokens", F.lit(0)).alias("run_total_tokens"),
        F.coalesce("total_calls", F.lit(0)).alias("run_total_calls"),
        "agent",
        *[F.coalesce(F.col(f"m.{c}"), F.lit(0)).alias(c) for c in ("calls", "prompt_tokens", "completion_tokens", "total_tokens", "cached_tokens", "errors", "retries")],
        F.coalesce("m.avg_latency_ms", F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce("m.cache_hit_rate", F.lit("0%")).alias("cache_hit_rate"),
    )


def multi_run_report(metrics_rows: DataFrame) -> DataFrame:
    """Per run, the agents and the total = sum of agent total_tokens."""
    return metrics_rows.groupBy("run_id").agg(
        F.count("agent").alias("agents"),
        F.sum("total_tokens").cast("bigint").alias("total_tokens"),
        F.sum("calls").cast("bigint").alias("calls"),
    )


def write_benchmark_results(runs: DataFrame, aggregate: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K7: benchmark results as two JSON datasets: per-run rows and the aggregate row."""
    runs.write.mode(mode).json(f"{path.rstrip('/')}/runs")
    aggregate.write.mode(mode).json(f"{path.rstrip('/')}/aggregate")
