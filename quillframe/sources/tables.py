"""Readers for the driver tables and the derived fact tables built on them.

Every reader is a plain ``spark.read.parquet``; selecting columns after the
read lets Catalyst prune the scan (``ReadSchema`` in ``explain``) and push
filters into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Fixed model names for the synthetic ``calls`` fact (model = user_id mod 3).
CALL_MODELS = ["model-a", "model-b", "model-c"]


def calls_from_events(events: DataFrame) -> DataFrame:
    """The ``calls`` fact table as a view over ``events``.

    One event = one model call: run_id = UTC day of ``ts`` (yyyyMMdd), stage =
    event_type, event_time = ts, k = props.k, prompt = 10*(k+1), completion =
    user_id, cached = 3*k, latency_ms = value as decimal(18,2), errors =
    (event_type = 'error'), retries = k mod 3, model by user_id mod 3.
    Pure projection: no shuffle, and only the six event columns are scanned.
    """
    k = F.get_json_object("props", "$.k").cast("bigint")
    models = F.array(*[F.lit(m) for m in CALL_MODELS])
    return events.select(
        F.date_format("ts", "yyyyMMdd").alias("run_id"),
        F.col("event_type").alias("stage"),
        F.col("ts").alias("event_time"),
        F.col("event_id").alias("call_id"),
        F.try_element_at(models, (F.col("user_id") % 3 + 1).cast("int")).alias("model"),
        (F.lit(10) * (k + 1)).alias("prompt_tokens"),
        F.col("user_id").cast("bigint").alias("completion_tokens"),
        (F.lit(3) * k).alias("cached_tokens"),
        F.col("value").cast("decimal(18,2)").alias("latency_ms"),
        (F.col("event_type") == "error").cast("int").alias("errors"),
        (k % 3).cast("int").alias("retries"),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls_from_events(table(spark, sf_dir, "events"))


# SQL text of the same view for the DuckDB oracle (kept next to the Spark
# definition so the two cannot drift apart silently).
CALLS_SQL = """
SELECT strftime(ts, '%Y%m%d') AS run_id,
       event_type AS stage,
       ts AS event_time,
       event_id AS call_id,
       ['model-a','model-b','model-c'][(user_id % 3) + 1] AS model,
       10 * (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) AS prompt_tokens,
       CAST(user_id AS BIGINT) AS completion_tokens,
       3 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS cached_tokens,
       CAST(value AS DECIMAL(18,2)) AS latency_ms,
       CAST(event_type = 'error' AS INTEGER) AS errors,
       CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS INTEGER) AS retries
FROM events
"""


def with_calls_cte(sql: str) -> str:
    """Prefix an oracle query with the ``calls`` CTE.

    A query starting with ``,`` continues the WITH list with its own CTEs.
    """
    body = sql.lstrip()
    sep = "" if body.startswith(",") else "\n"
    return f"WITH calls AS ({CALLS_SQL}){sep}{body}"


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def read_topics(spark: SparkSession, path: str, fmt: str = "text", stream: bool = False, files_per_batch: int | None = None,
                schema: str | None = None) -> DataFrame:
    """Topic intake from files: one topic per line (``text``) or records
    with a ``topic`` field (``json`` / ``parquet``); ``stream=True`` reads the
    folder as a file stream for continuous intake, ``files_per_batch`` files at
    a time.  ``schema`` states the records' fields; without it they are inferred
    from the files that are there.

    topic_id = xxhash64 of the topic text, so re-reading the same topics gives
    the same keys; other record fields (per-topic configuration) are kept.
    """
    if fmt == "text":
        reader = spark.readStream if stream else spark.read
        if stream and files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        df = reader.text(path).select(F.trim(F.col("value")).alias("topic")).where(F.col("topic") != "")
    else:
        reader = spark.readStream if stream else spark.read
        if stream or schema:
            reader = reader.schema(schema or spark.read.format(fmt).load(path).schema)
        if stream and files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        df = reader.format(fmt).load(path)
    if "topic_id" not in df.columns:
        df = df.withColumn("topic_id", F.xxhash64("topic"))
    return df


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """S3: stage overrides as JSON records (name, enabled, model_override,
    temperature_override, max_tokens_override, system_prompt_override);
    ``position`` (first match wins) defaults to the order of a stage's entries
    by file name and line.
    Values are taken literally (no ``${VAR}`` interpolation)."""
    from quillframe.operators.requests import OVERRIDE_SCHEMA

    df = spark.read.schema(OVERRIDE_SCHEMA).json(path)
    # the place in its file: block start and order of reading within it; the window is one stage's few entries
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    rows = df.select("*", place.alias("_place"))
    w = Window.partitionBy("name").orderBy("_place")
    return rows.withColumn("position", F.coalesce(F.col("position"), F.row_number().over(w).cast("int"))).drop("_place")
