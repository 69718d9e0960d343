"""The ledger of calls: one row per billed attempt, append-only.

A row is one request that was sent to a model, keyed by (call_id, attempt_id):
``call_id`` is the id of the request, ``attempt_id`` of the sending.  A request
that is sent again because its first reply was lost has a second attempt and
was billed twice; a row that is only written again (a job that is repeated, a
reply that several requests share) has the same key and counts once.

The columns are the ``calls`` fact that every report of
:mod:`quillframe.operators.metrics` reads.  As the tracker counts: a call has
its reply's usage whatever became of the reply, and a call that failed has an
error and no tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SCHEMA = (
    "call_id string, attempt_id string, run_id string, topic_id bigint, stage string, iteration int, variant string, model string, "
    "event_time timestamp, ended_at timestamp, prompt_tokens bigint, completion_tokens bigint, cached_tokens bigint, "
    "latency_ms decimal(18,2), errors int, retries int"
)
KEY = ["call_id", "attempt_id"]


def ledger_rows(results: DataFrame) -> DataFrame:
    """The calls behind stage results, one row per (call_id, attempt_id).

    ``event_time`` is when the call began, ``ended_at`` that plus its latency.
    Rows of a reply that several requests share are one call: they are merged
    on the key, combined before the shuffle.
    """
    micros = F.round(F.col("latency_ms") * 1000).cast("bigint")
    rows = results.where(F.col("call_id").isNotNull()).select(
        "call_id", "attempt_id", "run_id", F.col("topic_id").cast("bigint").alias("topic_id"), "stage", F.col("iteration").cast("int").alias("iteration"), "variant", "model",
        F.col("started_at").cast("timestamp").alias("event_time"),
        F.timestamp_micros(F.unix_micros(F.col("started_at").cast("timestamp")) + micros).alias("ended_at"),
        *[F.col(c).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens")],
        F.col("latency_ms").cast("decimal(18,2)").alias("latency_ms"),
        F.col("call_failed").cast("int").alias("errors"),
        F.col("retries").cast("int").alias("retries"),
    )
    return once(rows)


def once(rows: DataFrame) -> DataFrame:
    """One row per (call_id, attempt_id): of the requests that share a reply, the one that was sent names the call."""
    rest = [c for c in rows.columns if c not in KEY]
    first = ["run_id", "topic_id", "stage", "iteration", "variant"]
    ordered = first + [c for c in rest if c not in first]
    least = rows.groupBy(*KEY).agg(F.min(F.struct(*ordered)).alias("_r"))
    return least.select(*KEY, *[F.col(f"_r.{c}").alias(c) for c in rest])


def append(rows: DataFrame, path: str) -> None:
    """Append ledger rows, partitioned by the day on which the calls began."""
    day = F.coalesce(F.to_date("event_time"), F.to_date(F.lit("1970-01-01")))
    rows.withColumn("run_date", day).write.mode("append").partitionBy("run_date").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The calls of the ledger at ``path``, each attempt once however often its row was written."""
    return once(spark.read.schema(LEDGER_SCHEMA + ", run_date date").parquet(path).drop("run_date"))
