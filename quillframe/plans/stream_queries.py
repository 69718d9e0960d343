"""Driver queries for streamed replies (X1-X3, S4) and live consumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.plans.registry import query
from quillframe.plans.simulated import sse_lines
from quillframe.session import scratch_path
from quillframe.sources.tables import table, with_calls_cte
from quillframe.streaming import chunks as X
from quillframe.streaming import live as L


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn as one streamed reply, cut into 20-char chunks
    (plus keep-alive, malformed, empty-choices, usage, [DONE] and a stray
    post-[DONE] line); assistant turns also stream a reasoning chunk."""
    conv = table(spark, sf_dir, "conversations")
    resp = conv.select(
        (F.col("conv_id") * F.lit(1 << 32) + F.col("turn")).alias("response_id"),
        F.timestamp_seconds(F.lit(1704067200) + 60 * F.col("conv_id")).alias("event_time"),
        "text",
        F.when(F.col("role") == "assistant", F.concat(F.lit("plan for turn "), F.col("turn").cast("string"))).alias("reasoning"),
        (F.col("turn") * 10).alias("prompt_tokens"),
    )
    return sse_lines(resp, F.col("text"), 20, reasoning=F.col("reasoning"), prompt_tokens=F.col("prompt_tokens"))


_ASSEMBLY_SQL = """SELECT conv_id * 4294967296 + turn AS response_id,
       CAST(length(text) AS BIGINT) AS content_chars, md5(text) AS content_md5,
       CASE WHEN role = 'assistant' THEN 'plan for turn ' || CAST(turn AS VARCHAR) END AS reasoning_content,
       CAST(turn * 10 AS BIGINT) AS prompt_tokens,
       CAST((length(text) + 3) // 4 AS BIGINT) AS completion_tokens,
       CAST(turn * 10 + (length(text) + 3) // 4 AS BIGINT) AS total_tokens,
       true AS complete{extra}
FROM conversations"""


def chunk_rows(lines: DataFrame) -> DataFrame:
    a = X.assemble(X.decode(lines))
    return a.select(
        "response_id",
        F.length("content").cast("bigint").alias("content_chars"),
        F.md5("content").alias("content_md5"),
        "reasoning_content",
        F.col("usage.prompt_tokens").alias("prompt_tokens"),
        F.col("usage.completion_tokens").alias("completion_tokens"),
        F.col("usage.total_tokens").alias("total_tokens"),
        "complete",
    )


@query("chunk_assembly", _ASSEMBLY_SQL.format(extra=""))
def chunk_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 + X2: decode chunk lines and assemble one reply per response (batch)."""
    return chunk_rows(chunk_lines(spark, sf_dir))


#: Parts in which the lines reach the streaming query, and the heartbeat's delay behind the last of them.
PARTS = 3
HEARTBEAT_HOURS = 24


def arriving_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part, response_id, seq, event_time, line): the chunk lines as they reach a consumer.

    Lines are dealt to the parts by hash, so a reply's chunks come out of order
    and over all parts; a fifth of them come again in the next part; event time
    is the hour of arrival.  Every eleventh reply breaks off before ``[DONE]``,
    and a heartbeat line a day later moves the watermark past it.
    """
    lines = chunk_lines(spark, sf_dir)
    h = F.pmod(F.xxhash64("response_id", "seq"), F.lit(5 * PARTS))
    part = F.floor(h / 5).cast("int")
    again = F.when(h % 5 == 0, F.array(part, (part + 1) % PARTS)).otherwise(F.array(part))
    ended = (F.col("line") == "data: [DONE]") | F.contains("line", F.lit("after done"))
    come = lines.where(~((F.col("response_id") % 11 == 0) & ended)).select("response_id", "seq", "line", F.explode(again).alias("part"))
    beat = spark.range(1).select(F.lit(-1).cast("bigint").alias("response_id"), F.lit(0).cast("bigint").alias("seq"), F.lit(": heartbeat").alias("line"), F.lit(PARTS).alias("part"))
    hour = F.when(F.col("part") == PARTS, F.lit(HEARTBEAT_HOURS)).otherwise(F.col("part"))
    rows = come.unionByName(beat)
    return rows.select("part", "response_id", "seq", F.timestamp_seconds(F.lit(1704067200) + 3600 * hour + F.col("seq") % 60).alias("event_time"), "line")


@query(
    "stream_assembly",
    """SELECT conv_id * 4294967296 + turn AS response_id,
       CAST(length(text) AS BIGINT) AS content_chars, md5(text) AS content_md5,
       CASE WHEN role = 'assistant' THEN 'plan for turn ' || CAST(turn AS VARCHAR) END AS reasoning_content,
       CAST(turn * 10 AS BIGINT) AS prompt_tokens,
       CAST((length(text) + 3) // 4 AS BIGINT) AS completion_tokens,
       CAST(turn * 10 + (length(text) + 3) // 4 AS BIGINT) AS total_tokens,
       (conv_id * 4294967296 + turn) % 11 <> 0 AS complete,
       CASE WHEN (conv_id * 4294967296 + turn) % 11 <> 0 THEN 'success' ELSE 'partial' END AS status
FROM conversations""",
)
def stream_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply assembled by the stateful stream over four micro-batches.

    Chunks come late, repeated and out of order; a reply that breaks off is
    emitted as ``partial`` when the watermark passes it, any other one once.
    """
    src = scratch_path(spark, "chunk-lines")
    lines = arriving_lines(spark, sf_dir).persist()
    files = spark.sparkContext.defaultParallelism
    for part in range(PARTS + 1):  # one after the other: a later part's files are newer
        lines.where(F.col("part") == part).drop("part").repartition(files).write.mode("append").parquet(src)
    arriving = X.read_lines(spark, src, stream=True, files_per_batch=files)
    out = L.run_available_now(X.assemble_stream(X.decode(arriving, keep_skipped=True), "8 hours"), "stream-assembly")
    lines.unpersist()
    return out.select(
        "response_id",
        F.length("content").cast("bigint").alias("content_chars"),
        F.md5("content").alias("content_md5"),
        "reasoning_content",
        "prompt_tokens",
        "completion_tokens",
        "total_tokens",
        "complete",
        "status",
    )


@query("captured_lines", _ASSEMBLY_SQL.format(extra=""))
def captured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures as plain text files, read as a stream of lines with their
    positions, stored as a line table and assembled: the rows of ``chunk_assembly``."""
    src = scratch_path(spark, "captures")
    lines = chunk_lines(spark, sf_dir)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"]), "\n")
    files = lines.groupBy("response_id").agg(body.alias("body"))  # a group is one reply
    captured = files.select(F.concat(F.lit(X.CAPTURE_HEADER), F.col("response_id").cast("string"), F.lit("\n"), "body").alias("value"))
    captured.write.option("maxRecordsPerFile", 2000).text(src)
    read = L.run_available_now(X.read_captures(spark, src, stream=True), "captured-lines", path=f"{src}-job")
    return chunk_rows(read)


@query(
    "live_consumption",
    with_calls_cte(
        """
, m AS (SELECT max(event_time) AS mx FROM calls)
SELECT strftime(date_trunc('day', event_time), '%Y-%m-%d') AS period_start, stage,
       count(*) AS calls,
       CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens,
       CAST(sum(cached_tokens) AS BIGINT) AS cached_tokens,
       CAST(sum(errors) AS BIGINT) AS errors,
       date_trunc('day', min(event_time)) + INTERVAL 1 DAY > any_value(mx) - INTERVAL 1 HOUR AS open
FROM calls, m
GROUP BY date_trunc('day', event_time), stage
"""
    ),
)
def live_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day windows per stage from a stream of calls; every window is there,
    the ones that event time has not passed by an hour flagged as open."""
    w = L.live_events(spark, sf_dir)
    return w.select(F.date_format("window_start", "yyyy-MM-dd").alias("period_start"), "stage", "calls", "total_tokens", "cached_tokens", "errors", "open")
