"""Live consumption windows (X4): the streaming form of calendar consumption.

``calls`` arrive as a stream and are summed per tumbling window and stage; a
watermark bounds the state.  Every micro-batch writes the windows it changed
(update mode) into a folder of its own, named by the batch id: a batch that is
replayed after a failure overwrites its own folder, and a window's current row
is the one of its last batch.  So readers see open windows as well, flagged
``open`` until event time is ``lateness`` past their end, and a restarted job
goes on from its checkpoint beside the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.session import scratch_path
from quillframe.sources.tables import calls_from_events

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

WINDOW_KEYS = ("window_start", "window_end", "stage")


def windowed_consumption(calls: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Tumbling-window consumption per stage (window_start, window_end, stage, sums, last_event).

    On a stream a watermark of ``lateness`` bounds the state; rows that come
    later than that, in a later micro-batch, are not counted.
    """
    t = F.col("event_time").cast("timestamp")
    return (
        calls.withColumn("event_time", t)
        .withWatermark("event_time", lateness)
        .groupBy(F.window("event_time", window).alias("w"), "stage")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).cast("bigint").alias("total_tokens"),
            F.sum("cached_tokens").cast("bigint").alias("cached_tokens"),
            F.sum("errors").cast("bigint").alias("errors"),
            F.max("event_time").alias("last_event"),
        )
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "stage", "calls", "total_tokens", "cached_tokens", "errors", "last_event")
    )


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None,
                  events_path: str | None = None) -> DataFrame:
    """File-stream source over the ``events`` table, be it one file or a folder
    of part files; ``events_path`` names another folder that receives files."""
    r = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    # a pattern matches a file as well as a folder; a plain path must be a folder
    return r.parquet(events_path or f"{sf_dir.rstrip('/')}/[e]vents.parquet")


# --------------------------------------------------------------- keyed upsert


def upsert_into(stream: DataFrame, path: str, output_mode: str = "update") -> None:
    """Run ``stream`` over all available input into the batch log at ``path``.

    ``path/table/batch=<id>`` holds the rows of one micro-batch and
    ``path/checkpoint`` the stream's own state, so the same path resumes.
    """
    spark = stream.sparkSession
    table = f"{path.rstrip('/')}/table"
    # the table exists, with its columns, before the first batch
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{table}/batch=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path.rstrip('/')}/checkpoint").outputMode(output_mode)
    q.trigger(availableNow=True).start().awaitTermination()


def current_rows(spark: SparkSession, path: str, keys: tuple[str, ...]) -> DataFrame:
    """The last row of each key in the batch log at ``path``: one aggregate, combined before its shuffle."""
    log = spark.read.parquet(f"{path.rstrip('/')}/table")
    rest = [c for c in log.columns if c not in (*keys, "batch")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch").cast("bigint")).alias("_r"))
    return last.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def live_windows(spark: SparkSession, path: str, lateness: str = "1 hour") -> DataFrame:
    """Every window of the log, with ``open``: event time has not passed its end by ``lateness`` yet."""
    rows = current_rows(spark, path, WINDOW_KEYS)
    newest = rows.select(F.max("last_event")).scalar()
    return rows.withColumn("open", F.col("window_end") > newest - F.expr(f"INTERVAL {lateness}"))


def live_consumption(calls: DataFrame, path: str, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Bring the windows at ``path`` up to date with the stream ``calls`` and return them all."""
    upsert_into(windowed_consumption(calls, window, lateness), path)
    return live_windows(calls.sparkSession, path, lateness)


def live_events(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Day windows over the ``events`` table read as a stream; without ``path`` into a fresh folder."""
    calls = calls_from_events(events_stream(spark, sf_dir))
    return live_consumption(calls, path or scratch_path(spark, "live-consumption"))


def run_available_now(df: DataFrame, name: str, output_mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over all available input into parquet and read it back.

    ``path`` names the job's own folder (results and checkpoint): the same path
    goes on where the last run ended.  Without it the run is a fresh one under
    the checkpoint folder.
    """
    spark = df.sparkSession
    base = (path or scratch_path(spark, name)).rstrip("/")
    q = (
        df.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode(output_mode)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")
