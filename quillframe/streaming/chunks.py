"""Streamed reply chunks: decode (X1), batch assembly (X2), streaming
assembly (X3) and the stream-line sources (S4).

A chunk line is one server-sent-events line of a streamed chat completion,
keyed by (response_id, seq).  Only ``data: `` lines count; ``[DONE]`` ends a
response; lines that are not JSON, or have no choice, are skipped (a reply
with an empty ``choices`` list is skipped too instead of ending the stream).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillframe.functions import text as T
from quillframe.session import rocksdb_state, ship_package

CHUNK_SCHEMA = (
    "struct<choices:array<struct<delta:struct<content:string,reasoning_content:string>,finish_reason:string>>,"
    "usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>"
)
LINE_SCHEMA = "response_id bigint, seq bigint, event_time timestamp, line string"


def read_lines(spark, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """Chunk lines stored as parquet (response_id, seq, event_time, line)."""
    if stream:
        reader = spark.readStream.schema(LINE_SCHEMA)
        return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)
    return spark.read.schema(LINE_SCHEMA).parquet(path)


#: Comment line by which a capture names the reply whose lines follow; as a
#: comment it is no data line.
CAPTURE_HEADER = ": response "


def read_captures(spark, path: str, stream: bool = False) -> DataFrame:
    """Captured text lines, batch or stream: (response_id, seq, event_time, line, file).

    A capture file holds the raw lines of one or more replies, each after a
    line ``: response <id>``; what comes before the first such line (the whole
    file, if there is none) is a reply named by the hash of the file's path.
    ``seq`` is the line's position in its reply, so it is the same whenever and
    in whatever order files are read; event_time is the file's modification
    time.  A file is one cell until it is split: writers cap its size (see
    ``maxRecordsPerFile``).
    """
    reader = spark.readStream if stream else spark.read
    files = reader.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("event_time"))
    whole = F.regexp_replace("value", r"\r?\n\z", "")
    parts = files.select("file", "event_time", F.explode(F.split(whole, rf"\r?\n(?={CAPTURE_HEADER}-?[0-9]+\r?(?:\n|\z))")).alias("part"))
    named = F.regexp_extract("part", rf"\A{CAPTURE_HEADER}(-?[0-9]+)\r?(?:\n|\z)", 1)
    body = F.when(named != "", F.regexp_replace("part", r"\A[^\n]*(?:\n|\z)", "")).otherwise(F.col("part"))
    replies = parts.select(
        F.when(named != "", named.cast("bigint")).otherwise(F.xxhash64("file")).alias("response_id"),
        "file", "event_time", F.posexplode(F.split(body, r"\r?\n")).alias("seq", "line"),
    )
    return replies.select("response_id", F.col("seq").cast("bigint").alias("seq"), "event_time", "line", "file")


def decode(lines: DataFrame, keep_skipped: bool = False) -> DataFrame:
    """X1 + F4: keep ``data: `` lines, mark ``[DONE]``, parse the rest.

    Output: response_id, seq, event_time, is_done, delta ('' when absent),
    reasoning_delta, finish_reason, usage.  Stateless, so it runs the same
    on a batch or a streaming DataFrame.  With ``keep_skipped`` the lines that
    don't count stay, without content, so that a reader can tell a skipped
    line from one that has not arrived.
    """
    counts = F.coalesce(F.col("line").startswith("data: "), F.lit(False))
    data = lines.withColumn("line", F.when(counts, F.col("line"))) if keep_skipped else lines.where(counts)
    payload = T.strip_ws(F.substring(F.col("line"), 7, 1 << 30))
    parsed = data.select(
        "response_id",
        "seq",
        "event_time",
        (payload == "[DONE]").alias("is_done"),
        F.from_json(payload, CHUNK_SCHEMA).alias("c"),
    )
    choice = F.try_element_at(F.col("c.choices"), F.lit(1))
    ok = F.col("is_done") | (F.col("c").isNotNull() & (F.coalesce(F.size("c.choices"), F.lit(0)) >= 1))
    if keep_skipped:
        ok = F.coalesce(ok, F.lit(False))
        parsed = parsed.withColumns({"c": F.when(ok, F.col("c")), "is_done": F.coalesce("is_done", F.lit(False))})
    else:
        parsed = parsed.where(ok)
    return parsed.select(
        "response_id",
        "seq",
        "event_time",
        "is_done",
        F.when(~F.col("is_done"), F.coalesce(choice["delta"]["content"], F.lit(""))).alias("delta"),
        choice["delta"]["reasoning_content"].alias("reasoning_delta"),
        choice["finish_reason"].alias("finish_reason"),
        F.col("c.usage").alias("usage"),
    )


def assemble(decoded: DataFrame) -> DataFrame:
    """One response per response_id from its decoded chunks.

    content = non-empty deltas in seq order before the first ``[DONE]``;
    reasoning = the same for reasoning deltas, null when there are none;
    usage = the last usage seen (cached tokens are not reported by streams);
    finish_reason ``stop``; latency 0.  One shuffle on response_id; a group
    is one reply's chunks (bounded by the reply's max_tokens).
    """
    per = decoded.groupBy("response_id").agg(
        F.min(F.when(F.col("is_done"), F.col("seq"))).alias("done_seq"),
        F.array_sort(F.collect_list(F.struct("seq", "delta", "reasoning_delta", "usage"))).alias("parts"),
    )
    live = F.filter("parts", lambda p: F.col("done_seq").isNull() | (p["seq"] < F.col("done_seq")))
    text = F.array_join(F.transform(F.filter(live, lambda p: F.coalesce(p["delta"], F.lit("")) != ""), lambda p: p["delta"]), "")
    reasons = F.filter(live, lambda p: F.coalesce(p["reasoning_delta"], F.lit("")) != "")
    usages = F.filter(live, lambda p: p["usage"].isNotNull())
    last_usage = F.try_element_at(usages, F.lit(-1))["usage"]
    return per.select(
        "response_id",
        text.alias("content"),
        F.when(F.size(reasons) > 0, F.array_join(F.transform(reasons, lambda p: p["reasoning_delta"]), "")).alias("reasoning_content"),
        F.struct(
            F.coalesce(last_usage["prompt_tokens"], F.lit(0)).cast("bigint").alias("prompt_tokens"),
            F.coalesce(last_usage["completion_tokens"], F.lit(0)).cast("bigint").alias("completion_tokens"),
            F.coalesce(last_usage["total_tokens"], F.lit(0)).cast("bigint").alias("total_tokens"),
            F.lit(0).cast("bigint").alias("cached_tokens"),
        ).alias("usage"),
        F.lit("stop").alias("finish_reason"),
        F.lit(0.0).alias("latency_ms"),
        F.col("done_seq").isNotNull().alias("complete"),
    )


# ------------------------------------------------------------------- X3


ASSEMBLED_SCHEMA = (
    "response_id bigint, content string, reasoning_content string, prompt_tokens bigint, completion_tokens bigint, "
    "total_tokens bigint, status string, complete boolean"
)
#: One row per micro-batch: the chunks that came in it.
PART_STATE = (
    "parts array<struct<seq:bigint,delta:string,reasoning:string,counted:boolean,prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>>"
)
META_STATE = "done bigint, last_ms bigint, timer_ms bigint, closed boolean"


class ReplyAssembler(StatefulProcessor):
    """State of one reply: a list of the chunks that have come, and how far it is.

    A reply is emitted once: as ``success`` when ``[DONE]`` and every position
    before it are there, or as ``partial`` when the watermark passes its last
    chunk.  A closed reply keeps a marker, so that repeated or late chunks open
    no second one; the marker goes ``keep_ms`` of event time later.

    Every call to the state is a round trip, so a reply has one timer, which is
    moved on when it fires, not with every chunk.
    """

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getListState("parts", PART_STATE)
        self.meta = handle.getValueState("meta", META_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.meta.get()
        done, last, timer, closed = known or (None, None, None, False)
        came: list[tuple] = []
        for _, _, ms, seq, is_done, *part in rows:
            last = ms if last is None else max(last, ms)
            if is_done and not closed:
                done = seq if done is None else min(done, seq)
            elif not closed:
                came.append((seq, *part))
        if not closed and done is not None:
            parts = _in_order((self._held() if known else []) + came, done)
            if len(parts) == done:
                self.parts.clear()
                closed = True
                yield _reply(key[0], parts, "success")
        if not closed and came:
            self.parts.appendValue((came,))
        self._set(done, last, timer, closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        known = self.meta.get()
        if not known:
            return
        done, last, timer, closed = known
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        if timer < self._due(last, closed) >= timerValues.getCurrentWatermarkInMs():
            self._set(done, last, None, closed)
            return
        if closed:
            self.meta.clear()
            return
        yield _reply(key[0], _in_order(self._held(), done), "partial")
        self.parts.clear()
        self._set(done, last, None, True)

    def _held(self) -> list[tuple]:
        return [p for batch in self.parts.get() for p in batch[0]]

    def _due(self, last: int, closed: bool) -> int:
        return last + self.keep_ms if closed else last

    def _set(self, done, last, timer, closed) -> None:
        if timer is None:
            timer = self._due(last, closed)
            self.handle.registerTimer(timer)
        self.meta.update((done, last, timer, closed))

    def close(self) -> None:
        pass


def _in_order(parts: list[tuple], done: int | None) -> list[tuple]:
    """One chunk per position before ``done``, in order; the first to come counts."""
    once: dict[int, tuple] = {}
    for p in parts:
        if done is None or p[0] < done:
            once.setdefault(p[0], p)
    return [once[k] for k in sorted(once)]


_ASSEMBLED = Row(*[c.split()[0] for c in ASSEMBLED_SCHEMA.split(", ")])


def _reply(response_id, parts: list[tuple], status: str) -> Row:
    reasons = [p[2] for p in parts if p[2]]
    usage = next((p[4:] for p in reversed(parts) if p[3]), (0, 0, 0))
    return _ASSEMBLED(response_id, "".join(p[1] for p in parts if p[1]), "".join(reasons) if reasons else None, *usage, status, status == "success")


#: Stands for a missing event time: before any other.
NO_TIME = -((1 << 63) // 1_000_000)


def assemble_stream(decoded: DataFrame, abandon_after: str = "10 minutes", keep_closed_s: int = 3600) -> DataFrame:
    """Incremental assembly on a streaming DataFrame of chunks decoded with ``keep_skipped``.

    Chunks may come late, repeated and out of order, over any number of
    micro-batches (see :class:`ReplyAssembler`).  ``abandon_after`` is the
    watermark: a reply whose stream stops without all its chunks is emitted as
    ``partial`` once event time is that much past its last one.  State lives
    in the RocksDB store; a micro-batch adds its chunks to it.
    """
    spark = decoded.sparkSession
    ship_package(spark)
    rocksdb_state(spark)
    usage = [F.coalesce(F.col("usage")[c], F.lit(0)).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")]
    rows = decoded.withWatermark("event_time", abandon_after).select(
        "response_id",
        "event_time",
        F.coalesce(F.unix_millis(F.col("event_time").cast("timestamp")), F.lit(NO_TIME)).alias("ms"),
        "seq",
        "is_done",
        "delta",
        F.col("reasoning_delta").alias("reasoning"),
        F.col("usage").isNotNull().alias("counted"),
        *usage,
    )
    return rows.groupBy("response_id").transformWithState(ReplyAssembler(1000 * keep_closed_s), ASSEMBLED_SCHEMA, "Append", "EventTime")
