"""Chunk decode/assembly (X1-X3) and live windows."""

import datetime as dt

from pyspark.sql import functions as F

from quillframe.session import scratch_path
from quillframe.sources.tables import calls_from_events
from quillframe.operators import metrics as M
from quillframe.streaming import chunks as X
from quillframe.streaming import live as L

T0 = dt.datetime(2024, 1, 1)


def lines(spark, rows):
    return spark.createDataFrame(
        [(rid, seq, T0 + dt.timedelta(seconds=t), line) for rid, seq, t, line in rows], X.LINE_SCHEMA
    )


def test_decode_and_assemble(spark):
    df = lines(spark, [
        (1, 0, 0, 'data: {"choices":[{"delta":{"role":"assistant"}}]}'),
        (1, 1, 1, ": ping"),
        (1, 2, 2, 'data: {"choices":[{"delta":{"content":"Hel"}}]}'),
        (1, 3, 3, "data: {broken"),
        (1, 4, 4, 'data: {"choices":[]}'),
        (1, 5, 5, 'data: {"choices":[{"delta":{"content":"lo","reasoning_content":"r"}}]}'),
        (1, 6, 6, 'data: {"choices":[{"delta":{},"finish_reason":"stop"}],"usage":{"prompt_tokens":3,"completion_tokens":2,"total_tokens":5}}'),
        (1, 7, 7, "data: [DONE]"),
        (1, 8, 8, 'data: {"choices":[{"delta":{"content":"late"}}]}'),
        (2, 0, 0, 'data: {"choices":[{"delta":{"content":"partial"}}]}'),
    ])
    out = {r.response_id: r for r in X.assemble(X.decode(df)).collect()}
    assert out[1].content == "Hello" and out[1].reasoning_content == "r" and out[1].usage.total_tokens == 5
    assert out[1].complete and out[1].finish_reason == "stop"
    assert out[2].content == "partial" and not out[2].complete and out[2].reasoning_content is None


def _content(text):
    return 'data: {"choices":[{"delta":{"content":"%s"}}]}' % text


def _assembled(spark, batches, name, path=None, **kw):
    """Each batch of lines lands as one file; one micro-batch a file."""
    src = scratch_path(spark, "test-lines") if path is None else path
    for b in batches:
        lines(spark, b).coalesce(1).write.mode("append").parquet(src)
    stream = X.read_lines(spark, src, stream=True, files_per_batch=1)
    out = L.run_available_now(X.assemble_stream(X.decode(stream, keep_skipped=True), **kw), name, path=src + "-job")
    return sorted(out.select("response_id", "content", "status", "complete", "total_tokens").collect())


def test_stream_assembly_over_late_repeated_and_unordered_chunks(spark):
    usage = 'data: {"choices":[{"delta":{},"finish_reason":"stop"}],"usage":{"prompt_tokens":3,"completion_tokens":2,"total_tokens":5}}'
    batches = [
        # reply 1 ends before its middle has come; 2 breaks off; 4 is whole at once
        [(1, 0, 0, _content("ab")), (1, 4, 4, "data: [DONE]"), (1, 5, 5, _content("stray")), (2, 0, 3, _content("left hanging")),
         (4, 0, 0, ": comment"), (4, 1, 1, _content("whole")), (4, 2, 2, "data: [DONE]")],
        # more of 1, out of order and repeated; a repeat of the closed 4 opens no second reply; 5 has a gap
        [(1, 3, 3, usage), (1, 0, 0, _content("ab")), (4, 1, 1, _content("whole")), (4, 2, 2, "data: [DONE]"),
         (5, 0, 9, _content("x")), (5, 2, 9, "data: [DONE]"), (5, 2, 9, "data: [DONE]")],
        [(1, 2, 2, _content("ef")), (1, 1, 1, _content("cd")), (1, 1, 1, _content("cd"))],
        # much later: the watermark passes what is still open
        [(3, 0, 4000, _content("much later")), (3, 1, 4001, "data: [DONE]"), (1, 1, 4001, _content("again"))],
        [(6, 0, 9000, ": beat")],
    ]
    got = _assembled(spark, batches, "test-assembly", abandon_after="10 minutes")
    assert got == [
        (1, "abcdef", "success", True, 5), (2, "left hanging", "partial", False, 0), (3, "much later", "success", True, 0),
        (4, "whole", "success", True, 0), (5, "x", "partial", False, 0),
    ]


def test_stream_assembly_goes_on_after_a_restart(spark):
    src = scratch_path(spark, "test-restart")
    assert _assembled(spark, [[(7, 0, 0, _content("one "))]], "restart", path=src) == []
    assert _assembled(spark, [[(7, 2, 2, "data: [DONE]")]], "restart", path=src) == []
    want = [(7, "one two", "success", True, 0)]
    assert _assembled(spark, [[(7, 1, 1, _content("two"))]], "restart", path=src) == want
    assert _assembled(spark, [[(7, 1, 1, _content("two")), (7, 2, 2, "data: [DONE]")]], "restart", path=src) == want


class _State:
    """A state variable and the timers of one reply; every call is counted, as each is a round trip."""

    def __init__(self, calls):
        self.calls, self.value, self.items, self.timers = calls, None, [], set()

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            return {
                "get": lambda: iter(list(self.items)) if self.items or self.value is None and self.is_list else self.value,
                "update": lambda v: setattr(self, "value", v), "appendValue": self.items.append,
                "registerTimer": self.timers.add, "clear": lambda: (self.items.clear(), setattr(self, "value", None)),
            }[name](*args)

        return call

    is_list = False


class _Times:
    def __init__(self, ms):
        self.getExpiryTimeInMs = self.getCurrentWatermarkInMs = lambda: ms


def _assembler(keep_ms=1000):
    calls = []
    a = X.ReplyAssembler(keep_ms)
    a.handle, a.parts, a.meta = (_State(calls) for _ in range(3))
    a.parts.is_list = True
    return a, calls


def _chunk(ms, seq, text=None, done=False, usage=None):
    return (1, None, ms, seq, done, text, None, usage is not None, *(usage or (0, 0, 0)))


def test_few_state_calls_per_reply_and_batch():
    a, calls = _assembler()
    assert not list(a.handleInputRows((1,), iter([_chunk(5, 0, "a"), _chunk(9, 2, "c"), _chunk(7, 1, "b"), _chunk(7, 1, "b")]), None))
    assert calls == ["get", "appendValue", "registerTimer", "update"]  # one state row for the batch's chunks
    calls.clear()
    assert not list(a.handleInputRows((1,), iter([_chunk(50, 3, "d", usage=(1, 2, 3))]), None))
    assert calls == ["get", "appendValue", "update"]  # the timer stays where it is
    [r] = a.handleInputRows((1,), iter([_chunk(60, 4, done=True)]), None)
    assert (r.content, r.total_tokens, r.status) == ("abcd", 3, "success") and not a.parts.items


def test_a_timer_that_fires_early_is_moved_on():
    a, _ = _assembler()
    list(a.handleInputRows((1,), iter([_chunk(10, 0, "a")]), None))
    list(a.handleInputRows((1,), iter([_chunk(40, 1, "b")]), None))
    assert a.handle.timers == {10}
    assert not list(a.handleExpiredTimer((1,), _Times(20), _Times(10))) and a.handle.timers == {10, 40}
    [r] = a.handleExpiredTimer((1,), _Times(41), _Times(40))
    assert (r.content, r.status, r.complete) == ("ab", "partial", False) and 1040 in a.handle.timers
    assert not list(a.handleInputRows((1,), iter([_chunk(50, 2, done=True)]), None))  # closed: opens no second reply
    assert not list(a.handleExpiredTimer((1,), _Times(1041), _Times(1040))) and a.meta.value is not None
    assert not list(a.handleExpiredTimer((1,), _Times(2000), _Times(1050))) and a.meta.value is None
    # the watermark has passed the last chunk as well: no second round
    a, _ = _assembler()
    list(a.handleInputRows((1,), iter([_chunk(10, 0, "a")]), None))
    list(a.handleInputRows((1,), iter([_chunk(40, 1, "b")]), None))
    assert [r.content for r in a.handleExpiredTimer((1,), _Times(41), _Times(10))] == ["ab"]


def test_a_reply_without_id_costs_no_other_its_chunks(spark):
    """All lines without an id are one reply, as in the batch form; replies with ids stay whole."""
    src = scratch_path(spark, "test-null-ids")
    at = dt.datetime(2024, 1, 1)
    rows = [(i, j, at, line) for i in [*range(12), None] for j, line in enumerate([_content(f"r{i}"), "data: [DONE]"])]
    spark.createDataFrame(rows, X.LINE_SCHEMA).repartition(2).write.parquet(src)
    out = L.run_available_now(X.assemble_stream(X.decode(X.read_lines(spark, src, stream=True), keep_skipped=True)), "test-null-ids")
    assert {(r.response_id, r.content, r.status) for r in out.collect()} == {(i, f"r{i}", "success") for i in [*range(12), None]}


def test_captured_text_lines(spark):
    src = scratch_path(spark, "test-captures")
    text = [(": response 5\r\n" + _content("He") + "\r\n: ping\r\n" + _content("y") + "\r\ndata: [DONE]",),
            (": response -6\n\n" + _content("solo") + "\n" + _content("st"),)]
    spark.createDataFrame(text, "value string").coalesce(1).write.text(src)
    spark.createDataFrame([(_content("no header") + "\ndata: [DONE]",)], "value string").coalesce(1).write.mode("append").text(src)
    rows = X.read_captures(spark, src)
    assert [(r.seq, r.line) for r in rows.where("response_id = 5").orderBy("seq").collect()] == [
        (0, _content("He")), (1, ": ping"), (2, _content("y")), (3, "data: [DONE]")]
    batch = sorted((r.content, r.complete) for r in X.assemble(X.decode(rows)).collect())
    assert batch == [("Hey", True), ("no header", True), ("solost", False)]
    streamed = L.run_available_now(X.read_captures(spark, src, stream=True), "test-captures")
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, rows.collect()))


def _calls(spark, path, rows):
    spark.createDataFrame(
        [(i, dt.datetime(2024, 1, d, h), u, "click", 1.0, '{"k": 1}') for i, d, h, u in rows], L.EVENTS_SCHEMA
    ).coalesce(1).write.mode("append").parquet(path)


def test_live_windows_equal_batch_in_any_layout(spark):
    sf = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{sf}/events.parquet")
    folder = scratch_path(spark, "test-events")
    events.repartition(5).write.parquet(f"{folder}/events.parquet")  # a table that is a folder of part files
    batch = {(r.period_start, r.stage): (r.calls, r.total_tokens) for r in M.calendar_consumption(calls_from_events(events)).where("grain = 'day'").collect()}
    for table_dir in (sf, folder):
        live = L.live_events(spark, table_dir).collect()
        assert {(r.window_start.strftime("%Y-%m-%d"), r.stage): (r.calls, r.total_tokens) for r in live} == batch
        last = max(r.window_start for r in live)
        assert all(r.open == (r.window_start == last) for r in live)


def test_live_windows_go_on_after_a_restart_and_a_replay(spark):
    src, table = scratch_path(spark, "test-live-in"), scratch_path(spark, "test-live")

    def run():
        rows = L.live_consumption(calls_from_events(L.events_stream(spark, "", events_path=src)), table).collect()
        return sorted((r.window_start.day, r.calls, r.open) for r in rows)

    _calls(spark, src, [(1, 1, 5, 10), (2, 1, 6, 10)])
    assert run() == [(1, 2, True)]
    assert run() == [(1, 2, True)]  # nothing new
    _calls(spark, src, [(3, 1, 7, 10), (4, 2, 0, 10)])
    assert run() == [(1, 3, True), (2, 1, True)]  # an hour's lateness: day 1 may still get rows
    _calls(spark, src, [(5, 2, 2, 10)])
    assert run() == [(1, 3, False), (2, 2, True)]
    # a batch that is written again replaces its own folder
    log = spark.read.parquet(f"{table}/table")
    again = log.where("batch = 1").drop("batch").collect()
    spark.createDataFrame(again, log.drop("batch").schema).write.mode("overwrite").parquet(f"{table}/table/batch=1")
    assert run() == [(1, 3, False), (2, 2, True)]
