"""Batch completion: pools, journal, resumed jobs (with an injected transport, no server)."""

import json
import threading
import time

import pandas as pd
import pytest

from quillframe.operators import http_completion as H
from quillframe.operators import inference as I
from quillframe.operators import ledger as L
from quillframe.operators import metrics as M
from quillframe.operators import requests as Q
from quillframe.operators import stages as S
from quillframe.plans import workflow as W


def body(text="hi"):
    return json.dumps({"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 5, "completion_tokens": 2, "total_tokens": 7}}).encode()


def batches(n, size=10):
    rows = pd.DataFrame({"request_id": [f"r{i}" for i in range(n)], "payload": [json.dumps({"n": i}) for i in range(n)]})
    return iter([rows.iloc[i : i + size].reset_index(drop=True) for i in range(0, n, size)])


class Sent:
    """Remembers the payloads, in memory or, across processes, in a file; fails hard once ``limit`` were sent."""

    def __init__(self, path=None, limit=None):
        self.path, self.limit, self.seen, self.lock = path, limit, [], threading.Lock()

    def __getstate__(self):
        return {"path": self.path, "limit": self.limit}

    def __setstate__(self, s):
        self.__init__(**s)

    def count(self):
        return len(open(self.path).read().split()) if self.path else len(self.seen)

    def __call__(self, url, data, headers, timeout):
        with self.lock:
            if self.limit is not None and self.count() >= self.limit:
                raise KeyboardInterrupt("the executor is lost")
            self.seen.append(data)
            if self.path:
                with open(self.path, "a") as f:
                    f.write("x ")
        return 200, body()


def test_a_lost_task_sends_again_only_what_was_not_journalled(tmp_path):
    journal = H.ReplyJournal(f"file:{tmp_path}/j")
    first = Sent()
    run = H.HttpCompleter("http://x", transport=first, yield_rows=4, pool=2).send(3, batches(30), journal)
    got = [next(run) for _ in range(4)]  # lost after four hand-overs
    run.close()
    assert len(first.seen) == 14  # 4 + 4 + 2 of the first batch, 4 of the second
    second = Sent()
    out = pd.concat(H.HttpCompleter("http://x", transport=second, yield_rows=4, pool=2).send(3, batches(30), journal))
    assert len(second.seen) == 16 and sorted(out["request_id"]) == sorted(f"r{i}" for i in range(30))
    before = pd.concat(got).set_index("request_id")["attempt_id"]
    assert (out.set_index("request_id")["attempt_id"].loc[before.index] == before).all()  # the same billed attempts
    other = Sent()
    list(H.HttpCompleter("http://x", transport=other).send(4, batches(3), journal))
    assert len(other.seen) == 3  # another partition's journal


def test_failed_calls_are_tried_again_on_a_rerun(tmp_path):
    journal = H.ReplyJournal(str(tmp_path))
    down = H.HttpCompleter("http://x", transport=lambda *a: (400, b"no"))
    assert pd.concat(down.send(0, batches(3), journal))["error"].notna().all()
    up = Sent()
    assert pd.concat(H.HttpCompleter("http://x", transport=up).send(0, batches(3), journal))["error"].isna().all() and len(up.seen) == 3


def test_calls_run_side_by_side(tmp_path):
    def slow(*a):
        time.sleep(0.2)
        return 200, body()

    start = time.monotonic()
    list(H.HttpCompleter("http://x", transport=slow, pool=8).send(0, batches(8), H.ReplyJournal(str(tmp_path))))
    assert time.monotonic() - start < 1.0


def test_connections_stay_open(monkeypatch):
    made = []

    class Connection:
        def __init__(self, netloc, timeout):
            made.append(netloc)
            self.sent = 0

        def request(self, method, path, body, headers):
            self.sent += 1
            if self.sent == 3 and len(made) == 1:
                raise ConnectionResetError  # the other side closed it
            self.path = path

        def getresponse(self):
            return type("R", (), {"status": 200, "read": lambda s: b"ok"})()

        def close(self):
            pass

    monkeypatch.setattr(H.http.client, "HTTPSConnection", Connection)
    t = H.KeepAliveTransport()
    assert [t("https://h/v1/x?y=1", b"", {}, 5) for _ in range(4)] == [(200, b"ok")] * 4
    assert made == ["h", "h"]


def test_a_failed_job_resumes_from_its_journal(spark, tmp_path):
    d = spark.createDataFrame([("r", i, f"Topic {i}") for i in range(24)], "run_id string, topic_id bigint, topic string")
    counter = tmp_path / "calls.txt"
    counter.write_text("")
    kw = {"partitions": 2, "yield_rows": 3, "pool": 1, "journal": str(tmp_path / "journal")}
    with pytest.raises(Exception):  # noqa: B017 - the worker dies
        I.run_stage(d, S.RESEARCH, H.HttpCompleter("http://x", transport=Sent(str(counter), limit=13), **kw)).collect()
    res = I.run_stage(d, S.RESEARCH, H.HttpCompleter("http://x", transport=Sent(str(counter)), **kw)).collect()
    assert len(res) == 24 and all(r.status == "success" for r in res)
    # a hand-over of each of the two tasks may have been on its way
    assert 24 <= len(counter.read_text().split()) <= 24 + 2 * 3


def test_provider_reaches_request_and_endpoint(spark, monkeypatch):
    monkeypatch.delenv("GROQ_BASE_URL", raising=False)
    urls = []
    settings = Q.LLMSettings(provider="groq")
    c = H.HttpCompleter.from_settings(settings, transport=lambda url, data, headers, timeout: (urls.append((url, sorted(headers))), (200, body()))[1])
    assert (c.base_url, c.auth_style, c.api_key_env) == ("https://api.groq.com/openai/v1", "bearer", "GROQ_API_KEY")
    c.call_one("{}")
    assert urls == [("https://api.groq.com/openai/v1/chat/completions", ["Authorization", "Content-Type"])]
    d = spark.createDataFrame([("r", 1, "Topic")], "run_id string, topic_id bigint, topic string")
    assert json.loads(Q.build_requests(d, S.RESEARCH, settings).first().payload)["model"] == "llama-3.3-70b-versatile"
    mine = [("own", "http://own/v1", "api-key", "own-model", "OWN_KEY", "OWN_URL")]
    r = Q.resolved_settings(Q.LLMSettings(provider="own"), mine, env={"OWN_URL": "http://elsewhere"})
    assert (r.base_url, r.model, r.auth_style, r.api_key_env) == ("http://elsewhere", "own-model", "api-key", "OWN_KEY")
    assert Q.resolved_settings(Q.LLMSettings(provider="nobody"), env={}).model == Q.resolved_settings(Q.LLMSettings(), env={}).model
    assert Q.resolved_settings(Q.LLMSettings(provider="openai", model="m", base_url="http://b"), env={"OPENAI_BASE_URL": "http://e"}).base_url == "http://b"


# ------------------------------------------------------------------- ledger


def test_shared_replies_and_repeated_writes_count_once(spark, tmp_path):
    d = spark.createDataFrame([("r", i, "Same topic" if i < 4 else "Other") for i in range(6)], "run_id string, topic_id bigint, topic string")
    c = H.HttpCompleter("http://x", transport=lambda *a: (200, body()))
    calls = L.ledger_rows(I.run_stage(d, S.RESEARCH, c, Q.LLMSettings(model="m"), dedupe_payloads=True))
    path = str(tmp_path / "ledger")
    L.append(calls, path)
    L.append(calls, path)
    rows = L.read(spark, path).collect()
    assert len(rows) == 2 and {r.model for r in rows} == {"m"} and all(r.prompt_tokens == 5 and r.errors == 0 for r in rows)
    # a second attempt of the same request was billed as well
    L.append(L.read(spark, path).where("topic_id = 0 OR topic_id < 4").withColumn("attempt_id", H.F.lit("again")), path)
    assert L.read(spark, path).count() == 3


def test_usage_of_unusable_replies_is_kept(spark):
    from quillframe.plans.simulated import ExpressionCompleter

    t = spark.createDataFrame([(1, "Alpha"), (2, "Beta"), (3, "Gamma")], "topic_id bigint, topic string")
    c = ExpressionCompleter(
        replies={"quality": lambda col: H.F.when(col("topic_id") == 1, H.F.lit('{"overall_score": "no number"}')).otherwise(H.F.lit('{"overall_score": 95}'))},
        errors={"research": lambda col: H.F.when(col("topic_id") == 3, H.F.lit("refused"))},
    )
    t = t.withColumn("max_iterations", H.F.lit(1))
    run = W.run_pipeline(t, c, Q.LLMSettings(model="m"), run_id="r")
    calls = {(x.topic_id, x.stage): x for x in run.calls.collect()}
    bad = calls[1, "quality"]
    assert bad.prompt_tokens > 0 and bad.completion_tokens > 0 and bad.errors == 0
    assert (calls[3, "research"].errors, calls[3, "research"].prompt_tokens) == (1, 0)
    arts = {a.topic_id: a for a in run.articles.collect()}
    assert arts[1].agent_results["quality"].status == "failed" and arts[1].agent_results["quality"].tokens_used == 0
    assert arts[1].total_tokens == sum(x.prompt_tokens + x.completion_tokens for (i, _), x in calls.items() if i == 1)
    assert arts[3].status == "failed" and arts[3].total_calls == 1
    report = M.consumption_report(run.calls).where("is_total").first()
    assert report.calls == len(calls) and report.errors == 1
    assert M.run_duration(run.calls).first().duration_us > 0
    prices = spark.createDataFrame([("m", 1, 1, 1), ("m", 2, 2, 2)], "model string, input_per_m int, output_per_m int, cached_per_m int")
    cost = M.cost_by_stage(run.calls, prices).collect()
    assert sum(r.calls for r in cost) == len(calls) and all(r.unpriced_calls == 0 for r in cost)


def test_lost_topics_and_full_results(spark, tmp_path):
    from quillframe.plans.simulated import ExpressionCompleter

    t = spark.createDataFrame([(1, "Alpha", True, ["zh", "ms"]), (2, "Beta", False, None)], "topic_id bigint, topic string, enable_translation boolean, target_languages array<string>")
    c = ExpressionCompleter(replies={"quality": lambda col: H.F.lit('{"overall_score": 95}'), "writer": lambda col: H.F.lit("body"), "editor": lambda col: H.F.concat(col("draft"), H.F.lit("+"))})
    path = str(tmp_path / "metrics")
    run = W.run_pipeline(t, c, run_id="r", metrics_path=path)
    a = {x.topic_id: x for x in run.articles.collect()}[1]
    assert a.agent_results["writer"].content == "body" and a.agent_results["editor"].content == "body+" == a.article
    assert a.agent_results["writer"].metadata.word_count == 1 and a.agent_results["translator_ms"].metadata.target_language == "ms"
    assert [k for k in a.agents_run if k.startswith("translator")] == ["translator_zh", "translator_ms"]  # order of the calls
    assert a.metrics_path == path and L.read(spark, path).count() == run.calls.count()
    # rows that got lost: the topic is there, and failed
    kept = run.results.where("topic_id = 1 AND stage <> 'outline'")
    final = spark.createDataFrame([("r", 1, "text")], "run_id string, topic_id bigint, article string")
    lost = {x.topic_id: x for x in W.assemble(kept, final, W.normalize_topics(t, "r")).collect()}
    assert lost[1].status == "failed" and (lost[2].status, lost[2].agents_run, lost[2].total_calls) == ("failed", [], 0)


def test_registered_stages_run_in_the_chain(spark):
    from quillframe.plans.simulated import ExpressionCompleter

    shout = S.register(S.Stage("shout", "Capitals", "Shout.", S.Template(("Rewrite: ", S.Slot("content")))))
    check = S.register(S.Stage("fact_check", "Checks facts", "Check.", S.Template(("Check ", S.Slot("title"), ": ", S.Slot("content")))))
    try:
        t = spark.createDataFrame([(1, "Alpha", None), (2, "Beta", ["shout"])], "topic_id bigint, topic string, disabled_stages array<string>")
        c = ExpressionCompleter(replies={
            "quality": lambda col: H.F.lit('{"overall_score": 95}'), "editor": lambda col: H.F.lit("edited"),
            "shout": lambda col: H.F.upper(col("article")), "publisher": lambda col: H.F.concat(H.F.lit("published "), col("article")),
        })
        run = W.run_pipeline(t, c, run_id="r", extra_stages=[W.ExtraStage(check), W.ExtraStage(shout, rewrites=True)])
        a = {x.topic_id: x for x in run.articles.collect()}
        assert a[1].article == "EDITED" and a[1].agent_results["editor"].content == "edited" and a[1].publisher_output == "published EDITED"
        assert a[2].article == "edited" and "shout" not in a[2].agents_run and {"shout", "fact_check"} <= set(a[1].agents_run)
        assert a[1].agent_results["fact_check"].content.endswith("Check Alpha: edited") and a[1].total_calls == a[2].total_calls + 1
    finally:
        for name in ("shout", "fact_check"):
            S._REGISTRY.pop(name)
