"""Completers (I1-I6), score parsing (J4) and the workflow."""

import json
import re

import pytest
from pyspark.sql import functions as F

from quillframe.operators import inference as I
from quillframe.operators.http_completion import HttpCompleter
from quillframe.operators import requests as Q
from quillframe.operators import stages as S
from quillframe.plans import workflow as W
from quillframe.plans.simulated import ExpressionCompleter


def test_quality_score_cases(spark):
    cases = {
        '{"overall_score": 90}': (90.0, False), '{"overall_score": "90"}': (0.0, True), '{"overall_score": null}': (0.0, True),
        '{"x": 1}': (0.0, False), "[1]": (0.0, False), "```json\n{\"overall_score\": 90}\n```": (0.0, False),
        '{"overall_score": true}': (1.0, False), '{"overall_score": NaN}': (0.0, False),
        '{"overall_score": 1, "overall_score": 95}': (95.0, False), None: (0.0, True),
    }
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", I.quality_score(F.col("c")).alias("q"))
    for r in df.collect():
        assert (r.q.score, r.q.failed) == cases[r.c], r.c


def _drafts(spark, rows, max_iterations=3):
    return spark.createDataFrame(
        [("run", i, f"topic {i}", "draft", None, 0.8, max_iterations, s) for i, s in rows],
        "run_id string, topic_id bigint, topic string, draft string, seo string, quality_threshold double, max_iterations int, base int",
    )


def _scored():
    # score at round i = base + 10 * i
    return ExpressionCompleter(replies={
        "editor": lambda col: F.concat(col("draft"), F.lit("+")),
        "quality": lambda col: F.to_json(F.struct((col("base") + 10 * col("iteration")).alias("overall_score"))),
    })


def test_refine_loop_rounds(spark):
    d = _drafts(spark, [(1, 75), (2, 55), (3, 10)])
    rounds, final = W.refine_loop(d, _scored(), keep=["base"])
    got = {r.topic_id: (r.rounds, r.passed, r.final_score, r.article) for r in final.collect()}
    assert got[1] == (1, True, 85.0, "draft+")  # passes at round 1
    assert got[2] == (3, True, 85.0, "draft+++")  # passes at round 3
    assert got[3] == (3, False, 40.0, "draft+++")  # never: the last text is kept
    calls = W._union(rounds).groupBy("stage").count().collect()
    assert {r.stage: r["count"] for r in calls} == {"editor": 7, "quality": 7}  # 1 + 3 + 3 rounds


def test_refine_loop_zero_iterations(spark):
    rounds, final = W.refine_loop(_drafts(spark, [(1, 75)], max_iterations=0), _scored(), keep=["base"])
    r = final.first()
    assert rounds == [] and r.rounds == 0 and r.article == "draft"


def test_threshold_zero_passes_everything(spark):
    d = _drafts(spark, [(1, -10)]).withColumn("quality_threshold", F.lit(0.0))  # score 0 >= 0
    _, final = W.refine_loop(d, _scored(), keep=["base"])
    assert final.first().rounds == 1


def _topics(spark):
    return spark.createDataFrame(
        [(1, "Alpha", True, ["zh", "ms", "zh"]), (2, "Beta", False, None)],
        "topic_id bigint, topic string, enable_translation boolean, target_languages array<string>",
    )


def test_pipeline_end_to_end(spark):
    c = ExpressionCompleter(replies={"quality": lambda col: F.lit('{"overall_score": 95}')})
    run = W.run_pipeline(_topics(spark), c, run_id="r1")
    arts = {r.topic_id: r for r in run.articles.collect()}
    a = arts[1]
    assert a.status == "success"
    assert a.agents_run == ["research", "outline", "writer", "seo", "editor", "quality", "translator_zh", "translator_ms", "publisher"]
    assert sorted(a.translations) == ["ms", "zh"] and a.total_calls == 9
    assert arts[2].agents_run == ["research", "outline", "writer", "seo", "editor", "quality", "publisher"]
    s = {r.topic_id: r for r in run.summary().collect()}
    assert s[1].total_tokens > 0 and s[1].word_count > 0
    per_stage = {r.stage: r["count"] for r in run.calls.groupBy("stage").count().collect()}
    assert per_stage["translator"] == 2 and per_stage["research"] == 2


def test_pipeline_fail_fast_and_soft_failure(spark):
    c = ExpressionCompleter(
        replies={"quality": lambda col: F.lit('{"overall_score": 95}')},
        errors={
            "research": lambda col: F.when(col("topic_id") == 1, F.lit("boom")),
            "seo": lambda col: F.lit("seo down"),
        },
    )
    run = W.run_pipeline(_topics(spark), c, run_id="r1")
    arts = {r.topic_id: r for r in run.articles.collect()}
    assert arts[1].status == "failed" and arts[1].agents_run == ["research"] and arts[1].article == ""
    assert arts[1].agent_results["research"].error == "boom"
    # seo failed softly: the run still succeeds, the review is empty
    assert arts[2].status == "success" and arts[2].seo_analysis == "" and arts[2].agent_results["seo"].status == "failed"
    strict = W.run_pipeline(_topics(spark), c, run_id="r1", strict=True).articles.where("topic_id = 2").first()
    assert strict.status == "failed"
    failed_calls = run.calls.where("errors = 1").groupBy("stage").count().collect()
    assert {r.stage: r["count"] for r in failed_calls} == {"research": 1, "seo": 1}


@pytest.mark.parametrize("off, article", [(("research", "seo", "editor"), "body"), (("outline", "writer", "quality"), "+")])
def test_disabled_stages_pass_rows_through(spark, off, article):
    c = ExpressionCompleter(replies={"writer": lambda col: F.lit("body"), "editor": lambda col: F.concat(col("draft"), F.lit("+")),
                                       "quality": lambda col: F.lit('{"overall_score": 95}')})
    ov = spark.createDataFrame([(i, stage, False, None, None, None, None) for i, stage in enumerate(off)], Q.OVERRIDE_SCHEMA)
    run = W.run_pipeline(_topics(spark), c, overrides=ov, run_id="r1")
    arts = {r.topic_id: r for r in run.articles.collect()}
    assert {i: (a.status, a.article) for i, a in arts.items()} == {1: ("success", article), 2: ("success", article)}
    assert arts[2].agents_run == [s for s in ("research", "outline", "writer", "seo", "editor", "quality", "publisher") if s not in off]


def test_topic_switches_and_null_lists(spark):
    c = ExpressionCompleter(replies={"quality": lambda col: F.lit('{"overall_score": 95}')})
    t = spark.createDataFrame(
        [(1, "Alpha", True, None, False, None), (2, "Beta", True, None, None, ["translator", "publisher"])],
        "topic_id bigint, topic string, enable_translation boolean, target_languages array<string>, seo_enabled boolean, disabled_stages array<string>",
    )
    arts = {r.topic_id: r for r in W.run_pipeline(t, c).articles.collect()}
    assert arts[1].agents_run == ["research", "outline", "writer", "editor", "quality", "translator_zh", "translator_ms", "publisher"]
    assert arts[2].agents_run == ["research", "outline", "writer", "seo", "editor", "quality"]
    assert arts[1].run_id == arts[2].run_id != W.normalize_topics(t).first().run_id


# --------------------------------------------------------------- HTTP path


def _ok_body(content="hi"):
    return json.dumps({
        "model": "m", "choices": [{"message": {"content": content}, "finish_reason": "stop"}],
        "usage": {"prompt_tokens": 5, "completion_tokens": 2, "total_tokens": 7, "prompt_tokens_details": {"cached_tokens": 1}},
    }).encode()


class Script:
    def __init__(self, outcomes):
        self.outcomes = list(outcomes)
        self.calls = 0

    def __call__(self, url, body, headers, timeout):
        self.calls += 1
        o = self.outcomes.pop(0)
        if isinstance(o, Exception):
            raise o
        return o


def test_http_retries_then_success():
    t = Script([(503, b"busy"), TimeoutError("slow"), (200, _ok_body())])
    c = HttpCompleter(base_url="http://x/v1", transport=t, sleep=lambda s: None)
    raw, _, err, retries = c.call_one('{"model":"m"}')
    assert err is None and retries == 2 and json.loads(raw)["usage"]["total_tokens"] == 7 and t.calls == 3


def test_http_no_retry_on_client_error_and_bad_json():
    t = Script([(400, b"bad request")])
    c = HttpCompleter(base_url="http://x/v1", transport=t, sleep=lambda s: None)
    raw, _, err, retries = c.call_one("{}")
    assert raw is None and err.startswith("HTTP 400") and retries == 0 and t.calls == 1
    t2 = Script([(200, b"not json")])
    raw, _, err, _ = HttpCompleter(base_url="http://x", transport=t2, sleep=lambda s: None).call_one("{}")
    assert raw is None and err == "invalid JSON response"


def test_http_gives_up_after_max_retries():
    t = Script([(500, b"x")] * 3)
    raw, _, err, retries = HttpCompleter(base_url="http://x", transport=t, sleep=lambda s: None, max_retries=3).call_one("{}")
    assert raw is None and retries == 2 and t.calls == 3


def fake_transport(url, body, headers, timeout):
    payload = json.loads(body)
    if "fail" in payload["messages"][-1]["content"]:
        return 500, b"down"
    return 200, _ok_body("echo " + payload["messages"][-1]["content"][-5:])


def test_http_completer_in_stage(spark):
    d = spark.createDataFrame([("r", 1, "Topic ok"), ("r", 2, "fail this")], "run_id string, topic_id bigint, topic string")
    c = HttpCompleter(base_url="http://x/v1", transport=fake_transport, sleep=lambda s: None, partitions=2)
    res = {r.topic_id: r for r in I.run_stage(d, S.RESEARCH, c).collect()}
    assert res[1].status == "success" and res[1].tokens_used == 7 and res[1].cached_tokens == 1
    assert res[2].status == "failed" and res[2].content == "" and res[2].retries == 2 and res[2].tokens_used == 0


class CountingTransport:
    """Counts calls in a file so executor-side calls are visible to the test."""

    def __init__(self, path):
        self.path = path

    def __call__(self, url, body, headers, timeout):
        with open(self.path, "a") as f:
            f.write("x")
        return 200, _ok_body("same")


def test_dedupe_payloads_bills_each_prompt_once(spark, tmp_path):
    d = spark.createDataFrame(
        [("r", i, "Same topic" if i < 4 else "Other") for i in range(6)], "run_id string, topic_id bigint, topic string"
    )
    counter = tmp_path / "calls.txt"
    c = HttpCompleter(base_url="http://x/v1", transport=CountingTransport(str(counter)), sleep=lambda s: None)
    res = I.run_stage(d, S.RESEARCH, c, dedupe_payloads=True).collect()
    assert len(res) == 6 and all(r.status == "success" and r.tokens_used == 7 for r in res)
    assert len(counter.read_text()) == 2  # two distinct prompts


def test_partial_pipeline_research_writer_quality(spark):
    """A user-chosen chain of stages composed with run_stage."""
    t = spark.createDataFrame([("r", 1, "Topic")], "run_id string, topic_id bigint, topic string")
    c = ExpressionCompleter(replies={"quality": lambda col: F.lit('{"overall_score": 75}')})
    research = I.run_stage(t, S.RESEARCH, c, keep=["topic"])
    writer = I.run_stage(research.withColumn("research_data", F.col("content")), S.WRITER, c,
                         slot_cols={"outline": F.lit("")}, keep=["topic"])
    quality = I.run_stage(writer.withColumn("draft", F.col("content")), S.QUALITY, c,
                          slot_cols={"content": F.col("draft"), "title": F.col("topic"), "threshold": F.lit(0.7),
                                     "threshold_pct": F.lit(70.0)})
    q = quality.first()
    assert q.status == "success" and q.metadata.overall_score == 75.0 and q.metadata.passes_threshold


def test_summary_shuffles_no_texts(spark):
    c = ExpressionCompleter(replies={"quality": lambda col: F.lit('{"overall_score": 95}')})
    run = W.run_pipeline(_topics(spark), c, run_id="r1")
    plan = run.summary()._jdf.queryExecution().optimizedPlan().toString()
    assert "iteration, " in plan and not re.search(r"\b(content|reasoning|metadata), ", plan)  # structs of names and states only
    got = {r.topic_id: r for r in run.summary().collect()}
    assert got[1].translations == ["ms", "zh"] and got[2].translations == []
    assert got[1].agents_run == [r.agents_run for r in run.articles.where("topic_id = 1").collect()][0]


def test_stage_rows_are_written_once(spark, monkeypatch):
    """No second copy of rows that a cut has written already; the editor's rows come out of the review's."""
    cuts = {}
    original = W.cut
    monkeypatch.setattr(W, "cut", lambda df, name="round": cuts.setdefault(name, original(df, name)))
    c = ExpressionCompleter(replies={"writer": lambda col: F.lit("body"), "editor": lambda col: F.concat(col("draft"), F.lit("+")),
                                       "quality": lambda col: F.lit('{"overall_score": 95}')})
    run = W.run_pipeline(_topics(spark), c, run_id="r1")
    assert {r.stage for r in cuts["results"].collect()} == {"translator", "publisher"}
    assert "draft" not in cuts["quality-1"].columns
    editor = run.results.where("stage = 'editor'").collect()
    assert [(r.content, r.status, r.iteration) for r in editor] == [("body+", "success", 1)] * 2
    assert run.results.groupBy("stage").count().collect() and run.results.count() == 6 * 2 + 2 + 2  # six stages, publisher, two translations
