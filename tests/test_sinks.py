"""Sinks (K1-K7) and the metrics reader."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillframe.operators import metrics as M
from quillframe.plans import workflow as W
from quillframe.plans.simulated import ExpressionCompleter
from quillframe.session import scratch_path
from quillframe.sinks import documents as D
from quillframe.sinks import writers as K
from tests.test_metrics import calls


def _articles(spark):
    return spark.createDataFrame(
        [("r1", 1, "Alpha", "# Hello" + chr(10) + "body"), ("r1", 2, "Beta", "plain")],
        "run_id string, topic_id bigint, topic string, article string",
    )


def _read(spark, path):
    return {(r.run_id, r.topic_id, r.name): r.body for r in D.read_documents(spark, path).collect()}


def test_article_and_markdown_and_html_sinks(spark):
    a = _articles(spark)
    base = scratch_path(spark, "test-sinks")
    K.write_articles(a, f"{base}/articles", run_date=F.lit(dt.date(2024, 1, 2)))
    back = spark.read.parquet(f"{base}/articles")
    assert back.count() == 2 and back.where("run_date = '2024-01-02'").count() == 2
    K.write_article_bodies(a, f"{base}/docs", name="body.txt")
    K.write_markdown(a, f"{base}/docs")
    K.write_html(a, f"{base}/docs", date=F.lit("2024-01-02"))
    got = _read(spark, f"{base}/docs")
    assert len(got) == 6 and got["r1", "1", "body.txt"] == "# Hello\nbody"
    assert got["r1", "1", "article.md"] == "---\ntitle: Alpha\n---\n# Hello\nbody"
    assert "<title>Alpha</title>" in got["r1", "1", "article.html"] and "<h1>Hello</h1>" in got["r1", "1", "article.html"]


def test_documents_of_any_name_and_text_read_back(spark):
    rows = [("run/1", "a b%+ü'~", "x.md", "ä\r\n\n"), ("run/1", "a b", "x.md", ""), (None, "0", "x.md", None), ("r", "n" * 300, "x.md", "long name"), ("r", "1", "..", "dots")]
    df = spark.createDataFrame(rows, "run_id string, topic_id string, name string, body string").repartition(3)
    path = scratch_path(spark, "test-documents")
    D.write_documents(df, path, F.col("body"), F.col("name"))
    assert _read(spark, path) == {r[:3]: r[3] or "" for r in rows}
    # written again: the newer one counts
    D.write_documents(df.where("name = '..'"), path, F.lit("newer"), F.col("name"))
    assert _read(spark, path)["r", "1", ".."] == "newer" and D.read_manifest(spark, path).count() == 5


def test_a_failed_job_leaves_no_document(spark, tmp_path):
    path = str(tmp_path / "docs")
    ok = spark.createDataFrame([("r", "1", "kept")], "run_id string, topic_id string, body string")
    D.write_documents(ok, path, F.col("body"), "a.md")
    bad = spark.range(0, 40, 1, 4).select(F.lit("r").alias("run_id"), F.col("id").cast("string").alias("topic_id"), F.when(F.col("id") < 35, F.lit("x")).otherwise(F.raise_error(F.lit("lost"))).alias("body"))
    with pytest.raises(Exception):  # noqa: B017
        D.write_documents(bad, path, F.col("body"), "a.md")
    assert _read(spark, path) == {("r", "1", "a.md"): "kept"}
    assert len([f for f in (tmp_path / "docs" / "files").rglob("*") if f.is_file()]) == 1


def test_an_attempt_that_does_not_count_is_removed(tmp_path):
    w = D.DocumentWriter(str(tmp_path))
    row = {"run_id": "r", "topic_id": "1", "name": "a", "body": "x"}
    first, second = w.write(iter([row])), w.write(iter([row]))  # a task that ran twice
    w.commit([second])
    assert [p.name for p in (tmp_path / "files" / w.job).iterdir()] == [second.folder] != [first.folder]
    v = D.DocumentWriter(str(tmp_path))
    v.write(iter([row]))
    v.abort([None])
    assert not (tmp_path / "files" / v.job).exists()


def test_published_files_are_named_in_the_results(spark):
    t = spark.createDataFrame([(1, "Alpha"), (2, "Beta")], "topic_id bigint, topic string")
    c = ExpressionCompleter(
        replies={"quality": lambda col: F.lit('{"overall_score": 95}'), "editor": lambda col: F.concat(col("topic"), F.lit(" text")), "publisher": lambda col: F.lit('{"formats": {}}')},
        errors={"publisher": lambda col: F.when(col("topic_id") == 2, F.lit("down"))},
    )
    path = scratch_path(spark, "test-published")
    run = W.run_pipeline(t, c, run_id="r", output_path=path)
    arts = {r.topic_id: r for r in run.articles.collect()}
    files = arts[1].agent_results["publisher"].metadata.output_files
    assert [f.rsplit("~", 1)[1] for f in files] == ["'article.md", "'publisher_output.json"]
    assert arts[2].agent_results["publisher"].metadata is None
    assert _read(spark, path) == {("r", "1", "article.md"): "Alpha text", ("r", "1", "publisher_output.json"): '{"formats": {}}'}


def test_json_report_keeps_non_ascii(spark):
    df = spark.createDataFrame([("r1", "é", 3)], "run_id string, note string, n int")
    doc = json.loads(K.json_report(df).first().value)
    assert doc == {"run_id": "r1", "note": "é", "n": 3}


def test_metrics_roundtrip_and_multi_run_report(spark):
    c = calls(spark, [("r1", "a", 10, 5, 0, 1.0, 0, 0), ("r1", "b", 1, 1, 0, 1.0, 0, 0), ("r2", "a", 3, 3, 0, 1.0, 1, 0)])
    base = scratch_path(spark, "test-metrics")
    K.write_metrics(c, f"{base}/calls")
    assert spark.read.parquet(f"{base}/calls").count() == 3
    K.write_summary_documents(M.summary_document(c), f"{base}/docs")
    rows = K.read_metrics(spark, f"{base}/docs")
    rep = {r.run_id: r for r in K.multi_run_report(rows).collect()}
    assert rep["r1"].agents == 2 and rep["r1"].total_tokens == 17 and rep["r2"].calls == 1


def test_metrics_reader_defaults(spark):
    base = scratch_path(spark, "test-metrics-defaults")
    spark.createDataFrame([('{"run_id": "x", "agents": {"a": {"calls": 2}}}',)], "value string").write.text(base)
    r = K.read_metrics(spark, base).first()
    assert (r.calls, r.total_tokens, r.cache_hit_rate, r.pipeline_duration_s) == (2, 0, "0%", 0.0)


def test_benchmark_results_sink(spark):
    runs = spark.createDataFrame([("a", True, 100, 1.0)], "run_id string, ok boolean, total_tokens bigint, duration_s double")
    base = scratch_path(spark, "test-bench")
    K.write_benchmark_results(runs, M.benchmark_summary(runs), base)
    assert spark.read.json(f"{base}/aggregate").first().runs == 1
    assert spark.read.json(f"{base}/runs").count() == 1


def test_read_topics_and_overrides(spark):
    from quillframe.sources.tables import read_overrides, read_topics

    base = scratch_path(spark, "test-intake")
    spark.createDataFrame([("Spark at scale",), ("",), ("  Second topic ",)], "value string").coalesce(1).write.text(f"{base}/topics")
    t = read_topics(spark, f"{base}/topics").collect()
    assert sorted(r.topic for r in t) == ["Second topic", "Spark at scale"] and all(r.topic_id is not None for r in t)
    spark.createDataFrame(
        [('{"name": "writer", "temperature_override": 0.9}',), ('{"name": "writer", "temperature_override": 0.1}',)], "value string"
    ).coalesce(1).write.text(f"{base}/ovr")
    from quillframe.operators.requests import effective_overrides

    eff = effective_overrides(read_overrides(spark, f"{base}/ovr")).collect()
    assert len(eff) == 1 and eff[0].temperature_override == 0.9


def test_register_renderer(spark):
    from quillframe.functions import render as R

    R.register_renderer("shout", lambda body, title, meta: F.upper(body))
    df = spark.createDataFrame([("shout", "hi"), ("html", "# T"), ("nope", "x")], "t string, b string")
    got = [r[0] for r in df.select(R.render_target(F.col("t"), F.col("b"), F.lit("T"))).collect()]
    assert got == ["HI", "<h1>T</h1>", None] and "shout" in R.renderer_names()


def test_documents_are_read_by_the_manifest(spark, tmp_path, monkeypatch):
    """No folder of files is listed; small batches, empty, lost and oddly named documents come back in place."""
    monkeypatch.setattr(D, "READ_BATCH", 40)
    rows = [("r", str(i), f"n%20 '{i}.md", "" if i == 3 else "zé " * i * 5) for i in range(12)]
    df = spark.createDataFrame(rows, "run_id string, topic_id string, name string, body string")
    path = str(tmp_path / "docs")
    D.write_documents(df, path, F.col("body"), F.col("name"))
    read = D.read_documents(spark, path)
    assert "Scan text" not in read._jdf.queryExecution().executedPlan().toString()
    assert {(r.run_id, r.topic_id, r.name, r.body) for r in read.collect()} == set(rows)
    (lost,) = [r.path for r in D.read_manifest(spark, path).collect() if r.topic_id == "5"]
    (tmp_path / lost.removeprefix(f"{tmp_path}/")).unlink()
    assert {r.topic_id: r.body for r in D.read_documents(spark, path).collect()} == {r[1]: "" if r[1] == "5" else r[3] for r in rows}
