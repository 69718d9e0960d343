"""Continuous intake (S1), override order (S3), round report (W4), parity of two tables."""

import os

from pyspark.sql import functions as F

from quillframe.operators import analytics as A
from quillframe.operators import inference as I
from quillframe.operators import stages as S
from quillframe.plans import workflow as W
from quillframe.plans.simulated import ExpressionCompleter
from quillframe.session import scratch_path, scratch_root
from quillframe.sources.tables import read_overrides, read_topics
from quillframe.streaming import intake


def test_intake_takes_each_topic_once(spark):
    src, out = scratch_path(spark, "test-intake-in"), scratch_path(spark, "test-intake")
    c = ExpressionCompleter(replies={"quality": lambda col: F.lit('{"overall_score": 95}')})
    asked = []

    def model(batch_id):
        asked.append(batch_id)
        return c

    def come(*topics):
        spark.createDataFrame([(t,) for t in topics], "value string").coalesce(1).write.mode("append").text(src)

    def run():
        rows = intake.run_intake(read_topics(spark, src, stream=True, files_per_batch=1), out, model).collect()
        return sorted((r.run_id, r.agent_results["research"].metadata.topic, r.status) for r in rows)

    come("Alpha", " Beta ", "", "Alpha")
    first = [("intake-0", "Alpha", "success"), ("intake-0", "Beta", "success")]
    assert run() == first
    come("Alpha", "Beta")  # the file comes again
    assert run() == first and asked == [0]
    come("Beta", "Gamma")
    assert run() == [*first, ("intake-2", "Gamma", "success")] and asked == [0, 2]


def test_intake_leaves_no_tables_of_its_runs(spark):
    """Once a batch's articles are written, the tables of its chain are gone; its results and those of others stay."""
    src, out = scratch_path(spark, "test-intake-in"), scratch_path(spark, "test-intake")
    other = W.cut(spark.range(3), "not-of-the-intake")
    spark.createDataFrame([("Alpha",), ("Beta",)], "value string").coalesce(1).write.mode("append").text(src)
    before = set(os.listdir(scratch_root(spark).removeprefix("file:")))
    done = intake.run_intake(read_topics(spark, src, stream=True, files_per_batch=1), out, ExpressionCompleter())
    left = set(os.listdir(scratch_root(spark).removeprefix("file:"))) - before
    assert left == {os.path.basename(out)}
    assert done.count() == 2 and other.count() == 3


def test_override_position_is_the_place_in_the_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "writer", "model_override": "first"}\n{"name": "seo"}\n{"name": "writer", "model_override": "second"}\n')
    (tmp_path / "b.json").write_text('{"name": "writer", "model_override": "third"}\n{"name": "seo", "position": 0, "model_override": "zero"}\n')
    rows = read_overrides(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.position, r.model_override) for r in rows if r.name == "writer") == [("writer", 1, "first"), ("writer", 2, "second"), ("writer", 3, "third")]
    assert min((r.position, r.model_override) for r in rows if r.name == "seo") == (0, "zero")


def test_round_report(spark):
    scores = {1: ["70", "85"], 2: ["60", "50", "55"], 3: ['"x"', "40"]}
    rows = [("r", t, S.QUALITY.name, i, "", s) for t, v in scores.items() for i, s in enumerate(v, 1)]
    df = spark.createDataFrame(rows, "run_id string, topic_id bigint, stage string, iteration int, variant string, s string")
    d = df.select("run_id", "topic_id", F.lit("t").alias("topic"), F.col("iteration"), "s", F.lit("x").alias("draft"), F.lit(0.8).alias("quality_threshold"))
    c = ExpressionCompleter(replies={"quality": lambda col: F.concat(F.lit('{"overall_score": '), col("s"), F.lit("}"))})
    q = I.run_stage(d, S.QUALITY, c, slot_cols={"content": F.col("draft"), "title": F.col("topic"), "threshold": F.col("quality_threshold"), "threshold_pct": F.lit("80")},
                    iteration=F.col("iteration"), keep=["s", "quality_threshold"])
    got = {(r.topic_id, r.round): (r.score, r.gain, r.best_round, r.best_score, r.last_is_best) for r in W.round_report(q).collect()}
    assert got[1, 2] == (85.0, 15.0, 2, 85.0, True) and got[1, 1] == (70.0, None, 1, 70.0, True)
    assert got[2, 2] == (50.0, -10.0, 1, 60.0, False) and got[2, 3] == (55.0, 5.0, 1, 60.0, False)
    assert got[3, 1] == (None, None, None, None, True) and got[3, 2] == (40.0, None, 2, 40.0, True)


def test_parity_of_two_tables(spark):
    s = spark.createDataFrame(
        [(1, "# A\n## B\n### C", ["zh", "ms", "zh"], ["B", "Q"]), (2, "no heading", None, None), (3, "# only", ["zh"], [])],
        "topic_id bigint, body string, target_languages array<string>, keywords array<string>",
    )
    t = spark.createDataFrame(
        [(1, "zh", "# A\n### B\n### C"), (1, "ms", "# A\n## B\n### C\n## D"), (2, "zh", "# new"), (9, "zh", "# of nobody"), (1, "fr", "# A")],
        "topic_id bigint, language string, body string",
    )
    got = {(r.topic_id, r.language): tuple(r)[2:9] for r in A.parity_of_tables(s, t).collect()}
    assert got[1, "zh"] == ("ok", False, "level", 2, 2, 3, 1)
    assert got[1, "ms"] == ("ok", False, "extra", 4, None, 2, 1)
    assert got[1, "fr"] == ("unasked", False, "missing", 2, 2, None, 2)
    assert got[2, "zh"] == ("unasked", False, "extra", 1, None, 1, 0)
    assert got[3, "zh"] == ("missing", None, None, None, None, None, None)
    assert got[9, "zh"] == ("unasked", None, None, None, None, None, None) and len(got) == 6
