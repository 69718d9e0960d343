"""Request building: templates, overrides, parameter fall-through, providers, validation."""

from pyspark.sql import functions as F

from quillframe.operators import requests as Q
from quillframe.operators import stages as S


def _inputs(spark):
    return spark.createDataFrame([("run", 1, "Spark at scale", "body text")], "run_id string, topic_id bigint, topic string, content string")


def test_overrides_first_wins_and_falsy_fallthrough(spark):
    ov = spark.createDataFrame(
        [(1, "writer", True, "m1", 0.9, 100, "custom"), (2, "writer", True, "m2", 0.1, 5, "dup"), (3, "research", True, "", 0.0, 0, "")],
        Q.OVERRIDE_SCHEMA,
    )
    d = _inputs(spark).withColumn("outline", F.lit("o")).withColumn("research_data", F.lit("r"))
    w = Q.build_requests(d, S.WRITER, Q.LLMSettings(), ov).first()
    assert (w.model, w.temperature, w.max_tokens, w.system_prompt) == ("m1", 0.9, 8192, "custom")  # call max_tokens wins
    r = Q.build_requests(d, S.RESEARCH, Q.LLMSettings(), ov).first()
    assert (r.model, r.temperature, r.max_tokens, r.system_prompt) == (Q.resolved_settings(Q.LLMSettings()).model, 0.7, 4096, S.RESEARCH.system_prompt)
    assert [m.role for m in r.messages] == ["system", "user"] and "Spark at scale" in r.user_prompt
    assert '"stream":false' in r.payload and '"top_p":0.9' in r.payload


def test_optional_template_blocks(spark):
    d = _inputs(spark)
    with_seo = Q.build_requests(d, S.EDITOR, slot_cols={"seo_recommendations": F.lit("use headings")}).first().user_prompt
    without = Q.build_requests(d, S.EDITOR, slot_cols={"seo_recommendations": F.lit("")}).first().user_prompt
    assert "SEO REVIEW TO APPLY:\nuse headings" in with_seo and "SEO REVIEW" not in without
    assert "Reading level: general" in without


def test_context_message(spark):
    df = spark.createDataFrame([("", ), ("facts",)], "ctx string")
    got = df.select(Q.assemble_messages(F.lit("sys"), F.lit("u"), F.col("ctx")).alias("m")).collect()
    assert len(got[0].m) == 2 and len(got[1].m) == 3 and got[1].m[1].content == "Context:\nfacts"


def test_provider_resolution(spark):
    conn = spark.createDataFrame([("openai", "", "", ""), ("nope", "", "x", ""), ("groq", "http://h/v1", "", "")],
                                 "provider string, base_url string, model string, auth_style string")
    r = {x.provider: x for x in Q.resolve_providers(conn, Q.presets_df(spark)).collect()}
    assert r["openai"].base_url == "https://api.openai.com/v1" and r["openai"].auth_style == "bearer" and r["openai"].preset_found
    assert r["nope"].model == "x" and r["nope"].auth_style == "api-key" and not r["nope"].preset_found
    assert r["nope"].api_key_env == "MIMO_API_KEY" and r["groq"].base_url == "http://h/v1"


def test_unknown_stages(spark):
    req = spark.createDataFrame([(1, ["research", "summarize"]), (2, [])], "topic_id bigint, stages array<string>")
    rows = Q.unknown_stages(req).collect()
    assert {(r.topic_id, r.stage) for r in rows} == {(1, "summarize"), (2, None)}


def test_registry():
    import pytest

    assert S.get_stage("quality").name == "quality"
    with pytest.raises(ValueError, match="known"):
        S.get_stage("nope")


def test_conversations_beyond_the_window_are_error_rows(spark):
    t = spark.createDataFrame([(1, 0, "user", "short"), (2, 0, "user", "x" * 30), (2, 1, "assistant", "y" * 30), (3, 0, "user", None)], "conv_id bigint, turn int, role string, text string")
    fits, errors = Q.within_window(t, 40)
    assert sorted(r.conv_id for r in fits.collect()) == [1, 3]
    assert [(r.conv_id, r.chars) for r in errors.collect()] == [(2, 60)]


def test_unsupported_models(spark):
    d = spark.createDataFrame([(1, "gpt-4o-mini"), (2, "nothing"), (3, None), (4, ""), (5, "mine")], "topic_id bigint, model string")
    bad = Q.unsupported_models(d, Q.supported_models(more=["mine"])).collect()
    assert [(r.topic_id, r.error.split(";")[0]) for r in bad] == [(2, "unsupported model 'nothing'")]


def test_requests_of_all_stages_are_not_dealt_by_stage(spark):
    d = _inputs(spark).withColumn("outline", F.lit("o")).withColumn("research_data", F.lit("r"))
    ov = spark.createDataFrame([(1, "writer", True, "m1", 0.9, 100, None)], Q.OVERRIDE_SCHEMA)
    stages = [S.RESEARCH, S.WRITER, S.WRITER]
    slots = {"writer": {"language": F.lit("en")}}
    got = Q.build_all_requests(d, stages, slots, overrides=ov)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "hashpartitioning(stage" not in plan  # one task a stage, with every prompt of it
    assert [(r.stage, r.temperature) for r in got.orderBy("stage").collect()] == [("research", 0.7), ("writer", 0.9), ("writer", 0.9)]
