"""Driver queries for request building: messages and payloads from
``conversations`` (R2, R6, S5), parameter resolution over documents x stages
(R1, R3, R4, B1, F5), provider resolution (R5, B3, U3) and stage validation
(F6, B2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import requests as Q
from quillframe.operators import stages as S
from quillframe.plans.registry import query
from quillframe.plans.text_queries import SQL_TITLE, doc_title
from quillframe.sources.tables import table

SETTINGS = Q.resolved_settings(Q.LLMSettings(), env={})


def _payload_sql(messages_sql: str) -> str:
    return (
        f"CAST(to_json({{'model': '{SETTINGS.model}', 'messages': {messages_sql}, 'max_tokens': 4096, "
        "'temperature': CAST(0.7 AS DOUBLE), 'top_p': CAST(0.9 AS DOUBLE), 'stream': false}) AS VARCHAR)"
    )


@query(
    "messages",
    """SELECT conv_id, count(*) AS n_messages,
       count(*) FILTER (WHERE role = 'user') AS user_turns,
       count(*) FILTER (WHERE role = 'assistant') AS assistant_turns,
       count(*) FILTER (WHERE role = 'system') AS system_turns,
       CAST(sum(length(text)) AS BIGINT) AS content_chars,
       arg_min(role, turn) AS first_role,
       arg_max(role, turn) AS last_role
FROM conversations GROUP BY conv_id""",
)
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, the message-list profile (turn counts by role,
    characters, first and last role).

    Only declarative aggregates (count, sum, min_by, max_by): each is
    pre-aggregated per task, so a conversation holding a third of all turns
    costs one partial row per task, never one giant array.  The ordered
    message array itself is built only for the request payload.
    """
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count(F.when(F.col("role") == "user", 1)).alias("user_turns"),
        F.count(F.when(F.col("role") == "assistant", 1)).alias("assistant_turns"),
        F.count(F.when(F.col("role") == "system", 1)).alias("system_turns"),
        F.sum(F.length("text")).cast("bigint").alias("content_chars"),
        F.min_by("role", "turn").alias("first_role"),
        F.max_by("role", "turn").alias("last_role"),
    )


@query(
    "payload",
    f"""SELECT conv_id,
       {_payload_sql("list({'role': role, 'content': text} ORDER BY turn)")} AS payload
FROM conversations GROUP BY conv_id""",
)
def payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chat-completions request body per conversation."""
    m = Q.messages_from_turns(table(spark, sf_dir, "conversations"))
    return m.select(
        "conv_id",
        Q.payload_json(F.lit(SETTINGS.model), F.col("messages"), F.lit(SETTINGS.max_tokens), F.lit(SETTINGS.temperature), F.lit(SETTINGS.top_p)).alias(
            "payload"
        ),
    )


# Example stage-override list (config order = position): a duplicate writer
# entry (first wins), falsy values that fall through, a disabled stage.
OVERRIDES = [
    (1, "writer", True, "model-w", 0.9, 100, None),
    (2, "writer", True, "model-x", 0.1, 200, "ignored duplicate"),
    (3, "seo", True, "", 0.0, 0, ""),
    (4, "quality", True, None, 0.2, 2048, "Score strictly and reply with JSON."),
    (5, "research", True, "model-r", None, 1000, None),
    (6, "publisher", False, None, None, None, None),
]


def overrides_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OVERRIDES, Q.OVERRIDE_SCHEMA)


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


_OVR_SQL = ", ".join("(" + ", ".join(_sql_lit(x) for x in r) + ")" for r in OVERRIDES)


def _stage_slots_spark() -> dict[str, dict]:
    text = F.col("text")
    title = doc_title(text)
    return {
        "research": {"topic": title},
        "outline": {"target_words": F.lit(None).cast("int"), "research_data": text},
        "writer": {"language": F.col("lang"), "outline": title, "research_data": text},
        "seo": {"keywords": T.join_or_default(F.lit(None).cast("array<string>"), "auto-detect"), "content": text},
        "editor": {"seo_recommendations": F.when(F.col("doc_id") % 2 == 0, F.col("source")), "content": text},
        "quality": {"title": title, "threshold": F.lit(0.8), "threshold_pct": T.threshold_percent(F.lit(0.8)), "content": text},
        "translator": {
            "source_language": F.col("lang"),
            "target_language": F.lit(None).cast("string"),
            "keywords_note": F.when(F.col("doc_id") % 3 == 0, title),
            "content": text,
        },
        "publisher": {"targets_text": T.join_or_default(F.lit(None).cast("array<string>"), "markdown"), "title": title, "content": text},
    }


def _stage_slots_sql() -> dict[str, dict]:
    return {
        "research": {"topic": SQL_TITLE},
        "outline": {"target_words": "2000", "research_data": "text"},
        "writer": {"language": "lang", "outline": SQL_TITLE, "research_data": "text"},
        "seo": {"keywords": "'auto-detect'", "content": "text"},
        "editor": {"target_reading_level": "'general'", "seo_recommendations": "CASE WHEN doc_id % 2 = 0 THEN source END", "content": "text"},
        "quality": {"title": SQL_TITLE, "threshold_pct": "CAST(CAST(0.8 AS DOUBLE) * 100.0 AS VARCHAR)", "content": "text"},
        "translator": {"source_language": "lang", "target_language": "'zh'", "keywords_note": f"CASE WHEN doc_id % 3 = 0 THEN {SQL_TITLE} END", "content": "text"},
        "publisher": {"targets_text": "'markdown'", "title": SQL_TITLE, "content": "text"},
    }


def _params_sql() -> str:
    parts = []
    for name in S.STAGE_ORDER:
        st = S.get_stage(name)
        prompt = st.template.sql(_stage_slots_sql()[name])
        call_max = str(st.call_max_tokens) if st.call_max_tokens else "NULL"
        sysp = _sql_lit(st.system_prompt)
        parts.append(
            f"""SELECT doc_id, '{name}' AS stage,
       coalesce(nullif(o.model_override, ''), '{SETTINGS.model}') AS model,
       CAST(coalesce(nullif(o.temperature_override, 0.0), 0.7) AS DOUBLE) AS temperature,
       CAST(coalesce({call_max}, nullif(o.max_tokens_override, 0), 4096) AS INTEGER) AS max_tokens,
       coalesce(o.enabled, true) AS stage_enabled,
       md5(coalesce(nullif(o.system_prompt_override, ''), {sysp})) AS system_prompt_md5,
       CAST(length({prompt}) AS BIGINT) AS prompt_chars,
       md5({prompt}) AS prompt_md5
FROM documents LEFT JOIN eff o ON o.name = '{name}'"""
        )
    union = "\nUNION ALL\n".join(parts)
    return f"""WITH ovr(position, name, enabled, model_override, temperature_override, max_tokens_override, system_prompt_override)
  AS (VALUES {_OVR_SQL}),
eff AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY position) AS rn FROM ovr) WHERE rn = 1)
{union}"""


@query("params", _params_sql())
def params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 + R3 + R4 + B1 + F5: every document as input to every stage; the
    effective model / temperature / max_tokens / system prompt per request."""
    d = table(spark, sf_dir, "documents").select(
        F.col("source").alias("run_id"), F.col("doc_id").alias("topic_id"), "doc_id", "text", "lang", "source"
    )
    out = Q.build_all_requests(d, [S.get_stage(n) for n in S.STAGE_ORDER], _stage_slots_spark(), SETTINGS, overrides_df(spark))
    return out.select(
        F.col("topic_id").alias("doc_id"),
        "stage",
        "model",
        "temperature",
        "max_tokens",
        "stage_enabled",
        F.md5("system_prompt").alias("system_prompt_md5"),
        F.length("user_prompt").cast("bigint").alias("prompt_chars"),
        F.md5("user_prompt").alias("prompt_md5"),
    )


# Example provider choice per source number n (n mod 10), including an
# unknown name and an empty one (both fall back to the default preset).
PROVIDER_CHOICE = ["mimo", "openai", "openrouter", "ollama", "groq", "deepseek", "together", "mistral", "acme", ""]


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "documents").select("source").distinct()
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    choice = F.array(*[F.lit(p) for p in PROVIDER_CHOICE])
    return src.select(
        "source",
        F.try_element_at(choice, (n % 10 + 1)).alias("provider"),
        F.when(n % 7 == 0, F.lit("https://proxy.invalid/v1")).otherwise(F.lit("")).alias("base_url"),
        F.when(n % 5 == 0, F.lit("custom-model")).otherwise(F.lit("")).alias("model"),
        F.lit("").alias("auth_style"),
    )


_PRESETS_SQL = ", ".join("(" + ", ".join(_sql_lit(x) for x in r) + ")" for r in Q.PROVIDER_PRESETS)
_CHOICE_SQL = "[" + ", ".join(_sql_lit(p) for p in PROVIDER_CHOICE) + "]"


@query(
    "provider_resolve",
    f"""WITH presets(provider, preset_base_url, preset_auth_style, preset_model, api_key_env, base_url_env) AS (VALUES {_PRESETS_SQL}),
c AS (
  SELECT source, {_CHOICE_SQL}[CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 10 + 1] AS provider,
         CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 7 = 0 THEN 'https://proxy.invalid/v1' ELSE '' END AS base_url,
         CASE WHEN CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) % 5 = 0 THEN 'custom-model' ELSE '' END AS model
  FROM (SELECT DISTINCT source FROM documents)),
d AS (SELECT * FROM presets WHERE provider = '{Q.DEFAULT_PROVIDER}')
SELECT c.source, c.provider, p.preset_model IS NOT NULL AS preset_found,
       coalesce(nullif(c.base_url, ''), p.preset_base_url, d.preset_base_url) AS base_url,
       coalesce(nullif(c.model, ''), p.preset_model, d.preset_model) AS model,
       coalesce(p.preset_auth_style, d.preset_auth_style) AS auth_style,
       coalesce(p.api_key_env, d.api_key_env) AS api_key_env,
       coalesce(p.base_url_env, d.base_url_env) AS base_url_env
FROM c LEFT JOIN presets p ON c.provider = p.provider CROSS JOIN d""",
)
def provider_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R5 + B3: connection rows filled from the provider preset (unknown -> default)."""
    r = Q.resolve_providers(connections(spark, sf_dir), Q.presets_df(spark))
    return r.select("source", "provider", "preset_found", "base_url", "model", "auth_style", "api_key_env", "base_url_env")


# Example requested stage names: the eight registered ones plus two unknown.
CANDIDATES = list(S.STAGE_ORDER) + ["summarizer", "factcheck"]
_CAND_SQL = "[" + ", ".join(_sql_lit(c) for c in CANDIDATES) + "]"
_KNOWN = ", ".join(sorted(S.stage_names()))


@query(
    "unknown_stage",
    f"""WITH r AS (
  SELECT doc_id, list_transform(range(CAST(doc_id % 4 AS BIGINT)), lambda j: {_CAND_SQL}[CAST((doc_id + j) % 10 AS INTEGER) + 1]) AS stages
  FROM documents)
SELECT doc_id, stage, 'unknown stage ''' || stage || '''; known: {_KNOWN}' AS error
FROM (SELECT doc_id, unnest(stages) AS stage FROM r)
WHERE NOT list_contains({"[" + ", ".join(_sql_lit(c) for c in sorted(S.stage_names())) + "]"}, stage)
UNION ALL
SELECT doc_id, NULL, 'at least one stage is required' FROM r WHERE len(stages) = 0""",
)
def unknown_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 + B2: requested stage lists validated against the registry (anti join)."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    cand = F.array(*[F.lit(c) for c in CANDIDATES])
    req = d.select(
        "doc_id",
        F.transform(
            F.sequence(F.lit(0).cast("bigint"), F.col("doc_id") % 4 - 1),
            lambda j: F.try_element_at(cand, ((F.col("doc_id") + j) % 10 + 1).cast("int")),
        ).alias("stages"),
    )
    req = req.withColumn("stages", F.when(F.col("doc_id") % 4 == 0, F.expr("CAST(array() AS array<string>)")).otherwise(F.col("stages")))
    return Q.unknown_stages(req, key="doc_id")


#: A preset that the user adds, and one that takes a known one's place.
OWN_PRESETS = [
    ("acme", "https://llm.acme.test/v1", "bearer", "acme-large", "ACME_API_KEY", "ACME_BASE_URL"),
    ("groq", "https://groq.test/v1", "api-key", "own-llama", "GROQ_API_KEY", "GROQ_BASE_URL"),
]
_OWN_NAMES = {r[0] for r in OWN_PRESETS}
_ALL_PRESETS_SQL = ", ".join("(" + ", ".join(_sql_lit(x) for x in r) + ")" for r in [p for p in Q.PROVIDER_PRESETS if p[0] not in _OWN_NAMES] + OWN_PRESETS)


@query(
    "own_presets",
    f"""WITH presets(provider, base_url, auth_style, model, api_key_env, base_url_env) AS (VALUES {_ALL_PRESETS_SQL}),
n AS (SELECT DISTINCT source, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS n FROM documents),
c AS (SELECT source, {_CHOICE_SQL}[n % 10 + 1] AS provider, CASE WHEN n % 5 = 0 THEN 'custom-model' END AS model, CASE WHEN n % 7 = 0 THEN 'https://proxy.invalid/v1' END AS base_url FROM n)
SELECT c.source, c.provider, p.provider IS NOT NULL AS preset_found, coalesce(c.base_url, p.base_url, d.base_url) AS base_url, coalesce(c.model, p.model, d.model) AS model,
       coalesce(p.auth_style, d.auth_style) AS auth_style, coalesce(p.api_key_env, d.api_key_env) AS api_key_env
FROM c LEFT JOIN presets p ON c.provider = p.provider CROSS JOIN (SELECT * FROM presets WHERE provider = '{Q.DEFAULT_PROVIDER}') d""",
)
def own_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider resolution with a preset that the user adds and one that replaces a known one."""
    r = Q.resolve_providers(connections(spark, sf_dir), Q.presets_df(spark, OWN_PRESETS))
    return r.select("source", "provider", "preset_found", "base_url", "model", "auth_style", "api_key_env")


_SUPPORTED = Q.supported_models(more=["en-model"])


@query(
    "unsupported_models",
    f"""SELECT doc_id, lang || '-model' AS model, 'unsupported model ''' || lang || '-model''; supported: {", ".join(_SUPPORTED)}' AS error
FROM documents WHERE lang <> 'en'""",
)
def unsupported_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requests that name a model which is not supported, one error row each."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("lang", F.lit("-model")).alias("model"))
    return Q.unsupported_models(d, _SUPPORTED, key="doc_id")
