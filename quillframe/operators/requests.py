"""Request building: messages (R2), system prompt (R3), parameters (R4),
provider (R5), payload (R6), override lookup (B1), preset fallback (B3) and
stage validation (F6/B2).

Dimensions here are configuration, a row a provider or a stage.  Stage overrides
meet a table of mixed stages in a broadcast join: a table that comes from Python
rows has no known size, and without the hint the requests would be dealt to one
task a stage, prompts and all.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.operators import stages as S

MESSAGE_TYPE = "struct<role:string,content:string>"


@dataclass(frozen=True)
class LLMSettings:
    """Connection defaults (no secrets: the key is read from ``api_key_env`` on executors)."""

    provider: str = "mimo"
    base_url: str = ""
    model: str = ""
    auth_style: str = ""
    max_tokens: int = 4096
    temperature: float = 0.7
    top_p: float = 0.9
    timeout_s: float = 120.0
    max_retries: int = 3
    retry_delay_s: float = 1.0
    api_key_env: str = ""


# Provider presets (name, base_url, auth_style, default model,
# api-key env var, base-url env var), with "mimo" the default provider.
PROVIDER_PRESETS = [
    ("mimo", "https://token-plan-sgp.xiaomimimo.com/v1", "api-key", "mimo-v2.5-pro", "MIMO_API_KEY", "MIMO_BASE_URL"),
    ("openai", "https://api.openai.com/v1", "bearer", "gpt-4o-mini", "OPENAI_API_KEY", "OPENAI_BASE_URL"),
    ("openrouter", "https://openrouter.ai/api/v1", "bearer", "openai/gpt-4o-mini", "OPENROUTER_API_KEY", "OPENROUTER_BASE_URL"),
    ("ollama", "http://localhost:11434/v1", "bearer", "llama3.1", "OLLAMA_API_KEY", "OLLAMA_BASE_URL"),
    ("groq", "https://api.groq.com/openai/v1", "bearer", "llama-3.3-70b-versatile", "GROQ_API_KEY", "GROQ_BASE_URL"),
    ("deepseek", "https://api.deepseek.com/v1", "bearer", "deepseek-chat", "DEEPSEEK_API_KEY", "DEEPSEEK_BASE_URL"),
    ("together", "https://api.together.xyz/v1", "bearer", "meta-llama/Llama-3.3-70B-Instruct-Turbo", "TOGETHER_API_KEY", "TOGETHER_BASE_URL"),
    ("mistral", "https://api.mistral.ai/v1", "bearer", "mistral-small-latest", "MISTRAL_API_KEY", "MISTRAL_BASE_URL"),
]
DEFAULT_PROVIDER = "mimo"
PRESET_SCHEMA = "provider string, preset_base_url string, preset_auth_style string, preset_model string, api_key_env string, base_url_env string"

OVERRIDE_SCHEMA = (
    "position int, name string, enabled boolean, model_override string, temperature_override double, "
    "max_tokens_override int, system_prompt_override string"
)


def presets_df(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """The provider dimension; ``extra`` rows add or replace presets."""
    rows = {r[0]: r for r in PROVIDER_PRESETS}
    for r in extra or []:
        rows[r[0]] = r
    return spark.createDataFrame(list(rows.values()), PRESET_SCHEMA)


def resolved_settings(settings: LLMSettings, presets: list[tuple] | None = None, env: Mapping[str, str] | None = None) -> LLMSettings:
    """R5 + B3 for the one connection of a job: empty fields filled from the provider's preset.

    An unknown provider takes the default preset; an empty base URL the
    preset's variable of ``env`` (the driver's environment) before the preset's
    own.  ``presets`` add or replace presets (U3).  Keys stay in the
    environment: only their variable's name is kept.
    """
    known = {r[0]: r for r in [*PROVIDER_PRESETS, *(presets or [])]}
    _, base_url, auth_style, model, key_env, url_env = known.get(settings.provider, known[DEFAULT_PROVIDER])
    env = os.environ if env is None else env
    return replace(
        settings,
        base_url=settings.base_url or env.get(url_env, base_url),
        model=settings.model or model,
        auth_style=settings.auth_style or auth_style,
        api_key_env=settings.api_key_env or key_env,
    )


def resolve_providers(connections: DataFrame, presets: DataFrame) -> DataFrame:
    """R5 + B3: fill empty connection fields from the provider's preset.

    An unknown provider falls back to the default preset.  Output keeps the
    env-var *names* for key and base URL; secrets never become columns.
    """
    p = presets  # no hint: a local table of a few rows is broadcast by its known size
    # the default preset is one row: a scalar subquery, not a join
    d = presets.where(F.col("provider") == DEFAULT_PROVIDER).select(F.struct(*presets.columns)).scalar()
    j = connections.join(p, "provider", "left").select("*", d.alias("_d"))
    j = j.select(*[c for c in j.columns if c != "_d"], *[F.col(f"_d.{c}").alias(f"d_{c}") for c in presets.columns])

    def pick(given: str, preset: str) -> Column:
        return F.coalesce(F.nullif(F.col(given), F.lit("")), F.coalesce(F.col(preset), F.col(f"d_{preset}")))

    return j.select(
        *[c for c in connections.columns if c not in ("base_url", "model", "auth_style")],
        F.col("preset_model").isNotNull().alias("preset_found"),
        pick("base_url", "preset_base_url").alias("base_url"),
        pick("model", "preset_model").alias("model"),
        pick("auth_style", "preset_auth_style").alias("auth_style"),
        F.coalesce(F.col("api_key_env"), F.col("d_api_key_env")).alias("api_key_env"),
        F.coalesce(F.col("base_url_env"), F.col("d_base_url_env")).alias("base_url_env"),
    )


def effective_overrides(overrides: DataFrame) -> DataFrame:
    """B1: first matching entry per stage name wins (config list order = ``position``)."""
    w = Window.partitionBy("name").orderBy("position")
    return overrides.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "position")


def empty_overrides(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], OVERRIDE_SCHEMA)


_OVERRIDE_FIELDS = ("enabled", "model_override", "temperature_override", "max_tokens_override", "system_prompt_override")


def with_overrides(requests: DataFrame, overrides: DataFrame | None, stage_col: str = "stage",
                   stage_name: str | None = None) -> DataFrame:
    """Attach the effective override row of each request's stage (B1).

    With a constant ``stage_name`` (one stage per request table, the usual
    case) the override is a scalar subquery: evaluated once, no join.  For a
    table whose rows carry different stages it is an equi join on the stage
    name, broadcast: the effective overrides are one row a stage name.
    """
    if overrides is None:
        return requests.select("*", *[F.lit(None).cast(t).alias(c) for c, t in _override_types()])
    eff = effective_overrides(overrides)
    if stage_name is not None:
        row = eff.where(F.col("name") == stage_name).select(F.struct(*_OVERRIDE_FIELDS)).scalar()
        with_row = requests.select("*", row.alias("_ov"))
        return with_row.select(*requests.columns, *[F.col(f"_ov.{c}").alias(c) for c in _OVERRIDE_FIELDS])
    ov = eff.withColumnRenamed("name", "_ov_name")
    return requests.join(F.broadcast(ov), requests[stage_col] == ov["_ov_name"], "left").drop("_ov_name")


def _override_types() -> list[tuple[str, str]]:
    types = dict(x.strip().split(" ", 1) for x in OVERRIDE_SCHEMA.split(","))
    return [(c, types[c]) for c in _OVERRIDE_FIELDS]


def resolve_parameters(
    df: DataFrame,
    settings: LLMSettings,
    default_system_prompt: Column,
    call_max_tokens: Column | None = None,
    call_temperature: Column | None = None,
) -> DataFrame:
    """R3 + R4 on rows that carry override columns.

    system prompt = override if non-empty else the stage default; model =
    override or config; temperature / max_tokens = call arg, else override,
    else config, where 0 counts as unset (falsy fall-through).
    """
    cmt = call_max_tokens if call_max_tokens is not None else F.lit(None).cast("int")
    ctemp = call_temperature if call_temperature is not None else F.lit(None).cast("double")
    return df.withColumns(
        {
            "system_prompt": F.coalesce(F.nullif(F.col("system_prompt_override"), F.lit("")), default_system_prompt),
            "model": F.coalesce(F.nullif(F.col("model_override"), F.lit("")), F.lit(settings.model or None)),
            "temperature": F.coalesce(
                F.nullif(ctemp, F.lit(0.0)), F.nullif(F.col("temperature_override"), F.lit(0.0)), F.lit(settings.temperature)
            ).cast("double"),
            "max_tokens": F.coalesce(
                F.nullif(cmt, F.lit(0)), F.nullif(F.col("max_tokens_override"), F.lit(0)), F.lit(settings.max_tokens)
            ).cast("int"),
            "top_p": F.lit(settings.top_p).cast("double"),
            "stage_enabled": F.coalesce(F.col("enabled"), F.lit(True)),
        }
    )


def assemble_messages(system_prompt: Column, user_prompt: Column, context: Column | None = None) -> Column:
    """R2: [system, (user "Context:\\n"+ctx when ctx is non-empty), user prompt]."""
    sys_m = F.struct(F.lit("system").alias("role"), system_prompt.alias("content"))
    usr_m = F.struct(F.lit("user").alias("role"), user_prompt.alias("content"))
    if context is None:
        return F.array(sys_m, usr_m)
    ctx_m = F.struct(F.lit("user").alias("role"), F.concat(F.lit("Context:\n"), context).alias("content"))
    return F.filter(
        F.array(sys_m, F.when(F.coalesce(context, F.lit("")) != "", ctx_m), usr_m), lambda m: m.isNotNull()
    )


def messages_from_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """R2 over a message table (conv_id, turn, role, text): one ordered array per conversation.

    The array is one request payload, so its size is bounded by the model's
    context window; the aggregate is partial (collect per task, merge).
    """
    return turns.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("turn", "role", "text"))),
            lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")),
        ).alias("messages")
    )


def within_window(turns: DataFrame, max_chars: int, key: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(turns that fit, error rows) for a context window of ``max_chars`` characters.

    A conversation that no model could take is never gathered into one array:
    its length is summed first (combined before the shuffle), its turns are
    left out by an anti join, and it is an error row (key, chars, error).
    """
    size = turns.groupBy(key).agg(F.sum(F.length(F.coalesce("text", F.lit("")))).cast("bigint").alias("chars"))
    errors = size.where(F.col("chars") > max_chars).withColumn("error", F.lit(f"conversation exceeds the context window of {max_chars} characters"))
    return turns.join(errors.select(key), key, "left_anti"), errors


def payload_json(model: Column, messages: Column, max_tokens: Column, temperature: Column, top_p: Column, stream: bool = False) -> Column:
    """The chat-completions request body as JSON text (role + content only)."""
    return F.to_json(
        F.struct(
            model.alias("model"),
            F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"),
            max_tokens.alias("max_tokens"),
            temperature.alias("temperature"),
            top_p.alias("top_p"),
            F.lit(stream).alias("stream"),
        )
    )


def build_requests(
    inputs: DataFrame,
    stage: S.Stage,
    settings: LLMSettings = LLMSettings(),
    overrides: DataFrame | None = None,
    slot_cols: dict[str, Column] | None = None,
    iteration: Column | int = 1,
    variant: Column | str = "",
    keep: list[str] | None = None,
) -> DataFrame:
    """R1-R6 for one stage: one request row per input row.

    ``inputs`` must carry run_id and topic_id; slot values come from columns
    of the same name unless given in ``slot_cols``.  ``keep`` lists input
    columns carried through to the result (for later stages / completers).
    """
    settings = resolved_settings(settings)
    slots = {c: F.col(c) for c in inputs.columns}
    slots.update(slot_cols or {})
    user_prompt = stage.user_prompt(slots)
    it = F.lit(iteration) if isinstance(iteration, int) else iteration
    var = F.lit(variant) if isinstance(variant, str) else variant
    keep = [c for c in (keep or []) if c not in ("run_id", "topic_id")]
    base = inputs.select(
        "run_id",
        "topic_id",
        *keep,
        F.lit(stage.name).alias("stage"),
        it.cast("int").alias("iteration"),
        var.cast("string").alias("variant"),
        user_prompt.alias("user_prompt"),
        stage.input_metadata(slots).alias("meta_in"),
    )
    base = with_overrides(base, overrides, stage_name=stage.name)
    base = resolve_parameters(
        base,
        settings,
        F.lit(stage.system_prompt),
        call_max_tokens=F.lit(stage.call_max_tokens).cast("int") if stage.call_max_tokens else None,
    )
    model = F.col("model")
    msgs = assemble_messages(F.col("system_prompt"), F.col("user_prompt"))
    return base.select(
        F.sha2(
            F.concat_ws("\u0001", F.col("run_id"), F.col("topic_id").cast("string"), F.col("stage"), F.col("iteration").cast("string"), F.col("variant")),
            256,
        ).alias("request_id"),
        "run_id",
        "topic_id",
        "stage",
        "iteration",
        "variant",
        *keep,
        "stage_enabled",
        "system_prompt",
        "user_prompt",
        msgs.alias("messages"),
        model.alias("model"),
        "temperature",
        "max_tokens",
        "top_p",
        payload_json(model, msgs, F.col("max_tokens"), F.col("temperature"), F.col("top_p")).alias("payload"),
        "meta_in",
    )


def build_all_requests(
    inputs: DataFrame,
    stages: list[S.Stage],
    slot_cols: dict[str, dict[str, Column]],
    settings: LLMSettings = LLMSettings(),
    overrides: DataFrame | None = None,
) -> DataFrame:
    """R1 + R3 + R4 for several stages of every input row, in one scan.

    Each row becomes an array with one entry a stage (prompt, default system
    prompt, the stage's own max_tokens), which is exploded and meets the
    overrides in one join on the stage's name.
    """
    settings = resolved_settings(settings)

    def entry(stage: S.Stage) -> Column:
        slots = {c: F.col(c) for c in inputs.columns} | slot_cols.get(stage.name, {})
        return F.struct(
            F.lit(stage.name).alias("stage"),
            stage.user_prompt(slots).alias("user_prompt"),
            F.lit(stage.system_prompt).alias("_system"),
            F.lit(stage.call_max_tokens).cast("int").alias("_max_tokens"),
        )

    rows = inputs.select("run_id", "topic_id", F.explode(F.array(*[entry(s) for s in stages])).alias("_s")).select("run_id", "topic_id", "_s.*")
    rows = resolve_parameters(with_overrides(rows, overrides), settings, F.col("_system"), call_max_tokens=F.col("_max_tokens"))
    return rows.select("run_id", "topic_id", "stage", "stage_enabled", "system_prompt", "user_prompt", "model", "temperature", "max_tokens", "top_p")


def supported_models(presets: list[tuple] | None = None, more: list[str] | None = None) -> list[str]:
    """Models that requests may name: the presets' defaults and those that the user adds."""
    return sorted({r[3] for r in [*PROVIDER_PRESETS, *(presets or [])]} | set(more or []))


def unsupported_models(requested: DataFrame, supported: list[str], key: str = "topic_id") -> DataFrame:
    """error rows (key, model, error) for requested models that are not supported.

    ``requested`` has (key, model); a row without a model takes the default
    and is no error.
    """
    known = ", ".join(supported)
    bad = requested.where(F.coalesce("model", F.lit("")) != "").where(~F.col("model").isin(supported))
    return bad.select(key, "model", F.concat(F.lit("unsupported model '"), F.col("model"), F.lit(f"'; supported: {known}")).alias("error"))


def stage_registry_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in S.stage_names()], "stage string")


def unknown_stages(requested: DataFrame, spark: SparkSession | None = None, key: str = "topic_id") -> DataFrame:
    """F6 + B2: error rows for requested stage names that are not registered,
    plus one row per key whose request list is empty.

    ``requested`` has (key, stages array<string>).
    """
    spark = spark or requested.sparkSession
    reg = stage_registry_df(spark)
    known = ", ".join(sorted(S.stage_names()))
    names = requested.select(key, F.explode("stages").alias("stage"))
    unknown = names.join(reg, "stage", "left_anti").select(
        key, "stage", F.concat(F.lit("unknown stage '"), F.col("stage"), F.lit(f"'; known: {known}")).alias("error")
    )
    empty = requested.where(F.coalesce(F.size("stages"), F.lit(0)) == 0).select(
        key, F.lit(None).cast("string").alias("stage"), F.lit("at least one stage is required").alias("error")
    )
    return unknown.unionByName(empty)
