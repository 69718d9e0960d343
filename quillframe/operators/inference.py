"""Batch inference (I1-I6) with a pluggable completer.

A completer turns a request table into the same rows plus response columns
``raw`` (the chat-completions JSON body), ``latency_ms``, ``error``,
``retries``, ``attempt_id`` and ``started_at``.  Parsing (I3) always happens
JVM-side with ``from_json``; :mod:`quillframe.operators.http_completion` is the
completer for real endpoints.

Inference output is non-deterministic and billed, so :func:`run_stage`
materialises it (parquet under the session's checkpoint folder) before any
second use when the completer says it is not deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators import requests as Q
from quillframe.operators import stages as S
from quillframe.session import scratch_path

USAGE_TYPE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,cached_tokens:bigint>"

# The fields read from a chat-completions response body.
RESPONSE_SCHEMA = (
    "struct<model:string,"
    "choices:array<struct<message:struct<content:string,reasoning_content:string>,finish_reason:string>>,"
    "usage:struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint,"
    "prompt_tokens_details:struct<cached_tokens:bigint>>>"
)

RESPONSE_COLS = ["raw", "latency_ms", "error", "retries", "attempt_id", "started_at"]


class Completer:
    """U5 protocol: ``complete(requests, stage=None) -> requests + RESPONSE_COLS``.

    ``stage`` is a hint that every request row belongs to that stage (the
    case for :func:`run_stage`); completers may ignore it.  ``needs`` names the
    request columns that a completer reads (None: any).
    """

    deterministic: bool = False
    needs: tuple[str, ...] | None = None

    def complete(self, requests: DataFrame, stage: str | None = None) -> DataFrame:  # pragma: no cover - interface
        raise NotImplementedError


# ----------------------------------------------------------------- I3 / I4 / I5


def parse_responses(responses: DataFrame) -> DataFrame:
    """Parse ``raw`` into content, reasoning, usage (missing counts -> 0),
    model and finish_reason.  A body that does not parse, or has no choice,
    becomes an error row."""
    r = F.from_json(F.col("raw"), RESPONSE_SCHEMA)
    choice = F.try_element_at(r["choices"], F.lit(1))
    parsed = responses.withColumn("_r", r)
    r = F.col("_r")
    choice = F.try_element_at(r["choices"], F.lit(1))
    bad = F.col("error").isNull() & (r.isNull() | choice.isNull())
    usage = F.struct(
        F.coalesce(r["usage"]["prompt_tokens"], F.lit(0)).cast("bigint").alias("prompt_tokens"),
        F.coalesce(r["usage"]["completion_tokens"], F.lit(0)).cast("bigint").alias("completion_tokens"),
        F.coalesce(r["usage"]["total_tokens"], F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce(r["usage"]["prompt_tokens_details"]["cached_tokens"], F.lit(0)).cast("bigint").alias("cached_tokens"),
    )
    return parsed.select(
        *[c for c in responses.columns if c not in ("error",)],
        choice["message"]["content"].alias("content"),
        choice["message"]["reasoning_content"].alias("reasoning_content"),
        usage.alias("usage"),
        F.coalesce(r["model"], F.lit("")).alias("response_model"),
        F.coalesce(choice["finish_reason"], F.lit("")).alias("finish_reason"),
        F.when(bad, F.lit("unparseable response")).otherwise(F.col("error")).alias("error"),
    )


def quality_score(content: Column) -> Column:
    """struct(score double, failed boolean) from a quality reply.

    score = the top-level ``overall_score`` read as a number (last duplicate
    key wins), 0 when the reply is not a JSON object or lacks the key;
    booleans count 1/0 and NaN counts 0 (it can never pass).  The stage fails
    when the score is a JSON string or null, or the content itself is null.
    """
    num = F.from_json(content, "struct<overall_score:double>")["overall_score"]
    v = F.try_parse_json(content)
    field_v = F.try_variant_get(v, "$.overall_score", "variant")
    kind = F.when(field_v.isNotNull(), F.schema_of_variant(field_v))
    as_bool = F.when(F.try_variant_get(v, "$.overall_score", "boolean"), 1.0).otherwise(0.0)
    score = F.when(kind == "BOOLEAN", as_bool).otherwise(F.coalesce(num, F.lit(0.0)))
    score = F.when(F.isnan(score), F.lit(0.0)).otherwise(score)
    failed = content.isNull() | F.coalesce(kind.isin("STRING", "VOID"), F.lit(False))
    return F.struct(score.alias("score"), failed.alias("failed"))


RESULT_COLS = [
    "request_id",
    "run_id",
    "topic_id",
    "stage",
    "iteration",
    "variant",
    "status",
    "content",
    "tokens_used",
    "latency_ms",
    "error",
    "reasoning",
    "metadata",
    "prompt_tokens",
    "completion_tokens",
    "cached_tokens",
    "retries",
    "call_id",
    "attempt_id",
    "model",
    "started_at",
    "call_failed",
]


def stage_results(parsed: DataFrame, stage: S.Stage, keep: list[str] | None = None, threshold_col: Column | None = None) -> DataFrame:
    """I4 + I5: one result row per request.

    Failures (transport error, unparseable body, J4 type failure) give status
    ``failed``, empty content, 0 ``tokens_used`` and empty metadata.  The token
    counts are those of the call: a reply that was billed keeps its usage
    though the stage could not use it; only a call that failed itself
    (``call_failed``) counts 0 tokens and an error.  tokens_used is the API
    total.
    """
    keep = [c for c in (keep or []) if c in parsed.columns]
    df = parsed
    call_failed = F.col("error").isNotNull()
    failed = F.col("error").isNotNull() | F.col("content").isNull()
    err = F.coalesce(F.col("error"), F.when(F.col("content").isNull(), F.lit("reply has no content")))
    meta = stage.finish_metadata(F.col("meta_in"), F.col("content"))
    if stage.name == "quality":
        q = quality_score(F.col("content"))
        df = df.withColumn("_q", q)
        failed = failed | F.col("_q.failed")
        err = F.coalesce(err, F.when(F.col("_q.failed"), F.lit("overall_score is not a number")))
        thr = threshold_col if threshold_col is not None else F.col("meta_in.threshold")
        meta = meta.withField("overall_score", F.col("_q.score")).withField(
            "passes_threshold", F.col("_q.score") >= thr * F.lit(100.0)
        )
    empty_meta = F.lit(None).cast(S.METADATA_TYPE)
    return df.select(
        "request_id",
        "run_id",
        "topic_id",
        "stage",
        "iteration",
        "variant",
        *keep,
        F.when(failed, F.lit("failed")).otherwise(F.lit("success")).alias("status"),
        F.when(failed, F.lit("")).otherwise(F.col("content")).alias("content"),
        F.when(failed, F.lit(0)).otherwise(F.col("usage.total_tokens")).cast("bigint").alias("tokens_used"),
        F.col("latency_ms").cast("double").alias("latency_ms"),
        F.when(failed, err).alias("error"),
        (F.lit(None).cast("string") if not stage.keeps_reasoning else F.when(~failed, F.col("reasoning_content"))).alias(
            "reasoning"
        ),
        F.when(failed, empty_meta).otherwise(meta).alias("metadata"),
        *[F.when(call_failed, 0).otherwise(F.col(f"usage.{c}")).cast("bigint").alias(c) for c in ("prompt_tokens", "completion_tokens", "cached_tokens")],
        F.coalesce(F.col("retries"), F.lit(0)).cast("int").alias("retries"),
        (F.col("call_id") if "call_id" in parsed.columns else F.col("request_id")).alias("call_id"),
        "attempt_id",
        "model",
        "started_at",
        call_failed.alias("call_failed"),
    )


#: Status of a row whose stage was switched off.
SKIPPED = "skipped"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and read it back.

    Used for billed, non-deterministic inference output: one job computes it,
    the files are committed once, and later reads never call the model again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)  # texts take half the space of the default codec
    return df.sparkSession.read.parquet(path)


def complete_distinct(requests: DataFrame, completer: Completer, stage: str | None = None) -> DataFrame:
    """Response cache: send each distinct payload once and join the reply back.

    Requests are keyed by ``sha2(payload)``; of each key one row, cut to what
    the completer needs, goes to it (its output is written once), and every
    request row takes the reply of its key through an equi join on the hash.
    Identical prompts -- repeated topics, re-runs -- are billed once: all rows
    of a key carry the ``call_id`` of the request that was sent.
    """
    keyed = requests.withColumn("payload_sha", F.sha2(F.col("payload"), 256))
    columns = ["payload_sha", *(completer.needs or requests.columns)]
    # any row of a key can represent it: the payloads are identical
    resp = completer.complete(keyed.select(*columns).dropDuplicates(["payload_sha"]), stage=stage)
    replies = resp.select("payload_sha", F.col("request_id").alias("call_id"), *RESPONSE_COLS)
    if not completer.deterministic:
        replies = materialize(replies, f"responses-{stage or 'any'}")
    return keyed.join(replies, "payload_sha", "left").drop("payload_sha")


def run_stage(
    inputs: DataFrame,
    stage: S.Stage,
    completer: Completer,
    settings: Q.LLMSettings = Q.LLMSettings(),
    overrides: DataFrame | None = None,
    slot_cols: dict[str, Column] | None = None,
    iteration: Column | int = 1,
    variant: Column | str = "",
    keep: list[str] | None = None,
    threshold_col: Column | None = None,
    dedupe_payloads: bool = False,
    enabled: Column | None = None,
    pass_disabled: bool = False,
) -> DataFrame:
    """G*: build requests, complete, parse and project one stage.

    Requests whose stage is disabled (F5), by an override or by ``enabled``
    (a condition on kept columns), are not sent.  They leave the output, or
    with ``pass_disabled`` stay in it with status ``skipped`` and no content.
    With ``dedupe_payloads`` identical request bodies are sent once
    (:func:`complete_distinct`).
    """
    req = Q.build_requests(inputs, stage, settings, overrides, slot_cols, iteration, variant, keep)
    on = F.coalesce(F.col("stage_enabled"), F.lit(True))
    if enabled is not None:
        on = on & F.coalesce(enabled, F.lit(True))
    off = req.where(~on)
    req = req.where(on)
    if dedupe_payloads:
        resp = complete_distinct(req, completer, stage=stage.name)
    else:
        resp = completer.complete(req, stage=stage.name)
        if not completer.deterministic:
            resp = materialize(resp.drop("messages", "payload", "system_prompt", "user_prompt"), f"responses-{stage.name}")
    parsed = parse_responses(resp)
    results = stage_results(parsed, stage, keep=keep, threshold_col=threshold_col)
    if not pass_disabled or (overrides is None and enabled is None):
        return results
    known = {"status": F.lit(SKIPPED), "tokens_used": F.lit(0), "latency_ms": F.lit(0.0)}
    known |= {c: F.lit(0) for c in ("prompt_tokens", "completion_tokens", "cached_tokens", "retries")}
    known |= {c: F.lit(None) for c in ("call_id", "attempt_id", "started_at")} | {"call_failed": F.lit(False)}
    blank = [
        f.name if f.name in off.columns and f.name not in known else known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
        for f in results.schema
    ]
    return results.unionByName(off.select(*blank))
