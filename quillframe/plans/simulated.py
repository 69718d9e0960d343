"""Scripted stand-ins for a model: what the driver queries and the tests use in its place.

Nothing of the engine imports this module.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators.inference import Completer


def response_json(
    content: Column,
    prompt_tokens: Column,
    completion_tokens: Column,
    cached_tokens: Column | None = None,
    model: Column | None = None,
    finish_reason: str = "stop",
    reasoning: Column | None = None,
) -> Column:
    """Build a chat-completions style JSON body (used by fake completers)."""
    cached = cached_tokens if cached_tokens is not None else F.lit(0).cast("bigint")
    return F.to_json(
        F.struct(
            (model if model is not None else F.lit("fake")).alias("model"),
            F.array(
                F.struct(
                    F.struct(content.alias("content"), (reasoning if reasoning is not None else F.lit(None).cast("string")).alias("reasoning_content")).alias("message"),
                    F.lit(finish_reason).alias("finish_reason"),
                )
            ).alias("choices"),
            F.struct(
                prompt_tokens.cast("bigint").alias("prompt_tokens"),
                completion_tokens.cast("bigint").alias("completion_tokens"),
                (prompt_tokens + completion_tokens).cast("bigint").alias("total_tokens"),
                F.struct(cached.cast("bigint").alias("cached_tokens")).alias("prompt_tokens_details"),
            ).alias("usage"),
        )
    )


def approx_tokens(text: Column) -> Column:
    """A stand-in token count: ceil(chars / 4)."""
    return ((F.length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("bigint")


def prompt_chars(messages: Column) -> Column:
    return F.aggregate(messages, F.lit(0).cast("bigint"), lambda acc, m: acc + F.length(m["content"]))


@dataclass
class ExpressionCompleter(Completer):
    """Replies computed by Column expressions over the request row.

    ``replies`` maps a stage name to ``fn(row_columns) -> content Column``;
    stages without an entry echo the last 200 characters of the user prompt.
    ``errors`` optionally maps a stage to ``fn(row) -> error Column`` (null =
    success) to script failures.  Usage is ceil(chars/4) for prompt and reply.
    ``clock`` gives the time at which a request's call starts (default: now).
    """

    replies: Mapping[str, Callable[[Callable[[str], Column]], Column]] = field(default_factory=dict)
    errors: Mapping[str, Callable[[Callable[[str], Column]], Column]] = field(default_factory=dict)
    clock: Callable[[Callable[[str], Column]], Column] | None = None
    deterministic: bool = True

    def complete(self, requests: DataFrame, stage: str | None = None) -> DataFrame:
        names = requests.columns
        present = set(names)

        def col(name: str) -> Column:
            # replies for other stages may read columns this request table lacks
            return F.col(name) if name in present else F.lit(None)

        content = F.substring(F.col("user_prompt"), -200, 200)
        error = F.lit(None).cast("string")
        if stage is not None:
            # one stage per table: only its expressions enter the plan
            if stage in self.replies:
                content = self.replies[stage](col)
            if stage in self.errors:
                error = self.errors[stage](col)
        else:
            for name, fn in self.replies.items():
                content = F.when(F.col("stage") == name, fn(col)).otherwise(content)
            for name, fn in self.errors.items():
                error = F.when(F.col("stage") == name, fn(col)).otherwise(error)
        # each a column of its own: they are read several times, and long
        requests = requests.withColumns({"_content": content, "_error": error, "_p_tok": ((prompt_chars(F.col("messages")) + 3) / 4).cast("bigint")})
        requests = requests.withColumn("_c_tok", approx_tokens(F.col("_content")))
        content, error, p_tok, c_tok = (F.col(c) for c in ("_content", "_error", "_p_tok", "_c_tok"))
        cached = F.when(F.col("iteration") > 1, (p_tok / 2).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        raw = response_json(content, p_tok, c_tok, cached, model=F.col("model"))
        return requests.select(
            *names,
            F.when(error.isNull(), raw).alias("raw"),
            (F.lit(100.0) + c_tok.cast("double")).alias("latency_ms"),
            error.alias("error"),
            F.lit(0).alias("retries"),
            F.lit("1").alias("attempt_id"),
            (self.clock(col) if self.clock else F.current_timestamp()).alias("started_at"),
        )


def sse_lines(responses: DataFrame, text: Column, chunk_chars: int = 20, reasoning: Column | None = None,
              prompt_tokens: Column | None = None) -> DataFrame:
    """Build a realistic chunk-line stream for each (response_id, event_time) row:

    role-only opener, a keep-alive comment, the text cut into ``chunk_chars``
    pieces, an optional reasoning chunk, a malformed line, an empty-choices
    line, a usage chunk with finish_reason, ``[DONE]`` and one stray line after
    it.  Pure generator (explode) over the input rows -- no shuffle.
    """
    n = ((F.length(text) + chunk_chars - 1) / chunk_chars).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(-1))),
        lambda i: F.substring(text, i * chunk_chars + 1, chunk_chars),
    )
    pieces = F.when(n > 0, pieces).otherwise(F.expr("CAST(array() AS array<string>)"))

    def delta_line(content: Column) -> Column:
        return F.concat(
            F.lit("data: "),
            F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("delta"))).alias("choices"))),
        )

    pt = prompt_tokens if prompt_tokens is not None else F.lit(0)
    ct = ((F.length(text) + 3) / 4).cast("bigint")
    usage_line = F.concat(
        F.lit("data: "),
        F.to_json(
            F.struct(
                F.array(F.struct(F.struct().alias("delta"), F.lit("stop").alias("finish_reason"))).alias("choices"),
                F.struct(pt.cast("bigint").alias("prompt_tokens"), ct.alias("completion_tokens"), (pt + ct).cast("bigint").alias("total_tokens")).alias("usage"),
            )
        ),
    )
    reason_lines = F.expr("CAST(array() AS array<string>)")
    if reasoning is not None:
        reason_line = F.concat(
            F.lit("data: "),
            F.to_json(F.struct(F.array(F.struct(F.struct(reasoning.alias("reasoning_content")).alias("delta"))).alias("choices"))),
        )
        reason_lines = F.when(reasoning.isNotNull(), F.array(reason_line)).otherwise(reason_lines)
    lines = F.concat(
        F.array(F.lit('data: {"choices":[{"delta":{"role":"assistant"}}]}'), F.lit(": keep-alive")),
        reason_lines,
        F.transform(pieces, delta_line),
        F.array(F.lit("data: {not json"), F.lit('data: {"choices":[]}'), usage_line, F.lit("data: [DONE]"), delta_line(F.lit("after done"))),
    )
    return responses.select(
        "response_id",
        "event_time",
        F.posexplode_outer(lines).alias("seq", "line"),
    ).where(F.col("line").isNotNull()).select(
        "response_id",
        F.col("seq").cast("bigint").alias("seq"),
        (F.col("event_time") + F.make_interval(secs=F.col("seq").cast("decimal(18,6)"))).alias("event_time"),
        "line",
    )


class ScriptedEndpoint:
    """A transport without a network: what it answers follows from the prompt's length.

    ``length % 5``: 0 answers at once, 1 after one 503, 2 after two timeouts,
    3 refuses the request, 4 never answers.  The reply is the prompt's last 20
    characters, the usage its length.
    """

    def __init__(self) -> None:
        self.tries: dict[bytes, int] = {}

    def __call__(self, url: str, body: bytes, headers: Mapping[str, str], timeout: float) -> tuple[int, bytes]:
        prompt = json.loads(body)["messages"][-1]["content"]
        kind = len(prompt) % 5
        n = self.tries[body] = self.tries.get(body, 0) + 1
        if kind == 3:
            return 400, b"no"
        if kind == 4 or (kind == 1 and n == 1):
            return 503, b"busy"
        if kind == 2 and n <= 2:
            raise TimeoutError("timed out")
        self.tries.pop(body)
        usage = {"prompt_tokens": len(prompt), "completion_tokens": 20, "total_tokens": len(prompt) + 20}
        return 200, json.dumps({"choices": [{"message": {"content": prompt[-20:]}}], "usage": usage}).encode()


def no_wait(_: float) -> None:
    """In place of the pause between two tries."""
