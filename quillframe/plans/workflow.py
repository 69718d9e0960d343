"""The article workflow over a *table* of topics.

Each stage is a DataFrame -> DataFrame step; topic configuration and the
texts later stages need travel along the rows (narrow dependencies), so the
chain itself never shuffles.  The only shuffle is the final per-article
assembly (W8), grouped by (run_id, topic_id): a group is one article's stage
rows (stages x rounds + languages), a small bounded set.

* W2 fail-fast: rows whose research or outline failed leave the chain and
  rejoin at assembly; W3 soft failures carry an empty text forward.
* W4 refine loop: a driver loop over rounds that keeps only the still-failing
  rows; each round's rows are cut from lineage (checkpoint to the session's
  checkpoint folder) so plan size stays flat.  Bound = max(max_iterations).
* F5: a stage switched off (override table, or a topic's ``disabled_stages`` /
  ``seo_enabled``) makes no call and passes its rows through: empty research,
  outline or draft, no review, the draft unedited, one round without a gate.
* W5 last-wins per stage; W6 translation fan-out (explode distinct
  languages); W7 one publisher call per article naming all targets.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators import inference as I
from quillframe.operators import ledger as L
from quillframe.operators import requests as Q
from quillframe.operators import stages as S
from quillframe.session import ensure_checkpoint_dir
from quillframe.sinks import writers

TOPIC_DEFAULTS = {
    "target_word_count": 2000,
    "language": "en",
    "quality_threshold": 0.8,
    "max_iterations": 3,
    "enable_translation": False,
}

LIST_DEFAULTS = {"target_languages": ("zh", "ms"), "publish_targets": ("markdown",)}

RESULT_UNION_COLS = [
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


def normalize_topics(topics: DataFrame, run_id: Column | str | None = None) -> DataFrame:
    """Fill per-topic configuration defaults (PipelineConfig as columns)."""
    df = topics
    if "run_id" not in df.columns:
        rid = run_id if isinstance(run_id, Column) else F.lit(run_id or f"run-{uuid.uuid4().hex}")
        df = df.withColumn("run_id", rid.cast("string"))
    for c, v in TOPIC_DEFAULTS.items():
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    for c, values in LIST_DEFAULTS.items():
        default = F.array(*[F.lit(v) for v in values])
        df = df.withColumn(c, F.coalesce(F.col(c), default) if c in df.columns else default)
    if "seo_enabled" in df.columns or "disabled_stages" in df.columns:
        none = F.array().cast("array<string>")
        off = F.coalesce(F.col("disabled_stages"), none) if "disabled_stages" in df.columns else none
        if "seo_enabled" in df.columns:
            off = F.array_union(off, F.when(~F.col("seo_enabled"), F.array(F.lit("seo"))).otherwise(none))
        df = df.withColumn("disabled_stages", off)
    return df


def cut(df: DataFrame, name: str = "round") -> DataFrame:
    """Cut lineage: write the rows as parquet under the session's checkpoint
    folder (shared storage on a cluster) and read them back.

    One job computes the rows once (an RDD ``checkpoint()`` recomputes the
    plan to write it unless it is also persisted), the files survive
    executor loss, and later reads prune columns.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return I.materialize(df, f"cut-{name}")


@dataclass
class PipelineRun:
    results: DataFrame  # every stage call's result row (W5 history included)
    articles: DataFrame  # W8: one row per (run_id, topic_id)
    calls: DataFrame  # A1 input: the ledger of the run, one row per billed attempt

    def summary(self) -> DataFrame:
        return article_summary(self.articles)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0].select(*RESULT_UNION_COLS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*RESULT_UNION_COLS))
    return out


def _on(stage: str, switches: bool) -> Column | None:
    """F5 per topic: the stage is not among the row's ``disabled_stages``."""
    return ~F.array_contains("disabled_stages", stage) if switches else None


def sent(results: DataFrame) -> DataFrame:
    """The rows of calls that were made (a skipped stage made none)."""
    return results.where(F.col("status") != I.SKIPPED)


def refine_loop(
    drafts: DataFrame,
    completer: I.Completer,
    settings: Q.LLMSettings = Q.LLMSettings(),
    overrides: DataFrame | None = None,
    keep: list[str] | None = None,
    checkpoint_rounds: bool = True,
    bound: int | None = None,
) -> tuple[list[DataFrame], DataFrame]:
    """Editor -> quality rounds until the quality gate passes (F2).

    ``drafts`` carries run_id, topic_id, topic, draft (text to edit), seo
    (review text or null), quality_threshold, max_iterations.  Returns the
    per-round result frames (editor and quality rows) and ``final`` with one
    row per draft: article (the last edited text, or the draft itself when
    max_iterations = 0), rounds, passed, final_score.  ``bound`` (the largest
    max_iterations) may be given by the caller to avoid evaluating ``drafts``
    just to find it.
    """
    keep = list(dict.fromkeys((keep or []) + ["topic", "quality_threshold", "max_iterations", "draft", "seo"]))
    switches = "disabled_stages" in drafts.columns
    if switches:
        keep = list(dict.fromkeys(keep + ["disabled_stages"]))
    rounds: list[DataFrame] = []
    finished: list[DataFrame] = []
    carry = [c for c in keep if c not in ("draft", "seo")]
    # a scripted editor's rows travel with the review's, where a billed one's are written by run_stage
    together = checkpoint_rounds and completer.deterministic
    light = [c for c in RESULT_UNION_COLS if c not in ("run_id", "topic_id", "content")]
    none = drafts.where(F.col("max_iterations") < 1).select(
        "run_id", "topic_id", *carry, F.col("draft").alias("article"), F.lit(0).alias("rounds"),
        F.lit(False).alias("passed"), F.lit(None).cast("double").alias("final_score"),
    )
    finished.append(none)
    if bound is None:
        bound = drafts.agg(F.max("max_iterations")).first()[0] or 0
    active = drafts.where(F.col("max_iterations") >= 1)
    for i in range(1, int(bound) + 1):
        ed = I.run_stage(
            active, S.EDITOR, completer, settings, overrides,
            slot_cols={"content": F.col("draft"), "seo_recommendations": F.col("seo")},
            iteration=i, keep=keep, enabled=_on("editor", switches), pass_disabled=True,
        )
        # no cut here: the quality cut below bounds lineage, and a billed
        # (non-deterministic) completer's replies are already written by run_stage
        q_in = ed.withColumn("edited", F.when(F.col("status") == I.SKIPPED, F.col("draft")).otherwise(F.col("content")))
        if together:
            q_in = q_in.withColumn("_editor", F.struct(*light))
        q = I.run_stage(
            q_in, S.QUALITY, completer, settings, overrides,
            slot_cols={
                "content": F.col("edited"),
                "title": F.col("topic"),
                "threshold": F.col("quality_threshold"),
                "threshold_pct": T.threshold_percent("quality_threshold"),
            },
            iteration=i, keep=keep + ["edited"] + (["_editor"] if together else []),
            enabled=_on("quality", switches), pass_disabled=True,
        )
        if checkpoint_rounds:
            q = cut(q.drop("draft"), f"quality-{i}")
        if together:  # the edited text is written once, as the article of the round
            ed = q.select("run_id", "topic_id", "_editor.*", F.when(F.col("_editor.status") != I.SKIPPED, F.col("edited")).alias("content"))
            q = q.drop("_editor")
        rounds += [ed, q]
        passed = F.coalesce(F.col("metadata.passes_threshold"), F.lit(False))
        unjudged = F.col("status") == I.SKIPPED  # nothing can pass or fail the gate: one edit is final
        over = passed | unjudged | (F.col("max_iterations") <= i)
        score = F.when(~unjudged, F.coalesce(F.col("metadata.overall_score"), F.lit(0.0)))
        finished.append(
            q.where(over).select(
                "run_id", "topic_id", *carry, F.col("edited").alias("article"), F.lit(i).alias("rounds"),
                passed.alias("passed"), score.alias("final_score"),
            )
        )
        active = q.where(~over).select(
            "run_id", "topic_id", *[c for c in keep if c != "draft"], F.col("edited").alias("draft")
        )
        if active.isEmpty():
            break
    final = finished[0]
    for f in finished[1:]:
        final = final.unionByName(f)
    return rounds, final


def translate(
    articles: DataFrame,
    completer: I.Completer,
    settings: Q.LLMSettings = Q.LLMSettings(),
    overrides: DataFrame | None = None,
    keep: list[str] | None = None,
    preserve_keywords: Column | None = None,
) -> DataFrame:
    """One translator call per (article, distinct target language).

    ``articles`` carries article, language, target_languages and
    enable_translation.  Result rows have variant = target language and
    iteration = the call's place among the article's translations.
    """
    keep = list(dict.fromkeys((keep or []) + ["article"]))
    tr_in = articles.where(F.coalesce(F.col("enable_translation"), F.lit(False))).select(
        "*", F.posexplode(F.array_distinct("target_languages")).alias("_place", "target_language")
    )
    switches = "disabled_stages" in articles.columns
    if switches:
        keep = list(dict.fromkeys(keep + ["disabled_stages"]))
    note = T.join_or_default(preserve_keywords, "") if preserve_keywords is not None else F.lit(None).cast("string")
    return I.run_stage(
        tr_in, S.TRANSLATOR, completer, settings, overrides,
        slot_cols={"content": F.col("article"), "source_language": F.col("language"),
                   "target_language": F.col("target_language"), "keywords_note": note},
        iteration=F.col("_place") + 1, variant=F.col("target_language"), keep=keep + ["target_language"],
        enabled=_on("translator", switches),
    )


def publish(
    articles: DataFrame,
    completer: I.Completer,
    settings: Q.LLMSettings = Q.LLMSettings(),
    overrides: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One publisher call per article naming all its targets (default markdown)."""
    keep = list(dict.fromkeys((keep or []) + ["article"]))
    switches = "disabled_stages" in articles.columns
    if switches:
        keep = list(dict.fromkeys(keep + ["disabled_stages"]))
    return I.run_stage(
        articles, S.PUBLISHER, completer, settings, overrides,
        slot_cols={"content": F.col("article"), "title": F.col("topic"),
                   "targets_text": T.join_or_default("publish_targets", "markdown")},
        keep=keep, enabled=_on("publisher", switches),
    )


@dataclass(frozen=True)
class ExtraStage:
    """A stage of the user's own in the chain; with ``rewrites`` its reply becomes the article."""

    stage: S.Stage
    rewrites: bool = False


def extra_stage(final: DataFrame, extra: ExtraStage, completer: I.Completer, settings: Q.LLMSettings, overrides: DataFrame | None, keep: list[str]) -> DataFrame:
    """One call of ``extra`` an article; its template may use ``content`` (the article), ``title`` and the topic's own columns.

    A stage that is off, or whose call fails, leaves the article as it is.
    """
    switches = "disabled_stages" in final.columns
    carried = [c for c in final.columns if c not in ("run_id", "topic_id")]
    return I.run_stage(
        final, extra.stage, completer, settings, overrides, slot_cols={"content": F.col("article"), "title": F.col("topic")},
        keep=list(dict.fromkeys([*keep, *carried])), enabled=_on(extra.stage.name, switches), pass_disabled=True,
    )


def run_pipeline(
    topics: DataFrame,
    completer: I.Completer,
    settings: Q.LLMSettings = Q.LLMSettings(),
    overrides: DataFrame | None = None,
    run_id: Column | str | None = None,
    keep: list[str] | None = None,
    strict: bool = False,
    materialize_stages: bool = True,
    metrics_path: str | None = None,
    output_path: str | None = None,
    extra_stages: Sequence[ExtraStage] = (),
) -> PipelineRun:
    """Research -> outline -> writer -> seo -> (editor -> quality)* ->
    translator -> publisher over every topic row.

    ``keep`` names extra topic columns carried to every request (completers
    may read them).  ``strict`` turns W3 soft failures into failed articles.
    With ``materialize_stages`` each stage's results are written once (parquet
    in the checkpoint folder) so the chain is never recomputed by the loop,
    the fan-outs and the final assembly.  With ``metrics_path`` the run's calls
    are appended to the ledger there, failed calls and articles included, and
    the articles name that path.  With ``output_path`` every published article
    and the publisher's reply are written as files there, and the publisher's
    ``output_files`` name them.  ``extra_stages`` (U1) run in turn over the
    finished articles, before translation and publishing.
    """
    t = normalize_topics(topics, run_id)
    cfg = ["topic", "target_word_count", "language", "quality_threshold", "max_iterations",
           "enable_translation", "target_languages", "publish_targets"] + list(keep or [])
    switches = "disabled_stages" in t.columns
    cfg = list(dict.fromkeys(cfg + (["disabled_stages"] if switches else [])))

    def stage_out(df: DataFrame, name: str) -> DataFrame:
        return cut(df, name) if materialize_stages else df

    def gate(stage: str) -> dict:
        return {"enabled": _on(stage, switches), "pass_disabled": True}

    went_on = F.col("status").isin("success", I.SKIPPED)
    text = F.coalesce("content", F.lit(""))  # a skipped stage leaves an empty text
    # loop bound from the topic table itself (a cheap scan), not from the chain
    bound = int(t.agg(F.max("max_iterations")).first()[0] or 0)
    research = stage_out(I.run_stage(t, S.RESEARCH, completer, settings, overrides, keep=cfg, **gate("research")), "research")
    outline = stage_out(I.run_stage(
        research.where(went_on).withColumn("research_data", text), S.OUTLINE, completer, settings, overrides,
        slot_cols={"target_words": F.col("target_word_count")}, keep=cfg + ["research_data"], **gate("outline"),
    ), "outline")
    writer = stage_out(I.run_stage(
        outline.where(went_on).withColumn("outline", text), S.WRITER, completer, settings, overrides,
        keep=cfg,
        slot_cols={"outline": F.col("outline"), "research_data": F.col("research_data"), "language": F.col("language")},
        **gate("writer"),
    ), "writer")
    seo = stage_out(I.run_stage(
        writer.withColumn("draft", text), S.SEO, completer, settings, overrides,
        slot_cols={"content": F.col("draft"), "keywords": T.join_or_default(F.lit(None).cast("array<string>"), "auto-detect")},
        keep=cfg + ["draft"], **gate("seo"),
    ), "seo")
    drafts = seo.withColumn("seo", F.col("content"))
    rounds, final = refine_loop(drafts, completer, settings, overrides, keep=cfg, bound=bound)

    extras = []
    for e in extra_stages:
        ran = stage_out(extra_stage(final, e, completer, settings, overrides, cfg), f"extra-{e.stage.name}")
        extras.append(ran)
        took = F.lit(e.rewrites) & (F.col("status") == "success")
        final = ran.select(*[F.when(took, F.col("content")).otherwise(F.col("article")).alias("article") if c == "article" else c for c in final.columns])
    translator = translate(final, completer, settings, overrides, keep=cfg)
    publisher = publish(final, completer, settings, overrides, keep=cfg)
    if output_path:
        publisher = writers.write_published(final, stage_out(publisher, "publisher"), output_path)
    # what is not in a file yet is written now; the other stages' rows are read where they are
    unwritten = [*([] if completer.deterministic else rounds[0::2]), translator, publisher]
    rounds = rounds if completer.deterministic else rounds[1::2]
    every = _union([research, outline, writer, seo, *rounds, *extras, stage_out(_union(unwritten), "results")])
    results = sent(every)
    calls = L.ledger_rows(results)
    if metrics_path:
        L.append(calls, metrics_path)
    rewritten = any(e.rewrites for e in extra_stages)
    articles = assemble(every, final, t, strict=strict, editor_texts=rewritten).withColumn("metrics_path", F.lit(metrics_path).cast("string"))
    return PipelineRun(results=results, articles=articles, calls=calls)


def assemble(results: DataFrame, final: DataFrame, topics: DataFrame, strict: bool = False, editor_texts: bool = False) -> DataFrame:
    """W8 + W5 + W2/W3/W11: one row per (run_id, topic_id) of ``topics``.

    One groupBy, no join: the article's stage rows, its final text and the
    topic itself are collected together (bounded: stages x rounds +
    languages), sorted by pipeline order, and reduced to the last row per stage
    key (translator keys are ``translator_<lang>``, in the order of the calls).
    What says which calls were made (``ls``) is collected apart from the full
    rows (``rs``) and the article, so a reader of the former shuffles no texts.
    A topic whose rows were lost is there all the same, and failed: a stage
    without a row is excused only if a ``skipped`` row says that it was off,
    or an earlier stage has failed already.  The last editor's text is the
    article and travels once, unless ``editor_texts`` says that a later stage
    rewrote the article.
    """
    key = F.when(F.col("stage") == "translator", F.concat(F.lit("translator_"), F.col("variant"))).otherwise(F.col("stage"))

    def item(ord_: Column, it: Column, k: Column, stage: Column, variant: Column, status: Column, content: Column,
             tokens: Column, latency: Column, error: Column, reasoning: Column, metadata: Column) -> Column:
        return F.struct(ord_.alias("ord"), it.cast("int").alias("iteration"), k.alias("key"), stage.alias("stage"),
                        variant.alias("variant"), status.alias("status"), content.alias("content"),
                        tokens.cast("bigint").alias("tokens_used"), latency.cast("double").alias("latency_ms"),
                        error.cast("string").alias("error"), reasoning.cast("string").alias("reasoning"), metadata.alias("metadata"))

    made = F.col("status") != I.SKIPPED
    billed = made & (F.col("call_id") == F.col("request_id"))  # a shared reply is one call, of the request that was sent
    rows = results.select(
        "run_id",
        "topic_id",
        item(S.stage_order_index(F.col("stage")), F.col("iteration"), key, F.col("stage"), F.col("variant"), F.col("status"),
             F.when((F.col("stage") == "editor") & F.lit(not editor_texts), F.lit(None).cast("string")).otherwise(F.col("content")),
             F.col("tokens_used"), F.col("latency_ms"), F.col("error"), F.col("reasoning"), F.col("metadata")).alias("r"),
        F.struct(S.stage_order_index(F.col("stage")).alias("ord"), F.col("iteration").cast("int").alias("iteration"), key.alias("key"),
                 F.col("stage").alias("stage"), F.col("variant").alias("variant"), F.col("status").alias("status")).alias("l"),
        F.lit(None).cast("struct<article:string>").alias("a"),
        F.when(billed, F.col("prompt_tokens") + F.col("completion_tokens")).otherwise(F.lit(0)).alias("tok"),
        F.when(billed, F.col("latency_ms").cast("decimal(18,2)")).alias("lat"),
        F.when(billed, 1).alias("call"),
    )

    def extra(df: DataFrame, article: Column) -> DataFrame:
        none = F.lit(None)
        return df.select(
            "run_id", "topic_id", none.cast(full_type).alias("r"), none.cast(light_type).alias("l"), article.alias("a"),
            F.lit(0).cast("bigint").alias("tok"), none.cast("decimal(18,2)").alias("lat"), none.cast("int").alias("call"),
        )

    full_type, light_type = rows.schema["r"].dataType, rows.schema["l"].dataType
    # the final article and the topic travel as further rows of the same group (no join)
    art = extra(final, F.struct("article"))
    asked = extra(topics, F.lit(None).cast("struct<article:string>"))
    per = rows.unionByName(art).unionByName(asked).groupBy("run_id", "topic_id").agg(
        F.array_sort(F.collect_list("r")).alias("rs"),
        F.array_sort(F.collect_list("l")).alias("ls"),
        F.min("a")["article"].alias("_article"),
        F.sum("tok").cast("bigint").alias("total_tokens"),
        F.sum("lat").alias("lat_ms"),
        F.count("call").alias("total_calls"),
    )

    def last_of(items: str) -> Column:
        return F.filter(items, lambda x: ~F.exists(items, lambda y: (y["key"] == x["key"]) & (y["iteration"] > x["iteration"])))

    per = per.select("*", last_of("rs").alias("last"), last_of("ls").alias("last_calls"))
    ran = F.filter("last", lambda x: x["status"] != I.SKIPPED)
    calls = F.filter("last_calls", lambda x: x["status"] != I.SKIPPED)

    def text_of(x: Column) -> Column:
        return F.when((x["stage"] == "editor") & (x["status"] == "success") & F.lit(not editor_texts), F.col("_article")).otherwise(F.coalesce(x["content"], F.lit("")))

    def content_of(stage: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter(ran, lambda x: x["key"] == stage), F.lit(1))["content"], F.lit(""))

    def broken(stage: str) -> Column:
        """No row, or a failed one."""
        status = F.try_element_at(F.filter("last_calls", lambda x: x["key"] == stage), F.lit(1))["status"]
        return F.coalesce(status, F.lit("lost")).isin("lost", "failed")

    tr = F.filter(ran, lambda x: x["stage"] == "translator")
    return per.select(
        "run_id",
        "topic_id",
        F.when(broken("research") | broken("outline"), F.lit("failed"))
        .when(F.lit(strict) & F.exists(calls, lambda x: x["status"] != "success"), F.lit("failed"))
        .when(F.col("_article").isNull(), F.lit("failed"))
        .otherwise(F.lit("success"))
        .alias("status"),
        F.coalesce(F.col("_article"), F.lit("")).alias("article"),
        content_of("research").alias("research"),
        content_of("outline").alias("outline"),
        content_of("seo").alias("seo_analysis"),
        content_of("quality").alias("quality_report"),
        content_of("publisher").alias("publisher_output"),
        F.map_from_entries(F.transform(tr, lambda x: F.struct(x["variant"], x["content"]))).alias("translations"),
        F.transform(calls, lambda x: x["key"]).alias("agents_run"),
        F.map_from_entries(
            F.transform(
                ran,
                lambda x: F.struct(
                    x["key"],
                    F.struct(x["status"].alias("status"), text_of(x).alias("content"), x["tokens_used"].alias("tokens_used"),
                             x["latency_ms"].alias("latency_ms"), x["error"].alias("error"), x["iteration"].alias("iteration"),
                             x["reasoning"].alias("reasoning"), x["metadata"].alias("metadata")),
                ),
            )
        ).alias("agent_results"),
        "total_tokens",
        "total_calls",
        (F.coalesce(F.col("lat_ms"), F.lit(0)).cast("double") / F.lit(1000.0)).alias("pipeline_duration_s"),
    )


def article_summary(articles: DataFrame) -> DataFrame:
    """The run summary row per article.

    The languages are read from the names of the calls, not from the map of
    translated texts; a language twice is an error in both.
    """
    prefix = "translator_"
    calls = F.filter("agents_run", lambda x: x.startswith(prefix))
    languages = F.map_from_entries(F.transform(calls, lambda x: F.struct(F.substring(x, F.lit(len(prefix) + 1), F.length(x)), F.lit(True))))
    return articles.select(
        "run_id",
        "topic_id",
        "status",
        "total_tokens",
        "total_calls",
        F.bround("pipeline_duration_s", 2).alias("pipeline_duration_s"),
        "agents_run",
        F.length("article").cast("bigint").alias("article_length"),
        T.ws_word_count("article").alias("word_count"),
        F.array_sort(F.map_keys(languages)).alias("translations"),
        "metrics_path",
    )


def round_report(results: DataFrame) -> DataFrame:
    """One row per review round of an article: what the round gained, and the best round so far.

    ``results`` are stage results; of them the quality rows count.  A round
    whose review failed has no score: it gains nothing and the next round's
    gain is null as well.  ``best_round`` is the first round with the highest
    score up to here, ``last_is_best`` says whether the text that the loop kept
    (the last round's) is the best one.  The windows hold one article's rounds.
    """
    w = Window.partitionBy("run_id", "topic_id").orderBy("iteration")
    whole = Window.partitionBy("run_id", "topic_id")
    rows = results.where((F.col("stage") == "quality") & (F.col("status") != I.SKIPPED)).select(
        "run_id", "topic_id", F.col("iteration").cast("int").alias("round"), "iteration", "status", F.col("metadata.overall_score").alias("score"),
        F.coalesce("metadata.passes_threshold", F.lit(False)).alias("passed"),
    )
    rank = F.when(F.col("score").isNotNull(), F.struct(F.col("score"), -F.col("round")))
    best = F.max(rank)
    return rows.select(
        "run_id", "topic_id", "round", "status", "score", "passed",
        (F.col("score") - F.lag("score").over(w)).alias("gain"),
        (-best.over(w)["col2"]).cast("int").alias("best_round"),
        best.over(w)["score"].alias("best_score"),
        (F.max("round").over(whole) == -best.over(whole)["col2"]).alias("last_is_best"),
    )
