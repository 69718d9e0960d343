"""Driver queries that run the stage machinery (requests -> completer ->
parse -> results) over topics derived from ``documents``.

The completer is a deterministic :class:`ExpressionCompleter` whose replies
are closed-form functions of the document (the quality score of round i is
40 + 25*quality + n_chars mod 20 + 10*i), so the oracle SQL can state the
expected outcome without running a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import render as R
from quillframe.functions import text as T
from quillframe.operators import inference as I
from quillframe.operators import stages as S
from quillframe.plans import workflow as W
from quillframe.plans.registry import query
from quillframe.plans.simulated import ExpressionCompleter
from quillframe.session import scratch_path
from quillframe.plans.text_queries import SQL_MARKDOWN, SQL_TITLE, doc_markdown, doc_title, sql_markdown_to_html
from quillframe.sources.tables import table

# The eight quality dimensions of the quality contract.
DIMENSIONS = ["accuracy", "completeness", "clarity", "engagement", "originality", "structure", "seo", "readability"]


def score_expr(col, iteration: Column) -> Column:
    return F.lit(40) + F.lit(25) * F.coalesce(col("quality"), F.lit(0)) + col("n_chars") % 20 + F.lit(10) * iteration


def doc_completer() -> ExpressionCompleter:
    """Deterministic replies for every stage, computed from carried columns."""

    def quality(col):
        s = score_expr(col, col("iteration"))
        doc = col("topic_id")
        return (
            F.when(doc % 19 == 0, F.lit(None).cast("string"))
            .when(doc % 11 == 0, F.to_json(F.struct(s.cast("string").alias("overall_score"))))
            .when(doc % 13 == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct(s.alias("overall_score"))), F.lit("\n```")))
            .when(doc % 17 == 0, F.lit('{"overall_score": true}'))
            .otherwise(
                F.to_json(
                    F.struct(
                        s.alias("overall_score"),
                        (s >= 80).alias("pass_threshold"),
                        F.create_map(
                            *[
                                x
                                for k, d in enumerate(DIMENSIONS)
                                for x in (
                                    F.lit(d),
                                    F.struct(
                                        ((col("n_chars") + 13 * k) % 101).alias("score"),
                                        F.lit(f"{d} note").alias("notes"),
                                    ),
                                )
                            ]
                        ).alias("dimensions"),
                        F.array_repeat(F.lit("issue"), (col("n_chars") % 3).cast("int")).alias("factual_issues"),
                        F.array(F.lit("clear")).alias("strengths"),
                    )
                )
            )
        )

    return ExpressionCompleter(
        replies={
            "research": lambda col: F.concat(F.lit("Research notes: "), col("topic"), F.lit(". Key statistics and an expert quote follow.")),
            "outline": lambda col: F.concat(F.lit("# "), col("topic"), F.lit("\n## Background\n## Findings\n## Outlook")),
            "writer": lambda col: col("text"),
            "seo": lambda col: F.to_json(F.struct((col("n_chars") % 100).alias("seo_score"))),
            "editor": lambda col: F.concat(col("draft"), F.lit("\n\nRevision "), col("iteration").cast("string")),
            "quality": quality,
            "translator": lambda col: F.concat(F.lit("["), col("target_language"), F.lit("] "), col("article")),
            "publisher": lambda col: F.to_json(
                F.struct(
                    F.struct(col("topic").alias("social_twitter")).alias("formats"),
                    F.struct(col("topic").alias("title")).alias("metadata"),
                )
            ),
        }
    )


def labeled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality label, if any: the quality-loop input.

    No broadcast hint: ``labels`` grows with the corpus; AQE picks broadcast
    at runtime only when the measured side is small.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left")


def _drafts(df: DataFrame, max_iterations: int = 3, threshold: float = 0.8) -> DataFrame:
    return df.select(
        F.lit("loop").alias("run_id"),
        F.col("doc_id").alias("topic_id"),
        doc_title(F.col("text")).alias("topic"),
        F.col("text").alias("draft"),
        F.lit(None).cast("string").alias("seo"),
        F.lit(threshold).alias("quality_threshold"),
        F.lit(max_iterations).alias("max_iterations"),
        "n_chars",
        "quality",
    )


_SQL_LABELED = "(SELECT d.doc_id, d.text, d.n_chars, l.quality FROM documents d LEFT JOIN labels l USING (doc_id))"
_SQL_SCORE = "(40 + 25 * coalesce(quality, 0) + n_chars % 20 + 10 * {i})"


@query(
    "quality_gate",
    f"""SELECT doc_id,
       CASE WHEN doc_id % 19 = 0 OR doc_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN doc_id % 19 = 0 OR doc_id % 11 = 0 THEN NULL
            WHEN doc_id % 13 = 0 THEN 0.0
            WHEN doc_id % 17 = 0 THEN 1.0
            ELSE CAST({_SQL_SCORE.format(i=1)} AS DOUBLE) END AS overall_score,
       CASE WHEN doc_id % 19 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0 THEN false
            ELSE {_SQL_SCORE.format(i=1)} >= 80 END AS passes
FROM {_SQL_LABELED}""",
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 + J4: one quality call per labelled document, scripted reply kinds
    (number, string, code fence, boolean, null content) by doc_id."""
    d = _drafts(labeled_docs(spark, sf_dir)).withColumn("content", F.col("draft"))
    q = I.run_stage(
        d, S.QUALITY, doc_completer(),
        slot_cols={"title": F.col("topic"), "threshold": F.col("quality_threshold"),
                   "threshold_pct": T.threshold_percent("quality_threshold")},
        keep=["n_chars", "quality"],
    )
    return q.select(
        F.col("topic_id").alias("doc_id"),
        "status",
        F.col("metadata.overall_score").alias("overall_score"),
        F.coalesce(F.col("metadata.passes_threshold"), F.lit(False)).alias("passes"),
    )


def _sql_rounds() -> str:
    s = _SQL_SCORE
    return (
        f"CASE WHEN doc_id % 19 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 3 "
        f"WHEN {s.format(i=1)} >= 80 THEN 1 WHEN {s.format(i=2)} >= 80 THEN 2 ELSE 3 END"
    )


def _sql_passed() -> str:
    s = _SQL_SCORE
    return (
        f"(NOT (doc_id % 19 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0) AND {s.format(i=3)} >= 80)"
    )


def _refine(spark: SparkSession, sf_dir: str):
    return W.refine_loop(_drafts(labeled_docs(spark, sf_dir)), doc_completer(), keep=["n_chars", "quality"])


@query(
    "refine_loop",
    f"""SELECT doc_id, CAST({_sql_rounds()} AS INTEGER) AS rounds, {_sql_passed()} AS passed,
       CASE WHEN doc_id % 19 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 0.0
            WHEN doc_id % 17 = 0 THEN 1.0
            ELSE CAST(40 + 25 * coalesce(quality, 0) + n_chars % 20 + 10 * ({_sql_rounds()}) AS DOUBLE) END AS final_score,
       CAST(length(text) + 12 * ({_sql_rounds()}) AS BIGINT) AS article_chars
FROM {_SQL_LABELED}""",
)
def refine_loop_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 + F2: editor -> quality rounds (max 3, threshold 0.8) per labelled doc."""
    _, final = _refine(spark, sf_dir)
    return final.select(
        F.col("topic_id").alias("doc_id"),
        F.col("rounds").cast("int").alias("rounds"),
        "passed",
        "final_score",
        F.length("article").cast("bigint").alias("article_chars"),
    )


@query(
    "last_wins",
    f"""SELECT doc_id, CAST({_sql_rounds()} AS INTEGER) AS editor_iteration,
       CAST({_sql_rounds()} AS INTEGER) AS quality_iteration,
       CAST({_sql_rounds()} AS BIGINT) AS quality_calls,
       CASE WHEN doc_id % 19 = 0 OR doc_id % 11 = 0 THEN 'failed' ELSE 'success' END AS last_quality_status
FROM {_SQL_LABELED}""",
)
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last editor / quality row per document wins (max_by iteration)."""
    rounds, _ = _refine(spark, sf_dir)
    rows = W._union(rounds)
    return rows.groupBy(F.col("topic_id").alias("doc_id")).agg(
        F.max(F.when(F.col("stage") == "editor", F.col("iteration"))).cast("int").alias("editor_iteration"),
        F.max(F.when(F.col("stage") == "quality", F.col("iteration"))).cast("int").alias("quality_iteration"),
        F.count(F.when(F.col("stage") == "quality", 1)).alias("quality_calls"),
        F.max_by(F.when(F.col("stage") == "quality", F.col("status")), F.when(F.col("stage") == "quality", F.col("iteration"))).alias(
            "last_quality_status"
        ),
    )


_DIM_SQL = " UNION ALL ".join(f"SELECT {k} AS k, '{d}' AS dimension" for k, d in enumerate(DIMENSIONS))


@query(
    "dimension_scores",
    f"""WITH q AS (SELECT * FROM {_SQL_LABELED}
               WHERE NOT (doc_id % 19 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0)),
dims AS ({_DIM_SQL})
SELECT dimension, count(*) AS docs,
       CAST(sum((n_chars + 13 * k) % 101) AS DOUBLE) / count(*) AS avg_score,
       CAST(min((n_chars + 13 * k) % 101) AS DOUBLE) AS min_score,
       CAST(max((n_chars + 13 * k) % 101) AS DOUBLE) AS max_score,
       CAST(sum(n_chars % 3) AS BIGINT) AS factual_issues,
       CAST(sum(length(dimension || ' note')) AS BIGINT) AS notes_chars
FROM q, dims
GROUP BY dimension""",
)
def dimension_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explode the quality reply's dimension map; per-dimension score stats."""
    d = _drafts(labeled_docs(spark, sf_dir)).withColumn("content", F.col("draft"))
    q = I.run_stage(
        d, S.QUALITY, doc_completer(),
        slot_cols={"title": F.col("topic"), "threshold": F.col("quality_threshold"),
                   "threshold_pct": T.threshold_percent("quality_threshold")},
        keep=["n_chars", "quality"],
    )
    from quillframe.operators import contracts as C

    flat = C.quality_dimensions(q.where("status = 'success'"))
    return flat.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("docs"),
        (F.sum("score") / F.count(F.lit(1))).cast("double").alias("avg_score"),
        F.min("score").cast("double").alias("min_score"),
        F.max("score").cast("double").alias("max_score"),
        F.sum("factual_issues").cast("bigint").alias("factual_issues"),
        F.sum(F.length("notes")).cast("bigint").alias("notes_chars"),
    )


# ----------------------------------------------------------------- fan-outs


def _doc_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    langs = (
        F.when(F.col("lang") == "en", F.array(F.lit("zh"), F.lit("ms"), F.lit("zh")))
        .when(F.col("lang") == "fr", F.array(F.lit("en")))
        .when(F.col("lang") == "es", F.array(F.lit("ja"), F.lit("ko")))
        .otherwise(F.expr("CAST(array() AS array<string>)"))
    )
    targets = (
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("markdown"), F.lit("html"), F.lit("text")))
        .when(F.col("doc_id") % 3 == 1, F.array(F.lit("html")))
        .otherwise(F.lit(None).cast("array<string>"))
    )
    return d.select(
        F.col("source").alias("run_id"),
        F.col("doc_id").alias("topic_id"),
        doc_title(F.col("text")).alias("topic"),
        "text",
        "n_chars",
        F.lit(None).cast("int").alias("quality"),
        F.col("lang").alias("language"),
        langs.alias("target_languages"),
        (F.col("lang") != "de").alias("enable_translation"),
        targets.alias("publish_targets"),
    )


@query(
    "translation_fanout",
    """WITH d AS (
  SELECT doc_id, text, lang,
         CASE WHEN lang = 'en' THEN ['zh', 'ms'] WHEN lang = 'fr' THEN ['en'] WHEN lang = 'es' THEN ['ja', 'ko']
              ELSE [] END AS langs
  FROM documents WHERE lang <> 'de')
SELECT doc_id, target_language, 'success' AS status,
       CAST(length(text) + length(target_language) + 3 AS BIGINT) AS translated_chars,
       md5('[' || target_language || '] ' || text) AS translated_md5
FROM (SELECT doc_id, text, unnest(langs) AS target_language FROM d)""",
)
def translation_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explode distinct target languages -> translator; languages are distinct
    in the row, so each (article, language) is one row and nothing shuffles."""
    t = _doc_topics(spark, sf_dir).withColumn("article", F.col("text"))
    tr = W.translate(t, doc_completer(), keep=["n_chars"])
    return tr.select(
        F.col("topic_id").alias("doc_id"),
        F.col("variant").alias("target_language"),
        "status",
        F.length("content").cast("bigint").alias("translated_chars"),
        F.md5("content").alias("translated_md5"),
    )


def render_target(target: Column, title: Column, body: Column, lang: Column, source: Column) -> Column:
    """W7 + K3/K4 + U4: render one publishing target through the renderer registry."""
    return R.render_target(target, body, title, {"lang": lang, "source": source})


def _sql_plain(x: str) -> str:
    s = f"regexp_replace({x}, '(?m)^#{{1,6}}[ \\t]+', '', 'g')"
    s = f"regexp_replace({s}, '!\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')"
    s = f"regexp_replace({s}, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')"
    s = f"regexp_replace({s}, '\\*\\*(.+?)\\*\\*', '\\1', 'g')"
    s = f"regexp_replace({s}, '\\*(.+?)\\*', '\\1', 'g')"
    s = f"regexp_replace({s}, '`([^`]*)`', '\\1', 'g')"
    return f"regexp_replace({s}, '(?m)^[ \\t]*[-*+][ \\t]+', '', 'g')"


@query(
    "publish_fanout",
    f"""WITH d AS (
  SELECT doc_id, lang, source,
         trim(regexp_replace(regexp_replace(split_part(text, chr(10), 1), '[^\\pL\\pN ]', '', 'g'), ' +', ' ', 'g')) AS title,
         {SQL_MARKDOWN} AS md,
         CASE WHEN doc_id % 3 = 0 THEN ['markdown', 'html', 'text'] WHEN doc_id % 3 = 1 THEN ['html'] ELSE ['markdown'] END AS targets
  FROM documents),
e AS (SELECT doc_id, lang, source, title, md, unnest(targets) AS target FROM d),
r AS (
  SELECT doc_id, target,
         CASE WHEN target = 'markdown' THEN '---' || chr(10) || 'title: ' || title || chr(10) || 'lang: ' || lang
                   || chr(10) || 'source: ' || source || chr(10) || '---' || chr(10) || md
              WHEN target = 'html' THEN {sql_markdown_to_html('md')}
              ELSE {_sql_plain('md')} END AS rendered
  FROM e)
SELECT doc_id, target, CAST(length(rendered) AS BIGINT) AS rendered_chars, md5(rendered) AS rendered_md5 FROM r""",
)
def publish_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explode each article's publish targets (default markdown) and
    render each (front-matter Markdown, HTML body, plain text)."""
    t = _doc_topics(spark, sf_dir)
    e = t.select(
        F.col("topic_id").alias("doc_id"),
        "topic",
        F.col("language").alias("lang"),
        F.col("run_id").alias("source"),
        doc_markdown(F.col("text")).alias("md"),
        F.explode(F.coalesce(F.col("publish_targets"), F.array(F.lit("markdown")))).alias("target"),
    )
    r = e.select("doc_id", "target", render_target(F.col("target"), F.col("topic"), F.col("md"), F.col("lang"), F.col("source")).alias("rendered"))
    return r.select("doc_id", "target", F.length("rendered").cast("bigint").alias("rendered_chars"), F.md5("rendered").alias("rendered_md5"))


def article_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full eight-stage chain over every document as a topic
    (20 runs = sources), with the refine loop, translation and publishing."""
    run = W.run_pipeline(_doc_topics(spark, sf_dir), doc_completer(), keep=["text", "n_chars", "quality"])
    s = run.summary()
    return s.select(
        "run_id", "topic_id", "status", "total_tokens", "total_calls", "pipeline_duration_s",
        F.array_join("agents_run", ",").alias("agents_run"), "article_length", "word_count",
        F.array_join("translations", ",").alias("translations"),
    )


def _article_summary_sql() -> str:
    """Closed form of :func:`article_summary` under :func:`doc_completer`.

    Every prompt is rendered from the same stage templates (Template.sql), so
    prompt/completion tokens, calls, lengths and translation keys follow
    without running the chain.  With no quality label the round-i score is
    40 + n_chars mod 20 + 10 i < 80 for i < 3, so every article runs three
    editor/quality rounds.
    """
    from quillframe.plans.request_queries import _sql_lit

    def q(s: str) -> str:
        return _sql_lit(s)

    t = "title"
    research = f"('Research notes: ' || {t} || '. Key statistics and an expert quote follow.')"
    outline = f"('# ' || {t} || chr(10) || '## Background' || chr(10) || '## Findings' || chr(10) || '## Outlook')"
    seo = "('{\"seo_score\":' || CAST(n_chars % 100 AS VARCHAR) || '}')"

    def draft(i: int) -> str:  # text before editor round i
        return "(text" + "".join(f" || chr(10) || chr(10) || 'Revision {k}'" for k in range(1, i)) + ")"

    def toks(x: str) -> str:
        return f"((length(coalesce({x}, '')) + 3) // 4)"

    def ptoks(stage, slots) -> str:
        st = S.get_stage(stage)
        return f"((length({q(st.system_prompt)}) + length({st.template.sql(slots)}) + 3) // 4)"

    def score(i: int) -> str:
        return f"(40 + n_chars % 20 + 10 * {i})"

    dims = " || ',' || ".join(
        f"'\"{d}\":{{\"score\":' || CAST((n_chars + {13 * k}) % 101 AS VARCHAR) || ',\"notes\":\"{d} note\"}}'"
        for k, d in enumerate(DIMENSIONS)
    )

    def quality_reply(i: int) -> str:
        s = score(i)
        full = (
            f"'{{\"overall_score\":' || CAST({s} AS VARCHAR) || ',\"pass_threshold\":' || CASE WHEN {s} >= 80 THEN 'true' ELSE 'false' END"
            f" || ',\"dimensions\":{{' || {dims} || '}},\"factual_issues\":[' || "
            "array_to_string(list_transform(range(n_chars % 3), lambda x: '\"issue\"'), ',') || '],\"strengths\":[\"clear\"]}'"
        )
        return (
            f"(CASE WHEN doc_id % 19 = 0 THEN NULL "
            f"WHEN doc_id % 11 = 0 THEN '{{\"overall_score\":\"' || CAST({s} AS VARCHAR) || '\"}}' "
            f"WHEN doc_id % 13 = 0 THEN '```json' || chr(10) || '{{\"overall_score\":' || CAST({s} AS VARCHAR) || '}}' || chr(10) || '```' "
            f"WHEN doc_id % 17 = 0 THEN '{{\"overall_score\": true}}' ELSE {full} END)"
        )

    calls = [
        (ptoks("research", {"topic": t}), toks(research), "true"),
        (ptoks("outline", {"target_words": "'2000'", "research_data": research}), toks(outline), "true"),
        (ptoks("writer", {"language": "lang", "outline": outline, "research_data": research}), toks("text"), "true"),
        (ptoks("seo", {"keywords": "'auto-detect'", "content": "text"}), toks(seo), "true"),
    ]
    for i in (1, 2, 3):
        edited = draft(i + 1)
        calls.append((ptoks("editor", {"target_reading_level": "'general'", "seo_recommendations": seo, "content": draft(i)}), toks(edited), "true"))
        # a reply that the stage can't use was billed all the same
        calls.append((ptoks("quality", {"title": t, "threshold_pct": "'80.0'", "content": edited}), toks(quality_reply(i)), "true"))
    article = draft(4)
    pub = "('{\"formats\":{\"social_twitter\":\"' || title || '\"},\"metadata\":{\"title\":\"' || title || '\"}}')"
    targets = "CASE WHEN doc_id % 3 = 0 THEN 'markdown, html, text' WHEN doc_id % 3 = 1 THEN 'html' ELSE 'markdown' END"
    calls.append((ptoks("publisher", {"targets_text": targets, "title": t, "content": article}), toks(pub), "true"))
    tokens = " + ".join(f"CASE WHEN {ok} THEN {p} + {c} ELSE 0 END" for p, c, ok in calls)
    latency = " + ".join(f"100 + {c}" for _, c, _ in calls)
    tr_tokens = ptoks("translator", {"source_language": "lang", "target_language": "l", "keywords_note": "NULL", "content": article})
    tr_c = toks(f"('[' || l || '] ' || {article})")
    return f"""WITH d AS (
  SELECT doc_id, source, text, lang, n_chars, {SQL_TITLE} AS title,
         CASE WHEN lang = 'en' THEN ['zh', 'ms'] WHEN lang = 'fr' THEN ['en'] WHEN lang = 'es' THEN ['ja', 'ko'] ELSE [] END AS langs
  FROM documents),
b AS (SELECT *, {tokens} AS tok, {latency} AS lat FROM d),
tr AS (SELECT doc_id, sum({tr_tokens} + {tr_c}) AS tok, sum(100 + {tr_c}) AS lat, count(*) AS n
       FROM (SELECT d.*, unnest(langs) AS l FROM d) GROUP BY doc_id),
s AS (SELECT b.*, coalesce(tr.tok, 0) AS ttok, coalesce(tr.lat, 0) AS tlat, coalesce(tr.n, 0) AS tn FROM b LEFT JOIN tr USING (doc_id))
SELECT source AS run_id, doc_id AS topic_id, 'success' AS status,
       CAST(tok + ttok AS BIGINT) AS total_tokens, CAST(11 + tn AS BIGINT) AS total_calls,
       CAST(CASE WHEN 2 * ((lat + tlat) % 10) > 10 OR (2 * ((lat + tlat) % 10) = 10 AND ((lat + tlat) // 10) % 2 = 1)
                 THEN (lat + tlat) // 10 + 1 ELSE (lat + tlat) // 10 END AS DOUBLE) / 100.0 AS pipeline_duration_s,
       'research,outline,writer,seo,editor,quality' || array_to_string(list_transform(langs, lambda x: ',translator_' || x), '')
         || ',publisher' AS agents_run,
       CAST(length({article}) AS BIGINT) AS article_length,
       CAST(len(regexp_extract_all(text, '[^{T.WS}]+')) + 6 AS BIGINT) AS word_count,
       array_to_string(list_sort(langs), ',') AS translations
FROM s"""


query("article_summary", _article_summary_sql())(article_summary)


def _stage_switches_sql() -> str:
    """Closed form of :func:`stage_switches`: no label, so three rounds unless quality is off."""
    names = S.stage_names()
    on = {n: f"k <> {i + 1}" for i, n in enumerate(names)} | {"seo": f"(k <> {names.index('seo') + 1} AND lang <> 'es')"}
    rev = {i: f"chr(10) || chr(10) || 'Revision {i}'" for i in (1, 2, 3)}
    run = {n: f"CASE WHEN {on[n]} THEN ['{n}'] ELSE [] END" for n in names}
    run["translator"] = "list_transform(ls, lambda x: 'translator_' || x)"
    order = run[names[0]]
    for n in names[1:]:
        order = f"list_concat({order}, {run[n]})"
    once = " + ".join(f"CAST({on[n]} AS INTEGER)" for n in names if n not in ("editor", "quality", "translator"))
    return f"""WITH d AS (
  SELECT doc_id, source, text, lang, doc_id % {len(names) + 1} AS k,
         CASE WHEN lang = 'en' THEN ['zh', 'ms'] WHEN lang = 'fr' THEN ['en'] WHEN lang = 'es' THEN ['ja', 'ko'] ELSE [] END AS langs
  FROM documents),
s AS (SELECT *, CASE WHEN {on['writer']} THEN text ELSE '' END AS draft, CASE WHEN {on['quality']} THEN 3 ELSE 1 END AS r,
             CASE WHEN {on['translator']} THEN langs ELSE [] END AS ls FROM d),
a AS (SELECT *, draft || CASE WHEN NOT ({on['editor']}) THEN '' WHEN r = 1 THEN {rev[1]} ELSE {rev[1]} || {rev[2]} || {rev[3]} END AS article FROM s)
SELECT source AS run_id, doc_id AS topic_id, 'success' AS status,
       CAST({once} + CASE WHEN {on['editor']} THEN r ELSE 0 END + CASE WHEN {on['quality']} THEN r ELSE 0 END + len(ls) AS BIGINT) AS total_calls,
       array_to_string({order}, ',') AS agents_run,
       CAST(length(article) AS BIGINT) AS article_length, md5(article) AS article_md5
FROM a"""


@query("stage_switches", _stage_switches_sql())
def stage_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the chain over every document with each stage off by turns, and
    ``seo_enabled`` off for one language: one article per topic all the same."""
    t = _doc_topics(spark, sf_dir)
    names = S.stage_names()
    off = F.get(F.array(F.lit(None).cast("string"), *[F.lit(n) for n in names]), (F.col("topic_id") % (len(names) + 1)).cast("int"))
    t = t.withColumn("disabled_stages", F.array_compact(F.array(off))).withColumn("seo_enabled", F.col("language") != "es")
    run = W.run_pipeline(t, doc_completer(), keep=["text", "n_chars", "quality"])
    return run.articles.select(
        "run_id", "topic_id", "status", "total_calls", F.array_join("agents_run", ",").alias("agents_run"),
        F.length("article").cast("bigint").alias("article_length"), F.md5("article").alias("article_md5"),
    )


# ------------------------------------------------------------------- ledger

#: Stages of the ledger query; the others are off.
LEDGER_STAGES = ("research", "outline", "quality")
#: Prices per million tokens of the ledger query: (model, input, output, cached).  The second model has none.
LEDGER_MODELS = ("model-p", "model-q")
LEDGER_PRICE = (2, 6, 1)


def ledger_completer() -> ExpressionCompleter:
    """The scripted replies, with failing calls and a start time for every call:
    the article's minute, plus a second a stage and ten a round."""
    base = doc_completer()
    errors = {
        "research": lambda col: F.when(col("topic_id") % 23 == 0, F.lit("connection refused")),
        "quality": lambda col: F.when((col("topic_id") % 29 == 0) & (col("iteration") == 1), F.lit("HTTP 503")),
    }
    places = {n: i for i, n in enumerate(S.STAGE_ORDER)}
    place = lambda col: F.get(F.array(*[F.lit(places[n]) for n in S.STAGE_ORDER]), F.array_position(F.array(*[F.lit(n) for n in S.STAGE_ORDER]), col("stage")).cast("int") - 1)
    clock = lambda col: F.timestamp_seconds(F.lit(1704067200) + 60 * col("topic_id") + place(col) + 10 * col("iteration"))
    return ExpressionCompleter(replies=base.replies, errors=errors, clock=clock)


def _sql_text(stage: str, slots: dict[str, str]) -> str:
    from quillframe.plans.request_queries import _sql_lit

    st = S.get_stage(stage)
    return f"(length({_sql_lit(st.system_prompt)}) + length({st.template.sql(slots)}))"


def _sql_quality_reply(i: str, none: str) -> str:
    """The scripted review of round ``i``; ``none`` stands for a reply without content."""
    score = f"(40 + n_chars % 20 + 10 * {i})"
    dims = " || ',' || ".join(f"'\"{d}\":{{\"score\":' || CAST((n_chars + {13 * k}) % 101 AS VARCHAR) || ',\"notes\":\"{d} note\"}}'" for k, d in enumerate(DIMENSIONS))
    return (
        f"(CASE WHEN doc_id % 19 = 0 THEN {none} WHEN doc_id % 11 = 0 THEN '{{\"overall_score\":\"' || CAST({score} AS VARCHAR) || '\"}}' "
        f"WHEN doc_id % 13 = 0 THEN '```json' || chr(10) || '{{\"overall_score\":' || CAST({score} AS VARCHAR) || '}}' || chr(10) || '```' "
        "WHEN doc_id % 17 = 0 THEN '{\"overall_score\": true}' ELSE "
        f"'{{\"overall_score\":' || CAST({score} AS VARCHAR) || ',\"pass_threshold\":' || CASE WHEN {score} >= 80 THEN 'true' ELSE 'false' END"
        f" || ',\"dimensions\":{{' || {dims} || '}},\"factual_issues\":[' || "
        "array_to_string(list_transform(range(n_chars % 3), lambda x: '\"issue\"'), ',') || '],\"strengths\":[\"clear\"]}' END)"
    )


def _ledger_sql() -> str:
    """The tracker's rule over the calls that the chain makes: a call that failed
    counts an error and no tokens, any other its usage, whatever the stage made of it."""
    research = "('Research notes: ' || title || '. Key statistics and an expert quote follow.')"
    outline = "('# ' || title || chr(10) || '## Background' || chr(10) || '## Findings' || chr(10) || '## Outlook')"
    reply = _sql_quality_reply("i", "''")

    def call(stage: str, i: str, slots: dict, said: str, failed: str, source: str) -> str:
        k = S.STAGE_ORDER.index(stage)
        p, c = f"(({_sql_text(stage, slots)} + 3) // 4)", f"((length({said}) + 3) // 4)"
        return (
            f"SELECT source AS run_id, doc_id, '{stage}' AS stage, 60 * doc_id + {k} + 10 * {i} AS begun, "
            f"CASE WHEN {failed} THEN 0 ELSE {p} END AS p, CASE WHEN {failed} THEN 0 ELSE {c} END AS c, "
            f"CASE WHEN {failed} OR {i} = 1 THEN 0 ELSE {p} // 2 END AS k, 100 + {c} AS lat, CAST({failed} AS INTEGER) AS err, "
            f"CASE WHEN '{stage}' = 'quality' THEN '{LEDGER_MODELS[1]}' ELSE '{LEDGER_MODELS[0]}' END AS model FROM {source}"
        )

    # a review that failed has no score: the loop goes on, to three rounds in all as no score reaches 80 before
    calls = "\nUNION ALL\n".join([
        call("research", "1", {"topic": "title"}, research, "doc_id % 23 = 0", "d"),
        call("outline", "1", {"target_words": "'2000'", "research_data": research}, outline, "false", "(SELECT * FROM d WHERE doc_id % 23 <> 0)"),
        call("quality", "i", {"title": "title", "threshold_pct": "'80.0'", "content": "''"}, reply, "(doc_id % 29 = 0 AND i = 1)",
             "(SELECT *, unnest([1, 2, 3]) AS i FROM d WHERE doc_id % 23 <> 0)"),
    ])
    inp, out, cached = LEDGER_PRICE
    return f"""WITH d AS (SELECT doc_id, source, n_chars, {SQL_TITLE} AS title FROM documents),
c AS ({calls}),
r AS (SELECT run_id, (max(begun * 1000000 + lat * 1000) - min(begun * 1000000)) AS us FROM c GROUP BY run_id),
s AS (SELECT run_id, stage, count(*) AS calls, sum(p + c) AS total_tokens, sum(p) AS p, sum(k) AS k, sum(lat) AS lat, sum(err) AS errors, min(begun * 1000000) AS first_at,
             sum(CASE WHEN model = '{LEDGER_MODELS[0]}' THEN (p - k) * {inp} + k * {cached} + c * {out} END) AS micro, count(*) FILTER (WHERE model <> '{LEDGER_MODELS[0]}') AS unpriced
      FROM c GROUP BY run_id, stage),
report AS (
  SELECT run_id, stage, row_number() OVER (PARTITION BY run_id ORDER BY total_tokens DESC, first_at, stage) AS report_rank, calls, total_tokens, errors,
         CAST(lat AS DOUBLE) / calls AS avg_latency_ms, CASE WHEN p = 0 THEN 0.0 ELSE CAST(k AS DOUBLE) / p END AS cache_hit_rate, micro, unpriced FROM s
  UNION ALL
  SELECT run_id, 'TOTAL', NULL, sum(calls), sum(total_tokens), sum(errors), CAST(sum(lat) AS DOUBLE) / sum(calls), CAST(sum(k) AS DOUBLE) / greatest(sum(p), 1), sum(micro), sum(unpriced)
  FROM s GROUP BY run_id)
SELECT run_id, stage, CAST(report_rank AS BIGINT) AS report_rank, CAST(calls AS BIGINT) AS calls, CAST(total_tokens AS BIGINT) AS total_tokens, CAST(errors AS BIGINT) AS errors,
       avg_latency_ms, cache_hit_rate, CAST(micro AS DOUBLE) / 1000000.0 AS cost_usd, CAST(unpriced AS BIGINT) AS unpriced_calls,
       CAST((us + 5000) // 10000 AS DOUBLE) / 100.0 AS duration_s_2dp
FROM report JOIN r USING (run_id)"""


@query("run_ledger", _ledger_sql())
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I5 + A1 + A4 + A6 + A10 on the engine's own calls: the chain runs over
    every document with failing calls and unusable replies, its calls go to a
    ledger twice (a job that was repeated), and the report, the cost and the
    duration of every run are read back from there."""
    from quillframe.operators import ledger, metrics, requests

    off = [n for n in S.STAGE_ORDER if n not in LEDGER_STAGES]
    t = _doc_topics(spark, sf_dir).withColumn("disabled_stages", F.array(*[F.lit(n) for n in off]))
    models = spark.createDataFrame([(0, "quality", True, LEDGER_MODELS[1], None, None, None)], requests.OVERRIDE_SCHEMA)
    path = scratch_path(spark, "ledger")
    run = W.run_pipeline(t, ledger_completer(), requests.LLMSettings(model=LEDGER_MODELS[0]), models, keep=["n_chars", "quality"], metrics_path=path)
    ledger.append(run.calls, path)
    calls = W.cut(ledger.read(spark, path), "ledger-calls")
    prices = spark.createDataFrame([(LEDGER_MODELS[0], *LEDGER_PRICE)], "model string, input_per_m int, output_per_m int, cached_per_m int")
    return metrics.run_statement(calls, prices).select(
        "run_id", "stage", "report_rank", "calls", "total_tokens", "errors", "avg_latency_ms", "cache_hit_rate", "cost_usd", "unpriced_calls", "duration_s_2dp"
    )


@query(
    "round_report",
    f"""WITH d AS (SELECT *, {_sql_rounds()} AS rounds FROM {_SQL_LABELED}),
r AS (SELECT doc_id, CAST(i AS INTEGER) AS round, rounds, doc_id % 19 = 0 OR doc_id % 11 = 0 AS failed,
             CASE WHEN doc_id % 19 = 0 OR doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 0.0 WHEN doc_id % 17 = 0 THEN 1.0
                  ELSE CAST({_SQL_SCORE.format(i='i')} AS DOUBLE) END AS score
      FROM (SELECT *, unnest(range(1, CAST(rounds AS BIGINT) + 1)) AS i FROM d))
SELECT doc_id, round, CASE WHEN failed THEN 'failed' ELSE 'success' END AS status, score,
       coalesce(score >= 80, false) AS passed, score - lag(score) OVER w AS gain,
       CASE WHEN score IS NULL THEN NULL WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 1 ELSE round END AS best_round, score AS best_score,
       CASE WHEN score IS NULL THEN NULL ELSE rounds = 1 OR NOT (doc_id % 13 = 0 OR doc_id % 17 = 0) END AS last_is_best
FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY round)""",
)
def round_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, gain and best round of every review round of every document."""
    rounds, _ = _refine(spark, sf_dir)
    r = W.round_report(W._union(rounds))
    return r.select(F.col("topic_id").alias("doc_id"), "round", "status", "score", "passed", "gain", "best_round", "best_score", "last_is_best")


#: Stages of the intake query; the others are off.
INTAKE_STAGES = ("research", "outline", "writer")


@query(
    "topic_intake",
    """SELECT doc_id AS topic_id, 'intake-' || CAST(doc_id % 2 AS VARCHAR) AS run_id, 'success' AS status, 'research,outline,writer' AS agents_run,
       CAST(length(text) AS BIGINT) AS article_chars, md5(text) AS article_md5 FROM documents""",
)
def topic_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic files that come one after the other drive the chain, a run a
    micro-batch; the first file comes once more at the end and changes nothing."""
    from quillframe.sources.tables import read_topics
    from quillframe.streaming.intake import run_intake

    off = [n for n in S.STAGE_ORDER if n not in INTAKE_STAGES]
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = d.select(F.col("doc_id").alias("topic_id"), doc_title(F.col("text")).alias("topic"), "text", F.array(*[F.lit(n) for n in off]).alias("disabled_stages"))
    src = scratch_path(spark, "intake-topics")
    files = spark.sparkContext.defaultParallelism
    for part in (0, 1, 0):
        t.where(F.pmod("topic_id", F.lit(2)) == part).repartition(files, F.rand(1)).write.mode("append").option("compression", "gzip").json(src)
    schema = "topic_id bigint, topic string, text string, disabled_stages array<string>"
    topics = read_topics(spark, src, "json", stream=True, files_per_batch=files, schema=schema)
    done = run_intake(topics, scratch_path(spark, "intake"), doc_completer(), keep=["text"])
    return done.select(
        "topic_id", "run_id", "status", F.array_join("agents_run", ",").alias("agents_run"), F.length("article").cast("bigint").alias("article_chars"), F.md5("article").alias("article_md5")
    )


# ------------------------------------------------------------ full results

#: Metadata fields of the results query, with their SQL types.
_META = {
    "topic": "VARCHAR", "has_statistics": "BOOLEAN", "has_quotes": "BOOLEAN", "output_length": "BIGINT", "target_words": "BIGINT", "word_count": "BIGINT",
    "language": "VARCHAR", "content_length": "BIGINT", "input_length": "BIGINT", "reading_level": "VARCHAR", "overall_score": "DOUBLE", "threshold": "DOUBLE",
    "passes_threshold": "BOOLEAN", "source_language": "VARCHAR", "target_language": "VARCHAR",
}


def _results_sql() -> str:
    """Every stage's result row of every article, one review round, with failing research, outlines and reviews."""
    research = "('Research notes: ' || title || '. Key statistics and an expert quote follow.')"
    outline = "('# ' || title || chr(10) || '## Background' || chr(10) || '## Findings' || chr(10) || '## Outlook')"
    seo = "('{\"seo_score\":' || CAST(n_chars % 100 AS VARCHAR) || '}')"
    edited = "(text || chr(10) || chr(10) || 'Revision 1')"
    review = _sql_quality_reply("1", "NULL")
    pub = "('{\"formats\":{\"social_twitter\":\"' || title || '\"},\"metadata\":{\"title\":\"' || title || '\"}}')"
    targets = "CASE WHEN doc_id % 3 = 0 THEN 'markdown, html, text' WHEN doc_id % 3 = 1 THEN 'html' ELSE 'markdown' END"
    words = f"CAST(len(regexp_extract_all(text, '[^{T.WS}]+')) AS BIGINT)"
    tr = f"('[' || l || '] ' || {edited})"
    ok_r, ok_o = "doc_id % 23 <> 0", "doc_id % 23 <> 0 AND doc_id % 29 <> 0"

    def row(stage: str, content: str, slots: dict, failed: str, error: str, meta: dict[str, str], source: str, key: str | None = None, iteration: str = "1") -> str:
        tokens = f"(({_sql_text(stage, slots)} + 3) // 4 + (length({content}) + 3) // 4)"
        fields = ", ".join(f"CASE WHEN NOT ({failed}) THEN CAST({meta.get(c, 'NULL')} AS {t}) END AS m_{c}" for c, t in _META.items())
        return (
            f"SELECT doc_id AS topic_id, {key or repr(stage)} AS agent, CASE WHEN {failed} THEN 'failed' ELSE 'success' END AS status, CASE WHEN {failed} THEN {error} END AS error, "
            f"CAST({iteration} AS INTEGER) AS iteration, CASE WHEN {failed} THEN '' ELSE {content} END AS content, CAST(CASE WHEN {failed} THEN 0 ELSE {tokens} END AS BIGINT) AS tokens_used, {fields} FROM {source}"
        )

    no = "false"
    rows = "\nUNION ALL\n".join([
        row("research", research, {"topic": "title"}, "doc_id % 23 = 0", "'connection refused'", {"topic": "title", "has_statistics": "true", "has_quotes": "true", "output_length": f"length({research})"}, "d"),
        row("outline", outline, {"target_words": "'2000'", "research_data": research}, "doc_id % 29 = 0", "'HTTP 500'", {"target_words": "2000", "output_length": f"length({outline})"}, f"(SELECT * FROM d WHERE {ok_r})"),
        row("writer", "text", {"language": "lang", "outline": outline, "research_data": research}, no, "NULL", {"language": "lang", "word_count": words, "output_length": "length(text)"}, "ok"),
        row("seo", seo, {"keywords": "'auto-detect'", "content": "text"}, no, "NULL", {"content_length": "length(text)"}, "ok"),
        row("editor", edited, {"target_reading_level": "'general'", "seo_recommendations": seo, "content": "text"}, no, "NULL", {"input_length": "length(text)", "output_length": f"length({edited})", "reading_level": "'general'"}, "ok"),
        row("quality", review, {"title": "title", "threshold_pct": "'80.0'", "content": edited}, "(doc_id % 19 = 0 OR doc_id % 11 = 0)",
            "CASE WHEN doc_id % 19 = 0 THEN 'reply has no content' ELSE 'overall_score is not a number' END",
            {"threshold": "0.8", "content_length": f"length({edited})", "overall_score": "CASE WHEN doc_id % 13 = 0 THEN 0 WHEN doc_id % 17 = 0 THEN 1 ELSE 50 + n_chars % 20 END", "passes_threshold": "false"}, "ok"),
        row("translator", tr, {"source_language": "lang", "target_language": "l", "keywords_note": "NULL", "content": edited}, no, "NULL",
            {"source_language": "lang", "target_language": "l", "input_length": f"length({edited})", "output_length": f"length({tr})"},
            "(SELECT *, unnest(langs) AS l, generate_subscripts(langs, 1) AS place FROM ok)", "'translator_' || l", "place"),
        row("publisher", pub, {"targets_text": targets, "title": "title", "content": edited}, no, "NULL", {"content_length": f"length({edited})"}, "ok"),
    ])
    meta = ", ".join(f"m_{c}" for c in _META)
    return f"""WITH d AS (SELECT doc_id, text, lang, n_chars, {SQL_TITLE} AS title,
         CASE WHEN lang = 'en' THEN ['zh', 'ms'] WHEN lang = 'fr' THEN ['en'] WHEN lang = 'es' THEN ['ja', 'ko'] ELSE [] END AS langs FROM documents),
ok AS (SELECT * FROM d WHERE {ok_o}),
r AS ({rows})
SELECT topic_id, agent, status, error, iteration, CAST(length(content) AS BIGINT) AS content_chars, md5(content) AS content_md5, tokens_used, {meta},
       CASE WHEN topic_id % 23 = 0 OR topic_id % 29 = 0 THEN 'failed' ELSE 'success' END AS article_status
FROM r"""


@query("stage_results", _results_sql())
def stage_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage's full result in every article (status, error, content,
    tokens, metadata), where some research and outlines fail and end their article, and
    some reviews can't be used and don't."""
    errors = {
        "research": lambda col: F.when(col("topic_id") % 23 == 0, F.lit("connection refused")),
        "outline": lambda col: F.when(col("topic_id") % 29 == 0, F.lit("HTTP 500")),
    }
    c = ExpressionCompleter(replies=doc_completer().replies, errors=errors)
    t = _doc_topics(spark, sf_dir).withColumn("max_iterations", F.lit(1))
    run = W.run_pipeline(t, c, keep=["text", "n_chars", "quality"])
    r = run.articles.select("topic_id", F.col("status").alias("article_status"), F.explode("agent_results").alias("agent", "r"))
    return r.select(
        "topic_id", "agent", "r.status", "r.error", "r.iteration", F.length("r.content").cast("bigint").alias("content_chars"), F.md5("r.content").alias("content_md5"),
        "r.tokens_used", *[F.col(f"r.metadata.{c}").alias(f"m_{c}") for c in _META], "article_status",
    )


@query(
    "batch_completion",
    f"""WITH p AS (SELECT doc_id, {S.get_stage("research").template.sql({"topic": SQL_TITLE + " || ' ' || CAST(doc_id AS VARCHAR)"})} AS prompt FROM documents),
k AS (SELECT *, length(prompt) % 5 AS kind FROM p)
SELECT doc_id, CASE WHEN kind < 3 THEN 'success' ELSE 'failed' END AS status, CASE kind WHEN 3 THEN 'HTTP 400: no' WHEN 4 THEN 'HTTP 503: busy' END AS error,
       CASE WHEN kind < 3 THEN right(prompt, 20) ELSE '' END AS content, CAST(CASE kind WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 4 THEN 2 ELSE 0 END AS INTEGER) AS retries,
       CAST(CASE WHEN kind < 3 THEN length(prompt) + 20 ELSE 0 END AS BIGINT) AS tokens_used, kind >= 3 AS call_failed
FROM k""",
)
def batch_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a document through the HTTP completer (pools, retries, journal),
    over a transport that answers at once, late, never, or refuses."""
    from quillframe.operators.http_completion import HttpCompleter
    from quillframe.plans.simulated import ScriptedEndpoint, no_wait

    d = table(spark, sf_dir, "documents").select(F.lit("r").alias("run_id"), F.col("doc_id").alias("topic_id"), F.concat(doc_title(F.col("text")), F.lit(" "), F.col("doc_id").cast("string")).alias("topic"))
    c = HttpCompleter("http://endpoint.invalid/v1", transport=ScriptedEndpoint(), sleep=no_wait, yield_rows=256)
    r = I.run_stage(d, S.RESEARCH, c)
    return r.select(F.col("topic_id").alias("doc_id"), "status", "error", "content", "retries", "tokens_used", "call_failed")


@query(
    "chosen_stages",
    f"""WITH d AS (SELECT doc_id, n_chars, quality, {SQL_TITLE} AS title FROM {_SQL_LABELED})
SELECT doc_id, CASE WHEN doc_id % 19 = 0 OR doc_id % 11 = 0 THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN doc_id % 19 = 0 OR doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 0.0 WHEN doc_id % 17 = 0 THEN 1.0 ELSE CAST({_SQL_SCORE.format(i=1)} AS DOUBLE) END AS score,
       CAST(length('Research notes: ' || title || '. Key statistics and an expert quote follow.') AS BIGINT) AS reviewed_chars
FROM d""",
)
def chosen_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of the user's own choice, research straight to quality."""
    c = doc_completer()
    d = _drafts(labeled_docs(spark, sf_dir)).select("run_id", "topic_id", "topic", "n_chars", "quality", "quality_threshold")
    notes = I.run_stage(d, S.RESEARCH, c, keep=["topic", "n_chars", "quality", "quality_threshold"])
    notes = notes.withColumn("notes", F.col("content"))
    q = I.run_stage(
        notes, S.QUALITY, c, keep=["n_chars", "quality", "notes"],
        slot_cols={"content": F.col("notes"), "title": F.col("topic"), "threshold": F.col("quality_threshold"), "threshold_pct": T.threshold_percent("quality_threshold")},
    )
    return q.select(F.col("topic_id").alias("doc_id"), "status", F.col("metadata.overall_score").alias("score"), F.length("notes").cast("bigint").alias("reviewed_chars"))
