"""Stage definitions (G1-G8) and the stage registry.

A stage is data, not a class hierarchy: a system prompt, a user-prompt
template with named slots, an optional per-call ``max_tokens`` and a metadata
projection.  Templates render to a Spark ``concat`` (executors, codegen) and,
for the oracle, to SQL text from the same definition.  The wording of the
prompts is our own; the slots follow the stage contracts.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions import text as T

# ------------------------------------------------------------------ templates


@dataclass(frozen=True)
class Slot:
    name: str


@dataclass(frozen=True)
class Opt:
    """``prefix + value + suffix`` only when the slot value is non-empty."""

    name: str
    prefix: str = ""
    suffix: str = ""


Part = str | Slot | Opt


@dataclass(frozen=True)
class Template:
    parts: tuple[Part, ...]

    @property
    def slots(self) -> tuple[str, ...]:
        return tuple(p.name for p in self.parts if not isinstance(p, str))

    def column(self, slots: Mapping[str, Column]) -> Column:
        out: list[Column] = []
        for p in self.parts:
            if isinstance(p, str):
                out.append(F.lit(p))
            elif isinstance(p, Slot):
                out.append(F.coalesce(slots[p.name].cast("string"), F.lit("")))
            else:
                v = slots[p.name].cast("string")
                out.append(
                    F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(p.prefix), v, F.lit(p.suffix))).otherwise(
                        F.lit("")
                    )
                )
        return F.concat(*out)

    def sql(self, slots: Mapping[str, str]) -> str:
        def q(s: str) -> str:
            return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

        out: list[str] = []
        for p in self.parts:
            if isinstance(p, str):
                out.append(q(p))
            elif isinstance(p, Slot):
                out.append(f"coalesce(CAST({slots[p.name]} AS VARCHAR), '')")
            else:
                v = f"CAST({slots[p.name]} AS VARCHAR)"
                out.append(f"(CASE WHEN coalesce({v}, '') <> '' THEN {q(p.prefix)} || {v} || {q(p.suffix)} ELSE '' END)")
        return "(" + " || ".join(out) + ")"


# --------------------------------------------------------------------- stages

# One metadata struct type for every stage (fields a stage does not set are null).
METADATA_TYPE = (
    "struct<topic:string,has_statistics:boolean,has_quotes:boolean,output_length:bigint,"
    "target_words:bigint,word_count:bigint,language:string,target_keywords:array<string>,"
    "content_length:bigint,input_length:bigint,reading_level:string,overall_score:double,"
    "threshold:double,passes_threshold:boolean,source_language:string,target_language:string,"
    "publish_targets:array<string>,output_files:array<string>>"
)

InputMetaFn = Callable[[Mapping[str, Column]], dict[str, Column]]
OutputMetaFn = Callable[[Column], dict[str, Column]]


@dataclass(frozen=True)
class Stage:
    """A pipeline stage.

    ``defaults`` fill missing/null slot inputs; ``call_max_tokens`` is the
    per-call max_tokens the stage passes (it wins over a stage override);
    ``keeps_reasoning`` False drops the model's reasoning from the result.
    Metadata is split in what is known from the inputs (computed when the
    request is built, so big input texts need not travel with the request)
    and what is derived from the reply content.
    """

    name: str
    description: str
    system_prompt: str
    template: Template
    defaults: Mapping[str, object] = field(default_factory=dict)
    call_max_tokens: int | None = None
    keeps_reasoning: bool = True
    input_meta: InputMetaFn | None = None
    output_meta: OutputMetaFn | None = None

    def slot_columns(self, inputs: Mapping[str, Column]) -> dict[str, Column]:
        out = {}
        for name in self.template.slots + tuple(self.defaults):
            if name in out:
                continue
            col = inputs.get(name)
            default = self.defaults.get(name)
            if col is None:
                col = F.lit(default)
            elif default is not None:
                col = F.coalesce(col, F.lit(default))
            out[name] = col
        for name, col in inputs.items():
            out.setdefault(name, col)
        return out

    def user_prompt(self, inputs: Mapping[str, Column]) -> Column:
        return self.template.column(self.slot_columns(inputs))

    def input_metadata(self, inputs: Mapping[str, Column]) -> Column:
        """The metadata struct with the input-derived fields set."""
        fields = self.input_meta(self.slot_columns(inputs)) if self.input_meta else {}
        return _meta_struct(fields)

    def finish_metadata(self, meta_in: Column, content: Column) -> Column:
        """Add the reply-derived fields to a metadata struct."""
        out = meta_in
        for k, v in (self.output_meta(content) if self.output_meta else {}).items():
            out = out.withField(k, v)
        return out


def _meta_struct(fields: Mapping[str, Column]) -> Column:
    from pyspark.sql.types import StructType, _parse_datatype_string

    t: StructType = _parse_datatype_string(METADATA_TYPE)  # type: ignore[assignment]
    cols = []
    for f in t.fields:
        v = fields.get(f.name)
        cols.append((v if v is not None else F.lit(None)).cast(f.dataType).alias(f.name))
    return F.struct(*cols)


def _len(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit(""))).cast("bigint")


def _research_in(s):
    return {"topic": s["topic"]}


def _research_out(content):
    f = T.content_flags(F.coalesce(content, F.lit("")))
    return {"has_statistics": f["has_statistics"], "has_quotes": f["has_quotes"], "output_length": _len(content)}


def _outline_in(s):
    return {"target_words": s["target_words"].cast("bigint")}


def _length_out(content):
    return {"output_length": _len(content)}


def _writer_in(s):
    return {"language": s["language"]}


def _writer_out(content):
    return {"word_count": T.ws_word_count(F.coalesce(content, F.lit(""))), "output_length": _len(content)}


def _seo_in(s):
    kw = s.get("target_keywords")
    kw = kw if kw is not None else F.lit(None).cast("array<string>")
    return {
        "target_keywords": F.coalesce(kw, F.expr("CAST(array() AS array<string>)")),
        "content_length": _len(s["content"]),
    }


def _editor_in(s):
    return {"input_length": _len(s["content"]), "reading_level": s["target_reading_level"]}


def _quality_in(s):
    # overall_score / passes_threshold come from the score parser
    return {"threshold": s["threshold"].cast("double"), "content_length": _len(s["content"])}


def _translator_in(s):
    return {
        "source_language": s["source_language"],
        "target_language": s["target_language"],
        "input_length": _len(s["content"]),
    }


def _publisher_in(s):
    t = s.get("publish_targets")
    t = t if t is not None else F.lit(None).cast("array<string>")
    return {"publish_targets": F.coalesce(t, F.array(F.lit("markdown"))), "content_length": _len(s["content"])}


RESEARCH = Stage(
    name="research",
    description="Collects facts, figures, quotes and angles for a topic",
    system_prompt=(
        "You gather material for an article. Reply with JSON only: topic, key_subtopics "
        "(title, key_facts, statistics, expert_quotes), trending_angles, controversial_claims, "
        "suggested_sources, unique_angle."
    ),
    template=Template(
        (
            "Collect research material for an article.\n\nTopic: ",
            Slot("topic"),
            "\n\nCover the main subtopics with facts and figures, expert views, current angles "
            "and claims that need checking. Reply with JSON.",
        )
    ),
    input_meta=_research_in,
    output_meta=_research_out,
)

OUTLINE = Stage(
    name="outline",
    description="Turns research into a sectioned outline with word budgets",
    system_prompt=(
        "You plan article structure. Reply with JSON only: title, meta_description, target_word_count, "
        "sections (heading, subheadings, word_allocation, key_points, seo_keywords, transition_note), "
        "estimated_reading_time, content_type."
    ),
    template=Template(
        (
            "Plan an article of about ",
            Slot("target_words"),
            " words from this research.\n\nRESEARCH:\n",
            Slot("research_data"),
            "\n\nGive every section a word budget. Reply with JSON.",
        )
    ),
    defaults={"target_words": 2000},
    input_meta=_outline_in,
    output_meta=_length_out,
)

WRITER = Stage(
    name="writer",
    description="Writes the full draft in Markdown from outline and research",
    system_prompt="You write complete articles in Markdown, following the outline's sections and budgets.",
    template=Template(
        (
            "Write the complete article in language '",
            Slot("language"),
            "'.\n\nOUTLINE:\n",
            Slot("outline"),
            "\n\nRESEARCH:\n",
            Slot("research_data"),
            "\n\nUse the outline headings and reply with Markdown only.",
        )
    ),
    defaults={"language": "en"},
    call_max_tokens=8192,
    input_meta=_writer_in,
    output_meta=_writer_out,
)

SEO = Stage(
    name="seo",
    description="Reviews a draft for search optimisation",
    system_prompt=(
        "You review drafts for search optimisation. Reply with JSON only: seo_score, keyword_analysis "
        "(primary_keyword, secondary_keywords, keyword_density, recommendations), title_optimization, "
        "meta_description, heading_structure, featured_snippet_candidates, internal_link_suggestions, "
        "image_alt_suggestions, overall_recommendations."
    ),
    template=Template(
        (
            "Review this draft for search optimisation.\n\nTarget keywords: ",
            Slot("keywords"),
            "\n\nDRAFT:\n",
            Slot("content"),
            "\n\nReply with JSON.",
        )
    ),
    input_meta=_seo_in,
)

EDITOR = Stage(
    name="editor",
    description="Revises the draft, folding in the SEO review",
    system_prompt="You edit articles for clarity, flow and correctness and return the whole revised text.",
    template=Template(
        (
            "Revise this article.\n\nReading level: ",
            Slot("target_reading_level"),
            "\n\n",
            Opt("seo_recommendations", "SEO REVIEW TO APPLY:\n", "\n"),
            "\nARTICLE:\n",
            Slot("content"),
            "\n\nReturn the full revised article in Markdown followed by a short change note.",
        )
    ),
    defaults={"target_reading_level": "general"},
    call_max_tokens=8192,
    input_meta=_editor_in,
    output_meta=_length_out,
)

QUALITY = Stage(
    name="quality",
    description="Scores the article and lists issues",
    system_prompt=(
        "You score articles from 0 to 100. Reply with JSON only: overall_score, pass_threshold, "
        "dimensions (accuracy, completeness, clarity, engagement, originality, structure, seo, "
        "readability; each score and notes), factual_issues, logical_inconsistencies, bias_flags, "
        "improvement_suggestions, strengths."
    ),
    template=Template(
        (
            "Score this article.\n\nTitle: ",
            Slot("title"),
            "\nPass mark: ",
            Slot("threshold_pct"),
            "%\n\nARTICLE:\n",
            Slot("content"),
            "\n\nReply with JSON.",
        )
    ),
    defaults={"threshold": 0.8},
    input_meta=_quality_in,
)

TRANSLATOR = Stage(
    name="translator",
    description="Translates the final article, keeping Markdown structure",
    system_prompt="You translate Markdown articles, keeping structure, names and formatting intact.",
    template=Template(
        (
            "Translate this article from ",
            Slot("source_language"),
            " into ",
            Slot("target_language"),
            ".\nKeep every heading, list and link; keep brand names.",
            Opt("keywords_note", "\nLeave these keywords untranslated: ", ""),
            "\n\nARTICLE:\n",
            Slot("content"),
            "\n\nReply with the translated Markdown only.",
        )
    ),
    defaults={"target_language": "zh", "source_language": "en"},
    call_max_tokens=8192,
    keeps_reasoning=False,
    input_meta=_translator_in,
    output_meta=_length_out,
)

PUBLISHER = Stage(
    name="publisher",
    description="Formats the article for publishing targets and writes files",
    system_prompt=(
        "You prepare articles for publishing. Reply with JSON only: formats (markdown, html_snippet, "
        "social_twitter, social_linkedin, newsletter_subject, newsletter_preview) and metadata "
        "(title, description, tags, category, reading_time, word_count)."
    ),
    template=Template(
        (
            "Prepare this article for: ",
            Slot("targets_text"),
            "\n\nTitle: ",
            Slot("title"),
            "\n\nARTICLE:\n",
            Slot("content"),
            "\n\nInclude a post of at most 280 characters, a professional post, a newsletter subject "
            "and preview, and full metadata. Reply with JSON.",
        )
    ),
    keeps_reasoning=False,
    input_meta=_publisher_in,
)

# The stage order of the pipeline.
STAGE_ORDER = ("research", "outline", "writer", "seo", "editor", "quality", "translator", "publisher")

_REGISTRY: dict[str, Stage] = {
    s.name: s for s in (RESEARCH, OUTLINE, WRITER, SEO, EDITOR, QUALITY, TRANSLATOR, PUBLISHER)
}


def register(stage: Stage) -> Stage:
    """Add (or replace) a stage under its name."""
    _REGISTRY[stage.name] = stage
    return stage


def get_stage(name: str) -> Stage:
    """B2: look a stage up; unknown names fail listing the known ones."""
    try:
        return _REGISTRY[name]
    except KeyError:
        raise ValueError(f"unknown stage {name!r}; known: {sorted(_REGISTRY)}") from None


def stage_names() -> list[str]:
    return list(_REGISTRY)


def stage_order_index(name: Column) -> Column:
    """Position of a stage in the pipeline order (translator_xx counts as translator)."""
    base = F.regexp_replace(name, "_.*$", "")
    idx = F.array_position(F.array(*[F.lit(s) for s in STAGE_ORDER]), base)
    return F.when(idx == 0, F.lit(len(STAGE_ORDER) + 1)).otherwise(idx)
