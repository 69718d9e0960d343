"""Quality rules: a threshold table compiled into one projection of built-in functions.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: no words).  Every
measure is row-local, so the operator is a map over the scan: no shuffle, and
a hot source or long text only costs its own length (n log n for the repeated
windows, and only in texts that have any).  Windows are compared by 64-bit
hashes of their five words within one text.

A rule that knows certain languages only (stop words) is asked of rows whose
language column names one of them; rows of other or unknown languages are
undecided there and fail no such rule.  Without a language column every row is
of unknown language.

Empty texts and nulls have no words and fail the base rule.  Rows are judged
one by one: repeated rows, ties and null ids get the same verdict each time.
Input columns pass through ``judged``; the measures go into one struct column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import SPACE, let

#: Frequent words of the languages served (en, de, fr, es), lower case.  Fixed values.
STOP_WORDS = (
    "the of and to in is that was for with as on be it by this are at from or "
    "und der die das ist nicht ein eine mit von zu den im auf sich "
    "le la les de des et est un une que dans en pour pas du au "
    "el los las y es por con para se del no al lo"
).split()

#: Languages that ``STOP_WORDS`` serve, as primary subtags.
SERVED = ("en", "de", "fr", "es")

#: The threshold table: rule, measured column, per this column, least and most percent,
#: smallest n_words at which the rule applies, languages that it is asked of (None: all).
RULES = (
    ("word_length", "word_chars", "n_words", 300, 1000, 1, None),
    ("symbols", "n_symbols", "n_words", None, 10, 1, None),
    ("stop_words", "n_stop_words", "n_words", 4, None, 50, SERVED),
    ("duplicate_lines", "n_dup_lines", "n_lines", None, 40, 1, None),
)

WINDOW = 5


def _word_chars(text: Column) -> Column:
    return F.length(F.translate(text, "\x20\x09\x0a\x0b\x0c\x0d", "")).cast("long")


def _repeat_words(words: Column) -> Column:
    """Words covered by five-word windows that occur at least twice in the text."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def twice(ordered: Column) -> Column:
        def start(x: Column, i: Column) -> Column:
            same = F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))
            return F.when(same, x["i"])

        return let(F.sort_array(F.filter(F.transform(ordered, start), lambda p: p.isNotNull())), covered)

    def counted(windows: Column) -> Column:
        rows = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(rows, twice))

    def windows_of(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)])
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(windows_of(h), counted)))


def _failed_rule(rule: tuple) -> Column:
    name, part, whole, least, most, from_words, languages = rule
    bad = F.lit(False)
    if least is not None:
        bad = bad | (100 * F.col(part) < least * F.col(whole))
    if most is not None:
        bad = bad | (100 * F.col(part) > most * F.col(whole))
    if languages is not None:
        bad = bad & F.coalesce(F.col("language").isin(*languages), F.lit(False))
    return F.when(bad & (F.col("n_words") >= from_words), F.lit(name))


def measured(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: the input in struct ``row``, the language's primary subtag and the measures beside it."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    tag = F.col(f"`{lang}`").cast("string") if lang in docs.columns else F.lit(None).cast("string")
    language = F.substring_index(F.translate(F.lower(F.trim(tag)), "_", "-"), "-", 1)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("_text"), language.alias("language"))
    split = base.withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split("_text", "\n", -1), lambda x: _word_chars(x) > 0)
    )
    stops = F.filter("_words", lambda w: F.translate(F.lower(w), ".,", "").isin(*STOP_WORDS))
    return split.select(
        "row",
        "language",
        F.size("_words").cast("long").alias("n_words"),
        _word_chars(F.col("_text")).alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(stops).cast("long").alias("n_stop_words"),
        _repeat_words(F.col("_words")).alias("n_repeat_words"),
    )


def judged(docs: DataFrame, text: str = "text", rules: tuple = RULES, lang: str = "lang") -> DataFrame:
    """``measured`` plus ``base_failed``, ``failed_rules`` (names) and ``kept``."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    failed = F.filter(F.array(*[_failed_rule(r) for r in rules]), lambda n: n.isNotNull())
    return (
        measured(docs, text, lang)
        .withColumn("base_failed", base)
        .withColumn("failed_rules", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
    )


def kept_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input rows, in the input's columns, that the rules keep."""
    return judged(docs, text).where("kept").select("row.*")


QUERY_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def op8_quality_rules(docs: DataFrame) -> DataFrame:
    return judged(docs).select(F.col("row.doc_id").alias("doc_id"), *QUERY_COLUMNS[:-1], F.array_join("failed_rules", ",").alias("failed_rules"))


def quality_sql(source: str = "documents") -> str:
    """The same measures and verdicts in DuckDB (exact windows instead of hashes)."""
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    failed = []
    for name, part, whole, least, most, n, languages in RULES:
        tests = ([f"100 * {part} < {least} * {whole}"] if least is not None else []) + ([f"100 * {part} > {most} * {whole}"] if most is not None else [])
        spoken = f" AND language IN ({', '.join(repr(x) for x in languages)})" if languages else ""
        failed.append(f"CASE WHEN n_words >= {n} AND ({' OR '.join(tests)}){spoken} THEN '{name}' END")
    return f"""
    WITH base AS (SELECT *, coalesce("text", '') AS t, split_part(translate(lower(trim(lang)), '_', '-'), '-', 1) AS language, row_number() OVER () AS rid FROM {source}),
    w AS (SELECT *, {words} AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM base),
    win AS (SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
    dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS c FROM win) WHERE c > 1),
    rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM dup) GROUP BY rid),
    m AS (SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(len(list_filter(ws, lambda x: translate(lower(x), '.,', '') IN ({stop}))) AS BIGINT) AS n_stop_words,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
        FROM w LEFT JOIN rep USING (rid)),
    j AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        array_to_string(list_filter([{', '.join(failed)}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m)
    SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM j"""


OP8_SQL = f"SELECT doc_id, {', '.join(QUERY_COLUMNS)} FROM ({quality_sql()})"
