"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and phone
numbers found in the whole texts.  Terms (lower-cased letter runs of three or
more) of the texts that hold an entity may give it away.  How much a term tells
is its pointwise mutual information with the entity,
``log2(n_et * N / (n_e * (n_t + SMOOTH)))``: n_et texts with both, n_e texts with
the entity, n_t texts with the term, N texts, all counted over whole texts and
the whole corpus.  ``SMOOTH`` stands for texts not seen that hold the term
without the entity: a lower estimate, so that a pair of a single text is judged
too, with less than full weight.  Without it PMI reaches the entity's own
information content ``log2(N / n_e)`` when the term occurs nowhere else, so the
disclosure ratio PMI / IC is compared with two thresholds: terms from
``GENERALISE`` on are replaced by a category, from ``REMOVE`` on removed, wherever
they stand in the texts that hold the entity.  An entity that is in every text
has no information content: nothing can disclose it, and it gets no estimate.

Only DataFrame functions are used.  Texts with no entity are a map over the
scan.  Equal texts are counted as often as they occur but meet terms once, by
their SHA-256; entities of exactly the same texts have the same estimates and
are one class, named by their count and two XORs of the texts' hashes.  Terms
too common to disclose anything are left out before they meet the classes of
their text, by the bound that n_et can't pass n_e nor the term's count in texts
with entities.  Counts are map-side combined, so a term or entity in a third of
all texts is no hot group.

Null and empty texts have no spans.  Rows are counted one by one, also
repeated ones; rows need no id, and rows with a null id are judged like
others.  Extra columns pass through ``detected``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import SPAN, count_kind, fresh, replaced, sized, spans, spans_sql, spans_text, spans_text_sql, written

KINDS = ("email", "ip", "card", "phone", "general", "removed")
GENERAL, REMOVED = 4, 5

SMOOTH = 0.5
GENERALISE = 0.85
REMOVE = 0.95

_LOCAL = "[A-Za-z0-9._%+-]"
#: Possessive and anchored forms of the contract's patterns: the same matches in time linear in the text.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
IP_KEEP = rf"^{_PART}(?:\.{_PART}){{3}}$"
TERM = r"\p{L}+"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    empty = F.array().cast(SPAN)
    digit = text.rlike("[0-9]")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), spans(text, EMAIL, 0)).otherwise(empty),
        F.when(digit, spans(text, IP, 1, lambda m: m.rlike(IP_KEEP))).otherwise(empty),
        F.when(digit, spans(text, CARD, 2, _card)).otherwise(empty),
        F.when(F.contains(text, F.lit("+")), spans(text, PHONE, 3, lambda m: F.length(_digits(m)).between(10, 15))).otherwise(empty),
    )


def _entity(r: Column) -> Column:
    number = F.concat(r["kind"].cast("string"), F.lit(":"), _digits(r["match"]))
    return F.when(r["kind"] >= 2, number).otherwise(F.concat(r["kind"].cast("string"), F.lit(":"), F.lower(r["match"])))


def _terms(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.length(t) >= 3)


CLASS = ("n_e", "x1", "x2")


def _ratio(n_et: Column, total: int) -> Column:
    return 1 + F.log2(n_et / (F.col("n_t") + SMOOTH)) / F.log2(F.lit(float(total)) / F.col("n_e"))


def entity_classes(holding: DataFrame) -> DataFrame:
    """(text key, class of an entity in it), distinct, from ``holding``: _key, _base of the rows with entities."""
    mentions = holding.select("_key", F.explode(F.array_distinct(F.transform("_base", _entity))).alias("entity"))
    held = written(mentions.groupBy("_key", "entity").agg(F.count("*").alias("n")), "pii-entities")
    classes = held.groupBy("entity").agg(
        F.sum("n").alias("n_e"), F.bit_xor(F.xxhash64("_key")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "_key")).alias("x2")
    )
    return held.join(classes, "entity").select("_key", *CLASS).distinct()


def disclosing(texts: DataFrame, holding: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(text key, term, kind) of every term that discloses an entity of that text.

    ``texts``: ``_text`` of the whole corpus; ``holding``: ``_key, _text, _base`` of the rows with entities.
    """
    total = texts.count()
    classes = written(entity_classes(holding).where(F.col("n_e") < total), "pii-classes")
    terms = holding.select("_key", F.explode(F.array_distinct(_terms(F.col("_text")))).alias("term"))
    held = written(terms.groupBy("_key", "term").agg(F.count("*").alias("n")), "pii-terms-held")
    n_t = texts.select(F.explode(F.array_distinct(_terms(F.col("_text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    near = held.groupBy("term").agg(F.sum("n").alias("n_h")).join(n_t, "term")
    # an entity of one text has the most information, so this is the least that any entity asks for
    rare = written(near.where(F.log2(F.col("n_h") / (F.col("n_t") + SMOOTH)) >= (generalise - 1) * math.log2(max(2, total))), "pii-rare-terms")
    pairs = classes.join(held.join(sized(rare), "term"), "_key")
    pairs = written(pairs.where(_ratio(F.least("n_e", "n_h"), total) >= generalise), "pii-pairs")
    told = pairs.groupBy(*CLASS, "term").agg(F.sum("n").alias("n_et"), F.first("n_t").alias("n_t")).withColumn("ratio", _ratio(F.col("n_et"), total))
    kind = F.when(F.col("ratio") >= remove, REMOVED).otherwise(GENERAL)
    rules = written(told.where(F.col("ratio") >= generalise).select(*CLASS, "term", kind.alias("kind")), "pii-disclosing")
    hits = pairs.select("_key", *CLASS, "term").join(sized(rules), [*CLASS, "term"])
    return hits.groupBy("_key", "term").agg(F.max("kind").alias("kind"))


def _term_spans(text: Column, base: Column, general: Column, removed: Column) -> Column:
    def free(s: Column) -> Column:
        return ~F.exists(base, lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"]))

    def of(terms: Column, kind: int) -> Column:
        return F.filter(spans(text, TERM, kind, lambda m: F.array_contains(terms, F.lower(m))), free)

    return F.when(F.size(F.concat(general, removed)) == 0, F.array().cast(SPAN)).otherwise(F.concat(of(general, GENERAL), of(removed, REMOVED)))


def detected(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """``docs`` with the array column ``out`` of spans (start, kind number, end, match); a column of that name is replaced."""
    key, base, general, removed = [fresh(docs, n) for n in ("_key", "_base", "_general", "_removed")]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.withColumn(base, base_spans(body))
    holding = written(found.where(F.size(base) > 0).withColumn(key, F.sha2(body, 256)), "pii-holding")
    with_base = holding.select(F.col(key).alias("_key"), body.alias("_text"), F.col(base).alias("_base"))
    told = disclosing(docs.select(body.alias("_text")), with_base)
    by_text = told.groupBy(F.col("_key").alias(key)).agg(
        F.collect_list(F.when(F.col("kind") == GENERAL, F.col("term"))).alias(general),
        F.collect_list(F.when(F.col("kind") == REMOVED, F.col("term"))).alias(removed),
    )
    none = F.array().cast("array<string>")
    joined = holding.join(written(by_text, "pii-terms"), key, "left")  # rows hold arrays: Spark broadcasts by bytes
    kept, gone = F.coalesce(F.col(general), none), F.coalesce(F.col(removed), none)
    every = F.sort_array(F.concat(F.col(base), _term_spans(body, F.col(base), kept, gone)))
    rest = found.where(F.size(base) == 0).withColumn(out, F.array().cast(SPAN))
    columns = [c for c in docs.columns if c != out]
    return rest.select(*[f"`{c}`" for c in columns], out).unionByName(joined.withColumn(out, every).select(*[f"`{c}`" for c in columns], out))


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with entities masked, disclosing terms generalised to ``[TERM]`` or removed; other texts unchanged."""
    out = fresh(docs, "_pii_spans")
    masked = replaced(F.col(f"`{text}`"), F.col(out), ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""))
    return detected(docs, text, out).select(*[masked.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op7_pii(docs: DataFrame) -> DataFrame:
    base = F.filter("pii_spans", lambda s: s["kind"] < GENERAL)
    return detected(docs).select(
        "doc_id",
        *[count_kind(F.col("pii_spans"), k).alias(f"n_{KINDS[k]}") for k in range(GENERAL)],
        F.sha2(spans_text(base, KINDS), 256).alias("base_sha256"),
        spans_text(F.col("pii_spans"), KINDS).alias("spans"),
    )


def _sql() -> str:
    digits = "regexp_replace($m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(0, length({digits})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER)
        WHEN CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER) > 4 THEN 2 * CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER) - 9
        ELSE 2 * CAST(substr({digits}, length({digits}) - i, 1) AS INTEGER) END)) % 10 = 0"""
    found = (
        spans_sql("t", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "email", 0),
        spans_sql("t", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "ip", 1, "len(list_filter(string_split($m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0"),
        spans_sql("t", r"[0-9]([\x20-]?[0-9])+", "card", 2, f"length({digits}) BETWEEN 14 AND 19 AND {luhn}"),
        spans_sql("t", r"\+[0-9][\x20().0-9-]+[0-9]", "phone", 3, f"length({digits}) BETWEEN 10 AND 15"),
    )
    lists = ", ".join(f"{x} AS k{k}" for k, x in enumerate(found))
    terms = r"list_filter(regexp_extract_all(lower({0}), '\p{{L}}+'), lambda w: length(w) >= 3)"
    ratio = f"1 + log2(n_et / (n_t + {SMOOTH})) / log2(total / n_e)"
    return f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce("text", '') AS t FROM documents),
    m AS (SELECT *, {lists} FROM d), base AS (SELECT *, list_concat(list_concat(k0, k1), list_concat(k2, k3)) AS base FROM m),
    ment AS (SELECT rid, unnest(base) AS b FROM base),
    ent AS (SELECT DISTINCT rid, CASE WHEN b.k >= 2 THEN b.k || ':' || regexp_replace(b.m, '[^0-9]', '', 'g') ELSE b.k || ':' || lower(b.m) END AS entity FROM ment),
    tw AS (SELECT DISTINCT rid, unnest({terms.format('t')}) AS term FROM d),
    pairs AS (SELECT rid, entity, term FROM ent JOIN tw USING (rid)),
    et AS (SELECT entity, term, count(*) AS n_et FROM pairs GROUP BY ALL),
    e AS (SELECT entity, count(*) AS n_e FROM ent GROUP BY ALL),
    tt AS (SELECT term, count(*) AS n_t FROM tw GROUP BY ALL),
    rules AS (SELECT entity, term, {ratio} AS ratio FROM et JOIN e USING (entity) JOIN tt USING (term), (SELECT count(*) AS total FROM d) WHERE n_e < total),
    hit AS (SELECT rid, term, max(CASE WHEN ratio >= {REMOVE} THEN {REMOVED} ELSE {GENERAL} END) AS k FROM pairs JOIN rules USING (entity, term)
        WHERE ratio >= {GENERALISE} GROUP BY ALL),
    terms AS (SELECT rid, list(term) AS ts, list(k) AS tk FROM hit GROUP BY ALL),
    words AS (SELECT b.*, terms.ts, terms.tk, CASE WHEN ts IS NULL THEN [] ELSE {spans_sql("t", r"\p{L}+", "w", 9)} END AS ws FROM base b LEFT JOIN terms USING (rid)),
    added AS (SELECT *, list_transform(list_filter(ws, lambda r: list_contains(ts, lower(r.m)) AND len(list_filter(base, lambda b: r.s < b.s + length(b.m) AND b.s < r.s + length(r.m))) = 0),
        lambda r: {{'s': r.s, 'k': tk[list_position(ts, lower(r.m))], 'm': r.m, 'n': CASE WHEN tk[list_position(ts, lower(r.m))] = {GENERAL} THEN 'general' ELSE 'removed' END}}) AS extra FROM words)
    SELECT doc_id, {', '.join(f"CAST(len(k{k}) AS BIGINT) AS n_{KINDS[k]}" for k in range(4))},
        sha256({spans_text_sql('base')}) AS base_sha256, {spans_text_sql('list_concat(base, extra)')} AS spans FROM added"""


OP7_SQL = _sql()
