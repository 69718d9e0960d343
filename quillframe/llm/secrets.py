"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query (an OR
of clauses, each an AND of trigrams that every match must contain).  The index
holds postings (trigram, document) for the trigrams that the rules ask for,
found in the lower-cased whole text.  A clause's postings are intersected by a
grouped bit-or per document; documents that satisfy a rule's query are its
candidates, and only there is the expression run.  Rules without mandatory
trigrams (plain hexadecimal runs) scan every text.

Skew: postings are grouped by document, never by trigram, so a trigram that
occurs in a third of all texts is no group.  Null texts are empty; rows with a
null id can't be indexed and are verified for every rule; repeated rows share
their candidates and are verified one by one.  Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import SPAN, count_kind, fresh, replaced, sized, spans, spans_sql, spans_text, spans_text_sql, written

MAX_ALTERNATIVES = 16
MAX_CLAUSES = 64


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    keep: Callable[[Column], Column] | None = None
    keep_sql: str = "true"


_KEYWORDS = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")])
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

BASE = (
    Rule("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, "length(regexp_extract($m, '" + ASSIGN.replace("'", "''") + "', 2)) >= 6"),
    Rule("access", "AKIA[A-Z0-9]+", lambda m: F.length(m) >= 20, "length($m) >= 20"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Public token formats that the method adds.  Fixed values.
ADDED = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "sk_live_[A-Za-z0-9]{16,}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

Clauses = list[frozenset[str]]  # OR of ANDs; a clause without trigrams is always true
ALWAYS: Clauses = [frozenset()]


def _of_strings(strings: set[str]) -> Clauses:
    clauses = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return ALWAYS if frozenset() in clauses else sorted(clauses, key=sorted)


def _both(a: Clauses, b: Clauses) -> Clauses:
    """a AND b; where the product would be too long, the longer-clause side alone (weaker, never wrong)."""
    if len(a) * len(b) > MAX_CLAUSES:
        return max(a, b, key=lambda q: min(map(len, q)))
    return [x | y for x in a for y in b]


def _analyse(nodes) -> tuple[set[str] | None, Clauses]:
    """Strings that a sequence stands for (None: unbounded), and its trigram query."""
    query, run, exact = ALWAYS, {""}, True
    for op, arg in nodes:
        strings: set[str] | None = None
        if op is rc.LITERAL:
            strings = {chr(arg).lower()}
        elif op is rc.IN and len(arg) <= 8 and all(x is rc.LITERAL for x, _ in arg):
            strings = {chr(c).lower() for _, c in arg}
        elif op is rc.SUBPATTERN:
            strings, inner = _analyse(arg[3])
            query = _both(query, inner) if strings is None else query
        elif op is rc.BRANCH:
            parts = [_analyse(b) for b in arg[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            else:
                either = [c for s, q in parts for c in (q if s is None else _of_strings(s))]
                query = _both(query, ALWAYS if frozenset() in either or len(either) > MAX_CLAUSES else either)
        elif op is rc.MAX_REPEAT:
            least, most, body = arg
            inner_strings, inner = _analyse(body)
            if (least, most) == (0, 1) and inner_strings is not None:
                strings = {""} | inner_strings
            elif least == most == 1 and inner_strings is not None:
                strings = inner_strings
            elif least:
                query = _both(query, inner if inner_strings is None else _of_strings(inner_strings))
        longer = None if strings is None else {a + b for a in run for b in strings}
        if longer is not None and len(longer) <= MAX_ALTERNATIVES:
            run = longer
        else:
            query, run, exact = _both(query, _of_strings(run)), (strings if strings is not None and len(strings) <= MAX_ALTERNATIVES else {""}), False
    return (run if exact else None), _both(query, _of_strings(run))


def trigram_query(pattern: str) -> Clauses:
    """Necessary condition of a match over the lower-cased text, as an OR of trigram sets."""
    return _analyse(rp.parse(pattern))[1]


def clauses_of(rules: tuple[Rule, ...]) -> list[tuple[int, int, str, int, int]]:
    """Rows (rule, clause, trigram, bit, all bits) of the rules that can use the index."""
    rows = []
    for r, rule in enumerate(rules):
        query = trigram_query(rule.pattern)
        if frozenset() in query:
            continue
        for c, clause in enumerate(query):
            grams = sorted(clause)[:62]
            rows += [(r, c, g, 1 << i, (1 << len(grams)) - 1) for i, g in enumerate(grams)]
    return rows


def postings(docs: DataFrame, trigrams: list[str], id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: one row (trigram, doc) for each asked trigram in a text."""
    low = F.lower(F.col(f"`{text}`"))
    found = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("_low"), t))
    rows = docs.where(F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").alias("doc"), low.alias("_low"))
    return rows.select("doc", F.explode(found).alias("trigram"))


def candidates(index: DataFrame, rows: list[tuple[int, int, str, int, int]]) -> DataFrame:
    """(doc, bit mask of the rules whose trigram query the document satisfies)."""
    spark = index.sparkSession
    clauses = spark.createDataFrame(rows, "rule int, clause int, trigram string, bit long, full long")
    # the clause table is bounded by the rule set: at most 63 rules x 64 clauses x 62 trigrams
    met = index.join(F.broadcast(clauses), "trigram").groupBy("doc", "rule", "clause", "full").agg(F.bit_or("bit").alias("bits"))
    rule_bit = F.expr("shiftleft(1L, rule)")
    return met.where("bits = full").groupBy("doc").agg(F.bit_or(rule_bit).alias("mask"))


def scanned(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, out: str = "secret_spans") -> DataFrame:
    """``docs`` with the array column ``out`` of spans (start, rule number, end, match); a column of that name is replaced."""
    if len(rules) > 63:
        raise ValueError("at most 63 rules a scan: candidates carry one bit each")
    rows = clauses_of(rules)
    indexed = {r for r, *_ in rows}
    key, mask = fresh(docs, "_scan_doc"), fresh(docs, "_scan_mask")
    if rows:
        index = written(postings(docs, sorted({t for _, _, t, _, _ in rows}), id, text), "trigram-postings")
        found = written(candidates(index, rows).select(F.col("doc").alias(key), F.col("mask").alias(mask)), "secret-candidates")
        joined = docs.join(sized(found), F.col(f"`{id}`") == F.col(key), "left")
    else:
        joined = docs.withColumn(key, F.lit(None).cast("long")).withColumn(mask, F.lit(0).cast("long"))
    body, empty = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.array().cast(SPAN)
    parts = []
    for r, rule in enumerate(rules):
        match = spans(body, rule.pattern, r, rule.keep)
        asked = F.col(f"`{id}`").isNull() | (F.coalesce(F.col(mask), F.lit(0)).bitwiseAND(F.lit(1 << r)) != 0)
        parts.append(F.when(asked, match).otherwise(empty) if r in indexed else match)
    return joined.withColumn(out, F.sort_array(F.concat(*parts))).drop(key, mask)


def redacted(docs: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]``; texts without one (and nulls) stay as they are."""
    out = fresh(docs, "_secret_spans")
    done = scanned(docs, id, text, rules, out)
    masked = replaced(F.col(f"`{text}`"), F.col(out), tuple("[SECRET]" for _ in rules))
    return done.select(*[masked.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op10_secret_scans(docs: DataFrame) -> DataFrame:
    found = scanned(docs)
    names = tuple(r.name for r in RULES)
    base = F.filter("secret_spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        *[count_kind(F.col("secret_spans"), k).alias(f"n_{r.name}") for k, r in enumerate(BASE)],
        F.sha2(spans_text(base, names), 256).alias("base_sha256"),
        spans_text(F.col("secret_spans"), names).alias("spans"),
    )


def _sql() -> str:
    lists = ", ".join(f"{spans_sql('t', r.pattern, r.name, k, r.keep_sql)} AS k{k}" for k, r in enumerate(RULES))
    base = "list_concat(list_concat(k0, k1), k2)"
    every = base
    for k in range(len(BASE), len(RULES)):
        every = f"list_concat({every}, k{k})"
    counts = ", ".join(f"CAST(len(k{k}) AS BIGINT) AS n_{r.name}" for k, r in enumerate(BASE))
    return f"""
    WITH d AS (SELECT doc_id, coalesce("text", '') AS t FROM documents), m AS (SELECT doc_id, {lists} FROM d)
    SELECT doc_id, {counts}, sha256({spans_text_sql(base)}) AS base_sha256, {spans_text_sql(every)} AS spans FROM m"""


OP10_SQL = _sql()
