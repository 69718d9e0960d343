"""URL filters: rules, and logistic regression on hashed character n-grams of host and path.

A rule (host, path) fits its host and all subdomains if the url's path starts
with the rule's path; of fitting rules the longest decides.  Urls that no rule
fits get the verdict of a logistic regression over hashed character trigrams of
host and path.  It is trained from a small labelled table: (host, path, label)
rows, by default the urls that the rules decide, of which about
``TRAIN_ROWS`` distinct ones are taken by hash.

Everything is DataFrame functions.  Training is full-batch gradient descent:
each round is a projection (the weights are one constant array) and one sum per
bucket over the bounded table, so ``BUCKETS`` numbers reach the driver.
Scoring is a row-local projection: no shuffle, and a hot host costs nothing.

Null urls and urls without ``://`` have an empty host and path and get the
verdict of an empty url.  Without labelled rows of both classes there is no
model and undecided urls are allowed.  Ties of equally long rules go to the
earlier rule; a score of exactly zero is an allow.  Rows are judged one by one,
so repeated rows and null ids are harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import fresh, let, written

#: Rules in their given order: verdict, host, path.  Fixed values.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

BUCKETS = 1024
GRAM = 3
#: Labelled urls that the model is fitted on, about; a documented bound of the training table.
TRAIN_ROWS = 5_000
ROUNDS = 25
RATE = 8.0
DECAY = 1e-4

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, else null: the first that fits of a constant array, longest first."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))  # stable: the earlier of equally long rules comes first
    if not ordered:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = (f"named_struct('verdict', {quoted(v)}, 'host', {quoted(h)}, 'path', {quoted(p)})" for v, h, p in ordered)
    table = F.expr(f"array({', '.join(rows)})")  # folded to one literal

    def fits(r: Column) -> Column:
        return ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])

    def found(r: Column) -> Column:
        return F.when(r.isNotNull(), F.struct(F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict")))

    return let(F.get(F.filter(table, fits), F.lit(0)), found)


def buckets(host: Column, path: Column) -> Column:
    """Hashed trigrams of the host and, in another namespace, of the path."""

    def grams(text: Column, seed: str) -> Column:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        cut = lambda t: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - GRAM + 1)),
            lambda i: F.pmod(F.xxhash64(F.lit(seed), F.substr(t, i, F.lit(GRAM))), F.lit(BUCKETS)).cast("int"),
        )
        return let(padded, cut)

    return F.concat(grams(host, "host"), grams(path, "path"))


def _score(found: Column, weights: list[float]) -> Column:
    """Bias plus the mean weight of the trigrams, scaled by the root of their number."""
    constant = F.split(F.lit(" ".join(repr(w) for w in weights)), " ").cast("array<double>")  # folded to one literal
    total = F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(constant, b))
    return F.get(constant, F.lit(BUCKETS)) + total / F.sqrt(F.size(found))


def labelled(urls: DataFrame, rules: tuple = RULES, rows: int = TRAIN_ROWS) -> DataFrame:
    """About ``rows`` distinct (host, path, label) of the urls that the rules decide; label 1 is block.

    ``urls`` has host, path and the struct ``found``.  The rows are those of the
    least hashes, so every run and partitioning takes the same ones.
    """
    decided = urls.where("found IS NOT NULL").select("host", "path", (F.col("found.verdict") == "block").cast("int").alias("label"))
    n = decided.agg(F.approx_count_distinct(F.xxhash64("host", "path"))).first()[0]
    share = int((1 << 31) * min(1.0, rows / max(1, n)))
    return decided.where(F.pmod(F.xxhash64("host", "path"), F.lit(1 << 31)) < share).distinct()


def fitted(train: DataFrame) -> list[float] | None:
    """Weights of the buckets and the bias, from the small table (host, path, label)."""
    known = train.where("label IS NOT NULL").select(buckets(F.col("host"), F.col("path")).alias("found"), F.col("label").cast("double").alias("label"))
    rows = written(known.coalesce(4), "url-training")
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return None
    # both classes weigh the same
    share = F.when(F.col("label") == 1, F.lit(0.5 / ones)).otherwise(0.5 / (n - ones))
    weights = [0.0] * (BUCKETS + 1)
    for _ in range(ROUNDS):
        p = 1 / (1 + F.exp(-_score(F.col("found"), weights)))
        errors = rows.select("found", ((p - F.col("label")) * share).alias("e"))
        unit = F.col("e") / F.sqrt(F.size("found"))
        each = errors.select(F.explode(F.concat(F.transform("found", lambda b: F.struct(b.alias("b"), unit.alias("g"))), F.array(F.struct(F.lit(BUCKETS).alias("b"), F.col("e").alias("g"))))).alias("x"))
        gradient = each.groupBy("x.b").agg(F.round(F.sum("x.g"), 9).alias("g")).collect()  # at most BUCKETS + 1 rows
        weights = [w * (1 - RATE * DECAY) for w in weights]
        for b, g in gradient:
            weights[b] -= RATE * g
    return [round(w, 6) for w in weights]


def judged(pages: DataFrame, url: str = "url", rules: tuple = RULES, train: DataFrame | None = None) -> DataFrame:
    """``pages`` with struct ``filter`` (host, path, rule, verdict, score); a column of that name is replaced."""
    u, found = F.col(f"`{url}`"), fresh(pages, "_found")
    host, path = fresh(pages, "_host"), fresh(pages, "_path")
    parsed = pages.withColumn(host, host_of(u)).withColumn(path, path_of(u))
    parsed = parsed.withColumn(found, rule_of(F.col(host), F.col(path), rules))
    if train is None:
        train = labelled(parsed.select(F.col(host).alias("host"), F.col(path).alias("path"), F.col(found).alias("found")), rules)
    weights = fitted(train)
    score = _score(buckets(F.col(host), F.col(path)), weights) if weights else F.lit(0.0)
    rows = parsed.withColumn("_score", F.round(score, 6)) if "_score" not in pages.columns else parsed.withColumn("__score", F.round(score, 6))
    made = F.col("_score" if "_score" not in pages.columns else "__score")
    verdict = F.coalesce(F.col(found)["verdict"], F.when(made > 0, "block").otherwise("allow"))
    out = F.struct(F.col(host).alias("host"), F.col(path).alias("path"), F.col(found)["rule"].alias("rule"), verdict.alias("verdict"), made.alias("score"))
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns if c != "filter"], out.alias("filter"))


def op3_url_filters(pages: DataFrame) -> DataFrame:
    return judged(pages.select("page_id", "url")).select("page_id", "filter.host", "filter.path", "filter.rule", "filter.verdict", "filter.score")
