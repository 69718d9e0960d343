"""Shared helpers: typed inputs, materialised tables, size-checked joins, spans as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.session import scratch_path, ship_package
from quillframe.sources.tables import table

#: Whitespace of the word definition ``[^\x20\x09-\x0D]+``.
SPACE = r"[\x20\x09-\x0D]+"

#: A side of at most this many rows may be broadcast (rows here are a few dozen bytes).
BROADCAST_ROWS = 500_000


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    ship_package(spark)
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a parquet table in the shared folder: computed once, its lineage cut."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(side: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``side``, hinted for broadcast only if a count of it stays within ``max_rows``.

    Pass a written table (the count then reads parquet footers).  Beyond the
    bound the join is an ordinary shuffle join, which AQE splits on skew.
    """
    return F.broadcast(side) if side.count() <= max_rows else side


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` evaluated once per row (a lambda variable holds it)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sum(values: Column) -> Column:
    """Inclusive prefix sums of an array in log2(size) doubling passes."""
    powers = F.array(*[F.lit(1 << k) for k in range(30)])

    def step(acc: Column, p: Column) -> Column:
        shifted = F.transform(acc, lambda x, i: x + F.when(i >= p, F.get(acc, i - p)).otherwise(F.lit(0).cast("long")))
        return F.when(p < F.size(acc), shifted).otherwise(acc)

    return F.aggregate(powers, F.transform(values, lambda x: x.cast("long")), step)


SPAN = "array<struct<start:bigint,kind:int,end:bigint,match:string>>"


def spans(text: Column, pattern: str, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches as (start, kind, end, match), code points, end exclusive.

    Java's ``find`` loop gives the matches and ``split`` the pieces between
    them; starts are prefix sums of both.  Matches that fail ``keep`` are
    dropped after the search (no retry inside them).
    """
    empty = F.array().cast(SPAN)

    def located(found: Column) -> Column:
        def place(pieces: Column) -> Column:
            gaps = F.transform(
                found,
                lambda m, i: F.length(F.get(pieces, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(F.lit(0)),
            )
            return let(
                running_sum(gaps),
                lambda starts: F.transform(
                    found,
                    lambda m, i: F.struct(
                        F.get(starts, i).alias("start"),
                        F.lit(kind).alias("kind"),
                        (F.get(starts, i) + F.length(m)).alias("end"),
                        m.alias("match"),
                    ),
                ),
            )

        rows = let(F.split(text, pattern, -1), place)
        if keep is not None:
            rows = F.filter(rows, lambda r: keep(r["match"]))
        return F.when(F.size(found) == 0, empty).otherwise(rows.cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), located)


def spans_text(rows: Column, names: tuple[str, ...]) -> Column:
    """``kind:start:end`` of spans ordered by start, then kind, comma-joined."""
    named = F.array(*[F.lit(n) for n in names])
    ordered = F.sort_array(rows)
    return F.array_join(
        F.transform(ordered, lambda r: F.concat_ws(":", F.get(named, r["kind"]), r["start"].cast("string"), r["end"].cast("string"))), ","
    )


def count_kind(rows: Column, kind: int) -> Column:
    return F.size(F.filter(rows, lambda r: r["kind"] == kind)).cast("long")


def spans_sql(column: str, pattern: str, kind: str, order: int, keep: str = "true") -> str:
    """DuckDB list of (start, kind order, end, name) for the same matches; ``keep`` tests ``m``."""
    pattern = pattern.replace("'", "''")
    return f"""(SELECT list_filter(list_transform(range(1, len(ms) + 1), lambda i: {{
            's': coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0),
            'k': {order}, 'm': ms[i], 'n': '{kind}'}}), lambda r: list_bool_and([{keep.replace("$m", "r.m")}]))
        FROM (SELECT regexp_extract_all({column}, '{pattern}') ms, string_split_regex({column}, '{pattern}') ps))"""


def spans_text_sql(rows: str) -> str:
    return f"""array_to_string(list_transform(list_sort(list_transform({rows}, lambda r: {{'s': r.s, 'k': r.k, 'e': r.s + length(r.m), 'n': r.n}})),
        lambda r: r.n || ':' || CAST(CAST(r.s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(r.e AS BIGINT) AS VARCHAR)), ',')"""


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with leading underscores until no column of ``df`` has it."""
    while name in df.columns:
        name = "_" + name
    return name


def replaced(text: Column, rows: Column, labels: tuple[str, ...]) -> Column:
    """``text`` with each span replaced by the label of its kind; overlapping spans share the first label."""
    named = F.array(*[F.lit(x) for x in labels])
    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, r: Column) -> Column:
        piece = F.array(F.substr(text, (acc["pos"] + 1).cast("int"), (r["start"] - acc["pos"]).cast("int")), F.get(named, r["kind"]))
        return F.struct(
            F.greatest(acc["pos"], r["end"]).alias("pos"),
            F.when(r["start"] >= acc["pos"], F.concat(acc["parts"], piece)).otherwise(acc["parts"]).alias("parts"),
        )

    def done(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substr(text, (acc["pos"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(rows) == 0, text).otherwise(F.aggregate(F.sort_array(rows), zero, step, done))
