"""P8, near form: MinHash signatures, LSH bands, verified pairs between classes of equal texts.

A text's shingles are its runs of ``w`` tokens (the whole text, if it has
fewer), as 64-bit hashes, each once.  Texts with the same set are one class,
named by its least key, so copies never meet each other.  Signatures of
``bands * rows`` minima are made in vectorised batches and cut into bands; only
band values that two classes share are joined, and the pairs found are verified
on their whole shingle sets.  At 32 bands of 4 a pair of Jaccard similarity 0.8
is missed once in twenty million (0.0000001), one of 0.9 practically never.

What is shuffled is 32 longs a class and, for candidate pairs only, their
shingle sets.  Every pair of different texts that reaches the similarity is
one row, so the result grows with the number of such pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.operators.inference import materialize
from quillframe.session import ship_package

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
SEED = 17
#: Hashes that one step of a signature takes (a long text has many steps).
STEP = 1 << 16


def shingle_hashes(tokens: Column, w: int = SHINGLE) -> Column:
    """Sorted distinct 64-bit hashes of the ``w``-token shingles; of all tokens, if fewer; none without tokens.

    ``tokens`` must be a column reference: it is read inside a lambda.
    """
    n = F.size(tokens)
    some = F.transform(F.sequence(F.lit(1), F.greatest(n - w + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(tokens, i, w), " ")))
    return F.when(n > 0, F.array_sort(F.array_distinct(some))).otherwise(F.array().cast("array<bigint>"))


def band_values(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> np.ndarray:
    """The band values (int64) of one set of int64 hashes."""
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 63, (bands * rows, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, (bands * rows, 1), np.uint64)
    least = np.full(bands * rows, np.uint64(0xFFFFFFFFFFFFFFFF))
    h = hashes.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), STEP):
            mixed = h[None, at : at + STEP] * factor + shift
            mixed ^= mixed >> np.uint64(31)
            least = np.minimum(least, (mixed * factor).min(axis=1))
        value = np.zeros(bands, np.uint64)
        for column in least.reshape(bands, rows).T:
            value = (value ^ column) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
    return value.view(np.int64)


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", w: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, c1, c2, n, bands): two hashes that name the shingle set, its size, its band values; texts without tokens are left out."""

    @F.pandas_udf("array<bigint>")
    def banded(sets: pd.Series) -> pd.Series:
        return pd.Series([band_values(np.asarray(s), bands, rows) for s in sets])

    ship_package(docs.sparkSession)
    toks = docs.select(F.col(key), T.tokens(text).alias("_tk")).where(F.size("_tk") > 0)
    sets = toks.select(key, shingle_hashes(F.col("_tk"), w).alias("_s"))
    return sets.select(key, F.xxhash64("_s").alias("c1"), F.xxhash64(F.reverse("_s")).alias("c2"), F.size("_s").alias("n"), banded("_s").alias("bands"))


def text_classes(signed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(c1, c2, class_id, copies): classes of equal shingle sets; combined before the shuffle."""
    return signed.groupBy("c1", "c2").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("copies"))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    w: int = SHINGLE,
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (class_a < class_b, shared, jaccard) of different texts, and (key, class_id, copies) of every text.

    A class of thousands of copies is one side of its pairs.  Join ``members``
    to ``pairs`` for the documents behind them.
    """
    signed = materialize(signatures(docs, key, text, w, bands, rows), "minhash")
    classes = materialize(text_classes(signed, key), "text-classes")
    members = signed.join(classes, ["c1", "c2"]).select(key, "class_id", "copies")

    one = signed.join(classes.select(F.col("class_id").alias(key)), key, "left_semi").dropDuplicates([key])
    banded = one.select(F.col(key).alias("class_id"), F.posexplode("bands").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("band", "value")
    banded = materialize(banded.join(shared, ["band", "value"], "left_semi"), "shared-bands")
    a, b = (banded.select("band", "value", F.col("class_id").alias(f"class_{x}")) for x in "ab")
    found = a.join(b, ["band", "value"]).where("class_a < class_b").select("class_a", "class_b").distinct()
    found = materialize(found, "minhash-candidates")

    ends = found.select(F.col("class_a").alias(key)).unionByName(found.select(F.col("class_b").alias(key))).distinct()
    toks = docs.join(ends, key, "left_semi").dropDuplicates([key]).select(F.col(key), T.tokens(text).alias("_tk"))
    sets = materialize(toks.select(key, shingle_hashes(F.col("_tk"), w).alias("s")), "candidate-sets")
    sa, sb = (sets.select(F.col(key).alias(f"class_{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    both = found.join(sa, "class_a").join(sb, "class_b")
    counted = both.select("class_a", "class_b", F.size(F.array_intersect("sa", "sb")).cast("bigint").alias("shared"), (F.size("sa") + F.size("sb")).alias("_n"))
    scored = counted.select("class_a", "class_b", "shared", (F.col("shared") / (F.col("_n") - F.col("shared"))).alias("jaccard"))
    return scored.where(F.col("jaccard") >= similarity), members
