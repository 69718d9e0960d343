"""Connected components by alternating large-star and small-star rounds.

Every round is joins and map-side combined minima over the edge table, written
to the shared folder, so lineage stays short and a lost executor costs one
round's partition.  Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import written


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("x").agg(F.min("y").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least node it sees."""
    both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    joined = both.join(_lowest(both), "x").where("y > x")
    return joined.select(F.col("y").alias("x"), F.least("x", "low").alias("y"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are linked to the least of them."""
    low = _lowest(edges)
    joined = edges.join(low, "x").where("y > low").select(F.col("y").alias("x"), F.col("low").alias("y"))
    return joined.unionByName(low.select("x", F.col("low").alias("y"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's least node."""
    now = written(edges.select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).where("x > y").distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)")).alias("h")).first()
        if state == mark or state["n"] == 0:
            break
        mark = state
        now = written(_small_star(_large_star(now).distinct()), "stars")
    return now.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
