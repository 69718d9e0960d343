"""Continuous intake (S1): a stream of topics drives the article chain.

Every micro-batch of new topic files is one run, ``intake-<batch id>``.  Its
articles are written into the batch's own folder, which a replay of the batch
overwrites, and topics that an earlier batch has taken on are left out: a file
that comes twice, or a batch that is run again, changes nothing.  Results and
the stream's checkpoint lie side by side, so the same path resumes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators import inference as I
from quillframe.operators import requests as Q
from quillframe.plans import workflow as W
from quillframe.session import passing_scratch

TAKEN_SCHEMA = "topic_id bigint, batch bigint"


def run_intake(
    topics: DataFrame,
    path: str,
    completer: I.Completer | Callable[[int], I.Completer],
    settings: Q.LLMSettings = Q.LLMSettings(),
    overrides: DataFrame | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Run the chain over all topics that have come (``read_topics(..., stream=True)``) and return every article.

    ``completer`` may be a function of the batch id, so that a completer with a
    journal keeps one per batch and a replay is not billed again.
    """
    spark = topics.sparkSession
    base = path.rstrip("/")
    # both logs exist, with their columns, before the first batch
    spark.createDataFrame([], "topic_id bigint").write.mode("overwrite").parquet(f"{base}/taken/batch=-1")

    def handle(batch: DataFrame, batch_id: int) -> None:
        with passing_scratch(batch.sparkSession):  # the chain's tables, once the batch's articles are written
            take(batch, batch_id)

    def take(batch: DataFrame, batch_id: int) -> None:
        earlier = batch.sparkSession.read.schema(TAKEN_SCHEMA).parquet(f"{base}/taken").where(F.col("batch") < batch_id)
        fresh = batch.dropDuplicates(["topic_id"]).join(earlier.select("topic_id"), "topic_id", "left_anti")
        fresh = W.cut(fresh, f"intake-{batch_id}")
        if fresh.isEmpty():
            fresh.select("topic_id").write.mode("overwrite").parquet(f"{base}/taken/batch={batch_id}")
            return
        model = completer if isinstance(completer, I.Completer) else completer(batch_id)
        run = W.run_pipeline(fresh, model, settings, overrides, run_id=f"intake-{batch_id}", keep=keep)
        run.articles.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/articles/batch={batch_id}")
        # last: a batch that fails on the way takes nothing on
        fresh.select("topic_id").write.mode("overwrite").parquet(f"{base}/taken/batch={batch_id}")

    q = topics.writeStream.foreachBatch(handle).option("checkpointLocation", f"{base}/checkpoint")
    q.trigger(availableNow=True).start().awaitTermination()
    return articles(spark, base)


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Every article of an intake: one row per topic."""
    return spark.read.parquet(f"{path.rstrip('/')}/articles").drop("batch")
