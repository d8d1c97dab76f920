"""Queue reports over a stream: counts per profile, and reports that are due sent to a service."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.sinks.delivery import Post, deliver


def sender(url: str, post: Post) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over ``timers.queue_reports``: each report is posted, by tasks, with its queue and number as the key by which the service drops one that comes again."""

    def step(batch: DataFrame, number: int) -> None:  # noqa: ARG001
        rows = batch.select(F.lit(url).alias("url"), F.col("number").alias("id"), F.col("state").alias("body"), F.concat_ws(":", "queue", "number").alias("key"))
        failed = deliver(rows, post).where(~F.col("sent")).count()
        if failed:
            raise RuntimeError(f"{failed} reports could not be sent")  # the batch is tried again, under the same numbers

    return step


def counts(events: DataFrame) -> DataFrame:
    """events: profile, kind. How many of each kind, per profile."""
    kind = F.col("kind")
    return events.groupBy("profile").agg(F.count_if(kind == "inbox").alias("in_inbox"), F.count_if(kind == "busy").alias("busy"), F.count_if(kind == "failed").alias("failed"), F.count_if(kind == "duplicate").alias("duplicates"))
