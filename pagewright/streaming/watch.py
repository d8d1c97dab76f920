"""Watching a folder as a stream, a sign of life, and steps that run jobs."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pagewright.operators.service import claimed, recovered
from pagewright.sources.files import full_listing, pdf_candidates


def poll(spark: SparkSession, folder: str, step: Callable[[DataFrame, int], None], seconds: float = 30.0, exclude: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Hands the files that wait in a folder to step, once per interval. A clock drives the stream and not the files' arrival: readiness needs files seen again, unchanged, and files that have gone
    are simply not among the next listing."""

    def each(_: DataFrame, number: int) -> None:
        step(pdf_candidates(full_listing(spark, folder), folder, exclude), number)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(each).trigger(processingTime=f"{seconds} seconds")
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


class SignOfLife(StreamingQueryListener):
    """Touches a file whenever a stream makes progress."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)

    def onQueryStarted(self, event) -> None:  # noqa: ARG002, N802
        self.path.touch()

    def onQueryProgress(self, event) -> None:  # noqa: ARG002, N802
        self.path.touch()

    def onQueryTerminated(self, event) -> None:
        pass


def alive(path: str, most_seconds: float, now: Callable[[], float] = time.time) -> bool:
    """Whether the sign of life is there and fresh."""
    try:
        return now() - os.path.getmtime(path) < most_seconds
    except OSError:
        return False


def run_jobs(jobs: DataFrame, started_at, run: Callable[[DataFrame], DataFrame], after_restart: bool = False) -> tuple[DataFrame, DataFrame]:
    """(jobs with the oldest waiting one running, what run made of it). run: the job that was claimed -> its results."""
    ready = claimed(recovered(jobs) if after_restart else jobs, started_at)
    return ready, run(ready.filter("status = 'running'"))
