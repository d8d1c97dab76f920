"""Sending rows to services: with attempts and waits, and what came of it as rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.workers import let_workers_import

#: Fixed value: seconds between the attempts at a callback.
CALLBACK_DELAYS = (2.0, 5.0)
#: (url, body, idempotence key) -> status of the answer; raises OSError if there is none
Post = Callable[[str, str, str], int]


def deliver(rows: DataFrame, post: Post, delays: Sequence[float] = CALLBACK_DELAYS, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """rows: url, id, body, and a key if there is one. (id, sent, attempts, reason): each is posted until its answer's status is below 400, with a wait between attempts; none raises.

    A task that is run again posts again: every attempt carries the row's key (its id, if there is no key), by which the service drops what it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sent, attempts, reasons = [], [], [], []
            for url, own, body, key in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for attempt, delay in enumerate((*delays, None), 1):
                    try:
                        status = post(url, body, key)
                        ok, reason = status < 400, "" if status < 400 else f"HTTP {status}"
                    except OSError as error:
                        ok, reason = False, type(error).__name__
                    if ok or delay is None:
                        break
                    sleep(delay)
                ids.append(own)
                sent.append(ok)
                attempts.append(attempt)
                reasons.append(reason)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(1).type), pa.array(sent, pa.bool_()), pa.array(attempts, pa.int32()), pa.array(reasons, pa.string())], names=["id", "sent", "attempts", "reason"])

    let_workers_import(rows.sparkSession)
    key = F.col("key") if "key" in rows.columns else F.col("id").cast("string")
    return rows.select("url", "id", "body", key.alias("key")).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, sent boolean, attempts int, reason string")


def permission_bodies(changes: DataFrame, kind: str) -> DataFrame:
    """changes: id, owner, viewers. One request for all objects of an owner with the same viewers, as JSON text."""
    together = changes.groupBy("owner", "viewers").agg(F.array_sort(F.collect_list("id")).alias("objects"))
    no_one = F.array().cast("array<bigint>")
    rights = F.struct(F.struct(F.col("viewers").alias("users"), no_one.alias("groups")).alias("view"), F.struct(no_one.alias("users"), no_one.alias("groups")).alias("change"))
    body = F.struct("objects", F.lit(kind).alias("object_type"), F.lit("set_permissions").alias("operation"), "owner", F.lit(False).alias("merge"), rights.alias("permissions"))
    return together.select("owner", F.to_json(body).alias("body"))
