"""Stateful steps with timers, over ``transformWithState``: queue reports with heartbeats, tasks that are waited for, and snapshots whose differences are sent.

State lies in RocksDB and in the query's checkpoint, so a restart goes on where the stream stopped, and timers fire without input. What leaves a step has a number of its key's own, which comes out the same
if a batch is repeated: hand it on as the idempotence key. What a step does with a row is a plain function here, tested without a stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagewright.functions import messages
from pagewright.workers import let_workers_import

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Seconds between reports without a change, and seconds that a task is waited for.
HEARTBEAT, MOST_WAIT = 300.0, 3600.0


def _with_state(rows: DataFrame, keys: list[str], step: StatefulProcessor, output: str, clock: str = "ProcessingTime") -> DataFrame:
    """Timers and map state need RocksDB; a session that has another provider gets it."""
    spark: SparkSession = rows.sparkSession
    let_workers_import(spark)
    if "RocksDB" not in spark.conf.get(_PROVIDER, ""):
        spark.conf.set(_PROVIDER, _ROCKS)
    return rows.groupBy(*keys).transformWithState(step, output, "append", clock)


class _Timed(StatefulProcessor):
    """What the steps share: one timer per key."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def alarm(self, at: int | None) -> None:
        for known in list(self.handle.listTimers()):
            self.handle.deleteTimer(known)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


# --- queue reports -----------------------------------------------------------------------------------------------------

REPORT = "queue string, number long, reason string, at_ms long, state string"


def snapshot(counts: dict[str, tuple[int, int, int, int]]) -> str:
    """counts by profile: in the inbox, busy, failed, duplicates. The report as JSON text: per profile and in all."""
    profiles = {}
    for name, (inbox, busy, failed, duplicates) in sorted(counts.items()):
        profiles[name] = {"waiting": inbox - min(busy, inbox), "processing": min(busy, inbox), "failed": failed, "duplicates": duplicates}
    totals = {k: sum(p[k] for p in profiles.values()) for k in ("waiting", "processing", "failed", "duplicates")}
    return json.dumps({"queued": totals["waiting"] + totals["processing"], **totals, "profiles": profiles})


class _Reports(_Timed):
    def __init__(self, heartbeat_ms: int) -> None:
        self.heartbeat = heartbeat_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getMapState("counts", "profile string", "in_inbox long, busy long, failed long, duplicates long")
        self.last = handle.getValueState("last", "state string, number long")

    def _send(self, key: Any, reason: str, state: str, now: int) -> Iterator[Row]:
        number = (self.last.get()[1] if self.last.exists() else 0) + 1
        self.last.update((state, number))
        self.alarm(now + self.heartbeat)
        yield Row(queue=key[0], number=number, reason=reason, at_ms=now, state=state)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        for row in sorted(rows, key=lambda r: (r.at is not None, r.at)):  # a queue's counts of one batch
            self.counts.updateValue((row.profile or "",), tuple(int(x or 0) for x in (row.in_inbox, row.busy, row.failed, row.duplicates)))
        state = snapshot({k[0]: tuple(v) for k, v in self.counts.iterator()})
        if not self.last.exists() or self.last.get()[0] != state:
            yield from self._send(key, "change", state, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803, ARG002
        yield from self._send(key, "heartbeat", self.last.get()[0], timerValues.getCurrentProcessingTimeInMs())


def queue_reports(counts: DataFrame, heartbeat: float = HEARTBEAT) -> DataFrame:
    """counts, a stream: queue, profile, at, in_inbox, busy, failed, duplicates. A report whenever a queue's snapshot has changed, and when ``heartbeat`` seconds have passed since the last one, input or not.

    (queue, number, reason, at_ms, state); numbers of a queue go on over restarts. Null counts are 0, a null profile is the empty name."""
    return _with_state(counts, ["queue"], _Reports(int(heartbeat * 1000)), REPORT)


# --- tasks -------------------------------------------------------------------------------------------------------------

OUTCOME = "task string, outcome string, document long, message string, content string, at_ms long"
_WAITING, _ENDED, _LATE = "waiting", "ended", "timed out"


def outcome(status: str, document: int | None, message: str | None, duplicate: bool, original: int | None) -> tuple[str, int | None, str | None] | None:
    """The end that a status means: its kind, document and message; none while a task is at work."""
    if status == "SUCCESS":
        return "created", document, None
    if status not in ("FAILURE", "REVOKED"):
        return None
    return ("duplicate", original, message) if duplicate else ("failed", None, message)


class _Tasks(_Timed):
    def __init__(self, most_wait_ms: int, keep_ms: int) -> None:
        self.most_wait, self.keep = most_wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.task = handle.getValueState("task", "phase string, content string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        phase, content = self.task.get() if self.task.exists() else (None, None)
        before = phase
        for row in sorted(rows, key=lambda r: (r.at is not None, r.at, r.status != "")):  # a task's rows of one batch; its upload before its statuses
            if phase == _ENDED:
                break
            if row.status == "":  # uploaded, or waited for again
                phase, content = _WAITING, row.content if row.content is not None else content
                continue
            phase = phase or _WAITING
            end = outcome(row.status, row.document, row.message, bool(row.duplicate), row.original)
            if end and phase == _WAITING:
                phase = _ENDED
                yield Row(task=key[0], outcome=end[0], document=end[1], message=end[2], content=content if end[0] == "created" and end[1] is not None else None, at_ms=now)
        if phase != before:
            self.alarm(now + (self.keep if phase == _ENDED else self.most_wait))
        if phase:
            self.task.update((phase, None if phase == _ENDED else content))

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803, ARG002
        phase, content = self.task.get()
        if phase == _WAITING:
            self.task.update((_LATE, content))
            self.alarm(timerValues.getCurrentProcessingTimeInMs() + self.keep)
            yield Row(task=key[0], outcome=_LATE, document=None, message=None, content=None, at_ms=timerValues.getCurrentProcessingTimeInMs())
        else:
            self.task.clear()


def task_outcomes(rows: DataFrame, most_wait: float = MOST_WAIT, keep: float = 7 * 86_400.0) -> DataFrame:
    """rows, a stream: task, at, answer, content. A null answer says that a task was uploaded (or is to be waited for again), with the text that its document is to get; others are what the service says of it, as JSON text.

    (task, outcome, document, message, content, at_ms), once per task: "created", with the content to set now that there is a document; "duplicate", with the document it is one of; "failed"; or "timed out" after
    ``most_wait`` seconds, which ends when the task is waited for again. An end is remembered for ``keep`` seconds. Answers that mean no end, and what comes after one, change nothing."""
    answer = F.col("answer")
    about, original = messages.duplicate_id(messages.task_message(answer))
    status: Column = F.when(answer.isNull(), "").otherwise(F.coalesce(F.nullif(messages.task_status(answer), F.lit("")), F.lit("UNKNOWN")))
    shaped = rows.select("task", "at", "content", status.alias("status"), messages.task_document(answer).alias("document"), messages.task_message(answer).alias("message"), F.coalesce(about, F.lit(False)).alias("duplicate"), original.alias("original"))
    return _with_state(shaped, ["task"], _Tasks(int(most_wait * 1000), int(keep * 1000)), OUTCOME)


# --- snapshots ---------------------------------------------------------------------------------------------------------

CHANGE = "kind string, bucket int, id string, round long, change string, body string"


class _Differences(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "id string", "body string, round long")
        self.closed = handle.getValueState("closed", "round long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803, ARG002
        closed = self.closed.get()[0] if self.closed.exists() else None
        for row in sorted(rows, key=lambda r: (r.round, r.id is None, r.id or "", r.body or "")):  # a bucket's rows of one batch
            if closed is not None and row.round <= closed:
                continue
            if row.id is None:
                gone = [(k[0], v[0]) for k, v in self.known.iterator() if v[1] < row.round]
                for own, body in gone:
                    self.known.removeKey((own,))
                    yield Row(kind=key[0], bucket=key[1], id=own, round=row.round, change="gone", body=body)
                closed = row.round
                self.closed.update((closed,))
                continue
            before = self.known.getValue((row.id,))
            self.known.updateValue((row.id,), (row.body, row.round))
            if before is None or before[0] != row.body:
                yield Row(kind=key[0], bucket=key[1], id=row.id, round=row.round, change="added" if before is None else "changed", body=row.body)

    def close(self) -> None:
        pass


def in_buckets(objects: DataFrame, rounds: DataFrame, buckets: int) -> DataFrame:
    """objects: kind, id, round, body; rounds: kind, round, that are listed whole. The objects dealt out by id, and behind each bucket's a row without id that closes the round there, so that what is not
    among them is known to have gone."""
    own = objects.where(F.col("id").isNotNull()).select("kind", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"), F.col("round").cast("long").alias("round"), F.col("id").cast("string").alias("id"), "body")
    marks = rounds.select("kind", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.col("round").cast("long").alias("round"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("body"))
    return own.unionByName(marks)


def differences(rows: DataFrame) -> DataFrame:
    """rows, a stream as ``in_buckets`` gives it. What was added, changed or gone since the round before: (kind, bucket, id, round, change, body), the last body of what has gone. A round's objects may
    come over several batches, its closing rows with the last of them; rows of a closed round are left out. An object that has gone leaves the state."""
    return _with_state(rows, ["kind", "bucket"], _Differences(), CHANGE, "None")
