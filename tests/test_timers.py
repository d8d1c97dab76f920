"""Streams with state and timers: heartbeats without input, tasks that end once, differences between snapshots; each also over a restart."""

import json
import random
import time

import pytest

from pagewright.streaming import timers

COUNTS = "queue string, profile string, at double, in_inbox long, busy long, failed long, duplicates long"
TASKS = "task string, at double, answer string, content string"
ROWS = "kind string, bucket int, round long, id string, body string"


class Stream:
    """A folder of inputs and a query over it that can be stopped and started again from its checkpoint."""

    def __init__(self, spark, root, shape, step, seconds=0.5):
        self.spark, self.root, self.shape, self.step, self.seconds, self.n = spark, root, shape, step, seconds, 0
        (root / "in").mkdir()

    def put(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.shape).coalesce(1).write.parquet(f"{self.root}/in/{self.n}")

    def _writer(self):
        rows = self.spark.readStream.schema(self.shape).parquet(f"{self.root}/in/*")
        return self.step(rows).writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/checkpoint").outputMode("append")

    def drain(self):
        query = self._writer().trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    def run(self, until, seconds=60):
        query = self._writer().trigger(processingTime=f"{int(self.seconds * 1000)} milliseconds").start()
        end = time.time() + seconds
        try:
            while not until(self.rows()):
                assert query.exception() is None and time.time() < end
                time.sleep(0.3)
        finally:
            query.stop()
        return self.rows()

    def rows(self):
        try:
            return sorted((r.asDict() for r in self.spark.read.parquet(f"{self.root}/out").collect()), key=str)
        except Exception:  # nothing written yet
            return []


@pytest.fixture
def two(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_snapshot():
    state = json.loads(timers.snapshot({"b": (3, 1, 4, 2), "a": (1, 5, 0, 0)}))
    assert list(state["profiles"]) == ["a", "b"] and state["profiles"]["a"] == {"waiting": 0, "processing": 1, "failed": 0, "duplicates": 0}
    assert (state["queued"], state["waiting"], state["processing"], state["failed"], state["duplicates"]) == (4, 2, 2, 4, 2)


def test_reports_and_heartbeats_over_a_restart(spark, tmp_path, two):
    stream = Stream(spark, tmp_path, COUNTS, lambda rows: timers.queue_reports(rows, 3.0))
    stream.put([("q", "p", 1.0, 3, 1, 0, 0), ("q", "p", 2.0, 5, 1, None, 0)])
    first = stream.run(lambda rows: len(rows) >= 2)
    assert [r["reason"] for r in first[:2]] == ["change", "heartbeat"] and json.loads(first[0]["state"])["queued"] == 5
    stream.put([("q", "p", 3.0, 5, 1, 0, 0)])  # the same snapshot: no report of its own
    second = stream.run(lambda rows: len(rows) > len(first))
    assert {r["reason"] for r in second[len(first) :]} == {"heartbeat"}
    stream.put([("q", None, 4.0, 1, 0, 0, 0)])
    last = stream.run(lambda rows: sum(r["reason"] == "change" for r in rows) == 2)
    assert sorted(r["number"] for r in last) == list(range(1, len(last) + 1))  # none twice, none left out
    ordered = sorted(last, key=lambda r: r["number"])
    assert all(b["at_ms"] - a["at_ms"] >= 3000 for a, b in zip(ordered, ordered[1:], strict=False) if b["reason"] == "heartbeat")
    assert len({r["state"] for r in last}) == 2


def test_what_a_status_means():
    assert timers.outcome("STARTED", 5, "x", False, None) is None
    assert timers.outcome("SUCCESS", 5, "duplicate", True, 4) == ("created", 5, None)
    assert timers.outcome("REVOKED", None, "gone", False, None) == ("failed", None, "gone")
    assert timers.outcome("FAILURE", None, "duplicate (#4)", True, 4) == ("duplicate", 4, "duplicate (#4)")


def test_tasks_end_once_over_restarts(spark, tmp_path, two):
    stream = Stream(spark, tmp_path, TASKS, lambda rows: timers.task_outcomes(rows, 12.0))
    done, dup = '{"status":"success","result_data":{"document_id":7}}', '{"status":"FAILURE","result":"Not consuming: it is a duplicate of X (#31)."}'
    stream.put([("good", 1.0, None, "its text"), ("good", 2.0, '{"status":"STARTED"}', None), ("bad", 1.0, None, "t"), ("twice", 1.0, None, "t"), ("slow", 1.0, None, "late text"), ("odd", 1.0, '{"status":', None)])
    stream.run(lambda _: any((tmp_path / "checkpoint" / "commits").glob("[0-9]*")))
    assert stream.rows() == []
    stream.put([("good", 3.0, done, None), ("good", 4.0, dup, None), ("bad", 3.0, '{"status":"FAILURE","result":"broken file"}', None), ("twice", 2.0, dup, None)])
    got = {r["task"]: r for r in stream.run(lambda rows: len(rows) >= 5)}
    ends = {k: (r["outcome"], r["document"], r["content"]) for k, r in got.items()}
    assert ends == {"good": ("created", 7, "its text"), "bad": ("failed", None, None), "twice": ("duplicate", 31, None), "slow": ("timed out", None, None), "odd": ("timed out", None, None)}
    assert got["bad"]["message"] == "broken file"
    stream.put([("good", 9.0, done, None), ("slow", 5.0, done, None), ("odd", 6.0, None, None)])  # known ends; an answer that comes late; waited for again
    stream.put([("slow", 10.0, None, None), ("slow", 11.0, done, None)])
    last = stream.run(lambda rows: sum(r["task"] == "slow" for r in rows) == 2)
    assert sorted((r["task"], r["outcome"]) for r in last if r["task"] != "odd") == [("bad", "failed"), ("good", "created"), ("slow", "created"), ("slow", "timed out"), ("twice", "duplicate")]
    assert [r["content"] for r in last if r["task"] == "slow" and r["outcome"] == "created"] == ["late text"]


def brute(rounds):
    known, out = {}, []
    for number, objects in rounds:
        out += [(i, number, "added" if i not in known else "changed", b) for i, b in objects.items() if known.get(i, "") != b or i not in known]
        out += [(i, number, "gone", b) for i, b in known.items() if i not in objects]
        known = dict(objects)
    return sorted(out, key=str)


def test_three_rounds_give_each_change_once(spark, tmp_path, two):
    stream = Stream(spark, tmp_path, ROWS, timers.differences)
    rng = random.Random(9)
    rounds = [(n, {f"o{i}": rng.choice(["a", "b", None]) for i in range(30) if rng.random() < 0.6}) for n in (1, 2, 5, 6)]
    for n, (number, objects) in enumerate(rounds):
        listed = spark.createDataFrame([("tags", i, number, b) for i, b in objects.items()] + [("tags", None, number, "x")], "kind string, id string, round long, body string")
        placed = timers.in_buckets(listed, spark.createDataFrame([("tags", number)], "kind string, round long"), 3).select(*(c.split()[0] for c in ROWS.split(", ")))
        parts = placed.where("id is not null").collect(), placed.where("id is null").collect()
        for some in parts if n % 2 else (parts[0] + parts[1],):  # a round over two batches, with a restart between
            stream.put(some)
            stream.drain()
        stream.put([("tags", 0, number, "late", "x")])
    stream.drain()
    assert sorted(((r["id"], r["round"], r["change"], r["body"]) for r in stream.rows()), key=str) == brute(rounds)
