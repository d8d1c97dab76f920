"""A ledger that is changed in place: against a plain dictionary, with crashes and two writers."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pagewright.sinks import ledger as lg

SHAPE = "k string, v long, note string"


def rows(frame):
    return sorted(map(tuple, frame.collect()))


def made(spark, some, shape=SHAPE):
    return spark.createDataFrame(some, shape)


@pytest.fixture
def ledger(spark, tmp_path):
    return lg.Ledger.create(spark, f"file://{tmp_path}/ledger", SHAPE, "k", 5)


def test_random_changes_against_a_dictionary(spark, ledger):
    rng, known = random.Random(7), {}
    for step in range(6):
        some = [(f"key{rng.randrange(60)}", rng.randrange(1000), rng.choice(["x", None, "é"])) for _ in range(rng.randrange(1, 50))]
        if step % 3 == 2:
            ledger.upsert(made(spark, some), order="v", insert=False, assign={"v": F.col("old.v") + F.col("new.v")}, delete=F.col("new.note") == "é")
        else:
            ledger.upsert(made(spark, some), order="v")
        for k in {k for k, _, _ in some}:
            best = max((r for r in some if r[0] == k), key=lambda r: (r[1], r[2] is not None, r[2] or ""))
            if step % 3 != 2:
                known[k] = best
            elif k in known and best[2] == "é":
                del known[k]
            elif k in known:
                known[k] = (k, known[k][1] + best[1], known[k][2])
        assert rows(ledger.read()) == sorted(known.values(), key=lambda r: r[0])
    assert ledger.version().number == 6


def test_old_versions_stay_readable_until_they_are_swept(spark, ledger):
    ledger.upsert(made(spark, [("a", 1, None), ("b", 2, None)]))
    ledger.upsert(made(spark, [("a", 5, "new")]))
    assert rows(ledger.read(1)) == [("a", 1, None), ("b", 2, None)]
    assert rows(ledger.read(2)) == [("a", 5, "new"), ("b", 2, None)]
    assert ledger.vacuum(keep=1) == []  # too young
    untouched = set(ledger.version().folders.values())
    gone = ledger.vacuum(keep=1, now=lambda: 9e12)
    assert ledger.versions() == [2] and all(not f.startswith(g) for f in untouched for g in gone)
    assert rows(ledger.read()) == [("a", 5, "new"), ("b", 2, None)]


def test_a_crash_before_the_manifest_leaves_the_version_before(spark, ledger, monkeypatch):
    ledger.upsert(made(spark, [("a", 1, None)]))

    def crash(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(ledger.files, "write_first", crash)
    with pytest.raises(KeyboardInterrupt):
        ledger.upsert(made(spark, [("a", 2, None), ("b", 1, None)]))
    monkeypatch.undo()
    assert rows(ledger.read()) == [("a", 1, None)]
    assert len(ledger.files.names(f"{ledger.folder}/data")) == 2
    ledger.upsert(made(spark, [("b", 7, None)]))
    assert rows(ledger.read()) == [("a", 1, None), ("b", 7, None)]
    assert len(ledger.vacuum(now=lambda: 9e12)) == 1 and rows(ledger.read()) == [("a", 1, None), ("b", 7, None)]


def test_a_task_that_fails_changes_nothing(spark, ledger):
    ledger.upsert(made(spark, [("a", 1, None)]))
    with pytest.raises(PySparkException):
        ledger.upsert(made(spark, [("b", 1, None)]).withColumn("note", F.raise_error(F.lit("broken")).cast("string")))
    with pytest.raises(PySparkException):
        ledger.upsert(made(spark, [(None, 1, None)]))
    assert ledger.version().number == 1 and rows(ledger.read()) == [("a", 1, None)]


def test_of_two_writers_one_is_refused(spark, ledger, monkeypatch):
    other, seen = lg.Ledger(spark, ledger.folder), ledger.version()
    first = ledger.files.write_first

    def meanwhile(*args):
        monkeypatch.setattr(ledger.files, "write_first", first)
        other.upsert(made(spark, [("a", 1, "other")]))
        return first(*args)

    monkeypatch.setattr(ledger.files, "write_first", meanwhile)
    with pytest.raises(lg.LedgerConflictError):
        ledger.upsert(made(spark, [("a", 2, "own")]))
    assert rows(ledger.read()) == [("a", 1, "other")] and len(ledger.files.names(f"{ledger.folder}/data")) == 1
    with pytest.raises(lg.LedgerConflictError):
        ledger.upsert(made(spark, [("b", 2, "own")]), base=seen)
    monkeypatch.setattr(ledger.files, "write_first", meanwhile)
    ledger.with_retries(lambda own: own.upsert(made(spark, [("b", 3, "again")])))
    assert rows(ledger.read()) == [("a", 1, "other"), ("b", 3, "again")]


def test_a_batch_of_a_stream_counts_once(spark, ledger):
    add = {"assign": {"v": F.col("old.v") + F.col("new.v")}}
    for batch in (0, 0, 1, 1, 0):
        ledger.upsert(made(spark, [("a", 10, None)]), stream="s", batch=batch, **add)
    ledger.upsert(made(spark, [("a", 1, None)]), stream="t", batch=0, **add)
    assert rows(ledger.read()) == [("a", 21, None)]
    assert ledger.version().batches == {"s": 1, "t": 0}


def test_uploads_and_archive(spark, tmp_path):
    own = lg.Ledger.create(spark, str(tmp_path / "u"), lg.UPLOADS, "sha", 3)
    assert own.read().count() == 0 and own.upsert(own.read()).number == 0
    files = made(spark, [("x", 1, "in/x.pdf"), ("y", 2, "in/y.pdf")], "sha string, document long, file string")
    lg.uploaded(own, files)
    lg.archived(own, made(spark, [("x",), ("unknown",)], "sha string"))
    lg.uploaded(own, made(spark, [("x", 9, "again.pdf"), ("z", 3, None)], "sha string, document long, file string"))
    assert rows(own.read()) == [("x", 1, "in/x.pdf", False), ("y", 2, "in/y.pdf", True), ("z", 3, None, True)]
    again = lg.Ledger.create(spark, str(tmp_path / "u"), lg.UPLOADS, "sha", 99)
    assert again.version().buckets == 3
