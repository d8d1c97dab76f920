"""Documents written as a committed job: nothing of a job that fails, all of one that is decided."""

import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pagewright.sinks import committed as cm

SHAPE = "plan string, number long, folder string, stem string, suffix string, content binary"


def there(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(root) if "/." not in d[len(str(root)) :] for f in fs}


def put(spark, root, rows):
    cm.write_committed(spark.createDataFrame(rows, SHAPE), str(root))


def plan(name, *contents, folder="in", stem="Letter"):
    return [(name, i, folder, stem, ".pdf", c) for i, c in enumerate(contents)]


def recorded(spark, root):
    return {(r.plan, r.number): (r.name, r.sha256) for r in cm.records(spark, str(root)).collect()}


def test_free_names_and_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Letter.pdf").write_bytes(b"foreign")
    put(spark, tmp_path, plan("a", b"one", b"two") + plan("b", b"three", folder="in/deep") + [("c", 1, None, None, None, None)])
    assert there(tmp_path) == {"in/Letter.pdf": b"foreign", "in/Letter (2).pdf": b"one", "in/Letter (3).pdf": b"two", "in/deep/Letter.pdf": b"three", "Document": b""}
    assert recorded(spark, tmp_path)["a", 1] == ("in/Letter (3).pdf", hashlib.sha256(b"two").hexdigest())
    assert os.listdir(tmp_path / ".staging") == []


def test_a_rerun_changes_nothing(spark, tmp_path):
    rows = plan("a", b"one", b"two", b"two") + plan("b", b"other")
    put(spark, tmp_path, rows)
    before = {n: os.stat(tmp_path / n).st_mtime_ns for n in there(tmp_path)}
    known = recorded(spark, tmp_path)
    put(spark, tmp_path, rows)
    assert {n: os.stat(tmp_path / n).st_mtime_ns for n in there(tmp_path)} == before and recorded(spark, tmp_path) == known
    put(spark, tmp_path, [])
    assert recorded(spark, tmp_path) == known


def test_a_new_run_replaces_only_what_still_is_its_own(spark, tmp_path):
    put(spark, tmp_path, plan("a", b"one", b"two", b"three", b"four"))
    (tmp_path / "in" / "Letter (2).pdf").write_bytes(b"edited by hand")
    (tmp_path / "in" / "Letter (3).pdf").unlink()
    put(spark, tmp_path, plan("a", b"new", b"four"))
    assert there(tmp_path) == {"in/Letter.pdf": b"new", "in/Letter (2).pdf": b"edited by hand", "in/Letter (4).pdf": b"four"}
    assert {k: v[0] for k, v in recorded(spark, tmp_path).items()} == {("a", 0): "in/Letter.pdf", ("a", 1): "in/Letter (4).pdf"}


def test_a_failing_task_leaves_nothing_visible(spark, tmp_path):
    put(spark, tmp_path, plan("a", b"one"))
    before = there(tmp_path), recorded(spark, tmp_path)
    good = spark.createDataFrame(plan("a", b"new") + [(f"p{i}", 1, "in", "x", ".pdf", b"y") for i in range(50)], SHAPE)
    with pytest.raises(PySparkException):
        cm.write_committed(good.withColumn("content", F.when(F.col("plan") == "p7", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content"))), str(tmp_path))
    for folder, stem in (("../out", "x"), ("in/../../out", "x"), ("in", "../x"), ("in", ".hidden")):
        with pytest.raises(PySparkException):
            put(spark, tmp_path, plan("a", b"new") + [("z", 1, folder, stem, ".pdf", b"out")])
    assert (there(tmp_path), recorded(spark, tmp_path)) == before and not (tmp_path.parent / "out").exists()


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", range(14))
def test_a_crash_in_the_commit_is_made_good(tmp_path, monkeypatch, step):
    """The same job in one process, stopped at its n-th step: what recovers is what would have been without a stop."""

    def run(root, rows):
        writer = cm._DocumentWriter({"root": str(root)})
        names = cm.DocumentSink.schema(None).replace(" string", "").replace(" long", "").replace(" binary", "").split(", ")
        Row = __import__("collections").namedtuple("Row", names)
        writer.commit([writer.write(iter([Row(*r) for r in rows]))])

    first, second = plan("a", b"one", b"two", b"three") + plan("b", b"x"), plan("a", b"two", b"new", b"newer") + plan("b", b"y")
    for root in (tmp_path / "whole", tmp_path / "stopped"):
        root.mkdir()
        run(root, first)
    run(tmp_path / "whole", second)
    left = [step]

    def counted(f):
        def own(*args, **options):
            left[0] -= 1
            if left[0] == -1:
                raise Stop
            return f(*args, **options)

        return own

    monkeypatch.setattr(cm._Record, "add", counted(cm._Record.add))
    monkeypatch.setattr(cm._Record, "begin", counted(cm._Record.begin))
    monkeypatch.setattr(cm._Forward, "_unlink", staticmethod(counted(cm._Forward._unlink)))
    monkeypatch.setattr(cm.os, "link", counted(os.link))
    try:
        run(tmp_path / "stopped", second)
        stopped = False
    except Stop:
        stopped = True
    monkeypatch.undo()
    assert len(cm.recover(str(tmp_path / "stopped"))) == stopped
    assert there(tmp_path / "stopped") == there(tmp_path / "whole") and os.listdir(tmp_path / "stopped" / ".staging") == []
    plans = [cm._Record(str(tmp_path / r), p).files for r in ("whole", "stopped") for p in "ab"]
    assert plans[:2] == plans[2:]


def test_undecided_jobs_are_swept_when_they_are_old(tmp_path):
    (tmp_path / ".staging" / "j").mkdir(parents=True)
    assert cm.recover(str(tmp_path)) == [] and (tmp_path / ".staging" / "j").exists()
    assert cm.recover(str(tmp_path), now=lambda: 9e12) == [] and not (tmp_path / ".staging" / "j").exists()
    assert cm.recover(str(tmp_path / "none")) == []
