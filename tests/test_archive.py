"""An inbox that cleans up: files are moved once, to where their outcome sends them."""

import os
import time

import pytest
from pyspark.sql import functions as F

from pagewright.streaming import archive


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


def put(root, **files):
    for name, content in files.items():
        path = root / name.replace("__", "/").replace("_pdf", ".pdf")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
        os.utime(path, (time.time(), time.time()))


def outcome(files):
    kind = F.when(F.startswith("content", F.lit(b"bad")), "failed").when(F.startswith("content", F.lit(b"dup")), "duplicate").otherwise("done")
    return files.select("path", kind.alias("outcome"))


@pytest.fixture
def run(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.ignoreMissingFiles")
    (tmp_path / "in").mkdir()
    seen = []

    def once(fail=False):
        def record(known, number):
            seen.extend((number, os.path.relpath(r.path.removeprefix("file:"), tmp_path / "in"), r.outcome) for r in known.collect())

        step = archive.router(str(tmp_path / "in"), str(tmp_path / "failed"), str(tmp_path / "dup"), outcome, record)

        def broken(batch, number):
            step(batch, number)
            raise RuntimeError("stopped")

        query = archive.watched(archive.inbox(spark, str(tmp_path / "in"), str(tmp_path / "archive")), broken if fail else step, str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        try:
            query.awaitTermination(60)
        except Exception:
            assert fail
        return seen

    yield once
    spark.conf.set("spark.sql.files.ignoreMissingFiles", before)


def test_files_are_moved_once_over_restarts(run, tmp_path):
    box = tmp_path / "in"
    put(box, a_pdf=b"good", sub__b_pdf=b"bad", sub__c_pdf=b"dup", **{".hidden__d_pdf": b"bad", "note.txt": b"bad"})
    put(tmp_path / "failed" / "sub", b_pdf=b"there before")
    run(fail=True)  # everything is moved, then the batch fails
    assert tree(box) == [".hidden/d.pdf", "a.pdf", "note.txt"]
    seen = run()  # the batch is repeated: nothing is left to move
    put(box, e_pdf=b"good", g_pdf=b"bad too")
    run()
    put(box, f_pdf=b"good")
    run()
    end = time.time() + 20
    while "e.pdf" in tree(box) and time.time() < end:
        time.sleep(0.2)
    assert tree(tmp_path / "failed") == ["g.pdf", "sub/b (2).pdf", "sub/b.pdf"] and tree(tmp_path / "dup") == ["sub/c.pdf"]
    assert {".hidden/d.pdf", "note.txt"} <= set(tree(box)) and not {"sub/b.pdf", "sub/c.pdf"} & set(tree(box))
    archived = [os.path.basename(x) for x in tree(tmp_path / "archive")]
    assert "a.pdf" in archived and not {"b.pdf", "c.pdf", "g.pdf"} & set(archived) and len(archived) == len(set(archived))
    assert sorted({(p, o) for _, p, o in seen}) == [("a.pdf", "done"), ("e.pdf", "done"), ("f.pdf", "done"), ("g.pdf", "failed"), ("sub/b.pdf", "failed"), ("sub/c.pdf", "duplicate")]


def test_moves_to_free_names(tmp_path):
    put(tmp_path, a_pdf=b"1", to__a_pdf=b"2")
    assert archive.move_free(str(tmp_path / "a.pdf"), str(tmp_path / "to")).endswith("to/a (2).pdf")
    assert archive.move_free(str(tmp_path / "a.pdf"), str(tmp_path / "to")) is None
    put(tmp_path, b_pdf=b"3")
    os.link(tmp_path / "b.pdf", tmp_path / "to" / "b.pdf")  # linked, and stopped before the old name went
    assert archive.move_free(str(tmp_path / "b.pdf"), str(tmp_path / "to")).endswith("to/b.pdf") and tree(tmp_path) == ["to/a (2).pdf", "to/a.pdf", "to/b.pdf"]
