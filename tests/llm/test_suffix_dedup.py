import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import suffix_dedup
from pagewright.llm.suffix_dedup import LENGTH


def brute(texts):
    """Counts every window of every text."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - LENGTH + 1):
            seen[d[i : i + LENGTH]] = seen.get(d[i : i + LENGTH], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - LENGTH + 1):
            if seen[d[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        rest = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), hashlib.sha256(rest).hexdigest()))
    return out


def make_texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, line, long = say(70), say(20), say(300)
    texts = [None, "", "short", long, long, long + "!", say(150)]
    texts += [f"{say(rng.randrange(60))} {passage} {say(rng.randrange(60))}" for _ in range(30)]
    texts += [f"{say(30)}\n{line}\n{say(30)}" for _ in range(25)]
    texts += [f"{say(9)} {passage[:rng.randrange(150, 300)]}{say(40)}" for _ in range(15)]
    words = long.split()
    for _ in range(12):
        words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += ["ab" * 300, "x" * 199, "y" * 200, "z" * 201, "é" * 150, passage + " " + passage]
    return texts


def test_digests_match_brute_force(spark):
    texts = make_texts()
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, key string, marks string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(frame).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("most", [1, 3])
def test_many_snippets_are_split_and_counted(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_dedup, "MOST_SNIPPETS", most)
    texts = make_texts() + ["ab cd " * 200, "line of words\n" * 90, "x " + "line of words\n" * 40]
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(frame).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_repeated_rows_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(90))
    rows = [(1, text), (1, text), (None, text), (None, "a" + text[:250]), (2, "b" + text[:250]), (2, None)]
    got = sorted(suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert [tuple(r) for r in got] == sorted(brute([t for _, t in rows]))
    assert suffix_dedup.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_keep_columns(spark):
    texts = make_texts()
    frame = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n long")
    out = suffix_dedup.without_repeats(frame)
    assert out.columns == frame.columns
    got = {r.doc_id: r.text for r in out.collect()}
    want = brute(texts)
    for i, t in enumerate(texts):
        if want[i][1] == 0:
            assert got[i] == (t or "")
        assert len(got[i].encode()) <= want[i][0] - want[i][1]


def test_same_digests_however_rows_are_dealt(spark):
    texts = make_texts()
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    want = brute(texts)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, dealt in ((1, frame.coalesce(1)), (7, frame.repartition(5)), (3, frame.orderBy(F.desc("doc_id")))):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digests(dealt).collect()}
            assert [got[i] for i in range(len(texts))] == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_clashing_columns_and_very_long_texts(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(120_000))
    rows = [(1, "a", long, 3, -1, None), (2, "b", "x" + long[60_000:60_400] + "y", 4, -2, 7), (3, "c", "z" * 150_000, 5, -3, 8), (None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, __pw_class string, text string, __pw_marks int, c0 int, key int")
    out = suffix_dedup.without_repeats(frame)
    assert out.columns == frame.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].text == long[:60_000] + long[60_400:] and got[2].text == "xy" and got[3].text == "" and got[None].text == ""
    assert [tuple(got[i])[1::2] for i in (1, 2, 3)] == [("a", 3, None), ("b", 4, 7), ("c", 5, 8)] and [got[i].c0 for i in (1, 2, 3)] == [-1, -2, -3]
