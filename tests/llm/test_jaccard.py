import random
import re

import numpy as np
import pyarrow as pa

from pagewright.llm import jaccard, tiles
from pagewright.llm.pieces import text_buffer


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def brute(rows):
    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                links[i] += 1
                links[j] += 1
                parent[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, links[i], least.get(top(i))) for i, (d, _) in enumerate(rows)]


def make_rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghié") for _ in range(rng.randrange(1, 7)))
    say = lambda n: [word() for _ in range(n)]
    texts = [None, "", " \n", "one", "one", "one two", "one  two", "a b c d e", "a b c d e", "a b c d f"]
    passage = say(60)
    for size in (8, 20, 40, 120, 300):
        base = say(size)
        for _ in range(14):
            own = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, size // 20))):
                own[rng.randrange(size)] = word()
            texts.append(rng.choice((" ", "\n")).join(own))
    texts += [" ".join(say(30) + passage + say(20)) for _ in range(12)]
    texts += [" ".join(say(rng.randrange(1, 80))) for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)]


def test_links_match_brute_force(spark):
    rows = make_rows()
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, item int, copies string")
    got = jaccard.links(frame).collect()
    assert sorted(tuple(r)[:3] for r in got) == sorted(brute(rows))
    assert all(r.kept == (r.doc_id == r.group_id) for r in got)


def test_large_groups_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 3)
    rows = make_rows()
    assert sorted(tuple(r)[:3] for r in jaccard.links(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == sorted(brute(rows))


def test_one_of_each_group_stays(spark):
    rows = make_rows() + [(3, "one"), (7, "a b c d e"), (None, "a b c d e"), (None, None)]
    frame = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, least string")
    out = jaccard.one_of_each(frame)
    assert out.columns == frame.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    groups = {g if g is not None else ("alone", i) for i, ((_, t), (_, _, g)) in enumerate(zip(rows, brute(rows), strict=True)) if grams(t)}
    assert len([t for _, t in kept if grams(t)]) == len(groups)
    assert sorted(d for d, t in kept if grams(t)) == sorted(groups)
    assert len([t for _, t in kept if not grams(t)]) == 4  # texts without words all stay
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.links(empty).count() == 0 and jaccard.one_of_each(empty).count() == 0


def test_pruning_keeps_alike_pairs_and_drops_others():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    alike = base.copy()
    alike[:40] = rng.integers(0, 2**63, 40).astype(np.uint64)  # similarity 360 / 440
    half = base.copy()
    half[:200] = rng.integers(0, 2**63, 200).astype(np.uint64)  # 1 / 3
    values = jaccard.signatures(np.concatenate([base, alike, half]), np.array([0, 400, 800, 1200]))
    a, b = jaccard.likely_pairs(values, np.array([0, 0, 1]), np.array([1, 2, 2]))
    assert (0, 1) in set(zip(a.tolist(), b.tolist())) and (0, 2) not in set(zip(a.tolist(), b.tolist()))


def test_long_words_are_told_apart():
    thue = "".join("ab"[bin(i).count("1") & 1] for i in range(65536))
    texts = [w for n in (17, 1024, 2048, 65536) for w in (thue[:n], thue[:n].translate({97: 98, 98: 97}))] + ["x" * 16, "x" * 17, "x" * 15, "x" * 15 + "\0"]
    hashes, bounds = jaccard.shingles(*text_buffer(pa.array(texts)))
    assert len(set(hashes.tolist())) == len(texts) == len(hashes)
    again, _ = jaccard.shingles(*text_buffer(pa.array(["y " + x + " z" for x in texts])))
    assert len(set(again.tolist())) == len(texts)


def test_shingles_of_each_text_stand_apart():
    texts = ["a b c d e f", "", "b c", "\x0ba b c d e", "é"]
    hashes, bounds = jaccard.shingles(*text_buffer(pa.array(texts)))
    assert np.diff(bounds).tolist() == [2, 0, 1, 1, 1]
    assert hashes[0] == hashes[bounds[3]] and len(set(hashes.tolist())) == 4


def test_clashing_columns_and_very_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long, 5, "p", 9), (2, long + " end", 6, "q", 8), (3, "x" * 200_000, 7, "r", 7), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __pw_item int, c0 string, copies int")
    out = jaccard.one_of_each(frame)
    assert out.columns == frame.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(r) for i, r in enumerate(rows) if i != 1)


def test_a_chain_is_compared_by_buckets(spark):
    """Each text shares most words with the next, none is near enough: what is compared grows with the buckets, not with the chain's square."""
    from pyspark.sql import functions as F

    from pagewright.llm.tiles import members

    n, every = 3000, [f"w{i}" for i in range(3000 * 8 + 60)]
    frame = spark.createDataFrame([(i, " ".join(every[8 * i : 8 * i + 40])) for i in range(n)], "doc_id long, text string")  # 28 of 44 shingles in common
    assert jaccard.links(frame).filter("n_links > 0").count() == 0
    text = frame.select("text", F.xxhash64("text").alias("item"), F.xxhash64(F.lit(1), "text").alias("item2"), "doc_id")
    signed = text.mapInArrow(jaccard._signature_batches, "item long, item2 long, doc_id long, size int, values binary")
    keys = signed.select("item", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(jaccard.BANDS - 1)), lambda j: F.xxhash64(j, F.substr("values", j * 10 + 1, F.lit(10))))).alias("band", "key"))
    sizes = members(keys).groupBy("key", "low", "high").count()
    assert sizes.agg(F.sum(F.col("count") * F.col("count"))).first()[0] < 40 * n * 30
