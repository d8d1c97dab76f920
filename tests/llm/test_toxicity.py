import random

import numpy as np
import pytest

from pagewright.llm import toxicity


def make(n=500, seed=3):
    """Texts of invented words; toxic ones hold a bad word, disguised in every third."""
    rng = random.Random(seed)
    syllables = ["ta", "ri", "mo", "len", "sha", "du", "ke", "pos", "in", "er"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    hide = lambda w: rng.choice([w.replace("o", "0").replace("i", "1"), " ".join(w), w[0] + w[1] * 4 + w[2:], ".".join(w)])
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(5, 40))]
        toxic = int(i % 4 == 0)
        if toxic:
            bad = rng.choice(["gnorbel", "fwizzo", "kvatschi"])
            words.insert(rng.randrange(len(words)), hide(bad) if i % 12 == 8 else bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = make()
    docs = spark.createDataFrame([*((i, t, "x") for i, t in rows), (9001, None, "x"), (9002, "", "x"), (None, "gnorbel", "x"), (9003, "GNORBEL!!!", None), (9003, "GNORBEL!!!", None)], "doc_id long, text string, score string")
    return toxicity.score(docs, spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")).collect(), rows, dict((i, t) for i, _, t in labels)


def test_held_out_texts(scored):
    import zlib

    got, rows, truth = scored
    assert len(got) == len(rows) + 5
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.97 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    hidden = [r for r in got if r.doc_id in truth and r.doc_id % 12 == 8]
    assert sum(r.predicted for r in hidden) / len(hidden) > 0.85


def test_other_texts(scored):
    own = {}
    for r in scored[0]:
        own.setdefault(r.doc_id, []).append(r.predicted)
    assert own[9001] == own[9002] == [0] and own[9003] == [1, 1] and own[None] == [1]


def test_restores_words():
    text = " ".join(["stupid", "loser", "moron", "nation", "letter", "cool", "idiot", "clown", "hello", "trash"] * 50)
    from pagewright.llm.pieces import text_buffer
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array([text])], names=["t"])]
    out = next(toxicity._count_batches(iter(batches)))
    counts = np.zeros(toxicity.LETTERS**3)
    counts[out.column(0).to_numpy()] = out.column(1).to_numpy()
    three = counts.reshape([toxicity.LETTERS] * 3)
    model = np.log((three + 0.01) / (three.sum(axis=2, keepdims=True) + 0.64)).astype(np.float32).ravel()
    for seen, want in (("l0ser", "loser"), ("stuuuupid", "stupid"), ("m0r0n", "moron"), ("s.t.u.p.i.d", "stupid"), ("1d10t", "idiot"), ("le++er", "letter"), ("c001", "cool"), ("tr@$h", "trash"), ("hellllo", "hello")):
        assert want in toxicity.readings(seen, model), seen
    assert toxicity.readings("nation,", model) == ["nation"]
    assert text_buffer(pa.array([text]))[1].tolist() == [0, len(text)]


def test_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in toxicity.score(docs, none).collect()] == [(1, False, 0.0, 0)]
    assert toxicity.score(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0


def test_two_words_of_one_share_count_as_two():
    import pyarrow as pa

    counts = np.zeros(toxicity.LETTERS**3)
    out = next(toxicity._count_batches(iter([pa.RecordBatch.from_arrays([pa.array([" ".join(["gnorbel", "fwizzo", "nation", "letter"] * 50)])], names=["t"])])))
    counts[out.column(0).to_numpy()] = out.column(1).to_numpy()
    three = counts.reshape([toxicity.LETTERS] * 3)
    model = np.log((three + 0.01) / (three.sum(axis=2, keepdims=True) + 0.64)).astype(np.float32).ravel()
    scorer = toxicity.Scorer({"gnorbel": 0.9, "fwizzo": 0.9, "gnorb~": 0.9, "lette~": 0.6}, model)
    assert scorer.top_two("a gnorbel and fwizzo letter") == (0.9, 0.9)
    assert scorer.top_two("a gnorbel and f w i z z o") == (0.9, 0.9)
    assert scorer.top_two("gnorbel GNORBEL! gn0rbel g n o r b e l x") == (0.9, 0.0)
    assert scorer.top_two("gnorbel Gnorbel, letter") == (0.9, 0.6)
    assert scorer.top_two("nation") == scorer.top_two("") == (0.0, 0.0)


def sharp_model(words):
    import pyarrow as pa

    counts = np.zeros(toxicity.LETTERS**3)
    out = next(toxicity._count_batches(iter([pa.RecordBatch.from_arrays([pa.array([f"{w}\n\n" for w in words])], names=["t"])])))
    counts[out.column(0).to_numpy()] = out.column(1).to_numpy()
    three = counts.reshape([toxicity.LETTERS] * 3)
    return np.log((three + 0.01) / (three.sum(axis=2, keepdims=True) + 0.64)).astype(np.float32).ravel()


def path_score(path, model):
    """Of (reading, cost) pairs: log probability of the word with its edges, less the costs."""
    codes = [0, 0, *(toxicity.letter(c) for text, _ in path for c in text), 0]
    total = -sum(cost for _, cost in path)
    return total + sum(float(model[(a * toxicity.LETTERS + b) * toxicity.LETTERS + c]) for a, b, c in zip(codes, codes[1:], codes[2:]))


def test_viterbi_finds_the_best_of_all_paths():
    from itertools import product

    model = sharp_model(["stupid", "loser", "moron", "nation", "letter", "cool", "idiot", "été", "straße"] * 20)
    rng = random.Random(9)
    tokens = ["l0ser", "m00r0n", "s.t.u.p.i.d", "1d1!0t", "le++er", "", "...", "ÉTÉ", "5tra$$e", "aaa111", "|-|e"]
    tokens += ["".join(rng.choice("aeilost01!$.-_3+|é9x") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    for token in tokens:
        paths = list(product(*toxicity.lattice(token)))
        assert len(paths) < 60_000
        best = max(path_score(p, model) for p in paths)
        word = toxicity.restore(token, model)
        own = max(path_score(p, model) for p in paths if "".join(x for x, _ in p) == word)
        assert own == pytest.approx(best, abs=1e-4), (token, word)


def plain_scores(rows, labels):
    """The whole operator in plain loops: counts, features, cross-scored halves, a logistic function by gradient steps."""
    import math
    import zlib

    size = toxicity.LETTERS
    three = np.zeros((size, size, size))
    for _, text in rows:
        codes = [0, 0, *map(toxicity.letter, text.lower()), 0, 0]
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            three[a, b, c] += 1
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + size)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    model = np.log((three + 20 * p2) / (three.sum(axis=2, keepdims=True) + 20)).astype(np.float32).ravel()

    def half(text):
        import xxhash

        value = xxhash.xxh64_intdigest(text.encode(), 42)
        return value % 2  # the same for the signed number

    truth = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    known = sorted({(text, truth[i], half(text)) for i, text in rows if i in truth})
    prior = sum(t for _, t, _ in known) / len(known)
    counts = {}
    for text, t, h in known:
        words = {w for token in text.split() for w in toxicity.readings(token, model)}
        for f in {x for w in words for x in (w, *(w[:k] + "~" for k in (4, 5, 6) if len(w) >= k))}:
            own = counts.setdefault(f, [[0, 0], [0, 0]])
            own[h][0] += t
            own[h][1] += 1

    def table(halves):
        out = {}
        for f, own in counts.items():
            t, n = (sum(own[h][k] for h in (0, 1)) for k in (0, 1))
            if n >= 3 and (t + 8 * prior) / (n + 8) > min(0.5, 2 * prior):
                t, n = (sum(own[h][k] for h in halves) for k in (0, 1))
                if n:
                    out[f] = (t + 8 * prior) / (n + 8)
        return out

    def logits(pair):
        return [math.log((q := min(max(p, 0.01), 0.99)) / (1 - q)) for p in pair]

    scorers = [toxicity.Scorer(table(halves), model) for halves in ((1,), (0,), (0, 1))]
    x = np.array([[1.0, *logits(scorers[h].top_two(text))] for text, _, h in known])
    y, w, ridge = np.array([t for _, t, _ in known]), np.zeros(3), np.array([1e-3, 1.0, 1.0])
    for _ in range(60_000):
        w += 2.0 / len(known) * 0.5 * (x.T @ (y - 1 / (1 + np.exp(-x @ w))) - ridge * w)
    return {i: 1 / (1 + math.exp(-(w[0] + np.dot(w[1:], logits(scorers[2].top_two(text)))))) for i, text in rows}


def test_scores_match_a_plain_recomputation(spark):
    rows, labels = make(240, seed=4)
    want = plain_scores(rows, labels)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for some in (docs.repartition(3), docs.coalesce(1)):
        got = {r.doc_id: r.score for r in toxicity.score(some, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
        assert got == pytest.approx(want, abs=2e-4)


def test_repeated_ids_and_ties_keep_the_sample_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_LABELLED", 30)
    rows, labels = make(60, seed=5)
    docs = spark.createDataFrame([(i, f"{t} w{k}") for i, t in rows for k in range(20)], "doc_id long, text string")
    model = np.zeros(toxicity.LETTERS**3, np.float32)
    sized = []
    fit = toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y, **k: (sized.append(len(x)), fit(x, y, **k))[1])
    toxicity.train(docs, spark.createDataFrame(labels + labels, "doc_id long, quality int, toxic int"), model)
    assert sized == [30]


def test_long_texts_and_tokens():
    import time

    scorer = toxicity.Scorer({"gnorbel": 0.9, "gnorb~": 0.8}, sharp_model(["gnorbel", "nation"] * 9), most_chars=10_000)
    began = time.process_time()
    assert scorer.top_two("x y " * 20_000 + "g n o r b e l") == (0.9, 0.0)
    assert scorer.top_two("a1" * 50_000 + " gnorbel " + "b" * 100_000)[0] == 0.9
    for i in range(300):
        scorer.top_two(f"word{i}" * 20)
    assert scorer.chars <= 10_200 and time.process_time() - began < 20


def test_the_least_rows_without_a_sort_of_all(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 30_000, 1, 40).withColumn("hash", F.xxhash64("id"))
    for most in (1, 500, 29_999, 30_000, 40_000):
        want = sorted((r.hash, r.id) for r in rows.collect())[:most]
        assert sorted((r.hash, r.id) for r in toxicity.least_rows(rows, ["hash", "id"], most).collect()) == want
    few = toxicity.least_rows(rows, ["hash", "id"], 500)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan  # what partitions send is what the bound leaves
    same = spark.range(2000).withColumn("hash", F.lit(2**62))
    assert toxicity.least_rows(same, ["hash", "id"], 100).agg(F.max("id")).first()[0] == 99
