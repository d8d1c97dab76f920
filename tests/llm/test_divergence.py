import random
import re

from pagewright.llm import divergence

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def brute(rows, min_docs, top):
    terms = [(lang or "", source or "", re.findall(TERM, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = []
    for lang in {x[0] for x in terms}:
        own = [x for x in terms if x[0] == lang]
        docs = {t: sum(t in x[2] for x in own) for x in own for t in x[2]}
        kept = sorted(t for t, n in docs.items() if n >= min_docs)
        sources = sorted({x[1] for x in own})
        count = {(s, t): sum(x[2].count(t) for x in own if x[1] == s) for s in sources for t in kept}

        def share(n, total, kept=kept):
            return 1 + 10**9 * (n + 5) // (total + 5 * len(kept))

        p = {(s, t): share(count[s, t], sum(count[s, u] for u in kept)) for s in sources for t in kept}
        whole = {t: sum(count[s, t] for s in sources) for t in kept}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s, t] - p[o, t]) for t in kept)) for o in sources if o != s]
            marks = [(t, p[s, t] - q[t]) for t in kept if count[s, t] and p[s, t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", marks, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def made(spark, rows):
    return spark.createDataFrame([(i, *x, "z") for i, x in enumerate(rows)], "doc_id long, lang string, source string, text string, term string")


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = ["Alpha", "ALPHA", "beta", "gamma9delta", "Été", "été", "straße", "日本", "don't", "\U0001f600x", "Éa", "zz", "n\x00m"]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", "c", None]), " ".join(rng.choices(words, [9, 3, 5, 2, 4, 4, 1, 2, 3, 1, 1, 6, 1], k=rng.randrange(12)))) for _ in range(300)]
    rows += [("de", "only", "once"), ("de", "other", None), ("it", "alone", "eine " * 40), ("pt", None, ""), ("en", "a", "long " * 20_000), *[("en", "b", "same row again")] * 35]
    for least, top in ((30, 50), (3, 2)):
        got = sorted(map(tuple, divergence.audit(made(spark, rows), least, top).select("lang", "source", "part", "item", "value", "rank").collect()))
        assert got == brute(rows, least, top)
        assert {x[2] for x in got} == {"pair", "term"}


def test_equal_values_rank_by_bytes(spark):
    rows = [("x", s, t) for s, t in (("a", "é z ｚ \U00010000"), ("b", "")) for _ in range(30)]
    got = [x.item for x in divergence.audit(made(spark, rows)).where("part = 'term' and source = 'a'").orderBy("rank").collect()]
    assert got == []  # the language's own counts are the only source's
    rows += [("x", "b", "other")] * 30
    got = [x.item for x in divergence.audit(made(spark, rows)).where("part = 'term' and source = 'a'").orderBy("rank").collect()]
    assert got == ["z", "é", "ｚ", "\U00010000"]


def test_no_vocabulary_and_no_rows(spark):
    rows = [("x", "a", "word"), ("x", "b", "word"), ("x", None, None)]
    assert sorted(map(tuple, divergence.audit(made(spark, rows)).collect())) == [("x", "", "pair", "a", 0, 1), ("x", "", "pair", "b", 0, 2), ("x", "a", "pair", "", 0, 1), ("x", "a", "pair", "b", 0, 2), ("x", "b", "pair", "", 0, 1), ("x", "b", "pair", "a", 0, 2)]
    assert divergence.audit(made(spark, [])).count() == 0


def test_counts_beyond_longs_when_scaled(spark):
    frame = spark.sql("SELECT 4000000000000L AS n, 9000000000000L AS total, 7L AS terms").select(divergence._share("n", "total", "terms").alias("p"))
    assert frame.first().p == 1 + 10**9 * (4 * 10**12 + 5) // (9 * 10**12 + 35)
