import re

from pyspark.sql import functions as F

from pagewright.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    grams = {}
    for i in range(n - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup, symbols, chars = len(lines) - len(set(lines)), len(re.findall(r"[#*$%&|<>]", text)), sum(map(len, words))
    base = n < 50 or 100 * len(covered) > 50 * n
    letters = sum(c.isalpha() for c in text)
    bad = base or chars < 2 * n or chars > 20 * n or 10 * symbols > n or 2 * dup > len(lines) or 2 * letters < chars
    return n, chars, symbols, dup, len(covered), base, not bad


def words(n, start=0):
    return " ".join(f"word{chr(97 + (i + start) % 26)}{chr(97 + (i + start) // 26 % 26)}{chr(97 + (i + start) // 676)}" for i in range(n))


TEXTS = [
    None, "", " \t\n", "a", "a b", "a a a", words(49), words(50), words(300), " " + words(60) + "\n", words(30) + " " + words(30), words(20) + " " + words(20) + " " + words(60, 100),
    "\n".join([words(12)] * 5), "\n".join(words(10, 10 * (i % 6)) for i in range(9)), words(60) + " # $ % & | < > *", words(60) + " 😀 é ö \x85", "1234 5678 " * 40 + words(50),
    "x" * 3000 + " " + words(55), words(2000), " ".join("a" for _ in range(20000)), "b c " * 9000 + words(400), "\x0b".join(["one", "two", "three"] * 30),
]


def test_counts_and_verdicts_match_brute_force(spark):
    rows = [*enumerate(TEXTS), (3, "a"), (None, words(70))]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_words string, kept int")
    got = sorted(map(str, map(tuple, quality.judge(frame).collect())))
    assert got == sorted(str((i, *brute(t))) for i, t in rows)


def test_only_good_documents_stay(spark):
    rows = [*enumerate(TEXTS)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    out = quality.keep_good(frame)
    assert out.columns == frame.columns
    assert sorted(r.doc_id for r in out.collect()) == [i for i, t in rows if brute(t)[-1]]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_order_changes_no_verdict(spark):
    frame = spark.createDataFrame([*enumerate(TEXTS)], "doc_id long, text string")
    rules = quality.order_rules(frame)
    assert sorted(r.name for r in rules) == sorted(r.name for r in quality.RULES)
    every = (*quality.BASE_RULES, *quality.RULES)
    kept = [{r.doc_id for r in quality.keep_good(frame, some, sample_rows=5).collect()} for some in (every, every[::-1])]
    assert kept[0] == kept[1]


def test_cheap_strict_rules_come_before_costly_lax_ones(spark):
    frame = spark.createDataFrame([(i, words(200, i)) for i in range(60)], "doc_id long, text string")
    costly = lambda c: F.length(F.regexp_replace(F.repeat(quality._TEXT, 40), r"(w)(o)(r)(d)", "$4$3$2$1")) < 0
    lax = quality.Rule("costly_lax", costly)
    strict = quality.Rule("cheap_strict", lambda c: c.n_words() > 0)
    rare = quality.Rule("cheap_lax", lambda c: c.n_words() < 0)
    costly_strict = quality.Rule("costly_strict", lambda c: ~costly(c))
    for rules in ([lax, strict, rare], [rare, lax, strict]):
        assert [r.name for r in quality.order_rules(frame, rules)] == ["cheap_strict", "cheap_lax", "costly_lax"]
    assert [r.name for r in quality.order_rules(frame, [lax, costly_strict])] == ["costly_strict", "costly_lax"]
    same = [quality.Rule(str(i), lambda c: c.n_words() < 0) for i in range(2)]
    assert sorted(r.name for r in quality.order_rules(frame, same)) == ["0", "1"]


def test_only_some_files_of_a_large_table_are_sampled(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, f"text {i}") for i in range(800)], "doc_id long, text string").repartition(16).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(quality, "SAMPLED_ROWS", 200)
    some = quality._sample(docs, 10_000, "text")
    assert 0 < some.count() < 500
    local = spark.createDataFrame([(i, f"text {i}") for i in range(800)], "doc_id long, text string")
    assert quality._sample(local, 10_000, "text").count() == 800  # no scan of files
    assert {r.name for r in quality.order_rules(docs)} == {r.name for r in quality.RULES}


def test_clashing_columns_are_kept(spark):
    rows = [(i, t, "x", i, -i, 3) for i, t in enumerate(TEXTS)] + [(None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __pw_words string, __pw_n int, c0 int, n_words int")
    out = quality.keep_good(frame)
    assert out.columns == frame.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(r) for r in rows if brute(r[1])[-1])
