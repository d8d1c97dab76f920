import hashlib
import math
from collections import Counter
from functools import cache

import pytest
from pyspark.sql import functions as F

from pagewright.llm import mixing


def poisson(mean, u):
    k, term, total = 0, math.exp(-mean), math.exp(-mean)
    while u >= total and k < 200:
        k += 1
        term *= mean / k
        total += term
    return k


def uniform(seed, i):
    return int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 2**52


def test_copies_match_brute_force(spark):
    rows = [(i, "x" * (1 + i % 9), f"s{i % 4}") for i in range(400)] + [(None, None, None), (7, "", "s9"), (7, "", "s9")]
    frame = spark.createDataFrame([(*r, "own", 5) for r in rows], "doc_id long, text string, source string, lang string, copy int")
    weights = {"s0": 0.5, "s1": 0.1, "zz": 0.1, "*": 0.3}
    rates = mixing.rates(frame, weights)
    chars = Counter()
    for _, t, s in rows:
        chars[s if s in ("s0", "s1") else "*"] += len(t or "")
    total = sum(chars.values())
    assert rates["zz"] == 0 and all(rates[s] == pytest.approx(weights[s] * total / chars[s]) for s in ("s0", "s1", "*"))
    got = Counter(r.doc_id for r in mixing.mix(frame, weights).collect())
    want = Counter()
    for i, _, s in rows:
        want[i] += poisson(rates.get(s, rates["*"]), uniform(17, i))
    assert got == +want
    assert mixing.mixed_documents(frame, weights).columns == frame.columns


def test_large_means_and_shuffle(spark):
    frame = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("abc").alias("text"), F.lit("s").alias("source"))
    out = mixing.mix(frame, by_source={"*": 40.0})
    counts = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert [counts[i] for i in range(300)] == [min(k for k in range(200) if poisson_function(40.0, k) > uniform(17, i)) for i in range(300)]
    spread = sum((counts[i] - 40) ** 2 for i in range(300)) / 300
    assert abs(sum(counts.values()) / 300 - 40) < 1.5 and 30 < spread < 52  # the variance of a Poisson distribution is its mean
    parts = out.select(F.spark_partition_id().alias("p"), "position", "copy").collect()
    assert len({r.p for r in parts}) > 1 and len({(r.position, r.copy) for r in parts}) == len(parts)


def test_clashing_columns_keep_their_values(spark):
    rows = [(i, "abc", "s", 777 + i, -i, 5, 6, None) for i in range(40)] + [(None, None, None, None, None, None, None, 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int, position long, __pw_copies int, c0 int, `a.b` int")
    out = mixing.mixed_documents(frame, by_source={"*": 1.5})
    assert out.columns == frame.columns
    got = Counter(map(tuple, out.collect()))
    want = Counter({r: poisson(1.5, uniform(17, r[0])) for r in rows})
    assert got == +want
    assert mixing.mix(frame).columns == ["doc_id", "text", "source", "__pw_copies", "c0", "a.b", "copy", "position"]


def test_sql_inverts_the_same_distribution(spark, tmp_path):
    import duckdb

    from pagewright.llm import oracles

    rows = [(i, "x" * (3 if i < 3 else 400), "src1" if i < 3 else "other", "en", 1) for i in range(400)]  # src1 is so small that its rate is in the thousands
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").select("doc_id", "text", "lang", "source", "n_chars")
    frame.coalesce(1).write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    assert max(mixing.rates(frame).values()) > 1000
    assert sorted(map(tuple, mixing.mix(frame).collect())) == sorted(db.execute(oracles.MIX_SOURCES).fetchall())


def test_mix_is_the_same_each_time(spark):
    frame = spark.createDataFrame([(i, "abc", "src0") for i in range(50)], "doc_id long, text string, source string")
    assert sorted(mixing.mix(frame).collect()) == sorted(mixing.mix(frame.repartition(3)).collect())
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_copies_invert_poisson_at_every_rate(spark):
    frame = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.lit("s").alias("source"))
    for mean in (15.5, 16.5, 40.0, 300.0):
        got = Counter(r.doc_id for r in mixing.mix(frame, by_source={"*": mean}).select("doc_id").collect())
        assert [got[i] for i in range(400)] == [min(k for k in range(2000) if poisson_function(mean, k) > uniform(17, i)) for i in range(400)]


@cache
def poisson_function(mean, k):
    return (poisson_function(mean, k - 1) if k else 0.0) + math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))


def test_thresholds_of_a_very_large_mean():
    first, steps = mixing.thresholds(1e6)
    assert 985_000 < first < 991_500 and len(steps) < 20_000 and steps == sorted(steps) and steps[0] == 0 and steps[-1] == pytest.approx(1, abs=1e-12)
    assert steps[1_000_000 - first] == pytest.approx(0.5 + 2 / 3 / math.sqrt(2 * math.pi * 1e6), abs=1e-6)
