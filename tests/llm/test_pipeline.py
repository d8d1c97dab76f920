import base64
import hashlib
import os
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pagewright.llm import mixing, quality
from pagewright.llm import queries as llm
from tests.llm.test_jaccard import brute as groups_of
from tests.llm.test_mixing import poisson, uniform
from tests.llm.test_quality import brute as counts_of
from tests.llm.test_suffix_dedup import brute as rest_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_stages_match_brute_force(spark):
    """Each stage on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    good = stages["quality_rules"](spark, docs, SF).cache()
    rows = docs.collect()
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in rows if counts_of(r.text)[-1])
    one = stages["ngram_jaccard_join"](spark, good, SF).cache()
    groups = {g for _, _, g in groups_of([(r.doc_id, r.text) for r in good.collect()])}
    assert one.columns == columns and sorted(r.doc_id for r in one.collect()) == sorted(groups)
    cut = stages["suffix_array_dedup"](spark, one, SF).cache()
    before = sorted(one.collect(), key=lambda r: r.doc_id)
    want = {r.doc_id: w for r, w in zip(before, rest_of([r.text for r in before]), strict=True)}
    after = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and after.keys() == want.keys()
    for r in before:
        if want[r.doc_id][1] == 0:
            assert after[r.doc_id] == r
        else:
            assert len(after[r.doc_id].text.encode()) <= want[r.doc_id][0] - want[r.doc_id][1] and after[r.doc_id].n_chars == len(after[r.doc_id].text)
    mixed = stages["mix_sources"](spark, cut, SF).cache()
    assert mixed.columns == columns
    chars = Counter()
    for r in after.values():
        chars[r.source if r.source in mixing.WEIGHTS else "*"] += len(r.text)
    total, shares = sum(chars.values()), sum(mixing.WEIGHTS.values())
    rate = {x: mixing.WEIGHTS[x] / shares * total / chars[x] for x in chars if chars[x]}
    want = Counter({r: poisson(rate.get(r.source if r.source in mixing.WEIGHTS else "*", 0.0), uniform(17, r.doc_id)) for r in after.values()})
    assert Counter(mixed.collect()) == +want
    last = stages["byte_bpe"](spark, mixed, SF)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def digest(r):
        ids = library.encode_ordinary(r.text)
        return r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()

    assert Counter(map(tuple, last.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == Counter(digest(r) for r in mixed.collect())


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, copy int, __pw_text string, key string, c0 double"


def odd_documents(spark):
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    texts = [None, "", "  ", words, words, words + " end", "é " * 400, words[::-1], "x" * 5000]
    rows = [(i % 7, t, None if i % 2 else "en", None if i % 3 == 0 else "src0", None, 7, "own", None, 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, words[::-1], None, None, None, None, None, None, None), (None,) * 9], DOCUMENTS)


def test_stages_take_nulls_repeats_and_clashing_columns(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "byte_bpe":
            assert out.columns == docs.columns, name
            known = {r[5:] for r in docs.collect()}
            assert {tuple(r)[5:] for r in out.collect()} <= known, name  # the extra columns keep their values
        out.count()


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], DOCUMENTS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_run_over_odd_documents(spark, tmp_path):
    odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.filter(F.col("n_tokens") <= 0).count() == 0


def test_every_query_runs(spark):
    found = llm.queries()
    assert [n.split("_")[0] for n in found] == [f"op{i}" for i in range(1, 14)]
    assert quality.RULES
