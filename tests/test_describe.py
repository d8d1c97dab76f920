"""Documents described by a table function."""

import random

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text
from pagewright.sources import describe

PAGES = "stack long, part string, index int, header string, markdown string, footer string, cached string"


def test_one_call_per_document_without_a_record(spark, tmp_path):
    def ask(own):
        (tmp_path / f"{random.random()}").write_text(own)
        return {"title": own, "issuer": "x"}

    rows = [(s, p, i, "h" if i == 1 else None, f"text {s}{p}{i}", "", None) for s in range(3) for p in ("a", None) for i in (2, 0, 1)]
    rows += [(9, "a", i, "", "never read", "", '{"title": "known", "date": "2024-01-02"}') for i in range(3)]
    spark.udtf.register("describe_test", describe.describer(ask))
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    got = {(r.stack, r.part): (r.title, r.date, r.issuer, r.asked) for r in spark.sql("SELECT * FROM describe_test(TABLE({pages}), 1000)", pages=pages).collect()}
    want = {(s, p): (f"--- page 1 ---\ntext {s}{p}0\n\n--- page 2 ---\nh\ntext {s}{p}1\n\n--- page 3 ---\ntext {s}{p}2", None, "x", True) for s in range(3) for p in ("a", None)}
    assert got == want | {(9, "a"): ("known", "2024-01-02", None, False)}
    assert len(list(tmp_path.iterdir())) == 6
    assert spark.sql("SELECT * FROM describe_test(TABLE({pages}), 1000)", pages=pages.limit(0)).count() == 0


@pytest.mark.parametrize("call", ["describe_bad(1, 5)", "describe_bad(TABLE(SELECT 1 AS index), 5)", "describe_bad(TABLE(SELECT 1 AS index, '' AS header, '' AS markdown, '' AS footer, '' AS cached), 5)"])
def test_what_is_no_table_of_pages(spark, call):
    spark.udtf.register("describe_bad", describe.describer())
    with pytest.raises(Exception, match="TABLE\\(pages\\)|the pages have no|names the document"):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_the_same_texts_as_the_columns_give(spark):
    rng = random.Random(2)
    for most in (1, 7, 40, 100):
        parts = [[rng.choice(["", " a ", "x" * rng.randrange(30), "![i](u) pic", "  é "]) for _ in range(3)] for _ in range(rng.randrange(1, 6))]
        clipped = describe.Clipped(most)
        for i, p in enumerate(parts):
            clipped.add(describe.chunk(i + 1, *p))
        row = spark.createDataFrame([(i + 1, *p) for i, p in enumerate(parts)], "n int, h string, b string, f string")
        whole = row.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", text.page_chunk(F.col("n"), F.col("h"), F.col("b"), F.col("f")).alias("t")))), lambda x: x["t"]), "\n\n").alias("t"))
        assert clipped.text() == whole.select(text.clipped_text(F.col("t"), most)).first()[0]


def test_the_stand_in():
    assert describe.stand_in("--- page 1 ---\nBill: no. 7!\nof 2024-02-30") == {"title": "Bill no 7", "date": None}
    assert describe.stand_in("--- page 3 ---\n\n2024-02-29 x") == {"title": "", "date": "2024-02-29"} and describe.stand_in("") == {"title": "", "date": None}
