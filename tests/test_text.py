import pytest
from pyspark.sql import functions as F

from pagewright.functions import messages, names, ranges, text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")


def run(spark, values, make, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(make(F.col("v")).alias("x")).collect()]


def test_page_ranges_round_trip(spark):
    rows = spark.createDataFrame([(1, i) for i in (0, 2, 3, 4, 9, 9)] + [(2, 5)], "k int, i int")
    assert {r.k: r.pages for r in ranges.format_pages(rows, ["k"], "i").collect()} == {1: "1, 3-5, 10", 2: "6"}
    parse = lambda v: ranges.parse_pages(v, F.lit(10))
    assert run(spark, ["1, 3-5, 10", "5, 1-2", " 2 - 3 ,, ", "0", "3-2", "11", "a-b", "", "1,1"], parse) == [[0, 2, 3, 4, 9], [4, 0, 1], [1, 2], None, None, None, None, None, [0, 0]]


def test_names(spark):
    got = run(spark, ['Angebot: Dach/Keller "neu"?', "CON", "nul", "..", "a‮b", "é", " a  b. ", None], names.sanitize)
    assert got == ["Angebot Dach Keller neu", "_CON", "_nul", "", "ab", "é", "a b", None]


@pytest.mark.parametrize(("value", "size"), [("x" * 300, 150), ("Ж" * 150, 200), ("日" * 150, 198), ("a" + "😀" * 100, 197)])
def test_names_are_clipped_between_characters(spark, value, size):
    got = run(spark, [value], names.sanitize)[0]
    assert value.startswith(got) and len(got.encode()) == size


def test_stems(spark):
    rows = spark.createDataFrame([(" Invoice ", "2026-09-30"), ("", None), ("a {date}", "2026-01-01"), ("///", "")], "t string, d string")
    got = [r[0] for r in rows.select(names.build_stem("{title} {date}", F.col("t"), F.col("d"), "undated")).collect()]
    assert got == ["Invoice 2026-09-30", "Document undated", "a 2026-01-01 2026-01-01", "undated"]


def test_unique_names_heed_literal_numbers(spark):
    rows = spark.createDataFrame([("f", "A", 1), ("f", "A (2)", 2), ("f", "A", 3), ("g", "A", 1), ("f", "A", 4)], "folder string, stem string, n int")
    existing = spark.createDataFrame([("f", "A (3).pdf")], "folder string, name string")
    got = {(r.folder, r.n): r.name for r in names.unique_names(rows, "folder", "stem", "n", existing=existing).collect()}
    assert got == {("f", 1): "A.pdf", ("f", 2): "A (2).pdf", ("f", 3): "A (4).pdf", ("f", 4): "A (5).pdf", ("g", 1): "A.pdf"}


def test_dates(spark):
    assert run(spark, ["2026-09-30", " 2026-09-30 ", "2026-02-30", "30.09.2026", None, "0000-01-01", "2024-02-29"], names.normalize_date) == ["2026-09-30", "2026-09-30", None, None, None, None, "2024-02-29"]


def test_markers(spark):
    rows = [("Blatt 5 von 8", "", ""), ("", "", "s. 4/4"), ("Seite 7 von 6", "", ""), ("", "Preise ab 3/11", ""), ("", "x" * 500 + " page 1 of 4", ""), ("", "Page 3 of 9 " + "x" * 500, ""), ("Seite 9 von 2", "", "Blatt 1 / 2"), ("", "pages 1 of 2x", "")]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, h string, b string, f string").orderBy("i")
    got = [r[0] for r in frame.select(text.page_marker(F.col("h"), F.col("b"), F.col("f"))).collect()]
    assert [tuple(x) if x else None for x in got] == [(5, 8), (4, 4), None, None, (1, 4), (3, 9), (1, 2), None]


def test_text_chars_and_excerpt(spark):
    chars = lambda v: text.text_chars(F.lit("H-"), v, F.lit(""))
    assert run(spark, ["# a | b ![x](y) .", "\xa0　c", ""], chars) == [3, 2, 1]
    got = run(spark, ["  a ![i](x) b ", "y" * 1601, "z" * 1600], text.excerpt)
    assert got == ["a [image] b", "y" * 1200 + "\n[...]\n" + "y" * 400, "z" * 1600]


def test_plain_lines(spark):
    got = run(spark, ["# Title\n> quote\n- item **bold**\n| a | b |\n![i](x)[link](u) $x$ <b>t</b>\r\n\n1) one", ""], text.plain_lines)
    assert got == [["Title", "quote", "item bold", "a b", "link x t", "one"], []]


def test_limits(spark):
    rows = [(401, None, True), (200, None, False), (429, '{"message": "Monthly quota"}', True), (429, '{"message": "rate limit, billing"}', False), (429, '{"type": "rate_limited", "message": "quota"}', False), (429, "[1]", False), (429, "x", False), (429, None, False), (500, '{"message": "quota"}', False)]
    frame = spark.createDataFrame(rows, "s int, b string, want boolean")
    assert all(r[0] == r[1] for r in frame.select(messages.is_limit(F.col("s"), F.col("b")), "want").collect())


def test_files(spark):
    heads = [b"%PDF-1.7", b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n", b"II*\x00", b"MM\x00*", b"RIFF\0\0\0\0WEBP", b"RIFF\0\0\0\0WAVE", b""]
    assert run(spark, heads, messages.sniff, "binary") == ["pdf", "jpg", "png", "tif", "tif", "webp", None, None]
    assert run(spark, [b"x%%EOF\n", b"%%EOF" + b"x" * 2048, b"%%EOF" + b"x" * 2043, b""], messages.looks_complete, "binary") == [True, False, True, False]


def test_duplicate_messages(spark):
    frame = spark.createDataFrame([("It is a duplicate of X (#12).",), ("Duplicate",), ("duplicated (#5)",)], "m string")
    about, number = messages.duplicate_id(F.col("m"))
    assert [tuple(r) for r in frame.select(about, number).collect()] == [(True, 12), (True, None), (False, None)]
