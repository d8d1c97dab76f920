import pytest
from pyspark.sql import functions as F

from pagewright.backends import letter_verdict
from pagewright.functions.ranges import format_pages
from pagewright.operators import segmentation as seg

PAGES = "stack_id int, index int, markdown string, header string, footer string, has_images boolean, ink double"


def stack(spark, texts, **more):
    row = {"header": "", "footer": "", "has_images": False, "ink": None} | more
    return spark.createDataFrame([(1, i, t, row["header"], row["footer"], row["has_images"], row["ink"]) for i, t in enumerate(texts)], PAGES)


#: A morning's scans: a booklet whose pages count themselves, a lone card, an empty sheet between, minutes that go on doubtfully, an empty sheet at the end.
SCANS = ["LETTER of the sailing club to all crews", "moorings and tides, Blatt 2 von 3", "lists of buoys, Blatt 3 von 3", "LETTER card: the harbour office has moved", "", "LETTER minutes of the spring meeting", "second sheet, unsure whether it belongs here", "third sheet of the minutes", ""]


def test_scans_make_three_documents(spark):
    pages = stack(spark, SCANS)
    content = seg.apply_markers(pages.filter(~seg.is_blank()).select("*", *letter_verdict(F.col("markdown"))))
    shown = {r.seg: r.pages for r in format_pages(seg.with_segments(content), ["stack_id", "seg"], "index").collect()}
    assert shown == {1: "1-3", 2: "4", 3: "6-8"}
    assert [r.pages for r in format_pages(pages.filter(seg.is_blank()), ["stack_id"], "index").collect()] == ["5, 9"]
    docs = seg.with_first_page(seg.segments(content), content).select("seg", seg.review_reason().alias("r"), seg.document_confidence().alias("c")).orderBy("seg").collect()
    assert [r.r for r in docs] == ["", "single, nearly empty page 4", "uncertain continuation at page 7 (0.50: stand-in)"]
    assert [str(r.c) for r in docs] == ["0.97", "0.95", "0.50"]


def test_blank_pages(spark):
    rows = [("x" * 300, False, 0.01, False), ("words that were made up " * 9, False, 0.0, True), ("", True, None, False), ("# - |", False, None, True), ("", True, 0.001, True), ("x" * 15, False, 0.5, True), ("x" * 16, False, None, False)]
    frame = spark.createDataFrame([(1, i, t, "", "", im, ink, want) for i, (t, im, ink, want) in enumerate(rows)], f"{PAGES}, want boolean")
    assert all(r[0] == r[1] for r in frame.select(seg.is_blank(), "want").collect())
    assert frame.filter(seg.is_blank(max_ink=0.0)).count() == 2  # the ink rule is off


@pytest.mark.parametrize(("count", "window", "step"), [(2, 3, 1), (3, 3, 2), (7, 5, 3), (31, 10, 4), (260, 9, 5), (17, 7, 2)])
def test_windows_cover_all_positions(spark, count, window, step):
    members = seg.window_members(spark.createDataFrame([(1, count)], "stack_id int, n_content int"), window, step).cache()
    assert {r.pos for r in members.select("pos").distinct().collect()} == set(range(count))
    best = {r.pos: r.start for r in seg.best_windows(members, window).collect()}
    assert len(best) == count and all(s <= p < s + window for p, s in best.items())
    if (count, window, step) == (17, 7, 2):  # starts 0, 2, ..., 10
        assert (best[0], best[8], best[16]) == (0, 4 if best[8] == 4 else 6, 10)


def test_verdicts_fall_back(spark):
    members = seg.window_members(spark.createDataFrame([(1, 6)], "stack_id int, n_content int"), 4, 2)
    answers = spark.createDataFrame([(1, 0, 2, True, "1.5", "first"), (1, 2, 5, True, "0.4", "x" * 300)], "stack_id int, start int, pos int, starts_new boolean, confidence string, reason string").withColumn("confidence", F.col("confidence").cast(seg.CONFIDENCE))
    got = {r.pos: (r.starts_new, str(r.confidence), r.reason) for r in seg.select_verdicts(members, answers, 4).collect()}
    assert got[2] == (True, "1.0000", "first") and got[5] == (True, "0.4000", "x" * 200) and got[0] == (False, "0.0000", "no answer from model")


def test_markers_override(spark):
    pages = stack(spark, ["a", "b", "c"]).withColumns({"header": F.get(F.array(F.lit("page 1 of 2"), F.lit("page 2 of 2"), F.lit("page 1 of 1")), F.col("index")), "starts_new": F.lit(True), "confidence": seg.dec("0.5"), "reason": F.lit("m")})
    got = [(r.starts_new, str(r.confidence), r.reason) for r in seg.apply_markers(pages).orderBy("index").collect()]
    assert got == [(True, "1.0000", "first page of stack"), (False, "0.9700", "page marker k of n, k > 1"), (True, "0.5000", "m")]


def test_weakest_join_is_the_earliest_of_equals(spark):
    rows = [(1, 0, True, "1.0"), (1, 1, False, "0.6"), (1, 2, False, "0.6"), (1, 3, True, "0.7"), (2, 0, True, "1.0")]
    frame = spark.createDataFrame(rows, "stack_id int, index int, starts_new boolean, c string").withColumns({"confidence": F.col("c").cast(seg.CONFIDENCE), "reason": F.concat(F.lit("r"), F.col("index").cast("string"))})
    got = {(r.stack_id, r.seg): (r.join_index, r.join_reason, r.indices) for r in seg.segments(frame).collect()}
    assert got == {(1, 1): (1, "r1", [0, 1, 2]), (1, 2): (None, None, [3]), (2, 1): (None, None, [0])}


def test_blank_pages_join_the_document_before(spark):
    frame = spark.createDataFrame([(1, i, s) for i, s in enumerate([None, 1, None, None, 2, None])], "stack_id int, index int, seg int")
    assert [r.owner for r in seg.attach_blanks(frame).orderBy("index").collect()] == [1, 1, 1, 1, 2, 2]


def test_split_plan_with_and_without_blank_pages(spark):
    from pagewright.plans.page_queries import split_plan_of

    pages = stack(spark, SCANS).select("*", *letter_verdict(F.col("markdown")))
    for drop, want in ((True, ["1-3", "4", "6-8"]), (False, ["1-3", "4-5", "6-9"])):
        docs = split_plan_of(pages, drop_blank=drop).orderBy("seg").collect()
        assert [d.pages for d in docs] == want
        assert docs[0].stem == "LETTER of the sailing club to all crews undated" and [d.needs_review for d in docs] == [False, True, True]


def test_ranges_of_an_array(spark):
    from pagewright.functions.ranges import format_indices

    rows = spark.createDataFrame([([0, 2, 3, 4, 9, 9],), ([],), ([5],), ([3, 1, 2],)], "i array<int>")
    assert [r[0] for r in rows.select(format_indices(F.col("i"))).collect()] == ["1, 3-5, 10", "", "6", "2-4"]
