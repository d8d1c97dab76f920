import json

import pytest
from pyspark.sql import functions as F

from pagewright.functions import names
from pagewright.operators import records
from pagewright.sinks import plans
from pagewright.sources import files
from pagewright.sources.paged import PagedSource
from pagewright.streaming import gate, queue, stability


def pages_of(number):
    """What the paged source's test services give: lists ..."""
    return [{"id": number * 10 + i, "name": f"n{i}"} for i in range(number)] if number <= 4 else []


def linked_pages(number):
    """... pages with a link to the next one ..."""
    return {"results": [{"id": number}], "next": f"?page={number + 1}" if number < 6 else None}


def counted_pages(number):
    """... and with the number of results, which is one too low."""
    return {"results": [{"id": number * 10}, {"id": number * 10 + 1}], "next": "more" if number < 4 else None, "count": 6}


def test_paged_source(spark):
    spark.dataSource.register(PagedSource)
    read = lambda name, **options: sorted((r.page, json.loads(r.value)["id"]) for r in spark.read.format("paged").options(fetch=f"tests.test_flow:{name}", **options).load().collect())
    assert read("pages_of") == [(n, n * 10 + i) for n in range(1, 5) for i in range(n)]
    assert read("linked_pages") == [(n, n) for n in range(1, 7)]
    assert read("counted_pages") == [(n, n * 10 + i) for n in range(1, 5) for i in range(2)]
    assert read("pages_of", pages="4") == read("pages_of")
    with pytest.raises(Exception, match="more than 3 pages"):
        read("pages_of", pages="3")


def test_inbox(spark, tmp_path):
    for name in ("a.pdf", "B.PDF", ".hidden.pdf", "sub/c.pdf", ".x/d.pdf", "_e.pdf", "f.txt", "duplicates/g.pdf"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"%PDF- %%EOF")
    every = files.pdf_candidates(files.full_listing(spark, str(tmp_path)), str(tmp_path), "duplicates")
    assert [r.name for r in every.collect()] == ["B.PDF", "_e.pdf", "a.pdf", "sub/c.pdf"]
    listed = files.pdf_candidates(files.listing(spark, str(tmp_path)), str(tmp_path))
    assert [r.name for r in listed.collect()] == ["B.PDF", "a.pdf", "duplicates/g.pdf", "sub/c.pdf"]


def test_batch_results(spark, tmp_path):
    lines = [{"custom_id": "a", "response": {"status_code": 200, "body": {"x": 1}}}, {"custom_id": "b", "response": {"status_code": 500, "body": {}}}, {"custom_id": "c", "response": {"status_code": 200, "body": [1]}}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\nnot json\n")
    assert [tuple(r) for r in files.batch_results(spark, str(tmp_path / "r.jsonl")).collect()] == [("a", '{"x":1}')]


def test_jobs(spark, tmp_path):
    for name, body in (("j1", {"id": "j1", "status": "queued", "created_at": "2026-01-02"}), ("j2", {"id": "j2", "status": "done", "created_at": "2026-01-01"})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(json.dumps(body, indent=1))
    for name in ("j3", "j4"):
        (tmp_path / name).mkdir()
    (tmp_path / "j3" / "job.json").write_text("{broken")
    (tmp_path / "j4" / "upload").write_text("x")
    known = files.jobs(spark, str(tmp_path))
    assert [r.id for r in known.collect()] == ["j2", "j1"]
    left = files.leftovers(files.full_listing(spark, str(tmp_path)), known, str(tmp_path), F.current_timestamp() + F.expr("INTERVAL 1 HOUR"))
    assert sorted(r.id for r in left.collect()) == ["j3", "j4"]


def test_checksums(spark, tmp_path):
    (tmp_path / "sums").write_text("# c\n\nab12  deu\ncd34 eng\n")
    assert [tuple(r) for r in files.checksums(spark, str(tmp_path / "sums")).collect()] == [("deu", "ab12"), ("eng", "cd34")]


def test_plans(spark):
    docs = spark.createDataFrame([(1, 2, "3", "B", None), (1, 1, "1-2", "A", "2026-09-30")], "k int, n int, pages string, title string, date string")
    written = plans.to_plan(docs, "k", "n")
    assert json.loads(written.first().plan) == {"documents": [{"pages": "1-2", "title": "A", "date": "2026-09-30"}, {"pages": "3", "title": "B"}]}
    back = plans.from_plan(written, "k").orderBy("number").collect()
    assert [(r.number, r.pages, r.title, r.date, r.confidence, r.needs_review, r.review_reason) for r in back] == [(1, "1-2", "A", "2026-09-30", 1.0, False, ""), (2, "3", "B", None, 1.0, False, "")]


def test_sink_sends_each_batch_once(spark, tmp_path):
    sent = []
    step = plans.once_each(lambda batch, n: sent.append((n, batch.count())), str(tmp_path / "ledger"))
    for n in (0, 1, 1, 0, 2):
        step(spark.range(n), n)
    assert sent == [(0, 0), (1, 1), (2, 2)]


def test_sink_asks_after_a_crash(spark, tmp_path):
    sent, crash = [], []

    def send(batch, number):
        sent.append(number)
        if crash:
            raise RuntimeError(crash.pop())

    ledger = str(tmp_path / "ledger")
    asking = plans.once_each(send, ledger, arrived=lambda n: n in sent)
    crash.append("behind the service")
    with pytest.raises(RuntimeError):
        asking(spark.range(1), 7)
    asking(spark.range(1), 7)  # it had arrived
    asking(spark.range(1), 7)
    assert sent == [7]
    crash.append("again")
    plain = plans.once_each(send, ledger)
    with pytest.raises(RuntimeError):
        plain(spark.range(1), 8)
    plain(spark.range(1), 8)  # under the same number
    plain(spark.range(1), 8)
    assert sent == [7, 8, 8]


def test_folds_of_null_keys_and_large_numbers(spark):
    big = 2**53 + 1
    rows = [(None, 1, 60), (None, 2, 60), (None, 3, 60), (big, 1, 60), (big, 2, 60), (big - 1, 1, None), (big - 1, 2, 100), (big - 1, 3, 1)]
    got = {(r.k, r.n): r.batch for r in records.next_fit(spark.createDataFrame(rows, "k long, n int, size int"), "k", "n", "size", 100).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, (None, 3): 2, (big, 1): 0, (big, 2): 1, (big - 1, 1): 0, (big - 1, 2): 0, (big - 1, 3): 1}


def test_free_names(spark):
    rows = [("f", "A", 1), ("f", "A (2)", 2), ("f", "A", 3), ("f", "A", 4), ("g", "A", 1), ("f", "B", 5), ("f", "A (2)", 6), (None, "A", 7), (None, "A", 8)]
    there = spark.createDataFrame([("f", "A (3).pdf"), ("f", "B.txt"), ("g", "A.pdf"), ("h", "C.pdf")], "folder string, name string")
    frame = spark.createDataFrame([(*r, "x") for r in rows], "folder string, stem string, n int, other string")
    got = {(r.folder, r.n): r.name for r in names.unique_names(frame, "folder", "stem", "n", existing=there).collect()}
    assert got == {("f", 1): "A.pdf", ("f", 2): "A (2).pdf", ("f", 3): "A (4).pdf", ("f", 4): "A (5).pdf", ("g", 1): "A (2).pdf", ("f", 5): "B.pdf", ("f", 6): "A (2) (2).pdf", (None, 7): "A.pdf", (None, 8): "A (2).pdf"}


OBSERVED = [("a", 0.0, 10, 1, True), ("a", 30.0, 10, 1, True), ("a", 70.0, 10, 1, True), ("b", 0.0, 0, 1, False), ("b", 599.0, 0, 1, False), ("b", 600.0, 0, 1, False), ("c", 0.0, 5, 1, False), ("c", 100.0, 5, 1, False), ("c", 650.0, 6, 2, False), ("c", 1300.0, 6, 2, False)]


def test_files_become_ready(spark):
    frame = spark.createDataFrame(OBSERVED, "path string, at double, size long, mtime long, complete boolean")
    got = {(r.path, r.at): (r.ready, r.waiting_long) for r in stability.readiness(frame, 60.0).collect()}
    assert got == {("a", 0.0): (False, False), ("a", 30.0): (False, False), ("a", 70.0): (True, False), ("b", 0.0): (False, False), ("b", 599.0): (False, False), ("b", 600.0): (True, False), ("c", 0.0): (False, False), ("c", 100.0): (False, False), ("c", 650.0): (False, True), ("c", 1300.0): (True, False)}


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    schema = "path string, at double, size long, mtime long, complete boolean"
    frame = spark.createDataFrame(OBSERVED, schema)
    source = tmp_path / "in"
    for step in (0.0, 30.0, 70.0, 100.0, 599.0, 600.0, 650.0, 1300.0):
        frame.filter(F.col("at") == step).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    run = stability.readiness_stream(stream, 60.0).writeStream.format("memory").queryName("ready").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(180)
    assert sorted(map(tuple, spark.table("ready").collect())) == sorted(map(tuple, stability.readiness(frame, 60.0).collect()))


def test_gate(spark):
    steps = [(0, "try"), (1, "limit"), (2, "try"), (11, "try"), (12, "try"), (13, "limit"), (23, "try"), (24, "skip"), (25, "try"), (26, "done"), (27, "try")]
    frame = spark.createDataFrame([(k, float(t), i, s) for k in ("k", None) for i, (t, s) in enumerate(steps)], "key string, at double, n int, step string")
    for key in ("k", None):
        got = gate.gate(frame, 10.0).filter(F.col("key").eqNullSafe(key)).orderBy("at").collect()
        assert [r.allowed for r in got] == [True, True, False, True, False, True, True, True, True, True, True]
        assert [r.paused for r in got] == [False, True, True, True, True, True, True, True, True, False, False]


def test_reports_are_sent_with_their_number(spark, tmp_path):
    def post(url, body, key):
        if key == "q:3":
            return 500
        (tmp_path / key).write_text(f"{url} {body}")
        return 200

    step = queue.sender("http://x", post)
    frame = lambda *numbers: spark.createDataFrame([("q", n, "{}") for n in numbers], "queue string, number long, state string")
    step(frame(1, 2), 0)
    step(frame(2), 0)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["q:1", "q:2"] and (tmp_path / "q:1").read_text() == "http://x {}"
    got = queue.counts(spark.createDataFrame([("p", "inbox"), ("p", "inbox"), (None, "failed")], "profile string, kind string")).orderBy("profile").collect()
    assert list(map(tuple, got)) == [(None, 0, 0, 1, 0), ("p", 2, 0, 0, 0)]


def test_answers_without_a_fixed_schema(spark):
    from pagewright.sources import answers

    lines = [
        '{"custom_id":"a","response":{"status_code":200,"body":{"n":1,"deep":{"x":[1,2]}}}}', '{"custom_id":"b","response":{"status_code":200,"body":[1]}}', '{"custom_id":"c","response":{"status_code":200,"body":null}}',
        '{"custom_id":"d","response":{"status_code":500,"body":{}}}', '{"custom_id":"e","response":', "", None, "[1,2]", '{"response":{"status_code":200,"body":{}}}', '{"custom_id":"f"}', '{"custom_id":"a","response":{"status_code":200,"body":{"n":"two"}}}', '{"custom_id":"g","response":{"status_code":"x","body":{}}}',
    ]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "number int, value string")
    got = answers.batch_answers(frame)
    assert [(r.custom_id, r.j) for r in got.select("custom_id", F.to_json("body").alias("j")).collect()] == [("a", '{"n":"two"}')]
    every = answers.batch_answers(frame.drop("number"))
    assert {(r.n, r.x) for r in every.select(answers.field(F.col("body"), "$.n", "int").alias("n"), answers.field(F.col("body"), "$.deep.x[1]", "int").alias("x")).collect()} == {(1, 2), (None, None)}
    assert "deep" in spark.range(1).select(answers.schema_of(every)).first()[0]


def test_plans_that_keep_the_name(spark):
    rows = [(1, i, b) for i, b in ((0, False), (1, True), (2, False), (3, False), (5, True))] + [(2, 0, True)]
    pages = spark.createDataFrame(rows, "stack_id long, index int, blank boolean")
    got = {r.stack_id: tuple(r)[1:] for r in plans.keep_name_plans(pages, F.lit("scan"), F.col("blank")).collect()}
    assert got == {1: (5, "scan", "1, 3-4", "2, 6", None), 2: (1, "scan", "", "1", "every page of the scan is blank")}
    assert {r.stack_id: r.pages for r in plans.keep_name_plans(pages, F.lit("scan"), F.col("blank"), False).collect()} == {1: "1-4, 6", 2: "1"}
