"""Sources, hooks and sinks around services, without any service."""

import hashlib
import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright import backends
from pagewright.config import Settings
from pagewright.operators import layout, service
from pagewright.sinks import delivery, documents, plans
from pagewright.sources import files, pdf, raster
from pagewright.streaming import watch


def make_pdf(texts, packed=False, tagged=False):
    """A small PDF with a page per text; packed: pages in an object stream, contents compressed."""
    objects, kids = {}, []
    for i, text in enumerate(texts):
        page, content = 10 + 2 * i, 11 + 2 * i
        lines = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").split("\n")
        code = ("BT /F1 12 Tf 50 700 Td " + " 0 -14 Td ".join(f"({x}) Tj" for x in lines) + " ET").encode("latin-1")
        body = zlib.compress(code) if packed else code
        objects[content] = f"<< /Length {len(body)} {'/Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + body + b"\nendstream"
        objects[page] = f"<< /Type /Page /Parent 2 0 R /Contents {content} 0 R >>".encode()
        kids.append(f"{page} 0 R")
    objects[1] = b"<< /Type /Catalog /Pages 2 0 R" + (b" /MarkInfo << /Marked true >>" if tagged else b"") + b" >>"
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(texts)} >>".encode()
    out = b"%PDF-1.7\n"
    if packed:
        inner = {n: b for n, b in objects.items() if b"stream" not in b}
        flat, head = b"", []
        for n, b in inner.items():
            head.append(f"{n} {len(flat)}")
            flat += b + b" "
        first = " ".join(head).encode() + b" "
        body = zlib.compress(first + flat)
        out += f"90 0 obj\n<< /Type /ObjStm /N {len(inner)} /First {len(first)} /Filter /FlateDecode /Length {len(body)} >>\nstream\n".encode() + body + b"\nendstream\nendobj\n"
        objects = {n: b for n, b in objects.items() if n not in inner}
    return out + b"".join(f"{n} 0 obj\n".encode() + b + b"\nendobj\n" for n, b in objects.items()) + b"%%EOF"


def test_pdf_pages_texts_and_tags(spark, tmp_path):
    texts = ["Tide table\nfor (all) harbours", "", "caf\xe9 \\ bar"]
    for name, content in (("a", make_pdf(texts)), ("b", make_pdf(texts, packed=True, tagged=True)), ("c", b"not a pdf"), ("d", b""), ("e", make_pdf(texts)[:300])):
        (tmp_path / f"{name}.pdf").write_bytes(content)
    rows = spark.read.format("binaryFile").load(str(tmp_path)).withColumn("path", F.regexp_extract("path", "([a-z])\\.pdf$", 1))
    got = {r.path: (r.page_count, r.tagged) for r in pdf.summaries(rows).collect()}
    assert got == {"a": (3, False), "b": (3, True), "c": (0, False), "e": (0, False)}  # Spark lists no empty files
    assert pdf.read(b"") == pdf.read(None) == pdf.Pdf([], False)
    for name in "ab":
        assert [r.text for r in pdf.page_rows(rows).filter(F.col("path") == name).orderBy("index").collect()] == texts
    hexed = make_pdf(["x"]).replace(b"(x) Tj", b"[<FEFF0041006C> -250 (b) 3 (c)] TJ")
    assert pdf.read(hexed).texts == ["Al bc"]


def test_pages_cut_out_of_a_pdf():
    texts = [f"page {i}\nof a stack" for i in range(5)]
    for packed in (False, True):
        stack = make_pdf(texts, packed=packed).replace(b"/Type /Pages /Kids", b"/MediaBox [0 0 9 9] /Resources << /Font << /F1 << /Type /Font >> >> >> /Type /Pages /Kids")
        made = pdf.select(stack, [3, 0, 3], "T\xeftle", "S")
        assert pdf.read(made).texts == [texts[3], texts[0], texts[3]]
        assert b"page 1" not in made and made.endswith(b"%%EOF\n") and "T\xeftle".encode("utf-16-be").hex().upper().encode() in made
        assert packed or made.count(b"/MediaBox [0 0 9 9]") == 3
        start = int(made.split(b"startxref\n")[1].split()[0])
        assert made[start : start + 4] == b"xref"
        assert pdf.read(pdf.select(made, [1])).texts == [texts[0]]
    for bad in ([5], [-1]):
        with pytest.raises(IndexError):
            pdf.select(stack, bad)


def test_documents_are_cut_and_written(spark, tmp_path):
    texts = ["alpha", "beta", "", "gamma"]
    docs = spark.createDataFrame([("f/x", "Report", 1, "1-2"), ("f/x", "Report", 2, "4"), ("g", "Report", 1, "2, 1")], "folder string, stem string, number int, pages string")
    sources = spark.createDataFrame([("f/x", make_pdf(texts)), ("g", make_pdf(texts[:2], packed=True))], "folder string, content binary")
    pages = plans.pages_to_write(docs, F.lit(4))
    titles = pages.select("folder", "name").distinct().withColumns({"title": F.lit("T"), "subject": F.lit(None).cast("string")})
    cut = documents.cut_documents(pages, titles, sources)
    for _ in range(2):  # a second run leaves the same files
        written = {(r.folder, r["name"]): r.sha256 for r in documents.write_documents(cut, str(tmp_path)).collect()}
    assert set(written) == {("f/x", "Report.pdf"), ("f/x", "Report (2).pdf"), ("g", "Report.pdf")}
    got = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*") if p.is_file()}
    assert {k: pdf.read(v).texts for k, v in got.items()} == {"f/x/Report.pdf": ["alpha", "beta"], "f/x/Report (2).pdf": ["gamma"], "g/Report.pdf": ["beta", "alpha"]}
    assert all(hashlib.sha256(got["/".join(k)]).hexdigest() == v for k, v in written.items())
    with pytest.raises(Exception, match="outside"):
        documents.write_documents(cut.withColumn("folder", F.lit("../..")), str(tmp_path)).collect()


def plain_median(image):
    height, width = image.shape
    at = lambda y, x: image[min(max(y, 0), height - 1), min(max(x, 0), width - 1)]
    return np.array([[sorted(at(y + b, x + a) for a in (-1, 0, 1) for b in (-1, 0, 1))[4] for x in range(width)] for y in range(height)])


def test_rasters(spark):
    rng = np.random.default_rng(1)
    images = {1: rng.integers(0, 256, (40, 60)), 2: np.full((25, 21), 250), 3: rng.choice([20, 240], (19, 44), p=[0.1, 0.9])}
    images[2][3, 3] = 0  # a speck
    rows = [(k, bytes(v.astype(np.uint8).ravel().tolist()), v.shape[1], v.shape[0]) for k, v in images.items()] + [(4, None, 3, 3), (5, b"12", 3, 3), (6, b"", 0, 0)]
    frame = spark.createDataFrame(rows, "page int, content binary, width int, height int")
    got = {}
    for r in raster.histograms(frame, "page").collect():
        got.setdefault(r.page, {})[r.value] = r.n
    for k, v in images.items():
        y, x = v.shape[0] // 20, v.shape[1] // 20
        inner = plain_median(v[y : v.shape[0] - y, x : v.shape[1] - x])
        assert got[k] == {int(a): int(b) for a, b in zip(*np.unique(inner, return_counts=True), strict=True)}
    assert set(got) == {1, 2, 3}
    ink = {r.page: (r.dark, r.total) for r in layout.ink_coverage(raster.histograms(frame, "page"), "page").collect()}
    assert ink[2] == (0, 23 * 19)
    assert spark.createDataFrame([([0, 255, 256, 65535],)], "v array<int>").select(raster.to_8bit(F.col("v"))).first()[0] == [0, 0, 1, 255]


def test_chat_asks_each_request_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def ask(system, user, schema, name):
        with open(log / f"{name}-{user}", "a") as f:
            f.write("x")
        return {"said": user, "system": system}

    rows = [("s", "u1", "{}", "names"), ("s", "u1", "{}", "names"), ("s", "u2", "{}", "names"), ("s", None, "{}", "names"), ("t", "u1", "{}", "names")]
    requests = spark.createDataFrame(rows, "system string, user string, schema string, name string")
    empty = spark.createDataFrame([], "key string, answer string")
    found, fresh = backends.chat(requests.filter("user = 'u1' and system = 's'"), empty, "m", ask)
    cache = spark.createDataFrame(fresh.collect(), fresh.schema)
    assert cache.count() == 1
    found, fresh = backends.chat(requests, cache, "m", ask)
    fresh = spark.createDataFrame(fresh.collect(), fresh.schema)
    assert fresh.count() == 3
    found, again = backends.chat(requests, cache.unionByName(fresh), "m", ask)
    assert sorted((json.loads(r.answer)["said"] or "", json.loads(r.answer)["system"]) for r in found.collect()) == [("", "s"), ("u1", "s"), ("u1", "s"), ("u1", "t"), ("u2", "s")]
    assert again.count() == 0 and len((log / "names-u2").read_text()) == 1


def test_recognition_by_cache_batch_and_service(spark):
    def read(content, start, n):
        return [{"index": 0, "markdown": f"{content.decode()}{start + i}", "images": []} for i in range(n if start != 4 else n + 1)]

    files_ = spark.createDataFrame([(1, b"f"), (2, b"g")], "stack_id long, content binary")
    stacks = spark.createDataFrame([(1, 5), (2, 3)], "stack_id long, total int")
    answer = json.dumps([{"index": 3, "markdown": "cached a"}, {"index": 9, "markdown": "cached b"}])
    cached = spark.createDataFrame([(1, 0, answer)], "stack_id long, start int, answer string")
    batched = spark.createDataFrame([(1, 0, "[]"), (2, 0, json.dumps([{"markdown": "batch"}, {"markdown": "batch 2"}])), (2, 2, None)], "stack_id long, start int, answer string")
    pages, fresh = backends.recognise(files_, stacks, cached, 2, read, batched)
    got = sorted((r["stack_id"], r["index"], r["markdown"], r["problem"]) for r in pages.collect())
    assert got == [(1, 0, "cached a", None), (1, 1, "cached b", None), (1, 2, "f2", None), (1, 3, "f3", None), (1, 4, None, "answer has 2 pages instead of 1"), (2, 0, "batch", None), (2, 1, "batch 2", None), (2, 2, "g2", None)]
    assert sorted((r.stack_id, r.start) for r in fresh.collect()) == [(1, 2), (1, 4), (2, 0), (2, 2)]


def test_callbacks_are_tried_again(spark, tmp_path):
    def post(url, body, key):
        assert key == {"first": "1", "third": "2", "never": "3", "down": "4"}[url]
        path = tmp_path / url
        n = len(path.read_text()) if path.exists() else 0
        path.write_text("x" * (n + 1))
        if url == "down":
            raise ConnectionError
        return 200 if n >= {"first": 0, "third": 2, "never": 9}[url] else 503

    rows = spark.createDataFrame([("first", 1, "{}"), ("third", 2, "{}"), ("never", 3, "{}"), ("down", 4, "{}")], "url string, id int, body string")
    got = sorted(map(tuple, delivery.deliver(rows, post, sleep=lambda s: None).collect()))
    assert got == [(1, True, 1, ""), (2, True, 3, ""), (3, False, 3, "HTTP 503"), (4, False, 3, "ConnectionError")]


def test_permissions(spark):
    rows = [(1, 5, [7, 6], [], None), (2, 5, [6], [], None), (3, None, [], [], None), (4, 6, [5, 7], [8], None), (5, 6, None, None, [1])]
    objects = spark.createDataFrame(rows, "id long, owner long, viewers array<long>, changers array<long>, groups array<long>")
    changes = service.permission_changes(objects, spark.createDataFrame([(5,), (6,), (7,)], "id long"))
    assert sorted(map(tuple, changes.collect())) == [(2, 5, [6, 7]), (4, 6, [5, 7]), (5, 6, [5, 7])]
    bodies = {r.owner: json.loads(r.body) for r in delivery.permission_bodies(changes, "tags").collect()}
    assert bodies[6] == {"objects": [4, 5], "object_type": "tags", "operation": "set_permissions", "owner": 6, "merge": False, "permissions": {"view": {"users": [5, 7], "groups": []}, "change": {"users": [], "groups": []}}}


def test_token_file(spark, tmp_path):
    path = tmp_path / "tokens.json"
    tokens = files.Tokens(str(path))
    assert tokens.rows() == []
    path.write_text("{broken")
    with pytest.raises(ValueError, match="can't be read"):
        tokens.rows()
    path.write_text(json.dumps({"tokens": [{"name": "n", "sha256": "ab"}]}))
    assert tokens.rows() == [("n", "ab")]
    path.write_text("{broken again, longer")
    assert tokens.rows() == [("n", "ab")] and tokens.frame(spark).count() == 1
    path.unlink()
    assert tokens.rows() == []


def test_leftovers_and_counts(spark, tmp_path):
    for name in ("j1/job.json", "j2/upload.pdf", ".upload-x", ".upload-dir/part", "plain.txt", "in/a.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    listed = files.full_listing(spark, str(tmp_path))
    left = files.leftovers(listed, spark.createDataFrame([("j1",), ("in",)], "id string"), str(tmp_path), F.current_timestamp() + F.expr("INTERVAL 1 HOUR"))
    assert sorted(r.id for r in left.collect()) == [".upload-dir", ".upload-x", "j2"]
    assert files.leftovers(listed, spark.createDataFrame([], "id string"), str(tmp_path), F.timestamp_seconds(F.lit(0))).count() == 0
    assert files.count_candidates(listed, str(tmp_path)).first().n == 2
    assert files.count_candidates(listed.limit(0), str(tmp_path)).first().n == 0


def test_settings_from_the_environment():
    made = Settings.from_env({"X_WINDOW": "20", "X_STEP": " 10 ", "X_DROP_BLANK_PAGES": "no", "X_BLANK_MAX_INK": "0.01", "X_UPLOAD": "yes", "X_TEXT_SOURCE": "layer", "X_NAMING": ""}, "X_")
    assert (made.window, made.step, made.drop_blank_pages, made.blank_max_ink, made.naming) == (20, 10, False, 0.01, True)
    assert not made.asks_a_model and Settings().asks_a_model and not Settings(naming=False).asks_a_model
    assert Settings(split=False).single_documents_first and not Settings().single_documents_first
    for env, message in (({"WINDOW": "x"}, "number"), ({"WINDOW": "1"}, "at least 2"), ({"BLANK_MAX_INK": "nan"}, "finite"), ({"STEP": "30"}, "larger"), ({"FILENAME_PATTERN": "a"}, "title"), ({"SPLIT": "maybe"}, "yes or no")):
        with pytest.raises(ValueError, match=message):
            Settings.from_env(env)


def test_jobs_run_in_order(spark):
    rows = [("b", "queued", "2026-01-02", None), ("a", "queued", "2026-01-02", None), ("c", "running", "2026-01-01", "t"), ("d", "done", "2026-01-01", "t")]
    jobs = spark.createDataFrame(rows, "id string, status string, created_at string, started_at string")
    ready, result = watch.run_jobs(jobs, F.lit("now"), lambda job: job.select("id"), after_restart=True)
    assert [r.id for r in result.collect()] == ["c"]
    assert {r.id: (r.status, r.started_at) for r in ready.collect()} == {"a": ("queued", None), "b": ("queued", None), "c": ("running", "now"), "d": ("done", "t")}
    assert [r.id for r in watch.run_jobs(jobs, F.lit("now"), lambda job: job.select("id"))[1].orderBy("id").collect()] == ["a", "c"]
    assert service.claimed(jobs.limit(0), F.lit("now")).count() == 0


def test_watch_polls_and_shows_life(spark, tmp_path):
    import time

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    seen, life = [], str(tmp_path / "life")
    assert not watch.alive(life, 60)
    listener = watch.SignOfLife(life)
    spark.streams.addListener(listener)
    query = watch.poll(spark, str(tmp_path / "in"), lambda frame, n: seen.append([r.name for r in frame.collect()]), seconds=0.5)
    try:
        end = time.time() + 60
        while time.time() < end and not (["a.pdf"] in seen and [] in seen and watch.alive(life, 60)):
            if seen and (tmp_path / "in" / "a.pdf").exists():
                (tmp_path / "in" / "a.pdf").unlink()
            time.sleep(0.3)
    finally:
        query.stop()
        spark.streams.removeListener(listener)
    assert ["a.pdf"] in seen and [] in seen and watch.alive(life, 60)
    assert not watch.alive(life, 60, now=lambda: time.time() + 100)


def test_objects_without_an_end_take_linear_time():
    import time

    from pagewright.sources import pdf

    began = time.perf_counter()
    assert pdf._objects(b"1 0 obj " * 300_000) == {}
    assert time.perf_counter() - began < 3
    assert pdf._objects(b"1 0 obj a endobj 2 0 obj b 3 0 obj c endobj 1 0 obj d endobj 4 0 obj") == {1: b" d ", 2: b" b 3 0 obj c "}
