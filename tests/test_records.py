from pyspark.sql import functions as F

from pagewright.operators import layout, records


def test_layouts_by_division(spark):
    stacks = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 0)], "stack_id int, total int")
    cached = [(1, 3, s) for s in (0, 3, 6)] + [(1, 5, 0)] + [(2, 5, s) for s in (0, 5)] + [(2, 3, s) for s in (0, 3, 6)] + [(3, 3, 0), (3, 3, 0), (3, 3, 3)]
    frame = spark.createDataFrame(cached, "stack_id int, size int, start int")
    assert {r.stack_id: r.size for r in records.complete_layouts(stacks, frame, 5).collect()} == {1: 3, 2: 5, 3: 5, 4: 5}
    chunks = [(r.start, r.expected) for r in records.chunk_starts(stacks, 3).filter("stack_id = 1").orderBy("start").collect()]
    assert chunks == [(0, 3), (3, 3), (6, 1)]


def test_next_fit(spark):
    rows = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 5, 1, 20, 3, 8])], "k string, n int, size long")
    assert [r.batch for r in records.next_fit(rows, "k", "n", "size", 10).orderBy("n").collect()] == [0, 0, 1, 2, 3, 4]


def test_heartbeats(spark):
    rows = spark.createDataFrame([("a", t, s) for t, s in [(0, "x"), (5, "x"), (6, "y"), (15, "y"), (16, "y"), (17, None), (18, None)]], "k string, t long, s string")
    assert [r.t for r in records.heartbeats(rows, "k", "t", "s", 10).orderBy("t").collect()] == [0, 6, 16, 17]


def test_queue_totals(spark):
    counts = spark.createDataFrame([("a", 3, 1, 1, 0), ("b", 1, 5, 0, 2)], "profile string, in_inbox long, busy long, failed long, duplicates long")
    got = {r.profile: (r.waiting, r.processing, r.queued, r.failed, r.duplicates) for r in records.queue_snapshot(counts).collect()}
    assert got == {"a": (2, 1, 3, 1, 0), "b": (0, 1, 1, 0, 2), None: (2, 2, 4, 1, 2)}


def test_retention(spark):
    rows = [("old", "review", 1, 5), ("old", "plan", 2, 5), ("new", "review", 1, 1), ("new", "plan", 9, 1), ("open", "review", 1, 1), ("busy", "review", 1, 1), ("busy", "plan", 1, 1), ("old", "page", 99, 7)]
    files = spark.createDataFrame(rows, "folder string, kind string, mtime int, size int")
    active = spark.createDataFrame([("busy",)], "folder string")
    assert [tuple(r) for r in records.expired_folders(files, active, F.lit(2)).collect()] == [("old", 2, 17)]


def test_ledger(spark):
    files = spark.createDataFrame([(1, "a", "f1"), (2, "a", "f2"), (3, "b", "f3"), (4, "c", "f4"), (5, "c", "f5")], "n int, sha string, file string")
    ledger = spark.createDataFrame([("a", 7, "f1", True), ("b", 8, "f3", False)], "sha string, document int, file string, pending boolean")
    got = [(r.n, r.state, r.document) for r in records.ledger_state(files, ledger, "n").orderBy("n").collect()]
    assert got == [(1, "recovered", 7), (2, "duplicate", 7), (3, "duplicate", 8), (4, "new", None), (5, "in progress", None)]


def test_pitch_and_ink(spark):
    boxes = spark.createDataFrame([(1, t, t + 10.0) for t in (0.0, 12.0, 26.0, 27.0)] + [(2, 5.0, 15.0)], "k int, top double, bottom double")
    assert {r.k: r.pitch for r in layout.line_pitch(boxes, "k").collect()} == {1: 12.0, 2: 16.0}
    hist = spark.createDataFrame([(1, 255, 90), (1, 20, 10), (2, 30, 80), (2, 250, 20), (3, 200, 6), (3, 170, 2), (3, 100, 2)], "k int, value int, n int")
    assert {r.k: (r.dark, r.total) for r in layout.ink_coverage(hist, "k").collect()} == {1: (10, 100), 2: (80, 100), 3: (2, 10)}


def test_shares_depend_on_those_before(spark):
    rows = [  # kind, id, place, name, owner, refused
        ("tags", 1, 0, "Straße", "a", False), ("tags", 2, 1, "STRASSE", "b", False), ("tags", 3, 2, "Straße", "c", False), ("tags", 4, 3, " strasse ", "d", True), ("tags", 5, 4, "strasse", "e", None),
        ("tags", 6, 5, "Free", None, False), ("tags", 7, 6, "free", "a", True), ("tags", 8, 7, "Free", "a", False), ("tags", 9, 8, "Free", None, False),
        ("types", 10, 0, "Straße", "a", True), ("types", 11, 1, None, "a", False), ("types", 12, 2, None, "a", False), ("types", 13, 3, None, "b", True),
    ]
    objects = spark.createDataFrame(rows, "kind string, id long, place int, name string, owner string, refused boolean")
    got = {r.id: (r.shared, r.same_name_as) for r in records.shares_in_turn(objects, ["kind"]).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 2), 4: (False, 2), 5: (True, None), 7: (False, 9), 8: (False, 9), 10: (False, None), 11: (True, None), 12: (True, None), 13: (False, None)}
    parts = {r.id: r.part for r in records.share_sets(objects, "kind", ["STRASSE", "x"]).collect()}
    assert [i for i, p in parts.items() if p == "protected"] == [1, 2, 3, 5] and [i for i, p in parts.items() if p == "ownerless"] == [6, 9] and parts[10] == "owned" and parts[4] == "owned"
