import gzip
import hashlib
import io
import random
import zipfile

import pyarrow as pa
import pytest

from pagewright.llm import archives as ar


def brute(rows):
    out, groups = [], {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    for payload, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        for i, page in enumerate(ids):
            again = i and len(payload) >= 100
            out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*x, b"x", "y") for x in rows], "page_id long, url string, html string, payload binary, digest string")


def odd_rows():
    rng = random.Random(3)
    texts = [None, "", "short", "é" * 50, "é" * 49 + "a", "x" * 99, "x" * 100, "\r\n\r\nWARC/1.1\r\n" * 20, "\x00" * 150, "PK\x05\x06" * 30, "long " * 100_000]
    rows = [(rng.choice([None, rng.randrange(200)]), rng.choice([None, "http://a.b/ü?x=1 2", "no url", "http://a.b/\r\nX: y"]), rng.choice(texts)) for _ in range(300)]
    return rows + [(i, f"https://h{i % 7}.example/{i}", f"<p>page {i} " * 30) for i in range(200)] + [(i, None, "copy " * 60) for i in range(400, 600)] + [(5, "u", "z" * 200)] * 4


def test_against_brute_force(spark):
    rows = odd_rows()
    assert sorted(map(tuple, ar.round_trip(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_no_rows(spark):
    assert ar.round_trip(frame(spark, [])).count() == 0


def test_packages_are_standard_files_and_records_lie_where_indexes_say(spark, tmp_path, monkeypatch):
    rows = odd_rows()
    done = ar.write(frame(spark, rows), f"file://{tmp_path}/set")
    assert sum(n for _, n, _ in done) == len(rows)
    assert sorted(p.name for p in (tmp_path / "set").iterdir() if not p.name.endswith(".crc")) == [name for name, _, _ in done]
    seen = 0
    for name, n, _ in done:
        path = tmp_path / "set" / name
        with zipfile.ZipFile(path) as known:
            assert known.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in known.infolist())
            records = {i.filename: known.read(i) for i in known.infolist()}
        package = ar.Package(pa.OSFile(str(path)))
        assert {m: package.whole(e) for m, e in package.members.items()} == records
        places = ar.entries(package)
        assert len(places) == n
        for member, offset, length in places:
            assert package.read(package.members[member], offset, length) == records[member][offset : offset + length]
            fields, status, headers, payload = ar.parsed(records[member][offset : offset + length])
            assert status == 200 and fields["warc-record-id"].startswith("<urn:page:")
            assert fields["warc-type"] == "revisit" or hashlib.sha256(payload).hexdigest() == fields["warc-payload-digest"][7:] and len(payload) == int(headers["content-length"])
            seen += 1
    assert seen == len(rows)
    ids = [x.record_id for x in ar.read_folder(spark, f"file://{tmp_path}/set").select("record_id").collect()]
    assert len(ids) == len(set(ids)) == len(rows)
    known = {x.record_id: x for x in ar.read(spark, [f"{tmp_path}/set/{name}" for name, _, _ in done]).select("record_id", "record_type", "refers_to", "payload_digest").collect()}
    revisits = [x for x in known.values() if x.record_type == "revisit"]
    assert revisits and all(known[x.refers_to].record_type == "response" and known[x.refers_to].payload_digest == x.payload_digest for x in revisits)


def _package(**sizes):
    room = io.BytesIO()
    with zipfile.ZipFile(room, "w") as out:
        for name, n in sizes.items():
            with out.open(zipfile.ZipInfo(f"{name}é.bin"), "w", force_zip64=True) as member:
                member.write(bytes(range(256)) * n)
        out.comment = b"PK\x05\x06 a comment with an end record's mark"
    return room.getvalue()


@pytest.mark.parametrize("limit", [None, 700])
def test_directories_with_and_without_zip64(monkeypatch, limit):
    if limit:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    data = _package(a=1, b=40, c=3, d=0)
    assert (b"PK\x06\x07" in data) == bool(limit)
    package = ar.Package(pa.BufferReader(data))
    assert {m.name: m.size for m in package.members.values()} == {"aé.bin": 256, "bé.bin": 10240, "cé.bin": 768, "dé.bin": 0}
    member = package.members["bé.bin"]
    assert package.read(member, 250, 12) == (bytes(range(256)) * 2)[250:262]
    for offset, length in ((10240, 1), (-1, 4), (0, 10241)):
        with pytest.raises(ValueError, match="no bytes"):
            package.read(member, offset, length)


def test_what_is_no_package(tmp_path):
    good = _package(a=1)
    for data in (b"", b"no zip at all" * 9, good[:-60], good[: good.rfind(b"PK\x01\x02") - 30] + good[good.rfind(b"PK\x01\x02") :]):
        with pytest.raises(ValueError):
            package = ar.Package(pa.BufferReader(data))
            package.read(next(iter(package.members.values())), 0, 256)
    room = io.BytesIO()
    with zipfile.ZipFile(room, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("indexes/index.cdxj", 'k 1 {"filename": "x.warc.gz", "offset": "3", "length": "4"}\nbroken line\n')
        out.writestr("archive/x.warc.gz", b"abc" * 100)
    package = ar.Package(pa.BufferReader(room.getvalue()))
    assert ar.entries(package) == [("archive/x.warc.gz", 3, 4)]
    with pytest.raises(ValueError, match="compressed"):
        package.read(package.members["archive/x.warc.gz"], 3, 4)


def test_packages_and_members_of_bounded_size(tmp_path, monkeypatch):
    monkeypatch.setattr(ar, "PACKAGE_RECORDS", 10)
    monkeypatch.setattr(ar, "MEMBER_BYTES", 1000)
    writer = ar._Writer(str(tmp_path), 3)
    for i in range(25):
        payload = random.Random(i).randbytes(300)
        digest = hashlib.sha256(payload).hexdigest()
        writer.add(ar.record("response", f"urn:page:{i}:{digest[:32]}:0", f"http://x/{i}", digest, 300, payload, None), f"http://x/{i}", digest, "1970")
    writer.end()
    assert [n for _, n, _ in writer.done] == [10, 10, 5]
    found = []
    for name, _, _ in writer.done:
        package = ar.Package(pa.OSFile(str(tmp_path / name)))
        assert sum(m.startswith("archive/") for m in package.members) > 1
        found += [ar.parsed(package.read(package.members[m], o, n))[3] for m, o, n in ar.entries(package)]
    assert found == [random.Random(i).randbytes(300) for i in range(25)]


def test_records_of_other_origin():
    plain = b"WARC/1.0\r\nWARC-Type: resource\r\nX: a\r\n b\r\nContent-Length: 4\r\n\r\nbody\r\n\r\n"
    for data in (plain, gzip.compress(plain)):
        fields, status, headers, payload = ar.parsed(data)
        assert (fields["warc-type"], fields["x"], status, headers, payload) == ("resource", "a b", None, {}, b"body")
    for broken in (b"HTTP/1.1 200 OK\r\n\r\n", plain.replace(b"4", b"40"), b"WARC/1.0 nothing"):
        with pytest.raises(ValueError):
            ar.parsed(broken)
