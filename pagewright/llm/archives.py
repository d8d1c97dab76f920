"""WARC records in ZIP packages: written in parallel, and read by range, without extracting anything.

A package is a ZIP file whose members are stored (not compressed by ZIP): ``archive/data-NNN.warc.gz`` of gzipped records, one after another, ``indexes/index.cdxj`` with a
line per record (key, time, and as JSON the url, digest, member, offset and length), and ``datapackage.json``. The reader takes packages of any origin with such members:
it looks for the end of the central directory from the file's tail, follows the ZIP64 locator where there is one, parses the directory, finds where a stored member's
bytes begin by its local header, reads the index by range, and then the records, neighbours in one request.

Writing: pages meet the least page_id of their payload by digest and a bucket of the page's id, so that the copies of one payload are dealt out, and each task streams its sorted rows into packages
of bounded size. The first row of that least id is the ``response``, all others with this payload are ``revisit`` records: HTTP headers with the payload's length, and the response's
record in WARC-Refers-To. Payloads below ``MIN_REVISIT`` bytes are all responses. Files are written under a name of a task's own and renamed at its end, by ``pyarrow.fs``, so that the folder
may be mounted or in an object store; only a row per package reaches the driver.

Defined results: a null or empty html is an empty payload. A null page_id comes after all others, so that it is the response only of payloads that have no other. Of rows with equal page_id and payload one is the
response and the others revisit it. Null urls are written as an empty target. An empty table gives no packages and no rows. Columns beyond the named ones are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import give_back, let_workers_import, remove_at_exit, scratch_path, shuffle_partitions

MIN_REVISIT = 100
#: A package is closed, and another one begun, beyond this many bytes or records; the index of one is sorted in memory.
PACKAGE_BYTES = 256 << 20
PACKAGE_RECORDS = 50_000
#: A member of records within a package.
MEMBER_BYTES = 64 << 20
#: What is asked of a file at once where records are neighbours.
READ_BYTES = 4 << 20
#: Of an Arrow batch of payloads.
_BATCH_BYTES = 8 << 20
#: Buckets over which the copies of one payload are dealt out.
BUCKETS = 16
_DATE = "1970-01-01T00:00:00Z"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else path
    return fs.FileSystem.from_uri(path)


# --- ZIP ---------------------------------------------------------------------------------------------------------------

_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


@dataclass(frozen=True)
class Member:
    """An entry of a central directory."""

    name: str
    method: int
    packed: int
    size: int
    header: int

    @property
    def stored(self) -> bool:
        return self.method == 0


class Package:
    """A ZIP file that is read by range. ``file`` is a pyarrow random-access file or what has its ``size`` and ``read_at``."""

    def __init__(self, file: pa.NativeFile) -> None:
        self.file, self.length = file, file.size()
        start, length, count = self._directory()
        self.members = {m.name: m for m in self._entries(self._at(start, length), count)}
        self._begins: dict[str, int] = {}

    def _at(self, offset: int, length: int) -> bytes:
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise ValueError("the package ends too early")
        return data

    def _directory(self) -> tuple[int, int, int]:
        """Offset, length and entries of the central directory."""
        tail = min(self.length, 22 + _FULL16)  # the end record and the longest comment
        base = self.length - tail
        data = self._at(base, tail)
        at = data.rfind(_END)
        while at >= 0 and (at + 22 > tail or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != tail):
            at = data.rfind(_END, 0, at)
        if at < 0:
            raise ValueError("no ZIP package: its end record is missing")
        count, length, start = struct.unpack_from("<HII", data, at + 10)
        if count == _FULL16 or length == _FULL32 or start == _FULL32:
            locator = self._at(base + at - 20, 20)
            if locator[:4] == _LOCATOR64:
                end = self._at(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end[:4] != _END64:
                    raise ValueError("the ZIP64 end record is not where its locator points")
                count, length, start = struct.unpack_from("<QQQ", end, 32)
        return start, length, count

    @staticmethod
    def _entries(data: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != _ENTRY:
                raise ValueError("the central directory is damaged")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size, name_length, extra_length, comment_length = struct.unpack_from("<IIHHH", data, at + 20)
            header = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + name_length].decode("utf-8" if flags & 0x800 else "cp437")
            extra = data[at + 46 + name_length : at + 46 + name_length + extra_length]
            place = 0
            while place + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, place)
                if kind == 1:  # ZIP64: only the fields that are full in the entry, in this order
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, place + 4))
                    size = next(wide) if size == _FULL32 else size
                    packed = next(wide) if packed == _FULL32 else packed
                    header = next(wide) if header == _FULL32 else header
                place += 4 + length
            yield Member(name, method, packed, size, header)
            at += 46 + name_length + extra_length + comment_length

    def begins(self, member: Member) -> int:
        """Where a member's bytes begin: its local header has lengths of its own."""
        if member.name not in self._begins:
            local = self._at(member.header, 30)
            if local[:4] != _LOCAL:
                raise ValueError(f"{member.name}: no local header where the directory points")
            self._begins[member.name] = member.header + 30 + sum(struct.unpack_from("<HH", local, 26))
        return self._begins[member.name]

    def read(self, member: Member, offset: int, length: int) -> bytes:
        if not member.stored:
            raise ValueError(f"{member.name} is compressed by ZIP and can't be read by range")
        if offset < 0 or length < 0 or offset + length > member.size:
            raise ValueError(f"{member.name} has no bytes {offset} to {offset + length}")
        return self._at(self.begins(member) + offset, length)

    def whole(self, member: Member) -> bytes:
        """A small member such as an index, stored or deflated."""
        data = self._at(self.begins(member), member.packed)
        if member.stored:
            return data
        if member.method == 8:
            return zlib.decompress(data, -15)
        raise ValueError(f"{member.name}: unknown method {member.method}")


# --- records -----------------------------------------------------------------------------------------------------------


def _head(first: str, fields: Iterable[tuple[str, str]]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode()


def record(kind: str, own: str, url: str, digest: str, size: int, payload: bytes, refers_to: str | None, date: str = _DATE) -> bytes:
    """A gzipped WARC record of an HTTP response; a revisit has the response's headers alone."""
    block = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))]) + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{own}>"), ("WARC-Date", date), ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")] if kind == "revisit" else []),
        ("Content-Length", str(len(block))),
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(_head("WARC/1.1", fields) + block + b"\r\n\r\n") + packer.flush()


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    found, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last:  # a folded line goes on with the one before
            found[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if colon:
            last = name.strip().lower()
            found.setdefault(last, value.strip())
    return first, found


def parsed(packed: bytes) -> tuple[dict[str, str], int | None, dict[str, str], bytes]:
    """A record's fields, its HTTP status and headers where it has them, and its payload."""
    data = zlib.decompress(packed, 31) if packed[:2] == b"\x1f\x8b" else packed
    cut = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or cut < 0:
        raise ValueError("no WARC record")
    _, fields = _fields(data[:cut])
    length = int(fields.get("content-length", "0"))
    block = data[cut + 4 : cut + 4 + length]
    if len(block) != length:
        raise ValueError("the record is shorter than it says")
    if not fields.get("content-type", "").lower().startswith("application/http"):
        return fields, None, {}, block
    head, _, payload = block.partition(b"\r\n\r\n")
    first, headers = _fields(head)
    status = first.split(" ")[1] if first.startswith("HTTP/") and " " in first else ""
    return fields, int(status) if status.isdigit() else None, headers, payload


# --- writing -----------------------------------------------------------------------------------------------------------


class _Writer:
    """Packages of one task: records go to the current one, which is renamed when it is full."""

    def __init__(self, folder: str, part: int) -> None:
        self.files, self.folder = opened(folder)
        self.part, self.number, self.zip, self.token = part, 0, None, uuid.uuid4().hex
        self.done: list[tuple[str, int, int]] = []

    def _begin(self) -> None:
        self.name = f"part-{self.part:05d}-{self.number:04d}.wacz"
        self.out = self.files.open_output_stream(f"{self.folder}/.{self.name}.{self.token}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED)
        self.lines, self.member, self.members, self.bytes, self.number = [], None, 0, 0, self.number + 1

    def add(self, data: bytes, url: str, digest: str, date: str) -> None:
        if self.zip is None:
            self._begin()
        if self.member is None:
            self.name_in, self.offset, self.members = f"archive/data-{self.members:03d}.warc.gz", 0, self.members + 1
            self.member = self.zip.open(zipfile.ZipInfo(self.name_in), "w", force_zip64=True)
        self.member.write(data)
        stamp = "".join(c for c in date if c.isdigit())
        self.lines.append(f"{_key(url)} {stamp} " + json.dumps({"url": url, "digest": f"sha256:{digest}", "filename": self.name_in.removeprefix("archive/"), "offset": self.offset, "length": len(data)}))
        self.offset += len(data)
        self.bytes += len(data)
        if self.offset >= MEMBER_BYTES:
            self._end_member()
        if self.bytes >= PACKAGE_BYTES or len(self.lines) >= PACKAGE_RECORDS:
            self.end()

    def _end_member(self) -> None:
        if self.member is not None:
            self.member.close()
            self.member = None

    def end(self) -> None:
        if self.zip is None:
            return
        self._end_member()
        for name, text in (("indexes/index.cdxj", "\n".join([*sorted(self.lines), ""])), ("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))):
            self.zip.writestr(zipfile.ZipInfo(name), text)
        self.zip.close()
        self.out.close()
        self.files.move(f"{self.folder}/.{self.name}.{self.token}", f"{self.folder}/{self.name}")
        self.done.append((self.name, len(self.lines), self.bytes))
        self.zip = None


def _key(url: str) -> str:
    """The host's labels from the last to the first, then the rest: urls of a site stand together."""
    rest = url.partition("://")[2] or url
    host, slash, path = rest.partition("/")
    return quote(",".join(reversed(host.lower().split("."))) + ")" + slash + path, safe=",)/?&=%:;@+$!*'(~#")


def _urn(page: int | None, digest: str, copy: int) -> str:
    return f"urn:page:{'' if page is None else page}:{digest[:32]}:{copy}"


def _page_of(urn: str) -> int | None:
    page = urn.split(":")[2]
    return int(page) if page else None


_DONE = pa.schema([("name", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])


def _write(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by digest and page: page_id, url, payload, digest, and for payloads that repeat their least page (first)."""
    writer, before, copy = _Writer(folder, TaskContext.get().partitionId()), None, 0
    for batch in batches:
        for page, url, payload, digest, repeats, first in zip(*(batch.column(i) for i in range(6)), strict=True):
            page, digest, first, payload = page.as_py(), digest.as_py(), first.as_py(), payload.as_buffer().to_pybytes() if payload.is_valid else b""
            copy = copy + 1 if (digest, page) == before else 0
            before = digest, page
            kind = "revisit" if repeats.as_py() and (page != first or copy) else "response"
            target = quote(url.as_py() or "", safe="%/:?#[]@!$&'()*+,;=-._~")
            data = record(kind, _urn(page, digest, copy), target, digest, len(payload), payload, _urn(first, digest, 0) if kind == "revisit" else None)
            writer.add(data, target, digest, _DATE)
    writer.end()
    if writer.done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*writer.done, strict=True), _DONE.types, strict=True)], schema=_DONE)
    give_back()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> list[tuple[str, int, int]]:
    """Writes every page into packages in folder; returns (name, records, bytes) per package, in order."""
    let_workers_import(pages.sparkSession)
    files, place = opened(folder)
    files.create_dir(place, recursive=True)
    payload = F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    bucket = F.pmod(F.xxhash64("page_id"), F.lit(BUCKETS)).alias("bucket")
    counts = rows.where(F.length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where(F.col("n") > 1)
    firsts = counts.select("digest", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BUCKETS - 1).cast("long"))).alias("bucket"), F.lit(True).alias("repeats"))
    # dealt out by number before the join, which then takes the partitions as they are: rows of one page and payload stay in one task
    dealt = rows.select("*", bucket).repartition(shuffle_partitions(pages.sparkSession), "digest", "bucket").join(firsts, ["digest", "bucket"], "left")
    ordered = dealt.sortWithinPartitions("digest", F.asc_nulls_last("page_id"), "url").select("page_id", "url", "payload", "digest", F.coalesce("repeats", F.lit(False)).alias("repeats"), "first")
    made = ordered.mapInArrow(lambda batches: _write(folder, batches), "name string, n_records long, n_bytes long")
    return sorted(map(tuple, made.collect()))  # a row per package


# --- reading -----------------------------------------------------------------------------------------------------------

_RECORD = pa.schema(
    [("package", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
     ("payload_digest", pa.string()), ("refers_to", pa.string()), ("status", pa.int32()), ("content_length", pa.int64()), ("payload", pa.binary())]
)


def entries(package: Package) -> list[tuple[str, int, int]]:
    """(member, offset, length) of every record that the package's indexes name, in the order of the file."""
    found = set()
    for name, member in package.members.items():
        if name.startswith("indexes/") and name.endswith((".cdx", ".cdxj")):
            for line in package.whole(member).decode().splitlines():
                if "{" in line:
                    known = json.loads(line[line.index("{") :])
                    found.add((f"archive/{known['filename']}", int(known["offset"]), int(known["length"])))
    return sorted(found)


def _runs(places: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Neighbouring records of one member, up to READ_BYTES."""
    run: list[tuple[str, int, int]] = []
    for name, offset, length in places:
        if run and (run[-1][0] != name or run[-1][1] + run[-1][2] != offset or offset + length - run[0][1] > READ_BYTES):
            yield run
            run = []
        run.append((name, offset, length))
    if run:
        yield run


def _bare(text: str | None) -> str | None:
    return text[1:-1] if text and text.startswith("<") and text.endswith(">") else text


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths of packages to their records."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RECORD.types, strict=True)], schema=_RECORD)

    for batch in batches:
        for path in batch.column(0).to_pylist():
            files, place = opened(path)
            rows, held = [], 0
            with files.open_input_file(place) as file:
                package = Package(file)
                for run in _runs(entries(package)):
                    name, begin = run[0][0], run[0][1]
                    data = memoryview(package.read(package.members[name], begin, run[-1][1] + run[-1][2] - begin))
                    for _, offset, length in run:
                        fields, status, headers, payload = parsed(bytes(data[offset - begin : offset - begin + length]))
                        size = headers.get("content-length", "")
                        digest = fields.get("warc-payload-digest")
                        rows.append((path, name, offset, length, fields.get("warc-type"), _bare(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields.get("warc-date"), digest, _bare(fields.get("warc-refers-to")), status, int(size) if size.isdigit() else None, payload))
                        held += len(payload)
                        if held >= _BATCH_BYTES or len(rows) >= 10_000:
                            yield made(rows)
                            rows, held = [], 0
            if rows:
                yield made(rows)
    give_back()


_RECORD_DDL = "package string, member string, offset long, length long, record_type string, record_id string, target_uri string, date string, payload_digest string, refers_to string, status int, content_length long, payload binary"


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All records of packages, a task per package: where each lies, its fields, and its payload."""
    let_workers_import(spark)
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    if paths:
        frame = frame.repartitionByRange(len(paths), "path")
    return frame.mapInArrow(_read, _RECORD_DDL)


def read_folder(spark: SparkSession, folder: str, pattern: str = "*.wacz") -> DataFrame:
    """All records of a folder's packages. Spark lists the files and reads none of them; tasks read what their packages' indexes name."""
    let_workers_import(spark)
    paths = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")
    return paths.repartition(shuffle_partitions(spark)).mapInArrow(_read, _RECORD_DDL)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes packages into the shared folder and reads them back, per page: page_id, payload_bytes, payload_digest, record_type, refers_to. They go when the session ends."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "packages")
    done = write(pages, folder)
    remove_at_exit(spark, folder)
    records = read(spark, [f"{folder}/{name}" for name, _, _ in done])

    def page(urn: str):
        found = F.split(urn, ":")[2]
        return F.when(found != "", found.cast("long"))

    response = F.col("record_type") == "response"
    return records.select(
        page("record_id").alias("page_id"), F.when(response, F.length("payload")).otherwise(F.col("content_length")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"),
    )
