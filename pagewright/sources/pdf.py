"""What can be read of a PDF file without a renderer: its number of pages, the text of its pages, and whether it is tagged.

A reader of the format's outer parts: objects in the file and in object streams, Flate compression, the page tree, and the text operators of content
streams with single-byte strings in Latin-1 or UTF-16. Fonts with encodings of their own need a library behind ``page_rows``' reader parameter."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from pagewright.workers import let_workers_import

_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
_OBJECT_END = re.compile(rb"\bendobj")
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+(\d+)\s+R")
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\bT[jJdDm*]|\bBT|\bET|['\"]|-?\d*\.?\d+|\]|\[", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Fixed value: a shift of so many thousandths to the left between two strings is a space.
_GAP = -200.0


@dataclass(frozen=True)
class Pdf:
    texts: list[str]
    tagged: bool

    @property
    def pages(self) -> int:
        return len(self.texts)


def _inflated(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    if b"FlateDecode" in body[: found.start()]:
        reader = zlib.decompressobj()
        try:
            return reader.decompress(found.group(1))
        except zlib.error:
            return b""
    return found.group(1)


def _objects(data: bytes) -> dict[int, bytes]:
    """Bodies by number; the last one of a number counts, as later parts of a file update earlier ones."""
    found: dict[int, bytes] = {}
    at = 0
    while (begin := _OBJECT.search(data, at)) and (end := _OBJECT_END.search(data, begin.end())):  # without an end behind it there is none behind any other
        found[int(begin.group(1))] = data[begin.end() : end.start()]
        at = end.end()
    for body in list(found.values()):
        if b"/ObjStm" in body:
            flat, n, first = _inflated(body), _number(body, b"/N"), _number(body, b"/First")
            head = list(map(int, flat[:first].split()[: 2 * n]))
            ends = [*head[3::2], len(flat) - first]
            for number, start, end in zip(head[::2], head[1::2], ends, strict=False):
                found.setdefault(number, flat[first + start : first + end])
    return found


def _number(body: bytes, name: bytes) -> int:
    found = re.search(re.escape(name) + rb"\s+(\d+)", body)
    return int(found.group(1)) if found else 0


def _references(body: bytes, name: bytes) -> list[int]:
    """The objects that an entry names, one or an array of them."""
    found = re.search(re.escape(name) + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(m.group(1)) for m in _REFERENCE.finditer(found.group(1))] if found else []


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m.group(1), 8) & 255]) if m.group(1)[:1].isdigit() and m.group(1)[:1] < b"8" else b"" if m.group(1) in (b"\n", b"\r\n") else _ESCAPES.get(m.group(1), m.group(1)), token[1:-1], flags=re.S)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def _shown(content: bytes) -> str:
    """The text that a content stream shows; a move to another line is a line feed."""
    out, held, numbers, in_array = [], [], [], False
    for m in _SHOWN.finditer(content):
        token = m.group()
        if token[:1] == b"(" or token[:1] == b"<":
            held.append(_string(token))
        elif token == b"[":
            in_array = True
        elif token == b"]":
            in_array = False
        elif token[:1] in b"-.0123456789":
            numbers.append(float(token))
            if in_array and float(token) < _GAP and held:
                held.append(" ")
        else:
            if token in (b"'", b'"', b"T*", b"ET") or token in (b"Td", b"TD") and numbers and numbers[-1] != 0 or token == b"Tm":
                out.append("\n")
            if token in (b"Tj", b"TJ", b"'", b'"'):
                out += held
            held, numbers = [], []
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")


def _root(objects: dict[int, bytes]) -> bytes:
    return next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")


def _page_numbers(objects: dict[int, bytes]) -> list[int]:
    """The objects that are pages, in order."""
    pages: list[int] = []
    stack, seen = _references(_root(objects), b"/Pages"), set()
    while stack:
        number = stack.pop(0)
        body = objects.get(number, b"")
        if number in seen or not body:
            continue
        seen.add(number)
        if re.search(rb"/Type\s*/Pages\b", body):
            stack = _references(body, b"/Kids") + stack
        else:
            pages.append(number)
    return pages


def read(data: bytes) -> Pdf:
    """A file's pages in order. What isn't a PDF has none; a page whose content can't be read has an empty text."""
    objects = _objects(data or b"")
    root = _root(objects)
    texts = ["\n".join(filter(None, (_shown(_inflated(objects.get(n, b""))) for n in _references(objects[p], b"/Contents")))) for p in _page_numbers(objects)]
    marked = re.search(rb"/Marked\s+true\b", root + b" ".join(objects.get(n, b"") for n in _references(root, b"/MarkInfo")))
    return Pdf(texts, bool(marked) or b"/StructTreeRoot" in root)


def page_rows(files: DataFrame, reader: Callable[[bytes], Pdf] = read) -> DataFrame:
    """files: path, content (as Spark's binaryFile source gives them). A row per page: path, index, text, and the file's number of pages and tags."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = reader(content)
                n = found.pages
                yield pa.RecordBatch.from_pydict({"path": [path] * n, "index": pa.array(range(n), pa.int32()), "text": pa.array(found.texts, pa.string()), "page_count": pa.array([n] * n, pa.int32()), "tagged": [found.tagged] * n})

    let_workers_import(files.sparkSession)
    return files.select("path", "content").mapInArrow(rows, "path string, index int, text string, page_count int, tagged boolean")


def summaries(files: DataFrame, reader: Callable[[bytes], Pdf] = read) -> DataFrame:
    """files: path, content. (path, page_count, tagged); 0 pages for what can't be read."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [reader(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.pages for x in found], pa.int32()), pa.array([x.tagged for x in found], pa.bool_())], names=["path", "page_count", "tagged"])

    let_workers_import(files.sparkSession)
    return files.select("path", "content").mapInArrow(rows, "path string, page_count int, tagged boolean")


_INHERITED = (b"/Resources", b"/MediaBox", b"/CropBox", b"/Rotate")


def _value(body: bytes, name: bytes) -> bytes:
    """The value of an entry of a dictionary as it stands there; empty if there is none."""
    found = re.search(re.escape(name) + rb"(?![A-Za-z])\s*", body)
    if not found:
        return b""
    at, depth = found.end(), 0
    if body[at : at + 2] != b"<<" and body[at : at + 1] != b"[":
        simple = re.compile(rb"\d+\s+\d+\s+R|[^\s/<>\[\]]+|/[^\s/<>\[\]]+").match(body, at)
        return simple.group() if simple else b""
    for m in re.compile(rb"<<|>>|\[|\]").finditer(body, at):
        depth += 1 if m.group() in (b"<<", b"[") else -1
        if not depth:
            return body[at : m.end()]
    return b""


def _text(value: str) -> bytes:
    return b"<" + ("\ufeff" + value).encode("utf-16-be").hex().upper().encode() + b">"


def select(data: bytes, indices: list[int], title: str = "", subject: str = "") -> bytes:
    """A file of some pages of another, in the order given, each as often as it is named; raises IndexError for a page that isn't there."""
    objects = _objects(data or b"")
    pages = _page_numbers(objects)
    if any(not 0 <= i < len(pages) for i in indices):
        raise IndexError("no such page")
    wanted = [pages[i] for i in indices]
    tree, root, info = (max(objects, default=0) + k for k in (1, 2, 3))
    out: dict[int, bytes] = {}
    kids, free = [], info + 1
    for number in wanted:
        body, above, held = objects[number], objects.get(_parent(objects[number]), b""), b""
        for name in _INHERITED:
            node, seen = above, 0
            while node and not _value(body, name) and seen < 50:
                if value := _value(node, name):
                    held += name + b" " + value + b" "
                    break
                node, seen = objects.get(_parent(node), b""), seen + 1
        alone = re.sub(rb"/Parent\s+\d+\s+\d+\s+R", b"", body)
        own, free = (number, free) if number not in out else (free, free + 1)
        out[own] = alone.replace(b"<<", b"<< /Parent %d 0 R " % tree + held, 1)
        kids.append(own)
    todo = [int(m.group(1)) for n in kids for m in _REFERENCE.finditer(out[n])]
    while todo:  # what the pages refer to; other pages stay behind
        number = todo.pop()
        if number in objects and number not in out and number not in pages:
            out[number] = objects[number]
            todo += [int(m.group(1)) for m in _REFERENCE.finditer(_STREAM.sub(b"", objects[number]))]
    out[tree] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % n for n in kids))
    out[root] = b"<< /Type /Catalog /Pages %d 0 R >>" % tree
    out[info] = b"<< /Title " + _text(title) + b" /Subject " + _text(subject) + b" >>"
    made, places = bytearray(b"%PDF-1.7\n"), {}
    for number, body in sorted(out.items()):
        places[number] = len(made)
        made += b"%d 0 obj\n" % number + body.strip(b"\r\n ") + b"\nendobj\n"
    start = len(made)
    made += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % x for x in sorted(places.items()))
    return bytes(made + b"trailer\n<< /Size %d /Root %d 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (max(out) + 1, root, info, start))


def _parent(body: bytes) -> int:
    found = _references(body, b"/Parent")
    return found[0] if found else 0
