"""Token ids as flat binary files with 64-bit offsets, and reading them back through memory maps.

File format, in a folder that driver and executors share:

* ``part-NNNNN.bin``: ids of the part's documents one after another, little-endian unsigned integers of the width that the
  manifest names (2 bytes where the vocabulary allows, else 4);
* ``part-NNNNN.idx``: little-endian signed 64-bit: the documents' number n, n + 1 offsets in ids from the part's start, n ids of
  documents, then n bytes of which 1 marks a null document id;
* ``manifest.json``: the width, and per part its documents, its ids, and its base, the prefix sum of the ids of all parts before.

Documents are dealt out by ranges of the document id and the first characters of the text, and sorted, so parts and the documents in them ascend (null first; equal
ids by text). Each task writes under a name of its own and renames at the end: a repeated task leaves the same file. Only the
manifest's rows, one per part, reach the driver.

Defined results: a null or empty text is the end id alone. Repeated rows are written one by one. An empty table gives a manifest
without parts. Extra columns are ignored. A special token's string in a text is that token, as the tokenizers library has it
by default.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from urllib.parse import unquote, urlsplit

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import let_workers_import, remove_at_exit, scratch_path, shuffle_partitions, text_or_empty
from pagewright.llm.pieces import PieceStore, Ragged, slices

#: Distinct pieces that a worker remembers at most; then it starts anew.
MOST_PIECES = 1_000_000
_VOCABULARY = "byte_bpe_50k.json"


class LibraryEncoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece once: its byte-level pre-tokenizer cuts a text into
    pieces and encodes each by itself. Texts with a special token's string go to the library whole, and so do all texts
    where the file's pre-tokenizer is another one."""

    def __init__(self, path: str, width: int) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.kind = Tokenizer.from_file(path), f"<u{width}"
        with open(path) as file:
            own = json.load(file)
        form = own["pre_tokenizer"] or {}
        self.by_pieces = form.get("type") == "ByteLevel" and form.get("use_regex") and not form.get("add_prefix_space") and not own["normalizer"]
        self.special = [t["content"] for t in own["added_tokens"]]
        self.known = Ragged(self.kind)
        self.store = PieceStore(self._learn, self._forget, MOST_PIECES)

    def _forget(self) -> None:
        self.known = Ragged(self.kind)

    def _direct(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> None:
        """Pieces in one text of the library, with a line feed between them, are encoded apart: a line feed is a piece of its own there,
        as white space before the space or the other mark that a piece begins with. Pieces with white space beyond one leading space go by themselves."""
        texts = [x.decode() for x in pieces]
        ids: list[list[int]] = [[]] * len(texts)
        plain = [i for i, x in enumerate(texts) if not any(map(str.isspace, x[1:] if x[0] == " " and len(x) > 1 else x))]
        for at in range(0, len(plain), 512):
            some = plain[at : at + 512]
            made = np.array(self._direct(["\n".join(texts[i] for i in some)])[0], np.int64)
            ends = np.append(np.flatnonzero(made == self.line_feed), len(made))
            if len(ends) != len(some):
                raise AssertionError("a piece was not encoded apart")
            flat, start = made.tolist(), 0
            for i, end in zip(some, ends.tolist(), strict=True):
                ids[i], start = flat[start:end], end + 1
        rest = sorted(set(range(len(texts))) - set(plain))
        for i, own in zip(rest, self._direct([texts[i] for i in rest]), strict=True):
            ids[i] = own
        self.known.extend(np.array([t for x in ids for t in x]), np.fromiter(map(len, ids), np.int64, len(ids)))

    @cached_property
    def line_feed(self) -> int:
        return self._direct(["\n"])[0][0]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (and the end)."""
        if self.by_pieces and not any(pc.any(pc.match_substring(texts, s)).as_py() for s in self.special):
            numbers, bounds = self.store.numbers(texts)
            ids, ends = self.known.take(numbers)
            return ids, ends[bounds]
        ids = self._direct(texts.to_pylist())
        return np.array([t for x in ids for t in x], self.kind), np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])


_encoders: dict[tuple[str, int], LibraryEncoder] = {}


def _encoder(path: str, width: int) -> LibraryEncoder:
    if (path, width) not in _encoders:
        _encoders[path, width] = LibraryEncoder(path, width)
    return _encoders[path, width]


def _local(folder: str) -> str:
    """The shared folder's path for memory maps; it must be mounted on driver and executors."""
    parts = urlsplit(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped: {folder} has to be a mounted folder")
    return unquote(parts.path) if parts.scheme else folder


def _write(folder: str, path: str | None, width: int, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    encode = _encoder(path or public_tokenizers.path(_VOCABULARY), width)  # where the worker has it
    name, own = f"part-{part:05d}", f".{uuid.uuid4().hex}"
    sizes, ids, nulls = [np.zeros(1, np.int64)], [], []
    with open(f"{folder}/{name}.bin{own}", "wb") as out:
        for batch in batches:
            column = batch.column(0)
            ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            nulls.append(column.is_null().to_numpy(zero_copy_only=False).astype("u1"))
            for texts in slices(batch.column(1)):
                made, bounds = encode(texts)
                sizes.append(np.diff(bounds) + 1)
                out.write(np.insert(made, bounds[1:], end_id).astype(f"<u{width}").tobytes())
    offsets = np.cumsum(np.concatenate(sizes)).astype("<i8")
    n = len(offsets) - 1
    if n:
        with open(f"{folder}/{name}.idx{own}", "wb") as out:
            out.write(b"".join([np.array([n], "<i8").tobytes(), offsets.tobytes(), *(x.tobytes() for x in ids), *(x.tobytes() for x in nulls)]))
        os.replace(f"{folder}/{name}.idx{own}", f"{folder}/{name}.idx")
        os.replace(f"{folder}/{name}.bin{own}", f"{folder}/{name}.bin")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n], "n_tokens": [int(offsets[-1])]}, pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
    else:
        os.remove(f"{folder}/{name}.bin{own}")


@dataclass(frozen=True)
class TokenFiles:
    """A written set: its folder, the width of an id in bytes, and (part, documents, ids, base) in order."""

    folder: str
    width: int
    parts: list[tuple[int, int, int, int]]


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> TokenFiles:
    """Encodes every text, ends it with end_id, and writes the set into folder."""
    spark = docs.sparkSession
    let_workers_import(spark)
    with open(path or public_tokenizers.path(_VOCABULARY)) as f:
        model = json.load(f)
    most = max([end_id, *model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])])
    width, place = (2 if most < 1 << 16 else 4), _local(folder)
    os.makedirs(place, exist_ok=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    # the text's beginning parts rows of one id, or without any, that a range by the id alone would leave in one task
    dealt = rows.repartitionByRange(shuffle_partitions(spark), F.col("doc_id"), F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    made = dealt.mapInArrow(lambda batches: _write(place, path, width, end_id, batches), "part int, n_docs long, n_tokens long")
    parts, base = [], 0
    for part, n, ids in sorted(map(tuple, made.collect())):  # one row per part
        parts.append((part, n, ids, base))
        base += ids
    done = TokenFiles(folder, width, parts)
    with open(f"{place}/manifest.json.tmp", "w") as f:
        json.dump({"width": width, "parts": parts}, f)
    os.replace(f"{place}/manifest.json.tmp", f"{place}/manifest.json")
    return done


def load(folder: str) -> TokenFiles:
    with open(f"{_local(folder)}/manifest.json") as f:
        known = json.load(f)
    return TokenFiles(folder, known["width"], [tuple(x) for x in known["parts"]])


class Part:
    """One part, memory-mapped."""

    def __init__(self, folder: str, part: int, width: int) -> None:
        name = f"{_local(folder)}/part-{part:05d}"
        index = np.memmap(f"{name}.idx", "u1", "r")
        n = int(index[:8].view("<i8")[0])
        longs = index[8 : 8 + 8 * (2 * n + 1)].view("<i8")
        self.offsets, self.doc_ids, self.nulls = longs[: n + 1], longs[n + 1 :], index[8 + 8 * (2 * n + 1) :]
        self.ids = np.memmap(f"{name}.bin", f"<u{width}", "r")

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(folder: str, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for number, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = Part(folder, number, width)
            for at in range(0, len(part), 10_000):
                rows = range(at, min(len(part), at + 10_000))
                crc = [zlib.crc32(part[i].astype("<u4").tobytes()) for i in rows]
                ends = part.offsets[at : at + len(rows) + 1]
                ids = pa.array(part.doc_ids[at : at + len(rows)], mask=part.nulls[at : at + len(rows)].astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(ends[:-1] + base), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], schema=_ROWS)


def read(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, and the crc32 of its ids as uint32."""
    let_workers_import(spark)
    folder, width = files.folder, files.width
    parts = spark.createDataFrame([(p, b) for p, _, _, b in files.parts], "part int, base long")
    if files.parts:
        parts = parts.repartition(len(files.parts))
    return parts.mapInArrow(lambda batches: _read(folder, width, batches), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame) -> DataFrame:
    """Writes docs into the shared folder, and reads the files, which go when the session ends."""
    folder = scratch_path(docs.sparkSession, "token-files")
    files = write(docs, folder)
    remove_at_exit(docs.sparkSession, folder)
    return read(docs.sparkSession, files)
