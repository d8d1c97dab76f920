"""Byte-level BPE over length-bucketed, padded numpy matrices.

Each row of a matrix is a piece of text as byte tokens. In each round every row merges its leftmost pair of least rank: ranks
of adjacent pairs come from a hash table of pairs, kept beside the tokens, and only the two pairs next to a merge are looked
up again. Rows without a pair to merge leave the matrix. A piece beyond the widest bucket is merged by a heap of
(rank, place), in the same order, so that its cost is n log n.

Defined results: a null or empty text has no ids, decodes to nothing, and both digests are those of no bytes. Repeated rows are
encoded one by one. Extra columns are ignored by ``digests``. Strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import give_back, let_workers_import, text_or_empty
from pagewright.llm.pieces import PieceStore, Ragged, cut, slices, text_buffer

#: Widths of the buckets, in bytes. Longer pieces take the heap.
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512)
#: Distinct pieces that a worker remembers at most; then it starts anew. A piece takes about 150 bytes.
MOST_PIECES = 200_000
#: Pieces whose print is put together at a time.
_PIECES_AT_A_TIME = 100_000
_NONE = np.int32(2**31 - 1)
_ROWS = 1 << 16


class PairTable:
    """rank of a pair of adjacent tokens, looked up for arrays; open addressing with linear probes."""

    def __init__(self, pairs: dict[int, int]) -> None:
        self.bits = max(8, (len(pairs) * 4).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, _NONE, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        place, self.probes = self._home(keys), 0
        while len(keys):
            self.probes += 1
            free = self.keys[place] == -1
            first = np.zeros(len(keys), bool)
            first[np.unique(place, return_index=True)[1]] = True
            put = free & first
            self.keys[place[put]], self.ranks[place[put]] = keys[put], ranks[put]
            keys, ranks, place = keys[~put], ranks[~put], (place[~put] + 1) & (size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_NONE where the pair has no rank or a side is padding (-1)."""
        keys = (left.astype(np.int64) << 32) | right
        place = self._home(keys)
        out = np.full(keys.shape, _NONE, np.int32)
        hit = self.keys[place] == keys
        out[hit] = self.ranks[place[hit]]
        open_ = np.flatnonzero(~hit & (self.keys[place] != -1) & (left >= 0) & (right >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            place[open_] = (place[open_] + 1) & (len(self.keys) - 1)
            there = self.keys[place[open_]]
            same = there == keys[open_]
            out[open_[same]] = self.ranks[place[open_[same]]]
            open_ = open_[~same & (there != -1)]
        return out


class ByteBpe:
    """Encodes pieces of bytes by a rank file, and decodes ids."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, file.read().split(b"\n")))}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.pairs = {(a << 32) | b: r for t, r in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None}
        self.table = PairTable(self.pairs)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low = 1
        for width in WIDTHS:
            rows = np.flatnonzero((lengths >= low) & (lengths <= width))
            for at in range(0, len(rows), _ROWS):
                part = rows[at : at + _ROWS]
                for row, ids in zip(part.tolist(), self._matrix([pieces[i] for i in part.tolist()], lengths[part], width), strict=True):
                    out[row] = ids
            low = width + 1
        for row in np.flatnonzero(lengths >= low).tolist():
            out[row] = self._long(pieces[row])
        return out

    def _matrix(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> list[list[int]]:
        n = len(pieces)
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        tokens = np.full((n, width), -1, np.int32)
        columns = np.arange(width)
        tokens[columns < lengths[:, None]] = flat
        ranks = np.full((n, width), _NONE, np.int32)
        ranks[:, :-1] = self.table(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width - 1)
        done = np.full((n, width), -1, np.int32)
        live, left = np.arange(n), lengths.copy()
        while len(live):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(live))
            best = ranks[rows, at]
            over = best == _NONE
            if over.any():
                done[live[over], : tokens.shape[1]] = tokens[over]
                keep = ~over
                live, left, tokens, ranks, at, best = live[keep], left[keep], tokens[keep], ranks[keep], at[keep], best[keep]
                if not len(live):
                    break
                wide = max(2, int(left.max()))
                if wide < tokens.shape[1]:
                    tokens, ranks = tokens[:, :wide], ranks[:, :wide]
                rows = np.arange(len(live))
            w = tokens.shape[1]
            source = np.minimum(np.arange(w) + (np.arange(w) > at[:, None]), w - 1)
            tokens, ranks = np.take_along_axis(tokens, source, 1), np.take_along_axis(ranks, source, 1)
            tokens[rows, at] = best
            left -= 1
            tokens[np.arange(w) >= left[:, None]] = -1
            after = np.where(at + 1 < w, tokens[rows, np.minimum(at + 1, w - 1)], -1)
            ranks[rows, at] = self.table(best, after)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.table(tokens[has, at[has] - 1], best[has])
            ranks[np.arange(w) >= left[:, None] - 1] = _NONE
        counts = (done >= 0).sum(axis=1)
        ids, ends = done[done >= 0].tolist(), np.cumsum(counts).tolist()
        return [ids[b - c : b] for b, c in zip(ends, counts.tolist(), strict=True)]

    def _long(self, piece: bytes) -> list[int]:
        tokens = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, i) for i in range(n - 1) if (r := get((tokens[i] << 32) | tokens[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if tokens[i] < 0 or j >= n or get((tokens[i] << 32) | tokens[j]) != rank:
                continue
            tokens[i], tokens[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get((rank << 32) | tokens[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get((tokens[h] << 32) | rank)) is not None:
                heapq.heappush(heap, (r, h))
        return [t for t in tokens if t >= 0]

    def encode(self, text: str) -> list[int]:
        data, offsets = text_buffer(pa.array([text]))
        start, whole = cut(data, offsets).tolist(), data.tobytes()
        return [i for ids in self.encode_pieces([whole[a:b] for a, b in zip(start, [*start[1:], int(offsets[-1])], strict=False)]) for i in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Known:
    """What the pieces of a store became: ids, their decimal print, and the bytes that they decode to."""

    def __init__(self, path: str) -> None:
        self.coder = coder(path)
        self.forget()
        self.store = PieceStore(self.learn, self.forget, MOST_PIECES)

    def forget(self) -> None:
        self.ids, self.printed, self.decoded = Ragged("<i4"), Ragged("u1"), Ragged("u1")

    def learn(self, pieces: list[bytes]) -> None:
        ids = self.coder.encode_pieces(pieces)
        self.ids.extend(np.array([i for x in ids for i in x]), np.fromiter(map(len, ids), np.int64, len(ids)))
        for room, made in ((self.printed, ["".join(f"{i}," for i in x).encode() for x in ids]), (self.decoded, [*map(self.coder.decode, ids)])):
            room.extend(np.frombuffer(b"".join(made), np.uint8), np.fromiter(map(len, made), np.int64, len(made)))


_coders: dict[str, ByteBpe] = {}
_stores: dict[str, _Known] = {}


def coder(path: str) -> ByteBpe:
    """One per worker and rank file."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


def _known(path: str) -> _Known:
    if path not in _stores:
        _stores[path] = _Known(path)
    return _stores[path]


_RANKS = "byte_bpe_multi_50k.tiktoken"
_DIGESTS = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _hashes(room: Ragged, numbers: np.ndarray, bounds: np.ndarray, behind: int) -> list[str]:
    """sha256 of what the pieces of each text are, put together, without so many bytes at the end of a text that has pieces."""
    out, held, text = [], hashlib.sha256(), 0
    for at in range(0, max(1, len(numbers)), _PIECES_AT_A_TIME):
        flat, ends = room.take(numbers[at : at + _PIECES_AT_A_TIME])
        last = at + len(ends) - 1
        begin = 0
        while text < len(bounds) - 1 and bounds[text + 1] <= last:
            end = int(ends[bounds[text + 1] - at])
            held.update(flat[begin : max(begin, end - (behind if bounds[text + 1] > bounds[text] else 0))])
            out.append(held.hexdigest())
            held, text, begin = hashlib.sha256(), text + 1, end
        if text < len(bounds) - 1:
            held.update(flat[begin:])
    return out


def _digest_batches(path: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _known(path or public_tokenizers.path(_RANKS))  # where the worker has it
    for batch in batches:
        counts, ids, texts = [], [], []
        for part in slices(batch.column(1)):
            numbers, bounds = known.store.numbers(part)
            before = np.concatenate([[0], np.cumsum(known.ids.counts[numbers])])
            counts += np.diff(before[bounds]).tolist()
            ids += _hashes(known.printed, numbers, bounds, 1)
            texts += _hashes(known.decoded, numbers, bounds, 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t.type) for x, t in zip((counts, ids, texts), _DIGESTS, strict=True))], names=["doc_id", *_DIGESTS.names])
    give_back()


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: the number of ids, and sha256 of the ids in decimal, joined by commas, and of the bytes that they decode to."""
    let_workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _digest_batches(path, batches), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _token_batches(path: str | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _known(path or public_tokenizers.path(_RANKS))  # where the worker has it
    for batch in batches:
        out = []
        for part in slices(batch.column(1)):
            numbers, bounds = known.store.numbers(part)
            ids, ends = known.ids.take(numbers)
            ends = ends[bounds].tolist()
            out += [ids[a:b] for a, b in zip(ends, ends[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its ids, as an array."""
    let_workers_import(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _token_batches(path, batches), f"doc_id {kind}, ids array<int>")
