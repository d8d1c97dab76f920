"""Cutting text into the pieces that byte-level BPE encodes one by one, over whole batches of UTF-8 bytes at a time.

``cut`` gives the matches of the usual pattern of byte-level tokenizers (public_tokenizers.PATTERN): runs of letters, of numbers or of
other marks, each with one space before it; short English contractions; and white space. ``PieceStore`` numbers distinct pieces: a
64-bit hash finds a piece in a table of bounded size, and its bytes confirm it."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

_LETTER, _NUMBER, _OTHER, _SPACE = range(4)
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    """The class of each code point; made once per worker."""
    if not _classes:
        table = np.full(0x110000, _OTHER, np.uint8)
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every = "".join(map(chr, points))
        numbers = np.array(points)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[numbers[m.start() : m.end()]] = kind
        _classes.append(table)
    return _classes[0]


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to. data: valid UTF-8, with 4 zero bytes behind it."""
    table = char_classes()
    out = table[:256][data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        b0, b1, b2, b3 = (data[at + k].astype(np.int32) for k in range(4))
        point = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, (b0 & 7) << 18 | (b1 & 63) << 12 | (b2 & 63) << 6 | b3 & 63))
        kind = table[point]
        for k, rows in ((0, slice(None)), (1, slice(None)), (2, b0 >= 0xE0), (3, b0 >= 0xF0)):
            out[at[rows] + k] = kind[rows]
    return out


def cut(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start in the first offsets[-1] bytes of data. offsets: where texts start, and the end; data as for byte_classes."""
    n = int(offsets[-1])
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)[:n]
    begins = np.zeros(n + 4, bool)
    begins[offsets[:-1][offsets[:-1] < n]] = True
    start = np.zeros(n + 4, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start[:n] |= begins[:n]
    runs = np.flatnonzero(start[:n])
    after = runs[1:][(kind[runs[:-1]] == _SPACE) & ~begins[runs[1:]]]  # where a white-space run gives way to something else
    last = after - 1
    spaced = data[last] == 0x20
    start[after[spaced]] = False
    for _ in range(3):  # to the first byte of a character of several bytes
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    quotes = np.flatnonzero((data[:n] == 0x27) & start[:n])
    quotes = quotes[(quotes + 1 < n) & ~begins[quotes + 1]]
    b1, b2 = data[quotes + 1], data[quotes + 2]
    one = np.isin(b1, np.frombuffer(b"stmd", np.uint8))
    two = (((b1 == ord("r")) | (b1 == ord("v"))) & (b2 == ord("e")) | (b1 == ord("l")) & (b2 == ord("l"))) & (quotes + 2 < n) & ~begins[quotes + 2]
    start[quotes[one | two] + 1] = False
    start[quotes[one] + 2] = True
    start[quotes[two] + 3] = True
    return np.flatnonzero(start[:n])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array without nulls, with 4 zero bytes behind, and the texts' offsets from 0."""
    wide = column.cast(pa.large_string())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = np.zeros(offsets[-1] - offsets[0] + 4, np.uint8)
    if len(data) > 4:
        data[:-4] = np.frombuffer(wide.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20):
    """Parts of a string array of about ``most`` bytes each; a longer text is a part of its own."""
    sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(column).fill_null(0)))])
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + most, "right")) - 1)
        yield column.slice(at, end - at)
        at = end


_BASE = 0x9E3779B97F4A7C15
_byte_values = np.random.default_rng(20).integers(0, 2**64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """s with s[i] for the first i bytes; ``range_hashes`` takes differences of it."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values[data] * up[: len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from start to end, the same wherever they stand."""
    _, down = powers(len(prefix))
    return mixed((prefix[end] - prefix[start]) * down[start])


class PieceIndex:
    """Numbers from 0 for 64-bit hashes: open addressing over arrays, grown to stay under half full."""

    def __init__(self) -> None:
        self.size = 0
        self._room(1 << 12)

    def _room(self, slots: int) -> None:
        old = getattr(self, "slot_keys", None)
        kept = old[self.slot_numbers >= 0] if old is not None else np.zeros(0, np.uint64)
        numbers = self.slot_numbers[self.slot_numbers >= 0] if old is not None else np.zeros(0, np.int32)
        self.mask, self.shift = np.int64(slots - 1), np.uint64(64 - (slots.bit_length() - 1))
        self.slot_keys, self.slot_numbers = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self._place(kept, numbers)

    def _place(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        place = (keys >> self.shift).astype(np.int64)
        while len(keys):
            first = np.zeros(len(keys), bool)
            first[np.unique(place, return_index=True)[1]] = True
            put = first & (self.slot_numbers[place] < 0)
            self.slot_keys[place[put]], self.slot_numbers[place[put]] = keys[put], numbers[put]
            keys, numbers, place = keys[~put], numbers[~put], (place[~put] + 1) & self.mask

    def add(self, keys: np.ndarray) -> None:
        """keys: distinct and not yet there; they get the next numbers."""
        numbers = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self.size += len(keys)
        if 2 * self.size > len(self.slot_keys):
            self._room(1 << (4 * self.size).bit_length())
        self._place(keys, numbers)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers, -1 where there is none."""
        place = (keys >> self.shift).astype(np.int64)
        out = self.slot_numbers[place]
        open_ = np.flatnonzero((out >= 0) & (self.slot_keys[place] != keys))
        while len(open_):
            place[open_] = (place[open_] + 1) & self.mask
            there = self.slot_numbers[place[open_]]
            out[open_] = there
            open_ = open_[(there >= 0) & (self.slot_keys[place[open_]] != keys[open_])]
        return out


#: Ranges of up to this many bytes are held in two words, which say all of them.
SHORT = 16
_WORD_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def packed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes from each start to its end, as two little-endian words; zero behind the end."""
    room = np.zeros(len(data) + SHORT, np.uint8)
    room[: len(data)] = data
    words = np.ndarray((len(data) + SHORT - 7,), "<u8", room, strides=(1,))
    out = []
    for at in (0, 8):
        length = np.clip(end - start - at, 0, 8).astype(np.uint64)
        mask = np.where(length == 0, np.uint64(0), np.uint64(2**64 - 1) >> (np.uint64(64) - np.maximum(length, 1) * np.uint64(8)))
        out.append(words[np.minimum(start + at, len(words) - 1)] & mask)
    return out[0], out[1]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, pair: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """64-bit hashes of the bytes from start to end: of their two words and length up to 16 bytes, beyond that of a cryptographic digest."""
    low, high = pair or packed(data, start, end)
    length = end - start
    out = mixed(mixed(low * _WORD_FACTORS[0] + length.astype(np.uint64)) + mixed(high * _WORD_FACTORS[1] + _WORD_FACTORS[2]))
    long = np.flatnonzero(length > SHORT)
    if len(long):
        whole = data.tobytes()
        digest = b"".join(hashlib.blake2b(whole[a:b], digest_size=8).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True))
        out[long] = np.frombuffer(digest, "<u8")
    return out


class PieceStore:
    """Numbers distinct pieces by their bytes; ``learn`` is called with the bytes of new ones, in the order of their numbers, and ``forget`` when
    the store would hold more than ``most`` pieces or ``most_bytes`` bytes and starts anew, so that a worker's memory is bounded.

    A hash only finds a candidate: its words, and the bytes of pieces beyond two words, are compared, and a piece whose place is taken by another of the
    same hash looks on under a next hash."""

    def __init__(self, learn, forget, most: int = 1_000_000, most_bytes: int = 64 << 20, hashes=word_hashes) -> None:
        self.learn, self.forget, self.most, self.most_bytes, self.hashes = learn, forget, most, most_bytes, hashes
        self._empty()

    def _empty(self) -> None:
        self.index, self.held = PieceIndex(), 0
        self.known = [Ragged("<u8"), Ragged("<u8"), Ragged("<i8")]  # both words and the length, by number
        self.long: dict[int, bytes] = {}

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of each piece of the texts, and how many pieces come before each text (and in all)."""
        data, offsets = text_buffer(column)
        start = cut(data, offsets)
        end = np.append(start[1:], offsets[-1])[: len(start)]
        pair = packed(data, start, end)
        pieces = (*pair, end - start, start, data.tobytes())
        keys = self.hashes(data, start, end, pair)
        found = self._find(pieces, np.arange(len(start)), keys)
        if (found < 0).any():
            found = self._new(pieces, keys, found)
        return found, np.searchsorted(start, offsets)

    def _find(self, pieces, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Numbers of the rows' pieces, -1 where there is none; keys moves on to the hash under which the search ended."""
        low, high, length, start, whole = pieces
        found = self.index.find(keys[rows])
        open_ = np.flatnonzero(found >= 0)
        while len(open_):
            at, numbers = rows[open_], found[open_]
            same = (self.known[0].values[numbers] == low[at]) & (self.known[1].values[numbers] == high[at]) & (self.known[2].values[numbers] == length[at])
            for i in np.flatnonzero(same & (length[at] > SHORT)).tolist():
                a = int(start[at[i]])
                same[i] = whole[a : a + int(length[at[i]])] == self.long[int(numbers[i])]
            open_ = open_[~same]
            keys[rows[open_]] = mixed(keys[rows[open_]] + _WORD_FACTORS[0])
            found[open_] = self.index.find(keys[rows[open_]])
            open_ = open_[found[open_] >= 0]
        return found

    def _new(self, pieces, keys, found):
        low, high, length, start, whole = pieces
        fresh = np.flatnonzero(found < 0)
        first = np.unique(keys[fresh], return_index=True)[1]
        if self.index.size and (self.index.size + len(first) > self.most or self.held + int(length[fresh[first]].sum()) > self.most_bytes):
            self._empty()
            self.forget()
            fresh = np.arange(len(keys))
        while len(fresh):  # a round more for each further piece of one hash
            rows = fresh[np.unique(keys[fresh], return_index=True)[1]]
            size = self.index.size
            own = [whole[a : a + n] for a, n in zip(start[rows].tolist(), length[rows].tolist(), strict=True)]
            self.learn(own)
            self.long.update((size + i, own[i]) for i in np.flatnonzero(length[rows] > SHORT).tolist())
            for known, values in zip(self.known, (low, high, length), strict=True):
                known.extend(values[rows], np.ones(len(rows), np.int64))
            self.held += int(length[rows].sum())
            self.index.add(keys[rows])
            found[fresh] = self._find(pieces, fresh, keys)
            fresh = fresh[found[fresh] < 0]
        return found


class Ragged:
    """Growing arrays of unequal lengths, one after another, in room that doubles."""

    def __init__(self, kind: str) -> None:
        self._values, self._counts, self._starts = np.zeros(16, kind), np.zeros(16, np.int64), np.zeros(16, np.int64)
        self.used, self.size = 0, 0

    @property
    def values(self) -> np.ndarray:
        return self._values[: self.used]

    @property
    def counts(self) -> np.ndarray:
        return self._counts[: self.size]

    @staticmethod
    def _put(room: np.ndarray, used: int, values: np.ndarray) -> np.ndarray:
        if used + len(values) > len(room):
            wider = np.zeros(max(2 * len(room), used + len(values)), room.dtype)
            wider[:used] = room[:used]
            room = wider
        room[used : used + len(values)] = values
        return room

    def extend(self, values: np.ndarray, counts: np.ndarray) -> None:
        self._starts = self._put(self._starts, self.size, self.used + np.cumsum(counts) - counts)
        self._counts = self._put(self._counts, self.size, counts)
        self._values = self._put(self._values, self.used, values)
        self.size, self.used = self.size + len(counts), self.used + len(values)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' values one after another, and where each row's begin (and the end)."""
        counts = self._counts[rows]
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self._values[np.repeat(self._starts[rows] - ends[:-1], counts) + np.arange(ends[-1])], ends
