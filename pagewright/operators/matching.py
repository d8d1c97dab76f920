"""Equal runs of two texts as the standard library's sequence matcher finds them (the longest first, of equals the first; then left and right of it), for many pairs side by side.

The matcher looks at every pair of equal letters for every run, which grows with the square of a text. Here stretches of a power of two letters are numbered, so that a stretch of any
length is known by the numbers of its two halves (they overlap); the longest common one of all ranges is found by halving its length, and all of that length are taken in one walk. Each
step sorts the letters that are left. Ranges without a run of the least length end."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np

#: Letters that are looked at side by side.
_LETTERS = 400_000
#: Numbers of two halves and a range are put together below this bound; above it they are ranked.
_MOST = 1 << 61


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.unique(first * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1].astype(np.int64)


class _Names:
    """Numbers of stretches of both texts, by the power of two of their length."""

    def __init__(self, text: np.ndarray) -> None:
        self.levels = [np.unique(text, return_inverse=True)[1].astype(np.int64)]

    def of(self, starts: np.ndarray, lengths: np.ndarray, ranges: np.ndarray, n_ranges: int) -> np.ndarray:
        """A number per stretch, equal where range and letters are."""
        k = np.frexp(lengths)[1] - 1
        while len(self.levels) <= k.max(initial=0):
            half = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(_ranks(last[:-half], last[half:]) if len(last) > half else np.zeros(0, np.int64))
        first, second = np.empty_like(starts), np.empty_like(starts)
        for level in np.unique(k):
            own = slice(None) if (k == level).all() else k == level
            first[own] = self.levels[level][starts[own]]
            second[own] = self.levels[level][(starts + lengths - (1 << level))[own]]
        size = len(self.levels[0])
        if size * size * n_ranges >= _MOST:
            return _ranks(_ranks(first, second), ranges)
        return (ranges * size + first) * size + second


def _places(low: np.ndarray, high: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranges, starts): where a stretch of a range's length fits in it."""
    counts = np.maximum(high - low - lengths + 1, 0)
    ranges = np.repeat(np.arange(len(low)), counts)
    return ranges, np.arange(len(ranges)) + np.repeat(low - (np.cumsum(counts) - counts), counts)


def _common(names: _Names, box: np.ndarray, lengths: np.ndarray):
    """Places of stretches of each range's length, their numbers, and which numbers both texts have."""
    (ra, a), (rb, b) = _places(box[0], box[1], lengths), _places(box[2], box[3], lengths)
    ranges = np.concatenate([ra, rb])
    found = names.of(np.concatenate([a, b]), lengths[ranges], ranges, len(lengths))
    sided = np.sort(np.concatenate([found[: len(a)] * 2, found[len(a) :] * 2 + 1]))
    both = sided[1:][(sided[1:] ^ sided[:-1]) == 1] >> 1  # the same number, first in one and then in the other
    return ra, a, found[: len(a)], rb, b, found[len(a) :], both


def _has(names: _Names, box: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    ra, _, ka, _, _, _, both = _common(names, box, lengths)
    out = np.zeros(len(lengths), bool)
    if len(both):
        out[ra[_among(both, ka)]] = True
    return out


def _among(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return known[at] == asked


def _walk(names: _Names, box: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, a, b) of the runs of each range's length, which is its longest: the first by a, then b; then the first behind both; and so on."""
    ra, a, ka, rb, b, kb, both = _common(names, box, lengths)
    ours, theirs = _among(both, ka), _among(both, kb)
    ra, a, ka, b, kb = ra[ours], a[ours], ka[ours], b[theirs], kb[theirs]
    order = np.argsort(kb, kind="stable")
    kb, there = kb[order], b[order].tolist()
    begin, end = np.searchsorted(kb, ka).tolist(), np.searchsorted(kb, ka, side="right").tolist()
    size = lengths.tolist()
    out, last, next_a, next_b = [], -1, 0, 0
    for r, at, x, y in zip(ra.tolist(), a.tolist(), begin, end, strict=True):
        if r != last:
            last, next_a, next_b = r, 0, 0
        if at < next_a:
            continue
        found = bisect_left(there, next_b, x, y)
        if found < y:
            out.append((r, at, there[found]))
            next_a, next_b = at + size[r], there[found] + size[r]
    return out


def _side_by_side(pairs: list[tuple[str, str]], least: int) -> list[list[tuple[int, int, int]]]:
    whole = "".join(a + b for a, b in pairs)
    names = _Names(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))
    sizes = np.array([[len(a), len(b)] for a, b in pairs], np.int64)
    starts = np.cumsum(sizes.sum(1)) - sizes.sum(1)
    middle = starts + sizes[:, 0]
    box, pair = np.array([starts, middle, middle, middle + sizes[:, 1]]), np.arange(len(pairs))
    most = sizes.min(1)
    found: list[list[tuple[int, int, int]]] = [[] for _ in pairs]
    while len(pair):
        most = np.minimum(most, np.minimum(box[1] - box[0], box[3] - box[2]))
        keep = most >= least
        box, pair, most = box[:, keep], pair[keep], most[keep]
        keep = _has(names, box, np.full(len(pair), least))
        box, pair, most = box[:, keep], pair[keep], most[keep]
        low, high = np.full(len(pair), least), most.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            # short runs are by far the most: lengths are doubled before they are halved
            middle = np.minimum((low[open_] + high[open_] + 1) // 2, low[open_] * 2)
            yes = _has(names, box[:, open_], middle)
            low[open_[yes]] = middle[yes]
            high[open_[~yes]] = middle[~yes] - 1
        if not len(pair):
            break
        runs = np.array(_walk(names, box, low), np.int64).reshape(-1, 3)
        r, a, b = runs.T
        n = low[r]
        for p, x, y, size in zip(pair[r].tolist(), (a - starts[pair[r]]).tolist(), (b - starts[pair[r]] - sizes[pair[r], 0]).tolist(), n.tolist(), strict=True):
            found[p].append((x, y, size))
        # what is left of each run since the one before, and what is right of a range's last one
        opens = np.ones(len(r), bool)
        opens[1:] = r[1:] != r[:-1]
        ends = np.append(opens[1:], True)
        left_a, left_b = np.where(opens, box[0, r], np.roll(a + n, 1)), np.where(opens, box[2, r], np.roll(b + n, 1))
        box = np.hstack([np.array([left_a, a, left_b, b]), np.array([(a + n)[ends], box[1, r[ends]], (b + n)[ends], box[3, r[ends]]])])
        pair, most = np.concatenate([pair[r], pair[r[ends]]]), np.concatenate([n - 1, n[ends] - 1])
    return [sorted(x) for x in found]


def equal_runs(one: Sequence[str], other: Sequence[str], least: int) -> list[list[tuple[int, int, int]]]:
    """Per pair of texts the (a, b, n) of SequenceMatcher(None, one, other, autojunk=False).get_matching_blocks() with n >= least, in order."""
    out, waiting, letters = [], [], 0
    for pair in zip(one, other, strict=True):
        size = len(pair[0]) + len(pair[1])
        if waiting and letters + size > _LETTERS:
            out += _side_by_side(waiting, least)
            waiting, letters = [], 0
        waiting.append(pair)
        letters += size
    return out + (_side_by_side(waiting, least) if waiting else [])
