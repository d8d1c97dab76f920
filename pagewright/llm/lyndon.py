"""Suffix arrays of many strings at once, by the linear grouping construction.

Phase 1 puts suffixes that begin with the same Lyndon prefix into one group. Groups are taken in descending order; each suffix
of a group finds its previous suffix of a smaller group by pointers, and those predecessors, counted by how many of the group they
precede, move into new groups right behind their own: first those that precede once, then twice, and so on. Phase 2 walks the
suffixes in ascending order and puts the suffix before each, and its chain of previous smaller suffixes, at the next free place of its group.
There is no recursion and no renaming.

The strings run side by side: one step of the loop takes one group of every string, so that numpy works on arrays of the strings' number.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """symbols: strings one after another, each ending in its own only 0, the least symbol; starts: where they begin, and the end.

    Returns positions in symbols: for each string, its suffixes in ascending order, in the string's own range."""
    n = int(starts[-1])
    base, ends = starts[:-1].astype(np.int64), starts[1:].astype(np.int64)
    if not n:
        return np.zeros(0, np.int64)
    lane = np.repeat(np.arange(len(base)), ends - base)
    order = np.argsort(lane * (int(symbols.max()) + 1) + symbols, kind="stable")  # by string, then first symbol
    sorted_lane, sorted_symbol = lane[order], symbols[order]
    head = np.ones(n, bool)
    head[1:] = (sorted_lane[1:] != sorted_lane[:-1]) | (sorted_symbol[1:] != sorted_symbol[:-1])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    group = np.empty(n, np.int64)  # the first place of a suffix's group
    group[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    before = _group_phase(order, place, group, base, ends)
    return _order_phase(n, group, before, base, ends)


def _group_phase(order, place, group, base, ends) -> np.ndarray:
    """Refines group (and order, place) in place; returns each suffix's previous smaller one, -1 if there is none."""
    before = np.full(len(order), -1, np.int64)
    size = np.bincount(group, minlength=len(order))  # by a group's first place
    live, last = base.copy(), ends - 1
    while len(live):
        first = group[order[last]]
        count = last - first + 1
        if len(live) == int(count.sum()):
            mine, low, floor, top = order[first], first, live, last
        else:
            offset = np.cumsum(count) - count
            mine = order[np.repeat(first - offset, count) + np.arange(int(count.sum()))]
            low, floor, top = np.repeat(first, count), np.repeat(live, count), np.repeat(last, count)
        point = mine - 1
        walk = np.flatnonzero(point >= floor)
        walk = walk[place[point[walk]] > top[walk]]
        while len(walk):  # over suffixes of greater groups, whose pointers are known
            to = before[point[walk]]
            point[walk] = to
            on = to >= floor[walk]
            walk = walk[on]
            walk = walk[place[to[on]] > top[walk]]
        point[point < floor] = -1
        before[mine] = point
        same = np.flatnonzero(point >= 0)
        same = same[place[point[same]] >= low[same]]
        while len(same):  # over suffixes of the same group
            to = before[point[same]]
            point[same] = to
            before[mine[same]] = to
            same = same[to >= 0]
            same = same[place[point[same]] >= low[same]]
        moved = np.sort(point[point >= 0])
        if len(moved):
            _move(moved, order, place, group, size)
        last = first - 1
        keep = last >= live
        if not keep.all():
            live, last = live[keep], last[keep]
    return before


def _move(moved, order, place, group, size) -> None:
    """moved: sorted suffixes, one entry for each suffix that they precede. They go to the ends of their groups, by that number."""
    new = np.ones(len(moved), bool)
    new[1:] = moved[1:] != moved[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(moved)))
    moved = moved[at]
    own = group[moved]
    by = np.lexsort((times, own)) if (times > 1).any() else np.argsort(own, kind="stable")
    moved, own, times = moved[by], own[by], times[by]
    head = np.ones(len(own), bool)
    head[1:] = own[1:] != own[:-1]
    at = np.flatnonzero(head)
    many = np.diff(np.append(at, len(own)))
    groups = own[at]
    zone = groups + size[groups] - many  # where the moved ones of a group go
    target = np.repeat(zone - at, many) + np.arange(len(own))
    sits = order[target]
    # those in the zone that stay in the group go to the places that moved ones leave
    left = place[moved]
    leaves = np.sort(left[left < np.repeat(zone, many)])
    inside = np.zeros(len(target), bool)
    zone_of = np.repeat(zone, many)
    hit = left >= zone_of
    inside[np.searchsorted(target, left[hit])] = True
    stays = sits[~inside]
    order[leaves], place[stays] = stays, leaves
    order[target], place[moved] = moved, target
    head[1:] |= times[1:] != times[:-1]
    at = np.flatnonzero(head)
    starts = target[at]
    size[groups] -= many
    size[starts] = np.diff(np.append(at, len(own)))
    group[moved] = np.repeat(starts, size[starts])


def _order_phase(n, group, before, base, ends) -> np.ndarray:
    out = np.full(n, -1, np.int64)
    free = np.arange(n)  # by a group's first place: the next free one
    placed = np.zeros(n, bool)
    out[base], placed[ends - 1] = ends - 1, True
    at, stop, floor = base.copy(), ends, base
    point = ends - 2
    while len(at):
        ok = point >= floor
        ok[ok] = ~placed[point[ok]]
        put = point[ok]
        if len(put):
            g = group[put]
            to = free[g]
            out[to], free[g] = put, to + 1
            placed[put] = True
        at = at + ~ok
        keep = at < stop
        if not keep.all():
            at, stop, floor, ok, point = at[keep], stop[keep], floor[keep], ok[keep], point[keep]
            put = point[ok]
        point[ok] = before[put]
        done = ~ok
        point[done] = out[at[done]] - 1
    return out
