"""Suffix arrays of a shard in numpy, common prefixes, and the merging of shards.

A shard is a row of short stretches of bytes. Its positions are sorted by their first eight bytes; groups that are still
equal are refined by the rank of the position as far ahead as the ranks already reach, which doubles that reach, until all
are told apart (Larsson and Sadakane); positions that are alone are not touched again. Strings of `DEPTH` bytes start
where they lie within a stretch. Prefixes common to neighbours follow by Kasai's rule, that a suffix shares at least one
byte less than the one before it in the text did; all stretches advance together, a byte of each a step.
"""

from __future__ import annotations

import numpy as np

DEPTH = 50


def load64(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each position as a number; zeros stand after the end."""
    n = len(data)
    padded = np.zeros(n + 16, dtype=np.uint8)
    padded[:n] = data
    out = np.empty(n, dtype=np.uint64)
    for k in range(min(8, n)):
        many = (n - k + 7) // 8
        out[k::8] = padded[k : k + 8 * many].view(f"{order}u8")
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All positions in the order of what follows them.

    A position's rank is the first place of its group in the order. Only groups of several positions are sorted again, by
    the rank of the position as far ahead as ranks reach; a suffix that ends before that comes first, the shorter the
    earlier.
    """
    n = len(data)
    key = load64(data, ">")
    order = np.argsort(key)
    new = _changes(key[order])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    place = np.flatnonzero(~(new & np.append(new[1:], True)))
    position, group, reach = order[place], first[place], 8
    while len(place):
        ahead = position + reach
        later = np.where(ahead < n, rank.take(ahead, mode="clip") + reach + 1, n - position)
        key = (group.astype(np.uint64) << np.uint64(32)) | later.astype(np.uint64)
        turn = np.argsort(key)
        position, new = position[turn], _changes(key[turn])
        group = np.maximum.accumulate(np.where(new, place, 0))
        order[place], rank[position] = position, group
        several = ~(new & np.append(new[1:], True))
        place, position, group, reach = place[several], position[several], group[several], reach * 2
    return order


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; the first does."""
    return np.concatenate([np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]])


def common(data: np.ndarray, order: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each suffix in order, how many bytes (DEPTH at most) it shares with the one before it.

    begin, length: the stretches that data is a row of.
    """
    n, words = len(data), np.append(load64(data), np.zeros(1, dtype=np.uint64))
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, dtype=np.int64)
    longest = np.argsort(-length)
    first, live = begin[longest], len(begin) - np.cumsum(np.bincount(length, minlength=1))
    run = np.zeros(len(begin), dtype=np.int64)
    for step, many in enumerate(live.tolist()):
        i = first[:many] + step
        j = before.take(i)
        most = np.where(j < 0, 0, np.minimum(n - np.maximum(i, j), DEPTH))
        h = np.clip(run[:many] - 1, 0, most)
        more = np.flatnonzero(h < most)
        while len(more):
            at = h[more]
            differ = words.take(i[more] + at) ^ words.take(j[more] + at)
            same = (np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) >> 3).astype(np.int64)
            h[more] = np.minimum(at + same, most[more])
            more = more[(same == 8) & (h[more] < most[more])]
        run[:many] = shared[i] = h
    return shared[order]


def least_by_string(data: np.ndarray, begin: np.ndarray, many: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start (many at the begin of each stretch, one stretch after another), the least owner of any stretch in
    which its string starts. Also one start of each distinct string, in the strings' order, for merging.
    """
    where = np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    owners = np.full(len(data), -1, dtype=np.int64)
    owners[where] = np.repeat(np.arange(len(begin)), many)
    order = suffix_array(data)
    group = np.cumsum(common(data, order, begin, np.diff(np.append(begin, len(data)))) < DEPTH)
    some = owners[order] >= 0
    order, group = order[some], group[some]
    if not len(order):
        return np.zeros(0, dtype=np.int64), order
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    low = np.minimum.reduceat(owner[owners[order]], heads)
    least = np.zeros(len(data), dtype=np.int64)
    least[order] = np.repeat(low, np.diff(np.append(heads, len(order))))
    return least[where], order[heads]


def strings(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The DEPTH bytes from each position, as values that sort and compare like them."""
    return np.ascontiguousarray(data[at[:, None] + np.arange(DEPTH)]).view(f"S{DEPTH}").ravel()


def merge(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two shards' (sorted distinct strings, least owners) as one, by binary search of one's strings among the other's."""
    (a, x), (b, y) = left, right
    if not len(a) or not len(b):
        return right if not len(a) else left
    at = np.searchsorted(a, b)
    same = (at < len(a)) & (a[np.minimum(at, len(a) - 1)] == b)
    x = x.copy()
    x[at[same]] = np.minimum(x[at[same]], y[same])
    return np.insert(a, at[~same], b[~same]), np.insert(x, at[~same], y[~same])
