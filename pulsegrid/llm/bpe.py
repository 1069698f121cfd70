"""Byte-level BPE: pieces, merges by a segment tree of pair ranks, ids and back.

A segment tree over a piece's byte positions keeps, in each node, the smallest (rank, position) of the adjacent pairs
below it, so its root is the leftmost pair of the least rank. A merge drops the right part and renews three leaves: the
pair that merged, the pair to its left and the part that went; each renewal walks up the tree. Short pieces go through
the same tree many at a time, as rows of numpy arrays; long pieces one at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

from pulsegrid.llm.common import Remembered

#: Largest piece, in bytes, that goes through the batched trees.
BATCHED_BYTES = 64
_NEVER = np.int32(2**31 - 1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary:
    """Ranks of byte strings, as read from a rank file: one base64 string and its rank a line."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys = self._pairs()
        bits = max(4, int(len(keys) * 2).bit_length())
        self._shift = np.uint64(64 - bits)
        self._table = self._hashed(keys, bits)

    @classmethod
    def read(cls, path: str, limit: int | None = None) -> Vocabulary:
        """limit: take ranks below it only; as merges build on earlier ones, a prefix of the ranks is a vocabulary too."""
        ranks = read_ranks(path)
        return cls(ranks if limit is None else {t: r for t, r in ranks.items() if r < limit})

    def _pairs(self) -> np.ndarray:
        """Every way to put a token together from two tokens, as (key of the pair, rank): adjacent parts merge if their bytes make a token."""
        ranks = self.ranks
        made = (
            (ranks[a] * self.size + ranks[b], r) for t,
            r in ranks.items() for i in range(1, len(t)) if (a := t[:i]) in ranks and (b := t[i:]) in ranks
        )
        return np.array(sorted(made), dtype=np.int64).reshape(-1, 2)

    def _hashed(self, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Open addressing over pair keys: slots of keys and of ranks, and the longest way from a key's first slot."""
        slots, values = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, _NEVER, dtype=np.int32)
        left, far = np.arange(len(keys)), 0
        at = self._slot(keys[:, 0])
        while len(left):
            spot = (at[left] + far) & (len(slots) - 1)
            first = np.zeros(len(left), dtype=bool)
            first[np.unique(spot, return_index=True)[1]] = True
            put = (slots[spot] < 0) & first
            slots[spot[put]], values[spot[put]] = keys[left[put], 0], keys[left[put], 1]
            left, far = left[~put], far + 1
        return slots, values, far

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).view(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; a very large number for pairs that do not merge."""
        slots, values, far = self._table
        key = left * np.int64(self.size) + right
        at = self._slot(key)
        there = slots.take(at)
        found = np.where(there == key, values.take(at), _NEVER)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        for step in range(1, far):
            if not len(open_):
                break
            spot = (at.take(open_) + step) & (len(slots) - 1)
            there, wanted = slots.take(spot), key.take(open_)
            hit = there == wanted
            found[open_[hit]] = values[spot[hit]]
            open_ = open_[~hit & (there >= 0)]
        return found

    def _joined(self, left: int, right: int) -> int | None:
        return self.ranks.get(self.tokens[left] + self.tokens[right])

    def merge_one(self, piece: bytes) -> list[int]:
        """The ids of one piece of any length."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        ids, right, left = [int(self.byte_ids[b]) for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        never = (self.size, n)
        tree = [never] * (2 * width)
        for i in range(n - 1):
            if (r := self._joined(ids[i], ids[i + 1])) is not None:
                tree[width + i] = (r, i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def renew(i: int) -> None:
            j = right[i] if ids[i] >= 0 else n
            r = self._joined(ids[i], ids[j]) if j < n else None
            k = width + i
            tree[k] = never if r is None else (r, i)
            while k > 1:
                k >>= 1
                best = min(tree[2 * k], tree[2 * k + 1])
                if best == tree[k]:
                    break
                tree[k] = best

        while tree[1] != never:
            rank, i = tree[1]
            gone = right[i]
            ids[i], ids[gone], right[i] = rank, -1, right[gone]
            if right[i] < n:
                left[right[i]] = i
            renew(i)
            renew(gone)
            if left[i] >= 0:
                renew(left[i])
        return [t for t in ids if t >= 0]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for at, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[at] = whole.to_bytes(4, "little")
            elif len(piece) > BATCHED_BYTES:
                out[at] = np.array(self.merge_one(piece), dtype="<u4").tobytes()
            elif piece:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(at)
        for width, places in by_width.items():
            for start in range(0, len(places), 4096):
                some = places[start : start + 4096]
                for at, ids in zip(some, self._merge_rows([pieces[p] for p in some], width), strict=True):
                    out[at] = ids
        return out

    def _merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The trees of many pieces of at most width bytes, a row each; leaf i of a row stands for the pair that starts at byte i."""
        n, never = len(pieces), _NEVER
        lengths = np.array([len(p) for p in pieces])
        text = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        ids = self.byte_ids.take(text)
        ids[np.arange(width) >= lengths[:, None]] = -1
        right = np.broadcast_to(np.arange(1, width + 1, dtype=np.int32), (n, width)).copy().reshape(-1)
        left = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (n, width)).copy().reshape(-1)
        tree = np.full((n, 2 * width), never, dtype=np.int32)
        fits = np.arange(width - 1) + 1 < lengths[:, None]
        tree[:, width : 2 * width - 1][fits] = self._leaf(
            ids[:, :-1][fits],
            ids[:, 1:][fits],
            np.broadcast_to(np.arange(width - 1), fits.shape)[fits],
            width,
        )
        level = width
        while level > 1:
            half = level >> 1
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, half:level])
            level = half
        flat, flat_ids = tree.reshape(-1), ids.reshape(-1)

        def renew(base: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            k = leaf + width
            flat[base + k] = value
            for _ in range(width.bit_length() - 1):
                at = base + k
                value = np.minimum(value, flat.take(at ^ 1))
                k >>= 1
                flat[base + k] = value

        live = np.flatnonzero(tree[:, 1] != never)
        while len(live):
            base = live * (2 * width)
            row = live * width
            rank, i = np.divmod(flat.take(base + 1), width)
            here = row + i
            gone = right.take(here)
            after = right.take(row + gone)
            flat_ids[here] = rank
            flat_ids[row + gone] = -1
            right[here] = after
            value = np.full(len(live), never, dtype=np.int32)
            renew(base, gone.astype(np.int64), value)
            inside = np.flatnonzero(after < lengths.take(live))
            next_ = row.take(inside) + after.take(inside)
            left[next_] = i.take(inside)
            value[inside] = self._leaf(rank.take(inside), flat_ids.take(next_), i.take(inside), width)
            renew(base, i.astype(np.int64), value)
            before = left.take(here)
            has = np.flatnonzero(before >= 0)
            if len(has):
                was = before.take(has).astype(np.int64)
                renew(base.take(has), was, self._leaf(flat_ids.take(row.take(has) + was), rank.take(has), was, width))
            live = live[flat.take(base + 1) != never]
        kept = ids >= 0
        packed = ids[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(axis=1)) * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """The value of the leaf at place: rank and place in one number, or a very large one."""
        rank = self.pair_ranks(left, right)
        return np.where(rank != _NEVER, rank * np.int32(width) + place.astype(np.int32), _NEVER)


class Encoder:
    """Texts to ids; remembers the ids of the pieces it has seen."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self._find, self._seen = vocabulary, pieces(pattern), Remembered()

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for some in portions(texts):
            split = [self._find(t) for t in some]
            get = self._seen.filled(set().union(*split), self._ids).__getitem__
            out += [b"".join(map(get, found)) for found in split]
        return out

    def _ids(self, new: list[str]) -> list[bytes]:
        return self.vocabulary.merge_many([p.encode() for p in new])


def pieces(pattern: str) -> Callable[[str], list[str]]:
    """Finds a pattern's matches."""
    return regex.compile(pattern).findall


def portions(texts: list[str], chars: int = 400_000) -> Iterator[list[str]]:
    """Runs of whole texts of about so many characters together, so that what is made of them stays small."""
    some: list[str] = []
    size = 0
    for text in texts:
        if some and size + len(text) > chars:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str, limit: int | None = None) -> Encoder:
    """One for each Python worker: workers outlive tasks, so the tables are built once and pieces stay remembered."""
    return Encoder(Vocabulary.read(path, limit), pattern)


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """What each id stands for."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out
