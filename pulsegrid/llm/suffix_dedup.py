"""Removal of byte strings that start in an earlier document, by suffix arrays of shards.

A string of 50 bytes goes from a document if it also starts in one with a smaller doc_id. A text that is a copy as a
whole goes as a whole. For all others:

1. Of each 50-byte string, the least of the hashes of its 16-byte parts is its anchor: equal strings have equal anchors,
   and neighbouring strings mostly share theirs. Anchors are looked up over all documents; strings whose anchor occurs in
   one document only cannot repeat. This passes over whole texts and leaves no repeated string out.
2. Strings that are left travel in stretches, a stretch for each anchor, to the shard of their anchor; a stretch that
   several documents of a block share travels once, and all of a block for a shard in one row. Strings of an anchor that
   many blocks hold go by their two least hashes instead, so a frequent phrase is spread over shards.
3. A shard sorts its strings by a suffix array (see `suffix_array`), finds equal ones by their common prefixes and tells
   each document which of its strings started earlier. What is more than a suffix array should hold gets several, whose
   sorted strings are merged by binary search.
4. The bytes under such strings are cut out of the texts.

A very long text makes a block by itself and is whole; places within it are 32-bit numbers.

Texts are bytes in UTF-8; matches never cross documents, overlaps count, and strings are judged on the input. Null text
counts as empty. A null doc_id keeps all and removes nothing elsewhere. Rows that share a doc_id do not remove from each
other, and each loses only what its own text repeats. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.suffix_array import DEPTH, least_by_string, load64, merge, strings

PART, BLOCK_BYTES, LIST_BYTES, SHARD_BYTES = 16, 4_000_000, 12_000_000, 800_000
#: Blocks with an anchor from which on its strings go by two hashes.
FREQUENT = 64
SPREAD = DEPTH - PART + 1
_PLACE = np.uint64((1 << 27) - 1)
#: Positions that are hashed at a time, so that what is made of them stays in a processor's cache.
_PIECE = 1 << 15

_LISTS = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("block", T.LongType()),
        T.StructField("once", T.BinaryType()),
        T.StructField("more", T.BinaryType()),
    ]
)
_NOTES = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("hashes", T.BinaryType()),
        T.StructField("frequent", T.BinaryType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
        T.StructField("turn", T.IntegerType()),
        T.StructField("digest", T.StringType()),
    ]
)
#: A block's stretches for a shard: their bytes in a row, the length of each, how many places it has, and these. A place has
#: a document, which of that document's texts it is in (turns; empty if all are first ones), and where it starts.
_STRETCH = T.StructType(
    [T.StructField("shard", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("bytes", "lengths", "copies", "docs", "starts", "turns"))]
)
_SPAN = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("turn", T.IntegerType())]
)
_RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("kept", T.BinaryType()),
    ]
)


def _rows(docs: pa.Table, notes: pa.Table) -> Iterator[tuple[int | None, bytes, bool, int]]:
    """doc_id, text, whether it is a whole copy of an earlier one, as the notes with a digest say, and its turn among the
    texts of its doc_id, which is the same whatever order they come in."""
    copies: dict[int, set[str]] = {}
    for d, x in zip(notes.column("doc_id").to_pylist(), notes.column("digest").to_pylist(), strict=True):
        if x is not None:
            copies.setdefault(d, set()).add(x)
    ids, texts = docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()
    of: dict[int, set[bytes]] = {}
    if len(set(ids)) < len(ids):
        for d, text in zip(ids, texts, strict=True):
            of.setdefault(d, set()).add(text)
    turns = {d: {text: i for i, text in enumerate(sorted(found))} for d, found in of.items() if len(found) > 1}
    for d, text in zip(ids, texts, strict=True):
        digests = copies.get(d) if d is not None else None
        yield d, text, digests is not None and hashlib.sha256(text).hexdigest() in digests, turns[d][text] if d in turns else 0


class _Texts:
    """The texts of a block in a row, but for whole copies, with the anchor of each 50-byte string."""

    def __init__(self, docs: pa.Table, notes: pa.Table):
        use = [(d, t, turn) for d, t, copy, turn in _rows(docs, notes) if d is not None and not copy and len(t) >= DEPTH]
        raw = [t for _, t, _ in use]
        self.doc_ids = np.array([d for d, _, _ in use], dtype=np.int64)
        self.turns = np.array([turn for _, _, turn in use], dtype=np.int32)
        self.ends = np.cumsum([len(t) for t in raw], dtype=np.int64)
        self.begins = self.ends - np.array([len(t) for t in raw], dtype=np.int64)
        self.data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        n = len(self.data)
        if n < DEPTH:
            self.starts, self.anchor, self.hash = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
            return
        eight = load64(self.data)
        self.hash = h = np.empty(n - 8, dtype=np.uint64)
        for at in range(0, n - 8, _PIECE):
            h[at : at + _PIECE] = _hashed(eight[at : min(at + _PIECE, n - 8)], eight[at + 8 : at + 8 + _PIECE])
        place = np.concatenate([_least_places(h[at : at + _PIECE + SPREAD - 1]) + at for at in range(0, len(h) - SPREAD + 1, _PIECE)])
        good = np.zeros(n + 1, dtype=np.int32)
        np.add.at(good, self.begins, 1)
        np.add.at(good, self.ends - DEPTH + 1, -1)
        self.starts = np.flatnonzero(np.cumsum(good[: len(place)]) > 0)
        self.anchor = place[self.starts]

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and end, in starts, of the strings in a row that share an anchor."""
        if not len(self.starts):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        first = np.flatnonzero(np.concatenate([[True], (self.anchor[1:] != self.anchor[:-1]) | (self.starts[1:] != self.starts[:-1] + 1)]))
        return first, np.append(first[1:], len(self.starts))

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, place, side="right")

    def second(self, start: np.ndarray) -> np.ndarray:
        """The second least hash of each string."""
        every = np.lib.stride_tricks.sliding_window_view(self.hash, SPREAD)
        return np.concatenate([np.partition(every[start[k : k + 65_536]], 1, axis=1)[:, 1] for k in range(0, len(start), 65_536)])


def _hashed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Hashes of the 16 bytes that pairs of numbers make."""
    h = one * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += two * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    return h


def _least_places(h: np.ndarray) -> np.ndarray:
    """For each SPREAD hashes in a row, the place of the least."""
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach * 2 <= SPREAD:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < SPREAD:
        low = np.minimum(low[: len(low) - (SPREAD - reach)], low[SPREAD - reach :])
    return (low & _PLACE).astype(np.int64)


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each first to before its end."""
    many = end - first
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    n = len(keys[0])
    new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.concatenate([np.zeros(min(1, n), dtype=np.int64), np.flatnonzero(new) + 1, [n]]).astype(np.int64)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _lists(docs: pa.Table, notes: pa.Table, parts: int) -> pa.Table:
    """The block's anchors, split by hash: those of one document of the block, and those of several."""
    texts = _Texts(docs, notes)
    block = docs.column("block")[0].as_py() if docs.num_rows else 0
    first, _ = texts.runs()
    place = texts.anchor[first]
    h, doc = texts.hash[place], texts.doc_of(place)
    order = np.argsort(h)
    h, doc = h[order], texts.doc_ids[doc[order]]
    new = _edges(h)[:-1]
    several = (np.minimum.reduceat(doc, new) != np.maximum.reduceat(doc, new)) if len(h) else np.zeros(0, dtype=bool)
    h = h[new]
    part = _part(h, parts)
    order = np.argsort(part, kind="stable")
    low, part, several = h[order].astype(np.uint32), part[order], several[order]
    cuts = _edges(part).tolist()
    rows = [(int(part[a]), block, low[a:b][~several[a:b]].tobytes(), low[a:b][several[a:b]].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.Table.from_arrays(
        [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
        names=_LISTS.names,
    )


def _repeated(lists: pa.Table) -> pa.Table:
    """For each block, those of its anchors that occur in several documents, and those of them that many blocks have."""
    part, blocks = lists.column("part")[0].as_py(), lists.column("block").to_numpy()
    held = [np.frombuffer(x, dtype=np.uint32) for c in ("once", "more") for x in lists.column(c).to_pylist()]
    own = np.repeat(np.arange(len(held), dtype=np.uint64), [len(x) for x in held])
    key = np.sort((np.concatenate(held).astype(np.uint64) << np.uint64(32)) | own)
    low, own = key >> np.uint64(32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cuts = _edges(low)
    many = np.diff(cuts)
    more = np.maximum.reduceat(own, cuts[:-1]) >= len(blocks) if len(own) else np.zeros(0, dtype=bool)
    keep, often = np.repeat((many > 1) | more, many), np.repeat(many >= FREQUENT, many)
    low, own, often = low[keep].astype(np.uint32), own[keep] % len(blocks), often[keep]
    order = np.argsort(own, kind="stable")
    low, own, often = low[order], own[order], often[order]
    cuts = _edges(own).tolist()
    rows = [(int(blocks[own[a]]), low[a:b].tobytes(), low[a:b][often[a:b]].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)]
    n = len(rows)
    return pa.Table.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([part] * n, pa.int32()),
            pa.array([r[1] for r in rows], pa.binary()),
            pa.array([r[2] for r in rows], pa.binary()),
            *(pa.nulls(n, k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())),
        ],
        names=_NOTES.names,
    )


def _told(notes: pa.Table, column: str) -> np.ndarray:
    """The anchors that notes of all parts list in a column."""
    every = [
        np.frombuffer(x, dtype=np.uint32).astype(np.uint64) | np.uint64(p << 32) for p,
        x in zip(notes.column("part").to_pylist(), notes.column(column).to_pylist(), strict=True) if p is not None
    ]
    return np.concatenate(every) if every else np.zeros(0, dtype=np.uint64)


def _stretches(docs: pa.Table, notes: pa.Table, parts: int, shards: int) -> pa.Table:
    """The block's strings whose anchor is repeated, in stretches; equal stretches once, with all places."""
    texts = _Texts(docs, notes)
    first, end = texts.runs()
    key = texts.hash[texts.anchor[first]]
    code = (_part(key, parts).astype(np.uint64) << np.uint64(32)) | (key & np.uint64(0xFFFFFFFF))
    some = np.isin(code, _told(notes, "hashes"))
    first, end, key, code = first[some], end[some], key[some], code[some]
    often = np.isin(code, _told(notes, "frequent"))
    if often.any():
        at, run = _ranges(first[often], end[often]), np.repeat(np.flatnonzero(often), (end - first)[often])
        second = texts.second(texts.starts[at])
        cuts = _edges(run, second)
        mixed = (key[run[cuts[:-1]]] ^ second[cuts[:-1]]) * np.uint64(0x9E3779B97F4A7C15)
        first, end = np.concatenate([first[~often], at[cuts[:-1]]]), np.concatenate([end[~often], at[cuts[1:] - 1] + 1])
        key = np.concatenate([key[~often], mixed])
    begin, stop = texts.starts[first], texts.starts[end - 1] + DEPTH
    doc = texts.doc_of(begin)
    shard = ((key >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    begin, stop, shard, doc = begin[order], stop[order], shard[order], doc[order]
    doc_ids, starts, turns = texts.doc_ids[doc].astype("<i8"), (begin - texts.begins[doc]).astype("<i4"), texts.turns[doc].astype("<i4")
    whole, rows, cuts = texts.data.tobytes(), [], _edges(shard).tolist()
    begin, stop = begin.tolist(), stop.tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        seen: dict[bytes, int] = {}
        own = np.array([seen.setdefault(whole[i:j], len(seen)) for i, j in zip(begin[a:b], stop[a:b], strict=True)])
        turn = np.argsort(own, kind="stable")
        rows.append(
            (
                int(shard[a]),
                b"".join(seen),
                np.array([len(t) for t in seen], dtype="<i4").tobytes(),
                np.bincount(own).astype("<i4").tobytes(),
                doc_ids[a:b][turn].tobytes(),
                starts[a:b][turn].tobytes(),
                turns[a:b][turn].tobytes() if turns[a:b].any() else b"",
            )
        )
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], pa.int64() if not i else pa.binary()) for i in range(len(_STRETCH))], names=_STRETCH.names)


class _Shard:
    """Distinct stretches with the places where they stand."""

    def __init__(self) -> None:
        self.text: dict[bytes, int] = {}
        self.places: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, whole: bytes, lengths: np.ndarray, copies: np.ndarray, docs: np.ndarray, starts: np.ndarray, turns: np.ndarray) -> None:
        """The stretches of a row."""
        ends, text, before = np.cumsum(lengths).tolist(), self.text, len(self.text)
        own = np.array([text.setdefault(whole[a:b], len(text)) for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        self.places.append((np.repeat(own, copies), docs, starts, turns if len(turns) else np.zeros(len(docs), dtype=np.int32)))
        self.size += int(lengths[own >= before].sum()) + 4 * len(docs)

    def ready(self) -> None:
        self.data = np.frombuffer(b"".join(self.text), dtype=np.uint8)
        length = np.array([len(t) for t in self.text], dtype=np.int64)
        self.begin, self.many = np.cumsum(length) - length, length - DEPTH + 1
        self.own, self.doc, self.start, self.turn = (np.concatenate(x) for x in zip(*self.places, strict=True))
        first = np.full(len(length), 2**63 - 1)
        np.minimum.at(first, self.own, self.doc)
        self.least, heads = least_by_string(self.data, self.begin, self.many, first)
        order = np.zeros(len(self.data), dtype=np.int64)
        self.where = np.repeat(self.begin - (np.cumsum(self.many) - self.many), self.many) + np.arange(int(self.many.sum()))
        order[self.where] = self.least
        self.distinct = heads, order[heads]

    def keyed(self) -> tuple[np.ndarray, np.ndarray]:
        return strings(self.data, self.distinct[0]), self.distinct[1]

    def spans(self) -> pa.RecordBatch:
        """What each place loses: runs of strings that start in an earlier document."""
        stretch, doc, start = self.own, self.doc, self.start.astype(np.int64)
        many = self.many[stretch]
        total = np.cumsum(many) - many
        offset = np.arange(int(many.sum())) - np.repeat(total, many)
        first = (np.cumsum(self.many) - self.many)[stretch]
        gone = self.least[np.repeat(first, many) + offset] < np.repeat(doc, many)
        place = np.repeat(np.arange(len(doc)), many)
        edge = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (place[1:] != place[:-1])]))
        last = np.flatnonzero(gone & np.concatenate([~gone[1:] | (place[1:] != place[:-1]), [True]]))
        own = place[edge]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(doc[own]),
                pa.array((start[own] + offset[edge]).astype(np.int32)),
                pa.array((start[own] + offset[last] + DEPTH).astype(np.int32)),
                pa.array(self.turn[own].astype(np.int32)),
            ],
            names=_SPAN.names,
        )


def _settled(shards: list[_Shard]) -> Iterator[pa.RecordBatch]:
    for s in shards:
        s.ready()
    if len(shards) > 1:
        keys, low = shards[0].keyed()
        for s in shards[1:]:
            keys, low = merge((keys, low), s.keyed())
        for s in shards:
            s.least = low[np.searchsorted(keys, strings(s.data, s.where))]
    for s in shards:
        yield s.spans()


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of stretches, sorted by shard, to spans. What exceeds a suffix array's size is dealt to several and merged."""
    open_: list[_Shard] = []
    last = None
    for batch in batches:
        for shard, whole, *numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != last:
                yield from _settled(open_)
                open_, last = [_Shard()], shard
            elif open_[-1].size >= 2 * SHARD_BYTES:
                open_.append(_Shard())
            open_[-1].add(whole, *(np.frombuffer(x, dtype=kind) for x, kind in zip(numbers, ("<i4", "<i4", "<i8", "<i4", "<i4"), strict=True)))
    yield from _settled(open_)


def _cut(docs: pa.Table, notes: pa.Table) -> pa.Table:
    """Each text without the bytes of its spans."""
    spans = notes.filter(pc.is_valid(notes.column("start")))
    told: dict[tuple[int, int], list[int]] = {}
    for i, key in enumerate(zip(spans.column("doc_id").to_pylist(), spans.column("turn").to_pylist(), strict=True)):
        told.setdefault(key, []).append(i)
    start, stop = (spans.column(c).to_numpy() for c in ("start", "stop"))
    rows = []
    for d, text, copy, turn in _rows(docs, notes):
        cover = np.zeros(len(text) + 1, dtype=np.int64)
        if copy and len(text) >= DEPTH:
            cover[0], cover[-1] = 1, -1
        elif d is not None:
            at = told.get((d, turn), [])
            np.add.at(cover, start[at], 1)
            np.add.at(cover, stop[at], -1)
        gone = np.cumsum(cover[:-1]) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
        spans = edge.reshape(-1, 2)
        kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes() if len(spans) else text
        rows.append((d, len(text), int(gone.sum()), len(spans), spans.tolist(), kept))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int32())), pa.binary())
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=_RESULT.names)


def remove_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (pairs of byte offsets) and kept (bytes) of each row of docs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, parts = max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // LIST_BYTES))
    shards = max(1, -(-total // SHARD_BYTES))
    block_of = lambda *c: F.pmod(F.xxhash64(*c), F.lit(blocks)).cast("long")
    marks = rows.filter(f"doc_id IS NOT NULL AND octet_length(text) >= {DEPTH}").select(
        F.col("doc_id").alias("marked"),
        F.sha2("text", 256).alias("digest"),
    )
    first = marks.groupBy("digest").agg(
        F.min("marked").alias("first"),
        F.count("*").alias("n"),
    ).filter("n > 1").select(F.col("digest").alias("same"), "first")
    nothing = {"part": "int", "hashes": "binary", "frequent": "binary", "start": "int", "stop": "int", "turn": "int", "digest": "string"}
    none = lambda *names: [F.lit(None).cast(nothing[n]).alias(n) for n in names]
    copies = marks.join(first, F.col("digest") == F.col("same")).filter("marked > first").select("marked", "same").distinct()
    copied = copies.select(
        block_of("marked").alias("block"),
        *none("part", "hashes", "frequent"),
        F.col("marked").alias("doc_id"),
        *none("start", "stop", "turn"),
        F.col("same").alias("digest"),
    )
    # texts without a doc_id are told nothing and may lie in any block
    texts = rows.select(F.when(F.col("doc_id").isNull(), block_of("text")).otherwise(block_of("doc_id")).alias("block"), "doc_id", "text")

    def lists(left: pa.Table, right: pa.Table) -> pa.Table:
        return _lists(left, right, parts)

    def stretches(left: pa.Table, right: pa.Table) -> pa.Table:
        return _stretches(left, right, parts, shards)

    def by_block(notes: DataFrame, function, schema: T.StructType) -> DataFrame:
        return texts.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(function, schema)

    repeated = by_block(copied, lists, _LISTS).groupBy("part").applyInArrow(_repeated, _NOTES)
    found = by_block(repeated.unionByName(copied), stretches, _STRETCH)
    spans = found.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards, _SPAN)
    told = spans.select(block_of("doc_id").alias("block"), *none("part", "hashes", "frequent"), "doc_id", "start", "stop", "turn", *none("digest"))
    return by_block(told.unionByName(copied), _cut, _RESULT)
