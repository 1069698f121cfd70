"""Per-document frequencies of terms as postings of blocks, and sums over them once each term has a value.

A block is a run of documents that one task reads. For each distinct term of a block there is one row with the block's
documents that hold it and how often. Rows go to the task that values their term, then back to the task that sums their
block; so no row is made for each pair of a document and a term, and neither step depends on how frequent a term is:
a term has one row a block at most, and rows with many postings are dealt out by block as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents and characters of a block at most; a longer document makes a block by itself.
BLOCK_DOCS, BLOCK_CHARS = 32_768, 40_000_000
#: Terms with this many postings in a block are dealt out by term and block.
MANY = 64
ROWS = 20_000

SCHEMA = T.StructType([T.StructField("block", T.LongType()), T.StructField("term", T.StringType()), T.StructField("held", T.BinaryType())])
COUNTED = T.StructType([*SCHEMA, T.StructField("n", T.LongType())])
VALUED = T.StructType([T.StructField("block", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("held", T.BinaryType())])
#: A document of the block and how often it holds the term, 255 at most; more often takes more postings.
POSTING = np.dtype([("doc", "<u2"), ("times", "u1")])


class Block:
    """Gathers a block's documents: head holds integers of each, which come back with its sums."""

    def __init__(self, name: int):
        self.name, self.codes, self.head, self.chars = name, {}, [], 0
        self.code: list[int] = []
        self.time: list[int] = []
        self.per: list[int] = []

    def add(self, head: tuple[int, ...], frequencies: Iterable[tuple[str, int]], chars: int) -> None:
        codes, code, time, before = self.codes, self.code, self.time, len(self.code)
        for term, n in frequencies:
            c = codes.setdefault(term, len(codes))
            while n > 255:
                code.append(c)
                time.append(255)
                n -= 255
            code.append(c)
            time.append(n)
        self.per.append(len(code) - before)
        self.head.append(head)
        self.chars += chars

    def full(self) -> bool:
        return len(self.head) >= BLOCK_DOCS or self.chars >= BLOCK_CHARS

    def batches(self, counted: int | None = None) -> Iterator[pa.RecordBatch]:
        """One row with the heads and no term, then one row a term.

        counted: the place in the heads of a number by which a document's frequencies count in the sum of a term's row.
        """
        if not self.head:
            return
        names = SCHEMA.names if counted is None else COUNTED.names
        none = [] if counted is None else [pa.array([0])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([self.name]), pa.array([None], pa.string()), pa.array([np.array(self.head, dtype="<i8").tobytes()]), *none],
            names=names,
        )
        code = np.array(self.code, dtype=np.int32)
        order = np.argsort(code, kind="stable")
        held = np.empty(len(code), dtype=POSTING)
        held["doc"] = np.repeat(np.arange(len(self.per), dtype="<u2"), self.per)[order]
        held["times"] = np.array(self.time, dtype=np.uint8)[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(self.codes)))])
        terms = pa.array(list(self.codes))
        terms = terms.cast(pa.string())
        sums = []
        if counted is not None:
            by_doc = np.array([h[counted] for h in self.head], dtype=np.int64)
            running = np.concatenate([[0], np.cumsum(held["times"] * by_doc[held["doc"]])])
            sums = [running[ends[1:]] - running[ends[:-1]]]
        for a in range(0, len(terms), ROWS):
            b = min(a + ROWS, len(terms))
            cuts = (ends[a : b + 1] - ends[a]) * POSTING.itemsize
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(b - a, self.name)),
                    terms[a:b],
                    _binary(cuts, held[ends[a] : ends[b]].tobytes()),
                    *(pa.array(x[a:b]) for x in sums),
                ],
                names=names,
            )


def _binary(ends: np.ndarray, data: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])


def gather(
    rows: DataFrame,
    read: Callable[[pa.RecordBatch], Iterable[tuple[tuple[int, ...], Iterable[tuple[str | bytes, int]], int]]],
    counted: int | None = None,
) -> DataFrame:
    """Rows of SCHEMA (COUNTED, if a place in the heads is counted). read gives, for each row of a batch, its head, its terms with their frequencies, and its characters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        block = Block(part << 32)
        for batch in batches:
            for head, frequencies, chars in read(batch):
                if block.head and (block.full() or block.chars + chars > 2 * BLOCK_CHARS):
                    yield from block.batches(counted)
                    seq += 1
                    block = Block((part << 32) + seq)
                block.add(head, frequencies, chars)
        yield from block.batches(counted)

    return rows.mapInArrow(run, SCHEMA if counted is None else COUNTED)


def value(postings: DataFrame, valued: Callable[[list[str]], list[float]]) -> DataFrame:
    """Rows of VALUED. A task gets every light row of a term, sorted, and values each distinct term it holds once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_value = None, None
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            terms = coded.dictionary.to_pylist()
            known = {last: last_value} if last is not None else {}
            new = [t for t in terms if t not in known]
            known.update(zip(new, valued(new), strict=True))
            if terms:
                last, last_value = terms[-1], known[terms[-1]]
            of = pa.array([known[t] for t in terms], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), of.take(coded.indices), batch.column(2)], names=VALUED.names)

    many = F.when(F.col("term").isNull() | (F.length("held") >= MANY * POSTING.itemsize), F.col("block"))
    dealt = postings.repartition("term", many).sortWithinPartitions("term")
    return dealt.mapInArrow(run, VALUED)


def total(
    valued: DataFrame,
    width: int,
    finish: Callable[[np.ndarray, list[np.ndarray]], list[pa.Array]],
    schema: T.StructType,
    sums: Callable[[np.ndarray, np.ndarray], list[np.ndarray]] | None = None,
) -> DataFrame:
    """A row a document. finish gets the heads (documents x width) and sums over each document's terms of times x value.

    sums(values, times): other things to sum, an array for each.
    """
    sums = sums or (lambda values, times: [values * times])
    names = schema.names

    def run(group: pa.Table) -> pa.Table:
        held, values = group.column("held").combine_chunks(), group.column("value").combine_chunks()
        head = np.frombuffer(held.filter(values.is_null())[0].as_py(), dtype="<i8").reshape(-1, width)
        held, values = held.filter(values.is_valid()), values.filter(values.is_valid())
        ends, data = _parts(held)
        spread = np.repeat(values.to_numpy(zero_copy_only=False), np.diff(ends) // POSTING.itemsize)
        at, n = data["doc"], data["times"]
        added = [np.bincount(at, weights=w, minlength=len(head)) for w in sums(spread, n)]
        return pa.Table.from_arrays(finish(head, added), names=names)

    return valued.groupBy("block").applyInArrow(run, schema)


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of a binary column begin and end, and all their postings as one array."""
    if not len(column):
        return np.zeros(1, dtype=np.int32), np.zeros(0, dtype=POSTING)
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32, count=column.offset + len(column) + 1)[column.offset :]
    return ends, np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(POSTING)
