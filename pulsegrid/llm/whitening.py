"""Whitening of embeddings onto the leading components of their covariance.

Entries become whole numbers, floor(64 * c) + 1000000, so all moments are exact. The fit list has each distinct vector
once. Counts and sums come from one pass over it; a second pass multiplies what is left after whole means are taken off
(the rest of a mean, less than one half, is taken off exactly at the end), so the covariance is right to the last bit.
Tasks add up their rows and send one number for each pair of dimensions; what the driver gets depends on the width of the
vectors only. There `feast` finds the components. Two more passes measure the covariance of the whitened fit list.

Vectors that are null or hold null or non-finite entries are left out, and so are those with entries of 2**46 or more,
which a whole number in a double could not tell apart. Vectors of another width than most of the fit list (of several
widths as frequent, the greatest) have no place in its space and are left out as well, so empty vectors count only where
there are no others, and have no components. A component of no variance (at most 1e-12 of the trace, as with fewer
distinct vectors than dimensions) has null whitened values and does not count for identity_error. deviation is null where
a long cannot hold it. Null and repeated ids are rows like others; equal vectors get equal values. An empty table gives
an empty table. Other columns are kept, but for those named like a made column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import add_columns, written
from pulsegrid.llm.feast import largest

SCALE, SHIFT, MOST = 64, 1_000_000, 2.0**46
NOTHING = 1e-12

_SUMS = T.StructType(
    [
        T.StructField("width", T.IntegerType()),
        T.StructField("i", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
        T.StructField("value", T.DecimalType(38, 0)),
    ]
)
_PARTS = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("value", T.DoubleType())])
_MADE = T.StructType([T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])


@dataclass(frozen=True)
class Whitening:
    """n, width and sums (per dimension) of the fit list; components (columns) with their variances; the trace of the
    covariance; and the largest absolute entry of the whitened covariance less the identity."""

    n: int
    width: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def explained(self) -> list[float | None]:
        return [max(0.0, float(e)) / self.trace if self.trace > 0 else None for e in self.variances]

    @property
    def means(self) -> np.ndarray:
        """Whole numbers next to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def rests(self) -> list[int]:
        """Sums less n times the whole means."""
        return [s - self.n * int(m) for s, m in zip(self.sums, self.means, strict=True)]

    @property
    def some(self) -> np.ndarray:
        """Which components have a variance."""
        return self.variances > NOTHING * self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of whole numbers onto all components, over the root of their variances."""
        centred = (x - self.means).astype(np.float64) - np.array([r / self.n for r in self.rests])
        return centred @ (self.components / np.sqrt(np.where(self.some, self.variances, np.inf)))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - sums, exactly."""
        near = x - self.means
        if not x.size or self.n * (int(np.abs(near).max()) + 1) < 2**31 / np.sqrt(self.width):
            off = self.n * near - np.array(self.rests, dtype=np.int64)
            return (off * off).sum(axis=1).tolist()
        off = self.n * near.astype(object) - np.array(self.rests, dtype=object)
        return [v if v < 2**63 else None for v in (off * off).sum(axis=1).tolist()]


def usable(embedding: Column) -> Column:
    """Whether a vector can be read: not null, and all entries finite and below 2**46."""
    good = F.forall(embedding, lambda c: F.coalesce(F.abs(c.cast("double")) < MOST, F.lit(False)))
    return embedding.isNotNull() & F.coalesce(good, F.lit(False))


def whole(embedding: Column) -> Column:
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _exact(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each width: how many rows (at i = -1) and the sum of each dimension."""
    totals: dict[int, list[int]] = {}
    for batch in batches:
        lengths = pc.list_value_length(batch.column(0))
        for width in pc.unique(lengths).to_pylist():
            x = _matrix(batch.column(0).filter(pc.equal(lengths, width)), width)
            high, low = (x >> 20).sum(axis=0).tolist(), (x & ((1 << 20) - 1)).sum(axis=0).tolist()
            now = [len(x), *((h << 20) + r for h, r in zip(high, low, strict=True))]
            totals[width] = [a + b for a, b in zip(totals.get(width, [0] * (width + 1)), now, strict=True)]
    for width, values in totals.items():
        n = len(values)
        columns = [pa.array(x, pa.int32()) for x in ([width] * n, range(-1, n - 1), [0] * n)]
        yield pa.RecordBatch.from_arrays([*columns, _exact(values)], names=_SUMS.names)


def _products(x: np.ndarray) -> np.ndarray:
    """Exact products of all pairs of columns; by doubles as long as these hold every sum."""
    most = int(np.abs(x).max(initial=0))
    rows = (1 << 53) // max(1, most * most)
    if rows < 1:
        x = x.astype(object)
        return x.T @ x
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for at in range(0, len(x), rows):
        part = x[at : at + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total


def _moments(fit: DataFrame, width: int, means: np.ndarray) -> list[list[int]]:
    """Sums of the products of whole-centred dimensions."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            now = _products(_matrix(batch.column(0), width) - means)
            total = now if total is None else total + now
        if total is not None:
            i, j = (x.astype(np.int32) for x in np.triu_indices(width))
            columns = [pa.array(np.full(len(i), width, dtype=np.int32)), pa.array(i), pa.array(j), _exact(total[i, j].tolist())]
            yield pa.RecordBatch.from_arrays(columns, names=_SUMS.names)

    out = [[0] * width for _ in range(width)]
    for r in fit.mapInArrow(run, _SUMS).groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"]][r["j"]] = out[r["j"]][r["i"]] = int(r["value"])
    return out


def _added(fit: DataFrame, width: int, many: int, made: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over the fit list of what `made` gives for rows: a table of `many` columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            now = made(_matrix(batch.column(0), width))
            total = now if total is None else total + now
        if total is not None:
            i, j = (x.ravel().astype(np.int32) for x in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=_PARTS.names)

    rows = fit.mapInArrow(run, _PARTS).groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    out = np.zeros((max((r["i"] for r in rows), default=-1) + 1, many))
    for r in rows:
        out[r["i"], r["j"]] = r["value"]
    return out


def fit(vectors: DataFrame, embedding: str = "embedding", components: int = 16) -> Whitening | None:
    """The whitening that the distinct vectors of a table define; None without any."""
    column = F.col(f"`{embedding}`")
    distinct = written(vectors.filter(usable(column)).select(whole(column).alias("x")).distinct())
    sums = distinct.mapInArrow(_summed, _SUMS).groupBy("width", "i").agg(F.sum("value").alias("value")).collect()
    if not sums:
        return None
    n, width = max((int(r["value"]), r["width"]) for r in sums if r["i"] < 0)
    of = {r["i"]: int(r["value"]) for r in sums if r["width"] == width}
    model = Whitening(n, width, [of[i] for i in range(width)], np.zeros((width, 0)), np.zeros(0), 0.0)
    if not width:
        return model
    rows = distinct.filter(F.size("x") == width)
    moments, rests = _moments(rows, width, model.means), model.rests
    covariance = np.array([[(n * moments[i][j] - rests[i] * rests[j]) / (n * n) for j in range(width)] for i in range(width)])
    variances, vectors_ = largest(covariance, components)
    model = Whitening(n, width, model.sums, vectors_, variances, float(np.trace(covariance)))
    some = model.some
    many = int(some.sum())
    if not many:
        return model
    mean = _added(rows, width, many, lambda x: model.project(x)[:, some].sum(axis=0, keepdims=True))[0] / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = model.project(x)[:, some] - mean
        return w.T @ w

    error = np.abs(_added(rows, width, many, spread) / n - np.eye(many)).max()
    return Whitening(n, width, model.sums, vectors_, variances, model.trace, float(error))


def whiten(vectors: DataFrame, model: Whitening | None, embedding: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The usable vectors of the model's width (other columns, or those of `keep`) with deviation and whitened, a value for
    each component."""
    column = F.col(f"`{embedding}`")
    width = -1 if model is None else model.width
    rows = vectors.filter(usable(column) & (F.size(column) == width))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        x = _matrix(batch.column(0), width)
        made, many = model.project(x), model.components.shape[1]
        empty = np.broadcast_to(~model.some, made.shape)
        values = pa.array(made.ravel(), mask=np.ascontiguousarray(empty).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * many), values)
        return [pa.array(model.deviation(x), pa.int64()), lists]

    return add_columns(rows, {"x": whole(column)}, _MADE, run, keep)
