"""Links between near-duplicate embeddings by a pivot-permutation index.

Pivots are vectors of a bounded sample (about `SAMPLE` rows, by a hash of their id), taken in turn unless they lie close to one
taken before, so that a large group of near copies does not take them all. Every vector is described by the ordered
nearest of them, `near` in number. An inverted list is kept for each pair of pivots; a vector stands in the lists of all
pairs among its nearest. So vectors that meet share two pivots at least; they are compared in the list of the two
smallest pivots they share and in no other, once the shared pivots are counted. Similarity is then taken exactly, in
double precision. The number of pivots follows the square root of the number of vectors, which keeps lists short, up to 2,048;
beyond some 20 million vectors lists, and the pairs that are compared for a vector, grow with the table.

A list is compared in blocks of 256 x 256, each a group of its own; a block returns how many links each vector has there
and the smallest vector it reaches, so no row is made for a pair. Equal vectors are one class with a weight throughout.

A vector that is null, zero, or holds null or non-finite components links with nothing, nor does one without a vec_id.
Vectors of different length do not link. Rows that repeat are vectors of their own and link. An empty table gives an
empty table. Other columns (labels too) are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import written
from pulsegrid.llm.components import components
from pulsegrid.llm.groups import key_runs

SAMPLE, APART, SHARED, BLOCK, NEAR = 4096, 0.7, 2, 256, 8

_LISTED = T.StructType(
    [
        T.StructField("node", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("vector", T.BinaryType()),
        T.StructField("mask", T.BinaryType()),
        T.StructField("lists", T.ArrayType(T.IntegerType())),
    ]
)
_FOUND = T.StructType([T.StructField("node", T.LongType()), T.StructField("links", T.LongType()), T.StructField("reaches", T.LongType())])


def shape(rows: int) -> tuple[int, int]:
    """How many pivots there are for so many vectors, and how many describe a vector."""
    pivots = 2 ** round(math.log2(max(1.0, 0.6 * math.sqrt(rows))))
    return min(2048, max(64, pivots)), NEAR


def choose(sample: np.ndarray, many: int) -> np.ndarray:
    """Rows of sample (unit vectors), in turn, that are not close to one chosen before."""
    chosen = np.zeros((0, sample.shape[1]))
    for at in range(0, len(sample), 64):
        for v in sample[at : at + 64]:
            if len(chosen) < many and (not len(chosen) or (chosen @ v).max() < APART):
                chosen = np.vstack([chosen, v])
    return chosen


def _unit(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """Vectors as rows of one length, for distances to pivots only: longer ones are cut, shorter ones filled up."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: min(width, len(v))] = v[:width]
    norm = np.linalg.norm(out, axis=1)
    return out / np.where(norm > 0, norm, 1)[:, None]


def _described(classes: DataFrame, pivots: np.ndarray, near: int) -> DataFrame:
    """classes (node, n, embedding) with their vector as bytes, their pivots as bits, and the lists they stand in."""
    words = (len(pivots) + 63) // 64
    near = min(near, len(pivots))
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.array(v, dtype=np.float64) for v in batch.column(2).to_pylist()]
            close = _unit(vectors, shared.value.shape[1]) @ shared.value.T
            nearest = np.sort(np.argsort(-close, axis=1, kind="stable")[:, :near], axis=1)
            mask = np.zeros((len(vectors), words), dtype=np.uint64)
            for column in nearest.T:
                mask[np.arange(len(vectors)), column >> 6] |= np.uint64(1) << (column & 63).astype(np.uint64)
            two = [
                nearest[:, i] * len(shared.value) + nearest[:, j] for i,
                j in combinations(range(near), 2)
            ] or [nearest[:, 0] * (len(shared.value) + 1)]
            lists = np.stack(two, axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([v.tobytes() for v in vectors], pa.binary()),
                    pa.array([m.tobytes() for m in mask], pa.binary()),
                    pa.array(lists.tolist(), pa.list_(pa.int32())),
                ],
                names=_LISTED.names,
            )

    return classes.mapInArrow(run, _LISTED)


def _block_links(table: pa.Table, i: int, j: int, low: int, high: int, threshold: float) -> pa.RecordBatch:
    """What the vectors of block i and block j of a list have in links: their number and the smallest node reached."""
    node, n, own = (table.column(c).to_numpy() for c in ("node", "n", "own"))
    vectors = [np.frombuffer(v, dtype=np.float64) for v in table.column("vector").to_pylist()]
    mask = np.frombuffer(b"".join(table.column("mask").to_pylist()), dtype=np.uint64).reshape(len(node), -1)
    width = np.array([len(v) for v in vectors])
    x = np.flatnonzero(own == i)
    y = x if i == j else np.flatnonzero(own == j)
    both = mask[x][:, None, :] & mask[y][None, :, :]
    enough = np.bitwise_count(both).sum(axis=2) >= (SHARED if low != high else 1)
    below = np.zeros(mask.shape[1], dtype=np.uint64)
    for p in range(high):
        below[p >> 6] |= np.uint64(1) << np.uint64(p & 63)
    wanted = np.zeros_like(below)
    if low != high:
        wanted[low >> 6] = np.uint64(1) << np.uint64(low & 63)
    here = ((both & below) == wanted).all(axis=2)
    pairs = enough & here & (width[x][:, None] == width[y][None, :])
    if i == j:
        pairs &= node[x][:, None] > node[y][None, :]
    a, b = np.nonzero(pairs)
    a, b = x[a], y[b]
    close = np.empty(len(a))
    for w in np.unique(width[a]):
        of = np.flatnonzero(width == w)
        rows = np.stack([vectors[k] for k in of])
        rows = rows / np.abs(rows).max(axis=1)[:, None]
        rows = rows / np.linalg.norm(rows, axis=1)[:, None]
        place = np.zeros(len(node), dtype=np.int64)
        place[of] = np.arange(len(of))
        some = np.flatnonzero(width[a] == w)
        dots = rows @ rows.T
        close[some] = dots[place[a[some]], place[b[some]]]
    linked = close >= threshold
    a, b = a[linked], b[linked]
    links = np.bincount(a, weights=n[b], minlength=len(node)) + np.bincount(b, weights=n[a], minlength=len(node))
    reach = node.copy()
    while True:
        now = reach.copy()
        least = np.minimum(reach[a], reach[b])
        np.minimum.at(now, a, least)
        np.minimum.at(now, b, least)
        if (now == reach).all():
            break
        reach = now
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some].astype(np.int64)), pa.array(reach[some])], names=_FOUND.names)


def links(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """For each row: vec_id, n_links (other vectors at least that similar), component_id, kept (vec_id is its component's)."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding",
        lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)),
    ) & F.exists("embedding", lambda v: v != 0)
    able = rows.filter(F.coalesce(good, F.lit(False)))
    classes = written(able.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")).select("node", "n", "embedding"))
    size = classes.count()
    many, near = shape(size)
    low = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, SAMPLE / max(1, size)))
    drawn = classes.filter(low).select("node", "embedding").limit(2 * SAMPLE).collect()
    drawn = drawn or classes.select("node", "embedding").limit(1).collect()
    sample = [np.array(r["embedding"]) for r in sorted(drawn, key=lambda r: r["node"])]
    base = rows.join(classes.select("embedding", "node", "n"), "embedding", "left") if sample else rows.withColumns(
        {"node": F.lit(None).cast("long"), "n": F.lit(None).cast("long")}
    )
    base = base.withColumn("node", F.when(good, F.col("node"))).select("vec_id", "node", "n")
    if sample:
        pivots = choose(_unit(sample, max(map(len, sample))), many)
        count = len(pivots)
        listed = written(_described(classes, pivots, near)).withColumn("list", F.explode("lists")).drop("lists")
        sizes = listed.groupBy("list").agg(F.count("*").alias("members")).filter("members > 1")
        blocks = F.ceil(F.col("members") / BLOCK)
        spread = listed.join(sizes, "list").withColumn(
            "own",
            F.pmod(F.xxhash64("node", F.lit(11)), blocks),
        ).withColumn("far", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = spread.select(
            "list",
            F.least("own", "far").alias("i"),
            F.greatest("own", "far").alias("j"),
            "own",
            "node",
            "n",
            "vector",
            "mask",
        ).repartition("list", "i", "j").sortWithinPartitions("list", "i", "j")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in key_runs(batches, ["list", "i", "j"]):
                key, i, j = (group.column(c)[0].as_py() for c in ("list", "i", "j"))
                yield _block_links(group, i, j, key // count, key % count, threshold)

        found = written(dealt.mapInArrow(run, _FOUND).groupBy("node", "reaches").agg(F.sum("links").alias("links")))
        far = components(found.select(F.col("node").alias("a"), F.col("reaches").alias("b")))
        base = base.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(far, "node", "left")
    else:
        base = base.withColumns({"links": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    component = F.coalesce("component", "node", "vec_id")
    total = F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce("links", F.lit(0))
    return base.select(
        "vec_id",
        total.cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
