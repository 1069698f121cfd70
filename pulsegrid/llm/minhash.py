"""Near-duplicate documents by MinHash, banding and sequential Bayesian verification.

1. A document is the set of its distinct five-word shingles, as 64-bit hashes. Documents with the same set are one class
   from here on, named by its smallest doc_id.
2. Signatures of 128 hashes are cut into 32 bands of 4; classes that agree in a band are candidates. At similarity 0.75
   a pair shares a band but for 1 in 200,000.
3. Candidates are compared in batches of 16 hashes. After each batch a pair is dropped if the posterior chance that its
   similarity is 0.75 or more, under a uniform prior, is below `MISS`.
4. What is left is verified on the full sets of shingles.

Components need not be told every link within them. So the first pass compares each class with the smallest of its band
bucket only, and the next one with the member that has most links so far, as copies of a text are most alike to the text itself.
The last pass takes the buckets whose classes are then still of different components and compares all their pairs
of different components, a block of 256 x 256 a group, within tasks. Every candidate pair is thus either compared or
already joined; nothing is capped, and no bucket meets in one task.

Null or empty text, or text without words, has no shingles and links with nothing. Fewer than five words make one shingle
of the whole sequence. Rows that share a doc_id count as one document; a null doc_id links with nothing and is kept.
Repeated rows come back each. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import Remembered, add_columns, drop_written, put_aside, small_batches, written
from pulsegrid.llm.components import components
from pulsegrid.llm.groups import key_runs

WORDS, HASHES, BANDS, STEP = 5, 128, 32, 16
MISS = 1e-6
BLOCK = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)

_SKETCH = T.StructType(
    [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("signature", T.BinaryType())]
)
_SET = T.StructType([T.StructField("shingles", T.BinaryType())])
_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

_seeds = np.random.default_rng(20_240_501).integers(0, 2**64, size=(2, HASHES), dtype=np.uint64)
_FLIP, _TIMES = _seeds[0], _seeds[1] | np.uint64(1)
_memo = Remembered()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes. bytes.lower and bytes.split know ASCII only, as asked."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known = _memo.filled(set(words), lambda new: map(xxhash.xxh3_64_intdigest, new))
    hashed = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(WORDS, len(words))
    rolled = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        rolled = rolled * _ODD + hashed[i : len(words) - width + 1 + i]
    return np.unique(_mixed(rolled))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low 16 bits of the smallest of 128 hashes of a set."""
    low = np.full(HASHES, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 512):
        np.minimum(low, ((hashes[at : at + 512, None] ^ _FLIP) * _TIMES).min(axis=0), out=low)
    return (_mixed(low) & np.uint64(0xFFFF)).astype("<u2")


def _least_matches(threshold: float) -> list[int]:
    """For 16, 32, ... hashes compared, the fewest matches with which a pair stays.

    With a uniform prior and m of n matching, the chance of a similarity below t is that of more than m successes in n + 1
    trials of chance t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance, m = 0.0, 0
        while True:
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= MISS:
                break
            m += 1
        out.append(m)
    return out


def _stay(equal, pairs: int, threshold: float) -> np.ndarray:
    """Which of the pairs stay; equal(step, of) tells how many of a step's hashes the pairs `of` have in common."""
    left, matches = np.arange(pairs), np.zeros(pairs, dtype=np.int64)
    for step, least in enumerate(_least_matches(threshold)):
        matches[left] += equal(step, left)
        left = left[matches[left] >= least]
    return left


def sketch(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with n_shingles, a digest of the set and its signature (both null without shingles)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [shingles(t) for t in batch.column(0).to_pylist()]
        return [
            pa.array([len(s) for s in sets], pa.int64()),
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
            pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
        ]

    return add_columns(docs, {"text": text}, _SKETCH, run, keep)


def _band_rows(classes: DataFrame) -> DataFrame:
    width = 2 * HASHES // BANDS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring(F.col("signature"), i * width + 1, F.lit(width)), i))
    return classes.select("node", F.posexplode(keys).alias("band", "bucket"))


def _compared(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that sequential comparison leaves."""
    left = classes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = classes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(-1, HASHES) for i in (2, 3))
            stay = _stay(
                lambda step, of: (sa[of, step * STEP : (step + 1) * STEP] == sb[of, step * STEP : (step + 1) * STEP]).sum(axis=1),
                len(sa),
                threshold,
            )
            yield batch.select([0, 1]).take(pa.array(stay))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, _PAIR)


def _marked(inside: DataFrame, links: DataFrame) -> DataFrame:
    """The members of buckets that hold several components so far, each with its component as label."""
    found = components(links)
    labelled = written(inside.join(found, "node", "left").select("bucket", "band", "n", "node", F.coalesce("component", "node").alias("label")))
    drop_written(found)
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("bucket")
    out = written(labelled.join(mixed, "bucket", "left_semi"))
    drop_written(labelled)
    return out


def _to_hubs(marked: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of each member with the member of its bucket that has most links, if they are of different components."""
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    known = marked.join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = known.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), "label")).alias("hub"))
    far = known.join(best, "bucket").filter("label != hub.label").withColumn("hub_node", -F.col("hub.minus"))
    return far.select(F.col("node").alias("a"), F.col("hub_node").alias("b")).distinct()


def _alike(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return len(x) > 0 and both >= threshold * (len(x) + len(y) - both) - 1e-9


def _block_links(members: DataFrame, threshold: float) -> DataFrame:
    """members: bucket, band, n, node, label, signature, shingles. Verified links that join different labels of a bucket.

    A pair is taken in the first band that it shares, and left out once its block has joined its labels; so no row is
    made for a pair that is only compared.
    """
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("node", F.lit(7)), blocks)
    spread = members.withColumn("own", own).withColumn("far", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = spread.select(
        "bucket",
        F.least("own", "far").alias("i"),
        F.greatest("own", "far").alias("j"),
        "own",
        "band",
        "node",
        "label",
        "signature",
        "shingles",
    )

    def links_of(group: pa.Table) -> list[tuple[int, int]]:
        sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype="<u2").reshape(-1, HASHES)
        own, node, label = (group.column(c).to_numpy() for c in ("own", "node", "label"))
        i, j, band = (group.column(c)[0].as_py() for c in ("i", "j", "band"))
        x = np.flatnonzero(own == i)
        y = x if i == j else np.flatnonzero(own == j)
        a, b = (g.ravel() for g in np.meshgrid(x, y, indexing="ij"))
        wanted = label[a] != label[b]
        if i == j:
            wanted &= node[a] > node[b]
        a, b = a[wanted], b[wanted]
        stay = _stay(
            lambda step, of: (sig[a[of], step * STEP : (step + 1) * STEP] == sig[b[of], step * STEP : (step + 1) * STEP]).sum(axis=1),
            len(a),
            threshold,
        )
        a, b = a[stay], b[stay]
        parent, out = {k: k for k in label.tolist()}, []

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        sets: dict[int, np.ndarray] = {}
        held = group.column("shingles")
        for p, q in zip(a.tolist(), b.tolist(), strict=True):
            one, two = root(int(label[p])), root(int(label[q]))
            if one == two or int((sig[p] == sig[q]).reshape(BANDS, -1).all(axis=1).argmax()) != band:
                continue
            for k in (p, q):
                if k not in sets:
                    sets[k] = np.frombuffer(held[k].as_py(), dtype=np.uint64)
            if _alike(sets[p], sets[q], threshold):
                parent[max(one, two)] = min(one, two)
                out.append((max(int(node[p]), int(node[q])), min(int(node[p]), int(node[q]))))
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_runs(batches, ["bucket", "i", "j"]):
            if found := links_of(group):
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found]), pa.array([q for _, q in found])], names=["a", "b"])

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, _PAIR)


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its full set, of the documents that any pair can hold: made once, read by every pass."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([shingles(t).tobytes() for t in batch.column(0).to_pylist()], pa.binary())]

    rows = docs.withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi")
    return written(add_columns(rows, {"text": "text"}, _SET, run, keep=["node"]))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets have at least the threshold's similarity.

    b may be in very many pairs: they are dealt out in blocks of about `BLOCK`, and its set travels once for each block.
    """
    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"))
    members = dealt.join(sets.withColumnRenamed("node", "a"), "a").select("b", "block", "a", "shingles")
    own = blocks.join(sets.withColumnRenamed("node", "b"), "b").select(
        "b",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.lit(None).cast("long").alias("a"),  # sorts before the members
        "shingles",
    )

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            found = []
            for b, block, a, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a is None:
                    now, base = (b, block), np.frombuffer(raw, dtype=np.uint64)
                elif now == (b, block) and _alike(np.frombuffer(raw, dtype=np.uint64), base, threshold):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows = members.unionByName(own).repartition("b", "block").sortWithinPartitions("b", "block", "a")
    return rows.mapInArrow(check, _PAIR)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.75) -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id (smallest doc_id reached over links), kept (it is that one)."""
    with small_batches(docs.sparkSession):
        named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        sketched = written(sketch(named, keep=["doc_id"]))
        whole = sketched.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
        classes = written(whole.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")))
        bands = _band_rows(classes)
        shared = written(bands.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1"))
        inside = written(bands.join(shared, "bucket"))
        with_first = inside.filter("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
        sets = _sets(named.filter("doc_id IS NOT NULL"), inside.select("node").distinct())
        of_first = written(_verified(_compared(with_first, classes, threshold), sets, threshold))
        # pairs are done
        marked = _marked(inside.filter("n > 2").select("bucket", "band", "n", "node"), of_first)
        of_hubs = written(of_first.unionByName(_verified(_compared(_to_hubs(marked, of_first), classes, threshold), sets, threshold)))
        left = _marked(marked.select("bucket", "band", "n", "node"), of_hubs)
        members = left.join(classes.select("node", "signature"), "node").join(sets, "node")
        links = of_hubs.unionByName(_block_links(members, threshold))
    # rows of one document under several digests hold together by their doc_id; classes by their digest
    of_class = whole.select("doc_id", "digest").join(classes.select("digest", "node"), "digest").filter("doc_id != node").select(
        F.col("doc_id").alias("a"),
        F.col("node").alias("b"),
    )
    with small_batches(docs.sparkSession):
        found = components(links.unionByName(of_class))
    for done in (classes, shared, inside, sets, of_first, marked, of_hubs, left):
        drop_written(done)
    rows = sketched.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return rows.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.75) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever these are called."""
    gone = near_duplicates(docs, doc_id, text, threshold).filter("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    rows, back = put_aside(docs, doc_id=doc_id)
    return rows.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select(*back)
