"""Language-model scores of whole texts: a causal self-attention model on subword ids, beside a word unigram base.

Words are lower-cased (A-Z) runs of anything but ASCII white space. The model's subwords are those of a public rank file
below 4,095, within words that keep the space before them; the last id is the end of a text.

Learning: every training document is cut into windows of 48 subwords, whose scored parts hold each of its subwords and
its end once. The driver finds where to begin on about `START` windows (those with a low hash, of a share of the documents),
each seen `EPOCHS` times at most; then every task goes on from there with all windows of all texts of its part, mixed
within pools, and the weights are averaged in proportion to their windows. So every subword of every training text is
learned. Windows are made where they are learned and do not travel. As each task learns its own part, the weights, and so
the scores, depend a little on how the table is dealt to tasks. Word counts are taken over all training documents.

Scoring: texts are cut into overlapping windows, each subword is scored once (see `attention`). The base joins the
corpus's word counts to the documents' word frequencies by way of `postings`.

Null or empty text is the end token alone. A null doc_id takes part in training. Repeated rows are scored each for itself
and all count. Without training rows the counts are zero and the model is untrained. An empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm import attention, postings
from pulsegrid.llm.bpe import portions, read_ranks
from pulsegrid.llm.common import at_task_end, slices, written

START, STEPS, EPOCHS, BATCH, RATE = 24_576, 2000, 8, 96, 0.02
LATER_RATE = 0.004
#: Windows that a task mixes before it learns from them.
POOL = 64 * BATCH
CHUNK = 64
#: Blocks with rows of a frequent term that meet its count in one task.
TOGETHER = 64

SCORES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("held_out", T.BooleanType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_known", T.LongType()),
        T.StructField("base_sum", T.DoubleType()),
        T.StructField("score", T.DoubleType()),
    ]
)
_LESSON = T.StructType(
    [
        T.StructField("order", T.LongType()),
        T.StructField("inputs", T.BinaryType()),
        T.StructField("before", T.BinaryType()),
        T.StructField("targets", T.BinaryType()),
    ]
)
_CHUNK = T.StructType(
    [T.StructField("chunk", T.IntegerType()), T.StructField("windows", T.LongType()), T.StructField("values", T.ArrayType(T.FloatType()))]
)


class Subwords:
    """Ids of words. A text's are encoded together, as only a word's first subword holds a space: to look words up among
    those seen before costs more, as many are new."""

    def __init__(self, ranks_path: str):
        ranks = {t: r for t, r in read_ranks(ranks_path).items() if r < attention.END}
        self._encode = tiktoken.Encoding("below", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.array(self._encode((b" " + b" ".join(words)).decode()), dtype=np.int64)


@lru_cache(maxsize=2)
def _subwords(ranks_path: str) -> Subwords:
    return Subwords(ranks_path)


@lru_cache(maxsize=1)
def _scorer(packed: bytes) -> attention.Scorer:
    return attention.Scorer(attention.unflat(np.frombuffer(packed, dtype=np.float32)))


at_task_end.append(_scorer.cache_clear)


def words_of(text: str) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, as asked."""
    return text.encode().lower().split()


def _marks(order: int, n: int) -> np.ndarray:
    """Hashes of a document's n windows, which rank them for the start."""
    x = np.uint64(order) + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def first_lessons(training: DataFrame, ranks_path: str, chance: float = 1.0) -> DataFrame:
    """training: order (a hash), text. That share of the windows, by their marks."""
    limit = min(2**63 - 1, int(2**63 * chance))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            for order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _subwords(ranks_path).ids(words_of(text))
                marks = _marks(order, -(-(len(ids) + 1) // attention.SCORED))
                nth = np.flatnonzero(marks <= limit)
                at = 0
                for windows in attention.lessons(ids, nth):
                    many = len(windows[0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(marks[nth[at : at + many]]), *(pa.array([x.tobytes() for x in w], pa.binary()) for w in windows)],
                        names=_LESSON.names,
                    )
                    at += many

    return training.mapInArrow(run, _LESSON)


def all_lessons(batches: Iterable[pa.RecordBatch], ranks_path: str, one_in: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """One in so many of the windows of each of a task's texts (order, text), by their marks, in batches of `BATCH` that
    are drawn from pools; the last may be smaller."""
    draw = np.random.default_rng(4)
    pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def mixed(last: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        nonlocal pool, size
        whole = [np.concatenate(x) for x in zip(*pool, strict=True)]
        turn = draw.permutation(size)
        stop = size if last else size - size % BATCH
        for at in range(0, stop, BATCH):
            some = turn[at : min(at + BATCH, stop)]
            yield whole[0][some].astype(np.int64), whole[1][some], whole[2][some].astype(np.int64)
        pool, size = [tuple(x[turn[stop:]] for x in whole)], size - stop

    for batch in (part for whole in batches for part in slices(whole)):
        for order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = _subwords(ranks_path).ids(words_of(text))
            nth = None
            if one_in > 1:
                nth = np.flatnonzero(_marks(order, -(-(len(ids) + 1) // attention.SCORED)) % one_in == 0)
            for windows in attention.lessons(ids, nth):
                pool.append(windows)
                size += len(windows[0])
                if size >= POOL:
                    yield from mixed(False)
    if size:
        yield from mixed(True)


def _arrays(inputs: list[bytes], before: list[bytes], targets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    read = lambda parts, kind, width: np.frombuffer(b"".join(parts), dtype=kind).reshape(-1, width)
    return (
        read(inputs, "<u2", attention.SPAN).astype(np.int64),
        read(before, bool, attention.SPAN),
        read(targets, "<i2", attention.SCORED).astype(np.int64),
    )


def started(some: tuple[np.ndarray, np.ndarray, np.ndarray], steps: int = STEPS) -> attention.Weights:
    """The model after the driver's steps."""
    inputs, before, targets = some
    counts = np.bincount(targets[targets >= 0], minlength=attention.IDS)
    trainer, draw = attention.Trainer(attention.start(counts), RATE), np.random.default_rng(3)
    steps = min(steps, EPOCHS * len(inputs) // BATCH)
    for step in range(steps):
        pick = draw.integers(0, len(inputs), BATCH)
        trainer.step(inputs[pick], before[pick], targets[pick], RATE * (1 - 0.95 * step / steps))
    return trainer.w


def learn(training: DataFrame, ranks_path: str, many: int, size: int, steps: int = STEPS) -> attention.Weights:
    """training: order, text of `many` rows with `size` bytes. All of it is learned; what the driver starts on only says from where."""
    share = min(1.0, START / max(1, many))
    some = training.filter(F.col("order") <= int(2**62 * share)) if share < 1 else training
    # a subword has two bytes or more, mostly, so this is a little more than there are
    windows = size / (2 * attention.SCORED) + many
    chance = min(1.0, START / max(1.0, share * windows))
    # about START of them; the limit holds should very long texts be among the few that were chosen
    rows = first_lessons(some, ranks_path, chance).limit(2 * START).collect()
    if not rows and share < 1:  # rows that are all alike
        rows = first_lessons(training, ranks_path, min(1.0, START / max(1.0, windows))).limit(2 * START).collect()
    first = started(_arrays([r["inputs"] for r in rows], [r["before"] for r in rows], [r["targets"] for r in rows]), steps)
    shared = training.sparkSession.sparkContext.broadcast(attention.flat(first))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, n = attention.Trainer(attention.unflat(shared.value), LATER_RATE), 0
        for inputs, before, targets in all_lessons(batches, ranks_path):
            trainer.step(inputs, before, targets, LATER_RATE * len(inputs) / BATCH)
            n += len(inputs)
        if n:
            values = attention.flat(trainer.w)
            values = np.concatenate([values, np.zeros(-len(values) % CHUNK, dtype=np.float32)]).reshape(-1, CHUNK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(np.full(len(values), n)), pa.array(list(values), pa.list_(pa.float32()))],
                names=_CHUNK.names,
            )

    sums = training.mapInArrow(run, _CHUNK).groupBy("chunk").agg(
        F.sum("windows").alias("windows"),
        *[F.sum(F.col("values")[i] * F.col("windows")).alias(f"v{i}") for i in range(CHUNK)],
    )
    found = sorted(sums.collect(), key=lambda r: r["chunk"])
    if not found:
        return first
    return attention.unflat(np.array([[r[f"v{i}"] / r["windows"] for i in range(CHUNK)] for r in found]).ravel())


def scores(docs: DataFrame, held_out: Column, ranks_path: str, doc_id: str = "doc_id", text: str = "text", steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    training = rows.filter("NOT held_out").select(
        F.abs(F.coalesce(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(0)) % F.lit(2**62)).alias("order"),
        "text",
    )
    ends, size = training.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    packed = docs.sparkSession.sparkContext.broadcast(attention.flat(learn(training, ranks_path, ends, size, steps)).tobytes())

    def read(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, ...], Iterable[tuple[bytes, int]], int]]:
        scorer, subwords = _scorer(packed.value), _subwords(ranks_path)
        for part in slices(batch):
            heads = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
            for texts in portions(part.column(2).to_pylist()):
                found = [words_of(t) for t in texts]
                score = scorer.log10([subwords.ids(w) for w in found])
                for t, words, bits in zip(texts, found, score.view(np.int64).tolist(), strict=True):
                    one, out = next(heads)
                    yield (one or 0, one is not None, not out, len(words) + 1, bits), Counter(words).items(), len(t)

    held = written(postings.gather(rows, read, counted=2))
    terms = held.filter("term IS NOT NULL")
    counts = terms.groupBy("term").agg(F.sum("n").alias("c"))
    distinct, total = counts.filter("c > 0").agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    distinct, total = distinct + (ends > 0), total + ends

    def finish(head: np.ndarray, added: list[np.ndarray]) -> list[pa.Array]:
        base = added[0] + np.log10(ends + 0.1)
        return [
            pa.array(head[:, 0], pa.int64(), mask=head[:, 1] == 0),
            pa.array(head[:, 2] == 0),
            pa.array(head[:, 3]),
            pa.array(added[1].astype(np.int64) + (ends > 0)),
            pa.array(base),
            pa.array(np.ascontiguousarray(head[:, 4]).view(np.float64)),
        ]

    def sums(counted: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
        return [times * np.log10(counted + 0.1), times * (counted > 0)]

    # a row with many postings meets its term's count in a task of a few blocks, so a frequent term has many tasks
    many = F.octet_length("held") >= postings.MANY * postings.POSTING.itemsize
    salts = max(1, -(-held.filter("term IS NULL").count() // TOGETHER))
    frequent = counts.join(terms.filter(many).select("term").distinct(), "term", "left_semi")
    dealt = frequent.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    light = terms.filter(~many).join(counts, "term")
    heavy = terms.filter(many).withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).join(dealt, ["term", "salt"])
    valued = light.select("block", "c", "held").unionByName(heavy.select("block", "c", "held")).select(
        "block",
        F.col("c").cast("double").alias("value"),
        "held",
    )
    heads = held.filter("term IS NULL").select("block", F.lit(None).cast("double").alias("value"), "held")
    out = postings.total(valued.unionByName(heads), 5, finish, SCORES, sums)
    base = F.col("base_sum") - F.col("n_tokens") * float(np.log10(total + 0.1 * (distinct + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
