"""Language identification, word first, with backoff to shorter and shorter character n-grams.

A word that the model knows adds its log frequency in each language. A word it does not know is scored by its longest
n-grams of which the model knows any, the mean of their log frequencies standing for the word. Texts are whole; a word
is a run of letters, lower-cased.

The model is fitted on a bounded sample of labelled rows: of each label about `per_label`, chosen by a hash of their id.
It knows all words and n-grams that these hold, and is sent to the workers whole. Prediction covers every row.

Null text, or text without a letter, gives `und` with score 0. Of languages with equal scores, as for a text of which
nothing is known, the first by code point is predicted. Rows without a label, text or id do not teach. Repeated rows are
predicted each for itself and alike; so are very long texts, which are whole. With no rows to learn from, every text is
`und`; an empty table gives an empty table. Other columns are kept, but for those named like a made column.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.bpe import portions
from pulsegrid.llm.common import Remembered, add_columns, at_task_end, small_batches, written

UNKNOWN = "und"
MAX_ORDER = 5
#: Labels up to which their shares are broadcast.
MANY_LABELS = 10_000
_seen = Remembered(30_000_000)
_WORDS = regex.compile(r"\p{L}+").findall
_MADE = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_COUNTS = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("gram_order", T.IntegerType()),
        T.StructField("gram", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def grams(word: str, order: int) -> list[str]:
    """The n-grams of a word with its ends marked."""
    marked = f"<{word}>"
    return [marked[i : i + order] for i in range(len(marked) - order + 1)]


@dataclass
class Model:
    """labels; for each order (0: words) the row of each gram it knows; rows of log frequencies in each label."""

    labels: list[str]
    tables: list[dict[str, int]]
    known: np.ndarray

    def found(self, word: str) -> list[int]:
        """The rows whose mean scores a word: its own, or those of its longest known n-grams; none if nothing is known."""
        own = self.tables[0].get(word)
        if own is not None:
            return [own]
        for order in range(MAX_ORDER, 0, -1):
            get = self.tables[order].get
            some = [r for g in grams(word, order) if (r := get(g)) is not None]
            if some:
                return some
        return []

    def scored(self, words: list[str]) -> list[bytes]:
        """The scores of words in each label, as 32-bit numbers one after another."""
        found = [self.found(w) for w in words]
        many = np.array([len(f) for f in found])
        flat = self.known[np.array([r for f in found for r in f], dtype=np.int64)]
        out = np.zeros((len(words), len(self.labels)), dtype=np.float32)
        some = many > 0
        if some.any():
            starts = (np.cumsum(many) - many)[some]
            out[some] = np.add.reduceat(flat, starts, axis=0) / many[some, None]
        packed, width = out.tobytes(), 4 * len(self.labels)
        return [packed[k : k + width] for k in range(0, len(packed), width)]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The likeliest label of each text and its posterior under equal priors."""
        out: list[tuple[str, float]] = []
        for some in portions(texts):
            split = [_WORDS(t.lower()) for t in some]
            get = _seen.filled(set().union(*split) if self.labels else set(), self.scored).__getitem__
            for words in split:
                if not words or not self.labels:
                    out.append((UNKNOWN, 0.0))
                    continue
                total = np.frombuffer(b"".join(map(get, words)), dtype=np.float32).reshape(-1, len(self.labels)).sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                out.append((self.labels[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def _sample(training: DataFrame, per_label: int, key: Column) -> DataFrame:
    """About per_label rows of each label, by a hash of their id: the same rows in any run."""
    counted = training.groupBy("label").count().collect()
    shares = training.sparkSession.createDataFrame([(r["label"], min(1.0, per_label / r["count"])) for r in counted], "label string, share double")
    known = training.join(F.broadcast(shares) if len(counted) <= MANY_LABELS else shares, "label")
    return known.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.col("share") * float(1 << 30)).select("label", "text")


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words: dict[str, Counter] = defaultdict(Counter)
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words[label].update(_WORDS(text.lower()))
        for label, some in words.items():
            counts = [some, *(Counter() for _ in range(MAX_ORDER))]
            for word, n in some.items():
                for order in range(1, MAX_ORDER + 1):
                    for gram in grams(word, order):
                        counts[order][gram] += n
            for order, found in enumerate(counts):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([label] * len(found), pa.string()),
                        pa.array([order] * len(found), pa.int32()),
                        pa.array(list(found), pa.string()),
                        pa.array(list(found.values()), pa.int64()),
                    ],
                    names=_COUNTS.names,
                )


def fit(docs: DataFrame, learns: Column, label: str = "lang", text: str = "text", doc_id: str = "doc_id", per_label: int = 500) -> Model:
    """Fits a model on the rows of docs for which `learns` holds."""
    training = docs.filter(learns & F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()).select(
        F.col(label).cast("string").alias("label"),
        F.col(text).alias("text"),
        F.col(doc_id).alias("doc_id"),
    )
    counts = _sample(training, per_label, F.col("doc_id")).mapInArrow(_count, _COUNTS).groupBy("gram_order", "gram", "label").agg(F.sum("n").alias("n"))
    with small_batches(docs.sparkSession):
        found = written(counts).toArrow()
    order, label, n = found["gram_order"].to_numpy(), found["label"].combine_chunks().dictionary_encode(), found["n"].to_numpy()
    names = label.dictionary.to_pylist()
    labels = sorted(names)
    place = np.array([labels.index(x) for x in names], dtype=np.int64)[label.indices.to_numpy()]
    tables: list[dict[str, int]] = [{} for _ in range(MAX_ORDER + 1)]
    row = np.zeros(len(n), dtype=np.int64)
    many = 0
    for i, (o, gram) in enumerate(zip(order.tolist(), found["gram"].to_pylist(), strict=True)):
        row[i] = tables[o].setdefault(gram, many)
        many += row[i] == many
    known = np.full((many, len(labels)), 0.5, dtype=np.float64)
    np.add.at(known, (row, place), n)
    of = np.zeros(many, dtype=np.int64)
    of[row] = order
    totals = np.zeros((MAX_ORDER + 1, len(labels)))
    np.add.at(totals, (order, place), n)
    totals += 0.5 * (np.array([len(t) for t in tables]) + 1)[:, None]
    return Model(labels, tables, np.log(known / totals[of]).astype(np.float32))


@lru_cache(maxsize=1)
def _loaded(packed: bytes) -> Model:
    return pickle.loads(zlib.decompress(packed))


at_task_end.append(_loaded.cache_clear)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred and score (the posterior of lang_pred, 0 to 1)."""
    packed = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(Model(model.labels, model.tables, model.known)), 3))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found = _loaded(packed.value).predict([t or "" for t in batch.column(0).to_pylist()])
        return [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

    return add_columns(docs, {"text": text}, _MADE, run, keep)
