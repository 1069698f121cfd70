"""Token counts of whole texts without their ids.

The pieces of a text (its pre-tokens) are counted per document. Each distinct piece goes to one task, where the library
counts its tokens once; the counts meet the documents' frequencies there and are summed by document (see `postings`).
Pieces that are tokens of the vocabulary themselves are as many as the vocabulary has entries, so each worker looks them
up in a table of its own and they do not travel.

Null text counts as empty and has no tokens. A document is taken whole, however long. Rows that repeat a doc_id (or have
none) are counted each for itself; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm import postings
from pulsegrid.llm.bpe import pieces

COUNTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])


class Counts:
    """The library, its special strings and the counts of its own tokens, for one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        special = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        own = {self._tokenizer.decode([i], skip_special_tokens=False) for i in range(self._tokenizer.get_vocab_size())} - set(special)
        words = [w for w in own if w and "�" not in w]
        self.known = dict(zip(words, self.count(words), strict=True))

    def count(self, some: list[str]) -> list[int]:
        return [len(e) for e in self._tokenizer.encode_batch_fast(some, add_special_tokens=False)]


@lru_cache(maxsize=2)
def _counts(path: str) -> Counts:
    return Counts(path)


def token_counts(docs: DataFrame, tokenizer_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of each row of docs; tokenizer_path: a byte-level tokenizers file that splits by pattern."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, ...], list[tuple[str, int]], int]]:
        counts = _counts(tokenizer_path)
        find, known = pieces(pattern), counts.known
        for one, string in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            string = string.as_py()
            base, parts = 0, [string]
            if counts.special and counts.special.search(string):
                parts = counts.special.split(string)
                base = len(parts) - 1
            rest = []
            for piece, n in Counter(find(string) if not base else (p for part in parts for p in find(part))).items():
                if (k := known.get(piece)) is not None:
                    base += k * n
                else:
                    rest.append((piece, n))
            yield (one or 0, one is not None, len(string.encode()), base), rest, len(string)

    def valued(terms: list[str | None]) -> list[float | None]:
        some = [t for t in terms if t is not None]
        got = iter(_counts(tokenizer_path).count(some))
        return [None if t is None else float(next(got)) for t in terms]

    def finish(head, added) -> list[pa.Array]:
        return [pa.array(head[:, 0], pa.int64(), mask=head[:, 1] == 0), pa.array(head[:, 2]), pa.array(head[:, 3] + added[0].astype("i8"))]

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return postings.total(postings.value(postings.gather(rows, read), valued), 4, finish, COUNTS)
