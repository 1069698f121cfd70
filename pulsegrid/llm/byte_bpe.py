"""Byte-level BPE encoding and decoding of whole texts.

Each match of the split pattern is encoded by itself, with the segment tree of `bpe`. There is no shuffle: every task
encodes its own documents, and remembers the pieces it has met within a bound.

Null text counts as empty; an empty text has no ids. Texts of any length are encoded whole. Repeated rows are encoded
each for itself; an empty table gives an empty table. Other columns are kept, but for those named like a made column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.llm.bpe import encoder, token_bytes
from pulsegrid.llm.common import add_columns

_IDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
_BOTH = T.StructType([*_IDS, T.StructField("decoded", T.BinaryType())])
_DECODED = T.StructType([T.StructField("decoded", T.BinaryType())])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """docs (or its columns `keep`) with n_tokens and ids: little-endian unsigned 32-bit integers, one after another.

    decoded: also with what the ids decode to, by the worker that made them.
    """

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        ids = encoder(ranks_path, pattern).encode([t or "" for t in batch.column(0).to_pylist()])
        back = [pa.array(_bytes_of(ids, ranks_path), pa.binary())] if decoded else []
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), *back]

    return add_columns(docs, {"text": text}, _BOTH if decoded else _IDS, run, keep)


def _bytes_of(ids: list[bytes | None], ranks_path: str) -> list[bytes]:
    get = token_bytes(ranks_path).__getitem__
    return [b"".join(map(get, np.frombuffer(x or b"", dtype="<u4").tolist())) for x in ids]


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids") -> DataFrame:
    """encoded with decoded: the bytes that its ids stand for. Null ids count as none."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(_bytes_of(batch.column(0).to_pylist(), ranks_path), pa.binary())]

    return add_columns(encoded, {"ids": ids}, _DECODED, run)
