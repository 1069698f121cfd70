"""Removal of repeated lines, sentences, and runs of short lines or sentences.

A unit is a line of at least `LINE_WORDS` words or a run of sentences of at least `SENTENCE_WORDS`. From each sentence a
run takes as many as it needs, mostly that one; sentences end at a line's end, and are taken once more across lines, up
to a blank line. So passages are found in the middle of lines, wrapped into short or other lines, and in short
sentences. Where words are not parted by spaces, their number is estimated from characters. Text without sentence ends
that is wrapped differently, or lies within other such text of a line, has no unit in common.

Units are normalised (A-Z lower-cased, runs of white space made one space, ends trimmed) and digested, whatever their
kind; digests are grouped globally. Of units with one digest, the first by (doc_id, text digest, offset) stays where it
is unless it lies in another that goes; all others go. A unit that overlaps an earlier one of the same digest in its text
is none. Text that is left is joined; removed_spans are character offsets in the original text. With `least_words`, units
that go and touch make a run, and only runs of so many words go, or a run that is all of its text.

Only digests travel; a digest that is very frequent is counted where it is found before it travels, and where its
occurrences meet its first one, adaptive execution splits them over tasks. A very long text is whole, in one task.

Null text stays null and has no spans; text without such units stays as it is. A null doc_id ranks last. Rows that repeat
a doc_id and its text are one document and are treated alike. An empty table gives an empty table. Other columns are
kept, but for those named like a made column (n_removed, removed_spans).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import add_columns, drop_written, put_aside, slices, small_batches, written

LINE_WORDS, SENTENCE_WORDS = 5, 8
#: Scripts without spaces: those of about two characters a word, and those of about four, which part phrases by spaces.
_IDEOGRAPHS = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_LETTERS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
_UNSPACED = re.compile(f"[{_LETTERS}]")
#: So many characters count as a word at least, as in very long tokens.
_LONG = 12
_END = re.compile(f"[.!?\u3002\uff01\uff1f\uff61\u0964\u061f\u06d4]+[ \\t]*|(?<=[{_LETTERS}])[ \\t]+(?=[{_LETTERS}])")
_Piece = tuple[bytes, int, int, int]
_UNITS = T.StructType(
    [
        T.StructField("rank", T.LongType()),
        T.StructField("same", T.LongType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
    ]
)
_MADE = T.StructType(
    [
        T.StructField("left_text", T.StringType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("removed_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
    ]
)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _piece(text: str, start: int) -> _Piece:
    """What is digested of a text, its size in words, start and end."""
    words = text.encode().lower().split()
    size = max(len(words), len(text.strip()) // _LONG) if words else 0
    if words and not text.isascii():
        size = max(size, len(_IDEOGRAPHS.findall(text)) // 2, len(_UNSPACED.findall(text)) // 4)
    return b" ".join(words), size, start, start + len(text)


def _runs(pieces: list[_Piece]) -> Iterator[tuple[int, int, bytes]]:
    """From each piece, as many as make `SENTENCE_WORDS` words."""
    for i, (normal, size, start, stop) in enumerate(pieces):
        j = i + 1
        if size < SENTENCE_WORDS:
            while j < len(pieces) and size < SENTENCE_WORDS:
                size += pieces[j][1]
                j += 1
            normal, stop = b" ".join(p[0] for p in pieces[i:j]), pieces[j - 1][3]
        if size >= SENTENCE_WORDS:
            yield start, stop, normal


def units(text: str) -> Iterator[tuple[bytes, int, int]]:
    """(digest, start, end) of a text's lines (with their line end) and runs of sentences, by start."""
    found: list[tuple[int, int, bytes]] = []
    pieces: list[_Piece] = []
    sentences: list[_Piece] = []
    group: list[_Piece] = []

    def close() -> None:
        if group:
            sentences.append((b" ".join(p[0] for p in group), sum(p[1] for p in group), group[0][2], group[-1][3]))
            group.clear()

    at = 0
    for line in text.split("\n"):
        whole = _piece(line, at)
        if whole[1] >= LINE_WORDS:
            found.append((at, min(at + len(line) + 1, len(text)), whole[0]))
        if not whole[1]:
            close()
        else:
            ends = [m.end() for m in _END.finditer(line)]
            cuts = [0, *ends] if ends and ends[-1] == len(line) else [0, *ends, len(line)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                piece = whole if len(cuts) == 2 else _piece(line[a:b], at + a)
                if piece[1]:
                    pieces.append(piece)
                    group.append(piece)
                if b in ends[-1:] or b < len(line):
                    close()
        at += len(line) + 1
    close()
    found += _runs(pieces)
    if len(sentences) < len(pieces):
        found += _runs(sentences)
    last: dict[bytes, int] = {}
    for start, stop, normal in sorted(found, key=lambda f: (f[0], -f[1])):
        digest = xxhash.xxh3_128_digest(normal)
        if start >= last.get(digest, 0):
            last[digest] = stop
            yield digest, start, stop


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _rank(doc_id: str) -> Column:
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(2**63 - 1))


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in slices(whole)):
        rank, same, digest, start, stop = [], [], [], [], []
        for r, s, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for d, a, b in units(text):
                rank.append(r)
                same.append(s)
                digest.append(d)
                start.append(a)
                stop.append(b)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rank, pa.int64()),
                pa.array(same, pa.int64()),
                pa.array(digest, pa.binary()),
                pa.array(start, pa.int32()),
                pa.array(stop, pa.int32()),
            ],
            names=_UNITS.names,
        )


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """rank, same and spans of each document that has units to remove."""
    string = F.col(f"`{text}`")
    rows = docs.filter(string.isNotNull()).select(_rank(doc_id).alias("rank"), F.xxhash64(string).alias("same"), string.alias("text"))
    place = F.struct("rank", "same", "start")
    # as tables, so that texts are cut once, both sides of the join are dealt for it alone, and a very frequent digest's
    # rows can be split
    with small_batches(docs.sparkSession):
        found = written(rows.mapInArrow(_read, _UNITS))
    repeated = written(found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    gone = found.join(repeated, "digest").filter(place != F.col("first"))
    spans = written(gone.groupBy("rank", "same").agg(F.collect_set(F.struct("start", "stop")).alias("spans")))
    drop_written(found)
    drop_written(repeated)
    return spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = 0) -> DataFrame:
    """docs with what is left of their text, n_removed (characters) and removed_spans."""
    gone = repeats(docs, doc_id, text)
    kept = [c for c in docs.columns if c.lower() not in ("n_removed", "removed_spans")]
    rows, back = put_aside(docs.select(*[F.col(f"`{c}`") for c in kept]), doc_id=doc_id, text=text)
    marked = rows.join(gone, (_rank("doc_id") == F.col("rank")) & (F.xxhash64(F.col("text")) == F.col("same")), "left")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, spans, removed = [], [], []
        for string, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cut = merged((s["start"], s["stop"]) for s in found or ())
            if cut and least_words:
                cut = [(a, b) for a, b in cut if _piece(string[a:b], a)[1] >= least_words or not (string[:a] + string[b:]).strip()]
            if cut:
                ends = [0, *(x for span in cut for x in span), len(string)]
                string = "".join(string[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            texts.append(string)
            spans.append([{"start": a, "stop": b} for a, b in cut])
            removed.append(sum(b - a for a, b in cut))
        return [pa.array(texts, pa.string()), pa.array(removed, pa.int64()), pa.array(spans, _SPANS)]

    out = add_columns(marked, {"text": "text", "spans": "spans"}, _MADE, run, keep=[c for c in rows.columns if c != "text"])
    return out.withColumnRenamed("left_text", "text").select(*back, "n_removed", "removed_spans")
