"""The main text of web pages, by what the pages of a host repeat and what their markup says.

1. Pages are dealt to blocks of about `BLOCK_BYTES`: small hosts share one, and a host that is larger has several, over which
   its pages go by a hash. Pages travel once, packed and compressed.
2. A block concatenates the token streams of its pages (words, and a mark between blocks of text and at a page's ends) and
   sorts them to a suffix array, as deep as the shortest run that counts (`RUN` tokens). Strings that stand in pages of
   a host with different titles are repeated. Pages with one title are copies of one article, whose text is no boilerplate
   for being there twice. Strings that lie wholly in what the markup shows to be an article are not compared: they stay
   however often quotations and copies repeat them.
3. Hosts with several blocks are compared over all: each block lists the hashes of its strings (64 bits: the part of all
   lists it is looked up in, 40 bits of it, and 24 of the title), and is told which stand in other pages of the host too.
   A string is taken for repeated wrongly with a chance of about one in a million, as lists of a part are bounded.
4. A block of text is repeated if four fifths of its words or more are under repeated strings. Then the markup is held
   against that. Text in an article element (or its like) is kept, for quotations and copies are repeated as well; what
   menus, headers, footers, sidebars, notices, forms and comments hold is dropped, though nothing repeats it. All other
   text (in main elements, or in pages without either) goes where it is repeated and stays where it is unique.

Null and empty html gives an empty text. Pages without a host in their url have no others to compare with, and only their
markup counts. Repeated rows, null and repeated page_ids are pages like others. A very long page is whole, in one block. An
empty table gives an empty table. Other columns are kept, but for those named like a made column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import Remembered, slices, written
from pulsegrid.llm.html_blocks import ARTICLE, OPEN, Block, blocks
from pulsegrid.llm.periodic_runs import words

RUN, COVERED = 8, 0.8
BLOCK_BYTES, LIST_BYTES = 12_000_000, 12_000_000
#: Split hosts that are sent to all tasks; more are joined.
FEW_HOSTS = 100_000
_MARK = "\0"
_LOW = np.uint64(0xFFFFFF)

_PACKED = T.StructType([T.StructField("block", T.StringType()), T.StructField("pages", T.BinaryType())])
_LISTS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.StringType()), T.StructField("pairs", T.BinaryType())])
_NOTES = T.StructType([T.StructField("block", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("hashes", T.BinaryType())])
_MADE = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_repeated", T.LongType())])


def host(url: Column) -> Column:
    """The lower-cased host of a url, without user and port; empty where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(found)


class _Streams:
    """The pages of a table (host, html) as one row of tokens."""

    def __init__(self, hosts: list[str], htmls: list[str | None]):
        self.pages: list[list[Block]] = []
        texts, titles = [], []
        edge = f" {_MARK}" * (RUN - 1)
        for html in htmls:
            title, found = blocks(html or "")
            self.pages.append(found)
            inner = f" {_MARK} ".join(b.text for b in found)
            titles.append(xxhash.xxh3_64_intdigest(title or inner))
            texts.append(f"{edge} {inner}{edge}" if found else "")
        flat, self.begins = words(pa.array(texts, pa.string()))
        coded = flat.dictionary_encode() if len(flat) else pa.array([""]).dictionary_encode()[:0]
        self.names, self.ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        self.title = np.array(titles, dtype=np.uint64)
        self.page = np.repeat(np.arange(len(texts)), np.diff(self.begins))
        places: dict[str, int] = {}
        self.host = np.array([places.setdefault(h, len(places)) for h in hosts], dtype=np.int64)
        self.host_names = list(places)
        mark = self.names.index(_MARK) if _MARK in self.names else -1
        self.is_word = self.ids != mark
        #: Where a block of text begins: a word after a mark.
        self.heads = np.flatnonzero(self.is_word & np.concatenate([[True], ~self.is_word[:-1]])[: len(self.ids)])

    def _of_article(self) -> np.ndarray:
        """Which tokens are words of article text, or marks with no other text beside them in their page."""
        sure = np.array([b.verdict == ARTICLE for found in self.pages for b in found] + [True], dtype=bool)
        page = np.append(self.page[self.heads], -1)
        begun = np.zeros(len(self.ids), dtype=np.int64)
        begun[self.heads] = 1
        begun = np.cumsum(begun)
        before, after = begun - 1, np.where(self.is_word, begun - 1, begun)
        beside = lambda k: sure[k] | (page[k] != self.page)
        return beside(before) & beside(after)

    def starts(self) -> np.ndarray:
        """Where strings to be compared start: as many tokens follow in the page, which has a host, and some are of no article."""
        ends = self.begins[1:][self.page]
        none = np.array([h == "" for h in self.host_names], dtype=bool)
        others = np.concatenate([[0], np.cumsum(~self._of_article())])
        upto = np.minimum(np.arange(len(self.ids)) + RUN, len(self.ids))
        return (np.arange(len(self.ids)) + RUN <= ends) & ~none[self.host[self.page]] & (others[upto] > others[:-1])

    def hashes(self) -> np.ndarray:
        """A hash of the string at each token and of its host."""
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.names], dtype=np.uint64)
        salt = np.array([xxhash.xxh3_64_intdigest(h) for h in self.host_names], dtype=np.uint64)
        h = own[self.ids]
        reach = 1
        while reach < RUN:
            h = _mixed(h, np.concatenate([h[reach:], np.zeros(min(reach, len(h)), dtype=np.uint64)]))
            reach *= 2
        return _mixed(h, salt[self.host[self.page]])

    def repeated(self) -> np.ndarray:
        """Which strings stand in pages of their host with different titles, by the suffix array."""
        out = np.zeros(len(self.ids), dtype=bool)
        good = self.starts()
        # a token of no string has a rank of its own, and strings are told apart by host
        reached = np.zeros(len(self.ids) + 1, dtype=np.int64)
        np.add.at(reached, np.flatnonzero(good), 1)
        np.add.at(reached, np.flatnonzero(good) + RUN, -1)
        many = len(self.names)
        own = (int(self.host.max(initial=0)) + 1) * many + np.arange(len(self.ids))
        ids = np.where(np.cumsum(reached[:-1]) > 0, self.host[self.page] * many + self.ids, own)
        order, group = suffix_order(ids, RUN)
        keep = good[order]
        order, group = order[keep], group[keep]
        if not len(order):
            return out
        cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        title = self.title[self.page[order]]
        differ = np.minimum.reduceat(title, cuts) != np.maximum.reduceat(title, cuts)
        out[order] = np.repeat(differ, np.diff(np.append(cuts, len(order))))
        return out

    def decided(self, gone: np.ndarray) -> tuple[list[str], list[int], list[int]]:
        """Text, words and repeated words of each page; gone: which strings are repeated."""
        cover = np.zeros(len(self.ids) + 1, dtype=np.int64)
        at = np.flatnonzero(gone)
        np.add.at(cover, at, 1)
        np.add.at(cover, np.minimum(at + RUN, len(self.ids)), -1)
        under = (np.cumsum(cover[:-1]) > 0) & self.is_word
        n, k = (np.add.reduceat(x.astype(np.int64), self.heads) if len(self.heads) else np.zeros(0, dtype=np.int64) for x in (self.is_word, under))
        texts, size, covered = [], [], []
        place = 0
        n, k = n.tolist(), k.tolist()
        for found in self.pages:
            kept, a, b = [], 0, 0
            for text, verdict in found:
                a, b = a + n[place], b + k[place]
                if verdict == ARTICLE or verdict == OPEN and k[place] < COVERED * n[place]:
                    kept.append(text)
                place += 1
            texts.append("\n".join(kept))
            size.append(a)
            covered.append(b)
        return texts, size, covered


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def suffix_order(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All positions in the order of the `depth` numbers from them, and for each in order the number of its group of equals.

    Ranks double their reach each round; positions that are alone are not touched again (Larsson and Sadakane).
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    changes = lambda x: np.concatenate([np.ones(min(1, len(x)), dtype=bool), x[1:] != x[:-1]])
    new = changes(ids[order])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = first
    place = np.flatnonzero(~(new & np.append(new[1:], True)))
    position, group, reach = order[place], first[place], 1
    while len(place) and reach < depth:
        step = min(reach, depth - reach)
        ahead = position + step
        later = np.where(ahead < n, rank.take(ahead, mode="clip") + 1, 0)
        key = (group.astype(np.uint64) << np.uint64(32)) | later.astype(np.uint64)
        turn = np.argsort(key, kind="stable")
        position, new = position[turn], changes(key[turn])
        group = np.maximum.accumulate(np.where(new, place, 0))
        order[place], rank[position] = position, group
        several = ~(new & np.append(new[1:], True))
        place, position, group, reach = place[several], position[several], group[several], reach + step
    return order, rank[order]


def _listed(streams: _Streams, block: str, parts: int) -> Iterator[tuple[int, str, bytes]]:
    """The strings of some pages of a block by part: hash and title, two titles at most for each."""
    good = streams.starts()
    h, title = streams.hashes()[good], streams.title[streams.page[good]]
    part = ((h & _LOW) % np.uint64(parts)).astype(np.int64)
    pair = (h & ~_LOW) | (title & _LOW)
    order = np.lexsort((pair, part))
    part, pair = part[order], pair[order]
    head = pair >> np.uint64(24)
    new = np.concatenate([np.ones(min(1, len(pair)), dtype=bool), (head[1:] != head[:-1]) | (part[1:] != part[:-1])])
    last = np.append(new[1:], True)
    part, pair = part[new | last], pair[new | last]
    cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), dtype=bool), part[1:] != part[:-1]])).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=False):
        yield int(part[a]), block, pair[a:b].tobytes()


def _repeated(lists: pa.Table) -> pa.Table:
    """For each block, its hashes of this part that stand in pages with different titles."""
    part = lists.column("part")[0].as_py()
    held = [np.frombuffer(x, dtype=np.uint64) for x in lists.column("pairs").to_pylist()]
    names: dict[str, int] = {}
    block = [names.setdefault(b, len(names)) for b in lists.column("block").to_pylist()]
    pair, own = np.concatenate(held), np.repeat(np.array(block, dtype=np.int64), [len(x) for x in held])
    order = np.argsort(pair)
    pair, own = pair[order], own[order]
    head = pair >> np.uint64(24)
    cuts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
    ends = np.append(cuts[1:], len(pair))
    differ = np.repeat(pair[cuts] != pair[ends - 1], ends - cuts)
    head, own = head[differ], own[differ]
    rows = [(b, part, np.unique(head[own == k]).tobytes()) for b, k in names.items()] if len(head) else []
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.binary()))], names=_NOTES.names)


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def extract(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages without their html, with text, n_words (of all blocks of text) and n_repeated (those under repeated strings)."""
    made = {f.name.lower() for f in _MADE}
    kept = [c for c in pages.columns if c != html and c.lower() not in made]
    size = F.coalesce(F.octet_length(F.col(f"`{html}`")), F.lit(0)).cast("long")
    rows = pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], host(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"), size.alias("size"))
    hosts = written(rows.groupBy("host").agg(F.sum("size").alias("size")))
    splits = (F.col("size") > BLOCK_BYTES) & (F.col("host") != "")
    large = hosts.filter(splits).select(F.col("host").alias("split_host"), F.ceil(F.col("size") / BLOCK_BYTES).cast("int").alias("slices"))
    sum_of = lambda c: F.coalesce(F.sum(c), F.lit(0))
    total, split, many = hosts.agg(sum_of(F.col("size")), sum_of(F.when(splits, F.col("size"))), F.count_if(splits)).first()
    bins, parts = max(1, -(-(total - split) // BLOCK_BYTES)), max(1, -(-2 * split // LIST_BYTES))
    dealt = rows.join(F.broadcast(large) if many <= FEW_HOSTS else large, F.col("host") == F.col("split_host"), "left")
    whole = F.xxhash64("html", *[f"k{i}" for i, c in enumerate(kept) if c == url])
    # pages without a host lie anywhere
    key = F.when(F.col("slices").isNotNull(), F.concat_ws(":", F.lit("h"), "host", F.pmod(whole, F.col("slices")).cast("string")))
    key = F.coalesce(key, F.concat_ws(":", F.lit("b"), F.pmod(F.when(F.col("host") == "", whole).otherwise(F.xxhash64("host")), F.lit(bins)).cast("string")))
    dealt = dealt.withColumn("block", key)
    fields = [*(f"k{i}" for i in range(len(kept))), "host", "html"]

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).dictionary_encode()
            table = pa.RecordBatch.from_arrays(batch.columns[1:], names=fields)
            order = np.argsort(block.indices.to_numpy(), kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(block.indices.to_numpy(), minlength=len(block.dictionary)))])
            chunks = [_pack(table.take(pa.array(order[a:b]))) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([block.dictionary, pa.array(chunks, pa.binary())], names=_PACKED.names)

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in (part for whole_ in batches for part in slices(whole_)):
                block = batch.column(0).dictionary_encode()
                found = []
                for k, name in enumerate(block.dictionary.to_pylist()):
                    some = batch.filter(pc.equal(block.indices, k))
                    found += _listed(_Streams(some.column(1).to_pylist(), some.column(2).to_pylist()), name, parts)
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.binary()))], names=_LISTS.names)
        finally:
            Remembered.forget()

    kinds = {f.name: f.dataType for f in rows.schema}
    result = T.StructType([*(T.StructField(f"k{i}", kinds[f"k{i}"]) for i in range(len(kept))), *_MADE])

    def decided(left: pa.Table, right: pa.Table) -> pa.Table:
        chunks = [pa.ipc.open_stream(x).read_all() for x in left.column("pages").to_pylist()]
        table = pa.concat_tables(chunks)
        streams = _Streams(table.column("host").to_pylist(), table.column("html").to_pylist())
        gone = streams.repeated()
        if right.num_rows:
            told = np.concatenate([np.frombuffer(x, dtype=np.uint64) | np.uint64(p << 40) for p, x in zip(right.column("part").to_pylist(), right.column("hashes").to_pylist(), strict=True)])
            h = streams.hashes()
            gone |= streams.starts() & np.isin((h >> np.uint64(24)) | (((h & _LOW) % np.uint64(parts)) << np.uint64(40)), told)
        made_ = [pa.array(x, kind) for x, kind in zip(streams.decided(gone), (pa.string(), pa.int64(), pa.int64()), strict=True)]
        return pa.Table.from_arrays([*table.columns[: len(kept)], *made_], names=result.names)

    notes = dealt.filter("slices IS NOT NULL").select("block", "host", "html").mapInArrow(listed, _LISTS).groupBy("part").applyInArrow(_repeated, _NOTES)
    if not many:
        notes = notes.limit(0)
    packs = dealt.select("block", *fields).mapInArrow(packed, _PACKED)
    found = packs.groupBy("block").cogroup(notes.groupBy("block")).applyInArrow(decided, result)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *[f.name for f in _MADE])
