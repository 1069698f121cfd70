"""Periodic runs of words, found by a dictionary of basic factors, and texts with such runs collapsed to one period.

A run is a stretch of consecutive words with smallest period q and max(6, 4 * q) words or more that no neighbouring word
extends. Each text is dealt with on its own, so the work is a map without a shuffle; a record batch is one problem:

1. Level k of the dictionary names every stretch of 2**k words, equal stretches of a text alike; a level follows from the
   one below by naming pairs of names. A stretch that occurs once in its text cannot recur when it is longer either, so
   it leaves the dictionary: in ordinary prose few are left at four words.
2. An occurrence and the next ones of the same name, each within 2**(k + 1) words of the one before, at one and the same
   distance, are an arithmetic progression, and propose that distance as a period. A run of period q holds three such
   occurrences at the least level with 2**k >= q.
3. Neighbouring proposals of a period are one. It is extended to both sides by whole names, longest first; runs with the
   same ends have the least of their periods.

Words are `[^\\x20\\x09-\\x0D]+`. Null and empty text has no words, no runs and an empty collapsed text. A null id, repeated
rows and ties need no care, as rows do not meet; an empty table gives an empty table; a very long text is whole in one
batch, at some 100 bytes a word. Other columns are kept, but for those named like a made column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import add_columns

LEAST_WORDS, LEAST_PERIODS = 6, 4

_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
_MADE = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(_RUN)),
        T.StructField("collapsed", T.StringType()),
    ]
)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, and where each text's begin, with the end of the last."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, offsets = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
    some = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(some)])
    return flat.filter(pa.array(some)), before[offsets]


def _named(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions by key, then place, and which of them begin a group of one key; keys that occur once are left out."""
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]])
    several = ~(new & np.append(new[1:], True))
    return at[several], new[several]


def dictionary(ids: np.ndarray, begins: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """For each level the name of the stretch at each position (-1: it occurs once, or leaves its text), and the positions
    by name and place with the first of each name."""
    n = len(ids)
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    names: list[np.ndarray] = []
    sorted_: list[tuple[np.ndarray, np.ndarray]] = []
    at, new = _named(text * (int(ids.max(initial=0)) + 1) + ids, np.arange(n))
    most = int(np.diff(begins).max(initial=0)) // LEAST_PERIODS
    reach = 1
    while len(at):
        name = np.full(n + 1, -1, dtype=np.int64)
        name[at] = np.cumsum(new) - 1
        names.append(name)
        sorted_.append((at, new))
        if reach >= most:
            break
        live = np.sort(at)
        ahead = np.minimum(live + reach, n)
        both = name[ahead] >= 0
        live, ahead = live[both], ahead[both]
        inside = text[live] == text[ahead]
        live, ahead = live[inside], ahead[inside]
        at, new = _named(name[live] * (len(sorted_[-1][0]) + 1) + name[ahead], live)
        reach *= 2
    return names, sorted_


def proposals(at: np.ndarray, new: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Where three occurrences of a name in a row begin that are as far apart, at most 2 * reach: their places and distances."""
    apart = np.where(np.append(new[1:], True), 0, np.append(at[1:], 0) - at)
    good = (apart > 0) & (apart <= 2 * reach) & (np.append(apart[1:], 0) == apart)
    return at[good], apart[good]


def _extended(names: list[np.ndarray], at: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the longest stretch around `at` in which words `apart` from each other are the same."""
    low, high, last = at.copy(), at.copy(), len(names[0]) - 1
    for k in range(len(names) - 1, -1, -1):
        name, step = names[k], 1 << k
        going = np.arange(len(at))
        while len(going):
            here = name[np.minimum(high[going], last)]
            going = going[(here >= 0) & (here == name[np.minimum(high[going] + apart[going], last)])]
            high[going] += step
        going = np.arange(len(at))
        while len(going):
            back = low[going] - step
            here = np.where(back >= 0, name[np.maximum(back, 0)], -1)
            going = going[(here >= 0) & (here == name[np.minimum(np.maximum(back, 0) + apart[going], last)])]
            low[going] -= step
    return low, high + apart


def found(ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """first, end (places among all words) and period of every run of every text, by first, then period."""
    names, levels = dictionary(ids, begins)
    kept = [np.zeros((3, 0), dtype=np.int64)]
    for k, (at, new) in enumerate(levels):
        at, apart = proposals(at, new, 1 << k)
        order = np.lexsort((at, apart))
        at, apart = at[order], apart[order]
        head = np.concatenate([np.ones(min(1, len(at)), dtype=bool), (apart[1:] != apart[:-1]) | (at[1:] != at[:-1] + 1)])
        at, apart = at[head], apart[head]
        low, high = _extended(names, at, apart)
        long = high - low >= np.maximum(LEAST_WORDS, LEAST_PERIODS * apart)
        kept.append(np.stack([low[long], high[long], apart[long]]))
    low, high, apart = np.concatenate(kept, axis=1)
    order = np.lexsort((apart, high, low))
    low, high, apart = low[order], high[order], apart[order]
    first = np.concatenate([np.ones(min(1, len(low)), dtype=bool), (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    low, high, apart = low[first], high[first], apart[first]
    order = np.lexsort((apart, low))
    return low[order], high[order], apart[order]


def _detected(batch: pa.RecordBatch) -> list[pa.Array]:
    flat, begins = words(batch.column(0))
    ids = flat.dictionary_encode().indices.to_numpy().astype(np.int64) if len(flat) else np.zeros(0, dtype=np.int64)
    low, high, apart = found(ids, begins)
    text = np.searchsorted(begins, low, side="right") - 1
    cover = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(cover, low + apart, 1)
    np.add.at(cover, high, -1)
    stay = np.cumsum(cover[:-1]) == 0
    ends = np.concatenate([[0], np.cumsum(stay)])[begins]
    left = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(pa.array(stay)))
    of = np.searchsorted(text, np.arange(len(begins)))
    run = pa.StructArray.from_arrays([pa.array(x) for x in (low - begins[text], high - low, apart)], names=["start", "length", "period"])
    return [pa.array(np.diff(begins)), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), run), pc.binary_join(left, " ")]


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with n_words, runs (start and length in words, period; by start, then period) and
    collapsed: the words that no run holds after its first period, joined by one space."""
    return add_columns(docs, {"text": text}, _MADE, _detected, keep)


def longest(runs: Column) -> Column:
    """The run with the greatest length; of several the first, then the one with the least period. Null if there is none."""
    by = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("a"), (-r["period"]).alias("q"))))
    return F.when(by.isNotNull(), F.struct((-by["a"]).alias("start"), by["length"].alias("length"), (-by["q"]).alias("period")))



def repeating_tail(text: Column, doc_id: Column) -> Column:
    """The text as it is, or, for one in ten by a hash of its id, with a tail that repeats: what `op13_` is asked about.

    h = crc32 of the decimal id, g = h / 10. If h % 10 is 0 and the text has n words, those from a = g % n on become
    copies of the 1 + (n - a) / (3 + g % 8) words from a on. The text of a null id stays.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words_ = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size(words_)
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice(words_, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    whole = F.array_join(F.concat(F.slice(words_, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), whole).otherwise(text)
