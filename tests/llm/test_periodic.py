"""Periodic runs against a quadratic search, on whole results."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pulsegrid.llm.periodic_runs import found, periodic_runs, repeating_tail
from pulsegrid.llm.queries import QUERIES

from .cases import documents, frame
from .test_llm import by_row


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute(w):
    """Runs as (start, length, period) by trying all periods at all places."""
    runs = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                runs.setdefault((i, j + q - i), q)
            i = max(j, i + 1) if j == i else j
    return sorted((s, n, q) for (s, n), q in runs.items())


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def tail(w, doc_id):
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("seed", range(12))
def test_runs_equal_a_search_over_all_periods(seed):
    draw = random.Random(seed)
    texts = []
    for _ in range(60):
        letters = draw.choice(["ab", "abc", "abcdefgh", "a"])
        w = []
        while len(w) < draw.randint(0, 120):
            part = [draw.choice(letters) for _ in range(draw.randint(1, 9))]
            w += part * draw.choice([1, 1, 4, 5, 9]) + part[: draw.randint(0, len(part))]
        texts.append(w)
    ids = np.array([ord(c) for w in texts for c in w], dtype=np.int64)
    begins = np.cumsum([0, *map(len, texts)])
    low, high, apart = found(ids, begins)
    got = [[] for _ in texts]
    for a, b, q in zip(low.tolist(), high.tolist(), apart.tolist(), strict=True):
        k = int(np.searchsorted(begins, a, side="right")) - 1
        got[k].append((a - int(begins[k]), b - a, q))
    assert got == [brute(w) for w in texts]


def rows():
    draw = random.Random(3)
    out = documents(4, 80)
    for d in range(1000, 1150):
        part = " ".join(draw.choice("abcd") for _ in range(draw.randint(1, 40)))
        out.append((d, f"x y\x0b{part} " + f"{part}\r\n" * draw.randint(0, 30) + "end\x1cof\x85it", "en", "a", 0))
    return [*out, (2000, "la " * 20_000, "en", "a", 0), (2001, " \t\n", "en", "a", 0)]


def test_op13(spark, tmp_path):
    some = rows()
    frame(spark, some).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for d, t, *_ in some:
        w = tail(words(t), d)
        r = brute(w) if len(w) < 10_000 else [(0, len(w), 1)]
        s, n, q = max(r, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        text = "".join(f"{a},{b},{c}\n" for a, b, c in r)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(r), s, n, q, None if n is None else 1000 * n // q, sha(text), sha(collapse(w, r))))
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in got.dtypes if c in ("n_runs", "start", "length", "period", "exponent_milli")} == {"bigint"}
    assert by_row(got.collect()) == by_row(want)
    assert sum(x[1] > 0 for x in want) > 100


def test_awkward_rows(spark):
    made = frame(spark, documents(4, 20), extra=True).withColumnRenamed("kept", "runs")
    got = periodic_runs(made)
    assert got.columns == [c for c in made.columns if c != "runs"] + ["n_words", "runs", "collapsed"]
    assert got.count() == made.count()
    assert periodic_runs(made.limit(0)).count() == 0
    none = got.filter("text IS NULL").first()
    assert (none["n_words"], none["runs"], none["collapsed"]) == (0, [], "")


def test_tail_of_a_null_id_stays(spark):
    df = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert df.select(repeating_tail(df["text"], df["doc_id"]).alias("t")).first()[0] == "a b c d"
