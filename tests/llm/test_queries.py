"""Every registered query of the subpackage, over a small folder of tables, against brute force or the libraries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pulsegrid.llm import attention, bpe, gif, mixing
from pulsegrid.llm.queries import QUERIES

from .cases import components, documents, frame
from .test_llm import brute_strings, by_row

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ROWS = documents(9, 70)
TEXTS = [(d, t or "") for d, t, *_ in ROWS]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    frame(spark, ROWS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def asked(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def words(text):
    return re.findall(rb"[^\x20\x09-\x0d]+", text.encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))


def remainder(d, n):
    return None if d is None else zlib.crc32(str(d).encode()) % n


def test_op1(spark, folder):
    got = asked(spark, folder, "op1_lm_scoring")
    counts = Counter(w for d, t in TEXTS if remainder(d, 10) != 0 for w in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None])
    want = [(d, remainder(d, 10) == 0, len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), n, round(base(t), 6)) for d, t in TEXTS]
    assert by_row([(*r[:5], round(r[5], 6)) for r in got]) == by_row(want)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    same = {}
    for r in got:  # equal texts, equal scores
        text = next(t for d, t in TEXTS if d == r["doc_id"])
        assert same.setdefault(text, r["score"]) == pytest.approx(r["score"], rel=1e-5)


def plain_log10(w, ids):
    """The model by its definition, a position at a time, in double precision."""
    w = {k: v.astype("f8") for k, v in w.items()}
    inputs, targets, total = [attention.END, *ids], [*ids, attention.END], 0.0
    for i, target in enumerate(targets):
        first = max(0, i - i % attention.SCORED - attention.CONTEXT)
        query = w["embed"][inputs[i]] @ w["query"]
        keys = range(first, i + 1)
        level = np.array([query @ (w["embed"][inputs[j]] @ w["key"]) / math.sqrt(attention.DIM) + w["distance"][i - j] for j in keys])
        share = np.exp(level - level.max())
        seen = sum(s * (w["embed"][inputs[j]] @ w["value"]) for s, j in zip(share / share.sum(), keys, strict=True))
        back = lambda n: w["embed"][inputs[i - n] if i >= n else attention.END]  # noqa: B023, E731
        state = np.maximum(seen @ w["mix"] + back(0) @ w["own"] + back(1) @ w["last"] + back(2) @ w["second"] + w["bias"], 0)
        group, place = divmod(target, attention.SIDE)
        for logits, k in ((state @ w["group"] + w["group_bias"], group), (state @ w["place"] + w["place_bias"][group], place)):
            total += (logits[k] - logits.max() - np.log(np.exp(logits - logits.max()).sum())) / math.log(10)
    return total


def test_op1_scores_by_a_plain_loop():
    draw = np.random.default_rng(6)
    w = {k: (v + 0.3 * draw.normal(size=v.shape)).astype("f4") for k, v in attention.start(draw.random(attention.IDS)).items()}
    texts = [draw.integers(0, 4000, n) for n in (0, 1, 3, 31, 32, 33, 47, 150)]
    assert np.allclose(attention.Scorer(w).log10(texts), [plain_log10(w, t.tolist()) for t in texts], rtol=1e-4)
    far = {k: v * np.float32(40 if k in ("group_bias", "place_bias", "query") else 1) - np.float32(200 if k == "group_bias" else 0) for k, v in w.items()}
    got = attention.Scorer(far).log10(texts)
    assert np.allclose(got, [plain_log10(far, t.tolist()) for t in texts], rtol=1e-3) and (got <= 0).all()


def test_op1_learns_more_than_frequencies(spark):
    """On text with an order, held-out scores of the trained network beat those of a smoothed count of words."""
    from pulsegrid.llm import lm_scoring

    draw = random.Random(2)
    after = {w: draw.sample(WORDS, 3) for w in WORDS}
    rows = []
    for d in range(300):
        text, w = [], draw.choice(WORDS)
        for _ in range(120):
            text.append(w)
            w = draw.choice(after[w])
        rows.append((d, " ".join(text), None, None, 0))
    from pyspark.sql import functions as F

    got = lm_scoring.scores(frame(spark, rows), F.col("doc_id") % 10 == 0, MULTI, steps=600).filter("held_out").collect()
    assert sum(r["score"] for r in got) > 0.7 * sum(r["base_score"] for r in got)


WORDS = ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "his", "but", "at", "are", "this", "have", "from", "or", "had", "an", "they", "which", "one", "you", "were", "her", "all", "she", "there", "would", "their", "we", "him"]


def test_op2(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(d, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for d, t in TEXTS]
    assert by_row(asked(spark, folder, "op2_token_counts")) == by_row(want)


def test_op3(spark, folder):
    draw = np.random.default_rng(4)
    base = draw.normal(size=(60, 24))
    some = np.concatenate([base, base[:30] + 0.05 * draw.normal(size=(30, 24)), base[:30] * 2, np.repeat(base[5:6], 40, axis=0)])
    rows = [(i, v.tolist()) for i, v in enumerate(some.astype("f4"))] + [(500, None), (501, [0.0] * 24), (502, [1.0, None] * 12)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows[:-3]}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.95]
    count, of = Counter(x for p in links for x in p), components([i for i, _ in rows], links)
    assert by_row(asked(spark, folder, "op3_pivots")) == by_row([(i, count[i], of[i], of[i] == i) for i, _ in rows])


def test_op4(spark, folder):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = QUERIES["op4_mixing"](spark, folder)
    assert by_row([(*r[:3], round(r[3], 6), r[4]) for r in got.collect()]) == by_row([(*r[:3], round(r[3], 6), r[4]) for r in duck.sql(f"SELECT {', '.join(got.columns)} FROM ({mixing.ORACLE})").fetchall()])


def plain_units(text):
    """Units of a text by the rules of the operator, written plainly: normal form -> places, first of overlapping ones only."""
    size = lambda t: max(len(words(t)), len(t.strip()) // 12) if words(t) else 0
    lines, pieces, sentences, open_ = [], [], [], None
    at = 0
    for line in text.split("\n"):
        if size(line) >= 5:
            lines.append((at, min(len(text), at + len(line) + 1), tuple(words(line))))
        if not words(line):
            open_ = None
        ends = [m.end() for m in re.finditer(r"[.!?]+[ \t]*", line)]
        for a, b in zip([0, *ends], [*ends, len(line)], strict=True):
            if words(line[a:b]):
                pieces.append((at + a, at + b, size(line[a:b]), tuple(words(line[a:b]))))
                if open_ is None:
                    open_ = []
                    sentences.append(open_)
                open_.append(pieces[-1])
            if b in ends and words(line[a:b]):
                open_ = None
        at += len(line) + 1
    whole = [(s[0][0], s[-1][1], sum(p[2] for p in s), sum((p[3] for p in s), ())) for s in sentences]
    found = set(lines)
    for row in (pieces, whole):
        for i in range(len(row)):
            for j in range(i, len(row)):
                if sum(p[2] for p in row[i : j + 1]) >= 8:
                    found.add((row[i][0], row[j][1], sum((p[3] for p in row[i : j + 1]), ())))
                    break
    out = {}
    for start, stop, normal in sorted(found, key=lambda f: (f[0], -f[1])):
        if not out.get(normal) or start >= out[normal][-1][1]:
            out.setdefault(normal, []).append((start, stop))
    return out


def test_op5(spark, folder):
    """All of the result: every repeat of a unit but its first goes, and nothing else."""
    units = {(2**63 - 1 if d is None else d, t): plain_units(t) for d, t, *_ in ROWS if t is not None}
    every = {}
    for (d, t), found in units.items():
        for normal, places in found.items():
            every.setdefault(normal, []).extend((d, start, t, stop) for start, stop in places)
    assert len({d for d, _ in units}) == len(units)  # so ranks need no digest of the text
    gone = {}
    for places in every.values():
        for d, start, t, stop in sorted(places, key=lambda p: p[:2])[1:]:
            gone.setdefault((d, t), []).append((start, stop))
    want = []
    for d, t, *_ in ROWS:
        spans = []
        for start, stop in sorted(gone.get((2**63 - 1 if d is None else d, t), [])):
            if spans and start <= spans[-1][1]:
                spans[-1][1] = max(stop, spans[-1][1])
            else:
                spans.append([start, stop])
        left, last = "", 0
        for start, stop in spans:
            left, last = left + t[last:start], stop
        want.append((d, None if t is None else left + t[last:], sum(b - a for a, b in spans), len(spans), spans))
    got = [(*r[:4], [[s["start"], s["stop"]] for s in r["removed_spans"]]) for r in asked(spark, folder, "op5_line_dedup")]
    assert by_row(got) == by_row(want)
    assert sum(len(w[4]) for w in want) >= 15


def test_op6(spark, folder):
    assert by_row(asked(spark, folder, "op6_suffix_array")) == by_row(brute_strings(ROWS))


def test_op7(spark, folder):
    library = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    want = []
    for d, t in TEXTS:
        ids = library.encode_ordinary(t)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert by_row(asked(spark, folder, "op7_byte_bpe")) == by_row(want)


def near(rows):
    """doc_id -> component, by all pairs of shingle sets; a row without an id is on its own."""
    sets = {}
    for d, t, *_ in rows:
        if d is not None:
            w = words(t or "")
            sets.setdefault(d, []).append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs = [(a, b) for a in sets for b in sets if a < b for x in sets[a] for y in sets[b] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return components(list(sets), pairs)


def test_op8(spark, folder):
    of = near(ROWS)
    size = lambda t: len({tuple(w[i : i + 5]) for w in [words(t)] for i in range(max(1, len(w) - 4))}) if words(t) else 0
    want = [(d, size(t), of.get(d), d is None or of[d] == d) for d, t in TEXTS]
    assert by_row(asked(spark, folder, "op8_minhash")) == by_row(want)


def test_op9(spark, folder):
    want = []
    for d, t in TEXTS:
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = gif.write(payload)
        counts = Counter(b >> 4 for b in payload)
        feature = f"frames={-(-len(payload) // (64 * 1024))};ms={-(-len(payload) // (64 * 1024)) * 100};hist={','.join(str(counts[k]) for k in range(16))}"
        want.append((d, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
    assert by_row(asked(spark, folder, "op9_gif")) == by_row(want)


def test_op10(spark, folder):
    got = asked(spark, folder, "op10_language_id")
    assert by_row([(r["doc_id"], r["held_out"]) for r in got]) == by_row([(d, remainder(d, 4) == 2) for d, _ in TEXTS])
    for r in got:
        letters = any(c.isalpha() for d, t in TEXTS if d == r["doc_id"] for c in t)
        assert (r["lang_pred"] in ("en", "de")) == letters and (r["lang_pred"] == "und") != letters and 0 <= r["score"] <= 1


def test_pipeline_stages_on_their_inputs(spark, folder, tmp_path):
    """Near duplicates, mix and ids of the pipeline against brute force on what the stage before left; run() gives the same rows."""
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{i}.parquet")
        left.append([tuple(r) for r in docs.collect()])
    language, unique, passages, mix, ids = left
    of = near(language)
    assert by_row(unique) == by_row(r for r in language if r[0] is None or of[r[0]] == r[0])
    assert {r[0] for r in passages} <= {r[0] for r in unique} and all(r[4] == len(r[1]) for r in passages if r[1] != dict((x[0], x[1]) for x in unique)[r[0]])
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2.parquet/*.parquet'")
    taken = Counter()
    for d, size, n in duck.sql(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE})").fetchall():
        taken[d] += n if size else 0
    got = Counter()
    for r in mix:
        got[r[0]] += len(words(r[1] or ""))
    assert +got == +taken and {r[:1] for r in mix} <= {r[:1] for r in passages}
    library = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(MULTI), special_tokens={})
    want = [(d, lang, source, len(library.encode_ordinary(t or "")), np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), True) for d, t, lang, source, _ in mix]
    assert by_row([(*r[:4], bytes(r[4]), r[5]) for r in ids]) == by_row(want)
    assert by_row([(*r[:4], bytes(r[4]), r[5]) for r in corpus_pipeline.run(spark, folder).collect()]) == by_row(want)
