"""Plain versions of results that other tests look at by invariants: language scores, GIF files, pivot recall."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from pulsegrid.llm import gif, language_id, pivots
from pulsegrid.llm.queries import QUERIES

from .cases import documents, frame
from .test_llm import by_row


def plain_language(rows, held_out):
    """label and posterior by the definition: counts in dictionaries, backoff from the longest n-grams down, sums of logs."""
    counts = defaultdict(Counter)
    for d, text, label, *_ in rows:
        if d is not None and text is not None and label is not None and not held_out(d):
            for word in regex.findall(r"\p{L}+", text.lower()):
                counts[0][word, label] += 1
                for order in range(1, 6):
                    marked = f"<{word}>"
                    for i in range(len(marked) - order + 1):
                        counts[order][marked[i : i + order], label] += 1
    labels = sorted({label for _, label in counts[0]})
    known = {order: {g for g, _ in c} for order, c in counts.items()}
    total = {(order, label): sum(n for (_, at), n in c.items() if at == label) + 0.5 * (len(known[order]) + 1) for order, c in counts.items() for label in labels}
    log = lambda order, g, label: math.log((counts[order][g, label] + 0.5) / total[order, label])

    def word_score(word, label):
        if word in known[0]:
            return log(0, word, label)
        for order in range(5, 0, -1):
            marked = f"<{word}>"
            some = [g for i in range(len(marked) - order + 1) if (g := marked[i : i + order]) in known[order]]
            if some:
                return sum(log(order, g, label) for g in some) / len(some)
        return 0.0

    out = []
    for d, text, *_ in rows:
        words = regex.findall(r"\p{L}+", (text or "").lower())
        if not words or not labels:
            out.append((d, "und", 0.0))
            continue
        score = {label: sum(word_score(w, label) for w in words) for label in labels}
        best = max(labels, key=lambda label: (score[label], [-ord(c) for c in label]))
        out.append((d, best, 1 / sum(math.exp(min(700, s - score[best])) for s in score.values())))
    return out


def test_op10_whole_result(spark, tmp_path):
    rows = documents(12, 90)
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    want = plain_language(rows, held)
    got = QUERIES["op10_language_id"](spark, str(tmp_path)).collect()
    assert by_row([(r["doc_id"], r["lang_pred"], round(r["score"], 3)) for r in got]) == by_row([(d, label, round(s, 3)) for d, label, s in want])


def test_backoff_of_single_words(spark):
    rows = [(i, t, label, None, 0) for i, (t, label) in enumerate([("haus hausen baum", "de"), ("house home tree", "en"), ("hause", None), ("zzz", None), ("treeb", None), ("", None)])]
    model = language_id.fit(frame(spark, rows), learns=F.lit(True))
    got = language_id.predict(frame(spark, rows), model, keep=["doc_id"]).collect()
    want = plain_language(rows, lambda d: False)
    assert by_row([(r["doc_id"], r["lang_pred"], round(r["score"], 4)) for r in got]) == by_row([(d, label, round(s, 4)) for d, label, s in want])


def unpack(data, size):
    """LZW codes of a GIF by the book: a table of strings, codes read bit by bit."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, end, out, at, table, width, last = 1 << size, (1 << size) + 1, b"", 0, None, size + 1, None
    while True:
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == clear:
            table, width, last = {i: bytes([i]) for i in range(clear)} | {clear: b"", end: b""}, size + 1, None
            continue
        if code == end:
            return out
        if last is None:
            now = table[code]
        else:
            now = table[code] if code in table else last + last[:1]
            if len(table) < 4096:
                table[len(table)] = last + now[:1]
                if len(table) == 1 << width and width < 12:
                    width += 1
        out += now
        last = now


def decoded(media):
    """Frames of a GIF without transparency, as (delay, rows of red, green, blue); nothing of the module's reader is used."""
    assert media[:6] == b"GIF89a"
    width, height, flags, _, _ = struct.unpack("<HHBBB", media[6:13])
    at, palette = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        palette, at = [tuple(media[at + 3 * i : at + 3 * i + 3]) for i in range(n)], at + 3 * n
    delay, frames = None, []
    while media[at] != 0x3B:
        if media[at] == 0x21:
            if media[at + 1] == 0xF9:
                delay = struct.unpack("<H", media[at + 4 : at + 6])[0]
            at += 2
        else:
            assert media[at] == 0x2C
            left, top, w, h, flags = struct.unpack("<HHHHB", media[at + 1 : at + 10])
            assert (left, top, w, flags) == (0, 0, width, 0) and h <= height
            size, at = media[at + 10], at + 11
            data = b""
            while media[at]:
                data, at = data + media[at + 1 : at + 1 + media[at]], at + 1 + media[at]
            at += 1
            frames.append((delay, [palette[i] for i in unpack(data, size)]))
            continue
        while media[at]:
            at += 1 + media[at]
        at += 1
    assert at == len(media) - 1
    return frames


@pytest.mark.parametrize("size", [64, 128, 6400, 64 * 1024, 64 * 1030, 200_000 // 64 * 64])
def test_stored_gif_is_read_by_another_decoder(size):
    draw = np.random.default_rng(size)
    for payload in (draw.integers(0, 256, size, dtype=np.uint8).tobytes(), bytes(size), (b"abc " * size)[:size]):
        frames = decoded(gif.write(payload))
        assert all(r == g == b for _, pixels in frames for r, g, b in pixels)
        assert bytes(r for _, pixels in frames for r, _, _ in pixels) == payload
        assert [d for d, _ in frames] == [gif.DELAY] * len(frames)


@pytest.mark.parametrize(("rows", "width"), [(400, 16), (6000, 64), (3000, 384)])
def test_op3_recall_end_to_end(spark, rows, width):
    """Pairs just above the threshold in random directions: what the whole operator finds of them."""
    draw = np.random.default_rng(rows)
    base = draw.normal(size=(rows // 2, width))
    base /= np.linalg.norm(base, axis=1)[:, None]
    away = draw.normal(size=base.shape)
    away -= (away * base).sum(axis=1)[:, None] * base
    away /= np.linalg.norm(away, axis=1)[:, None]
    near = 0.9512 * base + math.sqrt(1 - 0.9512**2) * away
    data = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    got = {r["vec_id"]: r for r in pivots.links(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)).collect()}
    unit = np.concatenate([base, near])
    close = unit @ unit.T >= 0.95
    np.fill_diagonal(close, False)
    found, there = sum(r["n_links"] for r in got.values()), int(close.sum())
    assert all(got[i]["n_links"] <= close[i].sum() for i in got)
    assert found >= 0.98 * there


def test_op3_of_the_largest_given_table(spark):
    """Every hundredth vector against all: no link is missed or made up."""
    folder = "/root/testdata/check_l"
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype="f8")) for r in vectors.filter("vec_id % 100 = 0").collect()]
    asked = np.stack([v / np.linalg.norm(v) for _, v in rows])
    counts = np.zeros(len(rows), dtype=np.int64)
    for part in vectors.toArrow().to_batches(max_chunksize=8192):
        some = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype("f8")
        counts += ((some / np.linalg.norm(some, axis=1)[:, None]) @ asked.T >= 0.95).sum(axis=0)
    got = {r["vec_id"]: r["n_links"] for r in QUERIES["op3_pivots"](spark, folder).filter("vec_id % 100 = 0").collect()}
    assert [got[i] for i, _ in rows] == (counts - 1).tolist()


def test_op8_of_one_text_that_is_like_a_third_of_all(spark):
    """A hub with hundreds of near copies, which are not near to each other; pairs of the hub are dealt to blocks."""
    import random

    from pulsegrid.llm import minhash

    draw = random.Random(9)
    say = lambda n: [draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randint(0, 999)) for _ in range(n)]
    base = say(80)
    rows = [(1, " ".join(base), None, None, 0)]
    for d in range(2, 420):
        text = list(base)
        at = draw.randint(0, 70)
        text[at : at + 4] = say(4)
        rows.append((d, " ".join(text) if d % 3 else " ".join(say(80)), None, None, 0))
    got = minhash.near_duplicates(frame(spark, rows).repartition(4))
    sets = {d: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)} for d, t, *_ in rows}
    linked = {d for d in sets if d == 1 or 100 * len(sets[1] & sets[d]) >= 75 * len(sets[1] | sets[d])}
    assert len(linked) > 2 * minhash.BLOCK // 2
    assert {r["doc_id"] for r in got.filter("component_id = 1").collect()} == linked
