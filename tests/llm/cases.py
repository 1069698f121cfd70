"""Small documents with every awkward case, and helpers."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", size int, `Score` string, n_tokens string, k0 string, kept string"


def documents(seed=1, n=60):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefgéß") for _ in range(draw.randint(1, 9))) for _ in range(300)]
    say = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage = say(60)
    rows = []
    for d in range(n):
        text = f"{say(draw.randint(1, 90))}.\n{say(draw.randint(0, 40))}"
        if d % 7 == 0:
            text = f"{text}\n{passage}\n{say(5)}"
        if d % 11 == 0 and rows:
            text = rows[d // 2][1]
        if d % 13 == 5 and rows:
            base = rows[d // 3][1].split(" ")
            base[len(base) // 2 : len(base) // 2 + 1] = ["changed"]
            text = " ".join(base)
        rows.append((d * 3, text, draw.choice(["en", "de", None]), draw.choice(["a", "b", "B", None]), len(text)))
    rows += [(1, None, "en", "a", None), (2, "", "en", None, 0), (4, "%% !! 12", None, "b", 8), (None, "a text that has no id at all", None, "a", 28), (5, "x" * 5000 + " é" * 3000, "de", "c", 11000), (7, "Ends in <|endoftext|> special <|endoftext|>", "en", "a", 43)]
    rows += [rows[3], rows[3]]  # repeated rows
    return rows


def frame(spark, rows, extra=False):
    if not extra:
        return spark.createDataFrame(rows, SCHEMA)
    return spark.createDataFrame([(*r, 1, "s", "n", "k", "x") for r in rows], EXTRA)


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
