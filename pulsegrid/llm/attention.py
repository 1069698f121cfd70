"""A causal self-attention language model in numpy.

One layer with one head: a position's state is made of its subword's vector, those of the two before it, and what it
attends to in the window before it, through a rectifier; distance adds a learned bias to attention. The next subword is predicted in two steps, its group
and its place in the group, so a prediction costs two short softmaxes.

A text is cut into windows of `SCORED` positions with the `CONTEXT` before them. Windows overlap, and each subword is
scored once, in the window in which it is not context. Windows of many texts go through masked attention together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

CONTEXT, SCORED = 16, 32
SPAN = CONTEXT + SCORED
SIDE_BITS = 6
SIDE = 1 << SIDE_BITS
#: Ids are below this; the last is the end of a text, which also stands before its first subword.
IDS = SIDE * SIDE
END = IDS - 1
DIM, HIDDEN = 24, 48
SHAPES = {
    "embed": (IDS, DIM),
    "query": (DIM, DIM),
    "key": (DIM, DIM),
    "value": (DIM, DIM),
    "mix": (DIM, HIDDEN),
    "own": (DIM, HIDDEN),
    "last": (DIM, HIDDEN),
    "second": (DIM, HIDDEN),
    "bias": (HIDDEN,),
    "distance": (SPAN,),
    "group": (HIDDEN, SIDE),
    "group_bias": (SIDE,),
    "place": (HIDDEN, SIDE),
    "place_bias": (SIDE, SIDE),
}
_FAR = np.subtract.outer(np.arange(SCORED) + CONTEXT, np.arange(SPAN))
_LATER = _FAR < 0
_PAST = np.maximum(_FAR, 0)
Weights = dict[str, np.ndarray]


def start(counts: np.ndarray, seed: int = 7) -> Weights:
    """Weights before training; the biases begin at the frequencies of ids."""
    draw = np.random.default_rng(seed)
    w = {k: (draw.normal(size=s) / np.sqrt(s[0] if len(s) > 1 and k != "embed" else 4)).astype(np.float32) for k, s in SHAPES.items()}
    table = (counts + 0.05).reshape(SIDE, SIDE)
    w["group_bias"] = np.log(table.sum(axis=1) / table.sum()).astype(np.float32)
    w["place_bias"] = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    w["bias"][:] = 0
    w["distance"][:] = 0
    for k in ("group", "place"):
        w[k] *= 0.1
    return w


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of ids: inputs and targets of all positions in a row, where each window's scored part begins, and its text."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    begins = ends - np.array([len(t) + 1 for t in texts])
    targets = np.full(ends[-1], END, dtype=np.int64)
    inputs = np.full(ends[-1], END, dtype=np.int64)
    for t, b in zip(texts, begins, strict=True):
        targets[b : b + len(t)] = t
        inputs[b + 1 : b + 1 + len(t)] = t
    many = -(-(ends - begins) // SCORED)
    text = np.repeat(np.arange(len(texts)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return inputs, targets, begins[text] + nth * SCORED, text


def _cut(inputs: np.ndarray, begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that windows at `at` can attend to, and which of them lie before their text's begin (they are ends)."""
    keys = at[:, None] + np.arange(-CONTEXT, SCORED)
    before = keys < begin[:, None]
    ids = inputs.take(keys, mode="clip")
    ids[before] = END
    return ids, before


def _near(w: Weights) -> np.ndarray:
    """What distance adds to attention; what comes later is ruled out."""
    kind = w["distance"].dtype.type
    return np.where(_LATER, kind(-1e9), w["distance"][_PAST])


#: Numbers no larger need no shift before exp: sums of rows stay well within 32-bit floats.
SAFE = 40


def _norm(x: np.ndarray) -> float:
    """The largest length of a row, so products of rows of x and y are not above _norm(x) * _norm(y)."""
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max(initial=0)))


def _exponents(x: np.ndarray, most: float) -> np.ndarray:
    """exp in place, along the last axis, and its sums. Where numbers may exceed SAFE, rows are first moved to have 0 as their largest."""
    if not most < SAFE:
        x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], dtype=x.dtype)).reshape(x.shape[:-1])


def _attended(near: np.ndarray, before: np.ndarray, levels: np.ndarray, most: float) -> np.ndarray:
    """Levels become weights of attention, not yet divided by their sums, which are returned. most: of levels and distance."""
    levels += near
    early = np.flatnonzero(before[:, 0])
    if len(early):
        levels[early] += np.where(before[early], near.dtype.type(-1e9), near.dtype.type(0))[:, None, :]
    return _exponents(levels, most)


def _logits(w: Weights, heads: np.ndarray, state: np.ndarray, group: np.ndarray, room: Room) -> tuple[np.ndarray, float]:
    """Of groups and of places in the wanted group, and what none of them exceeds."""
    n = len(state)
    out = np.matmul(state, heads, out=room("logits", 2, n, SIDE))
    out[0] += w["group_bias"]
    out[1] += w["place_bias"].take(group, axis=0, out=room("bias", n, SIDE), mode="clip")
    return out, _norm(state) * _norm(np.concatenate(list(heads), axis=1).T) + max(np.abs(w["group_bias"]).max(), np.abs(w["place_bias"]).max())


class Room:
    """Arrays by name, whose memory is kept from batch to batch: fresh memory for each would cost more than the sums."""

    def __init__(self, kind: np.dtype):
        self._kind, self._made = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size, held = math.prod(shape), self._made.get(name)
        if held is None or len(held) < size:
            held = self._made[name] = np.empty(size, dtype=self._kind)
        return held[:size].reshape(shape)


class Scorer:
    """Weights with what follows from them for each id, which saves products by position."""

    def __init__(self, w: Weights):
        self.w = w
        self.query = w["embed"] @ w["query"] / np.float32(np.sqrt(DIM))
        self.key, self.value = w["embed"] @ w["key"], w["embed"] @ w["value"]
        self.own = w["embed"] @ w["own"] + w["bias"]
        self.last, self.second = w["embed"] @ w["last"], w["embed"] @ w["second"]
        self.near, self.heads = _near(w), np.stack([w["group"], w["place"]])
        self.most = _norm(self.query) * _norm(self.key) + np.abs(w["distance"]).max()

    def log10(self, texts: list[np.ndarray], batch: int = 64) -> np.ndarray:
        """The log10 probability of each text with its end."""
        if not texts:
            return np.zeros(0)
        inputs, targets, at, text = windows(texts)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        out = np.zeros(len(targets), dtype=np.float32)
        room = Room(np.dtype(np.float32))
        for k in range(0, len(at), batch):
            where, of = at[k : k + batch], text[k : k + batch]
            many, n = len(where), len(where) * SCORED
            keys, before = _cut(inputs, begins[of], where)
            query = self.query.take(keys[:, CONTEXT:], axis=0, out=room("query", many, SCORED, DIM), mode="clip")
            key = self.key.take(keys, axis=0, out=room("key", many, SPAN, DIM), mode="clip")
            value = self.value.take(keys, axis=0, out=room("value", many, SPAN, DIM), mode="clip")
            attend = np.matmul(query, key.transpose(0, 2, 1), out=room("attend", many, SCORED, SPAN))
            shares = _attended(self.near, before, attend, self.most)
            seen = np.matmul(attend, value, out=room("seen", many, SCORED, DIM))
            seen /= shares[:, :, None]
            state, more = np.matmul(seen.reshape(-1, DIM), self.w["mix"], out=room("state", n, HIDDEN)), room("more", n, HIDDEN)
            for table, back in ((self.own, 0), (self.last, 1), (self.second, 2)):
                state += table.take(keys[:, CONTEXT - back : SPAN - back].ravel(), axis=0, out=more, mode="clip")
            np.maximum(state, 0, out=state)
            # positions after a text's end are worked out with the others and left aside
            spots = (where[:, None] + np.arange(SCORED)).ravel()
            inside = np.flatnonzero(spots < np.repeat(begins[of + 1], SCORED))
            aims = targets.take(spots, mode="clip")
            group, place = aims >> SIDE_BITS, aims & (SIDE - 1)
            logits, most = _logits(self.w, self.heads, state, group, room)
            if not most < SAFE:
                logits -= logits.max(axis=2, keepdims=True)
            flat, line = logits.reshape(-1), np.arange(0, n * SIDE, SIDE)
            hit = flat.take(line + group) + flat.take(line + (n * SIDE + place))
            hit -= np.log(_exponents(logits, 0)).sum(axis=0)
            out[spots[inside]] = hit[inside]
        return np.add.reduceat(out.astype(np.float64), begins[:-1]) / np.log(10)


def gradients(w: Weights, inputs: np.ndarray, before: np.ndarray, targets: np.ndarray, room: Room | None = None) -> tuple[float, Weights]:
    """Mean loss over windows (inputs: windows x SPAN, targets: windows x SCORED, negative where there is none) and its gradient.

    What depends on an id alone is worked out once for each id among the inputs, as in `Scorer`.
    """
    kind, many = w["embed"].dtype, len(inputs)
    total, room = many * SCORED, room or Room(kind)
    wanted = (targets >= 0).ravel()
    n = max(1, int(wanted.sum()))
    ones = np.ones(total, dtype=kind)
    two = lambda x: x.reshape(-1, x.shape[-1])

    there = np.zeros(IDS, dtype=bool)
    there[inputs] = True
    ids, nth = np.flatnonzero(there), np.empty(IDS, dtype=np.int64)
    nth[ids] = np.arange(len(ids))
    at = nth[inputs]
    embed, scale = w["embed"][ids], kind.type(1 / np.sqrt(DIM))
    queries, keys = embed @ (w["query"] * scale), embed @ w["key"]
    query = queries.take(at[:, CONTEXT:], axis=0, out=room("query", many, SCORED, DIM), mode="clip")
    key = keys.take(at, axis=0, out=room("key", many, SPAN, DIM), mode="clip")
    value = (embed @ w["value"]).take(at, axis=0, out=room("value", many, SPAN, DIM), mode="clip")
    attend = np.matmul(query, key.transpose(0, 2, 1), out=room("attend", many, SCORED, SPAN))
    attend /= _attended(_near(w), before, attend, _norm(queries) * _norm(keys) + np.abs(w["distance"]).max())[:, :, None]
    seen = np.matmul(attend, value, out=room("seen", many, SCORED, DIM))
    state, more = np.matmul(two(seen), w["mix"], out=room("state", total, HIDDEN)), room("more", total, HIDDEN)
    for back, name in enumerate(("own", "last", "second")):
        table = embed @ w[name] if back else embed @ w[name] + w["bias"]
        state += table.take(at[:, CONTEXT - back : SPAN - back].reshape(-1), axis=0, out=more, mode="clip")
    np.maximum(state, 0, out=state)

    aims = np.maximum(targets.reshape(-1), 0)
    group, place = aims >> SIDE_BITS, aims & (SIDE - 1)
    p, most = _logits(w, np.stack([w["group"], w["place"]]), state, group, room)
    flat, line = p.reshape(-1), np.arange(0, total * SIDE, SIDE)
    sums = _exponents(p, most)
    hits, share = (line + group, line + (total * SIDE + place)), wanted.astype(kind) / kind.type(n)
    loss = -sum(float(np.log(flat[hit] / s + 1e-30) @ wanted) for s, hit in zip(sums, hits, strict=True)) / n
    # positions without a target have no share
    p *= (share / sums)[:, :, None]
    for hit in hits:
        flat[hit] -= share

    in_group = room("in_group", total, SIDE)
    in_group[:] = 0
    in_group.reshape(-1)[line + group] = 1
    d_heads = state.T @ p
    d_state = np.matmul(p[0], np.ascontiguousarray(w["group"].T), out=more)
    d_state += np.matmul(p[1], np.ascontiguousarray(w["place"].T), out=room("d_place", total, HIDDEN))
    d_state *= state > 0

    # the vectors of a position and of the two before it, side by side
    e_key, three = embed.take(at, axis=0, out=room("embed", many, SPAN, DIM), mode="clip"), room("three", many, SCORED, 3 * DIM)
    for back in range(3):
        three[:, :, back * DIM : (back + 1) * DIM] = e_key[:, CONTEXT - back : SPAN - back]
    d_three, d_mix = (d_state.T @ two(three)).T, (d_state.T @ two(seen)).T
    d_seen = np.matmul(d_state, w["mix"].T, out=room("d_seen", total, DIM)).reshape(many, SCORED, DIM)
    d_attend = np.matmul(d_seen, value.transpose(0, 2, 1), out=room("d_attend", many, SCORED, SPAN))
    d_attend -= np.einsum("bid,bid->bi", d_seen, seen)[:, :, None]
    d_attend *= attend
    d_query, d_key = np.matmul(d_attend, key, out=room("d_query", many, SCORED, DIM)), room("d_key", many, SPAN, 2 * DIM)
    d_query *= scale
    np.matmul(d_attend.transpose(0, 2, 1), query, out=d_key[:, :, :DIM])
    np.matmul(attend.transpose(0, 2, 1), d_seen, out=d_key[:, :, DIM:])
    e_own = two(three)[:, :DIM]
    d_both = two(e_key).T @ two(d_key)
    pair = np.concatenate([w["key"], w["value"]], axis=1)
    d_embed = np.matmul(two(d_key), pair.T, out=room("d_embed", many * SPAN, DIM)).reshape(many, SPAN, DIM)
    d_embed[:, CONTEXT:] += (two(d_query) @ w["query"].T).reshape(many, SCORED, DIM)
    backward = np.concatenate([w["own"], w["last"], w["second"]]).T
    d_back = np.matmul(d_state, backward, out=room("d_back", total, 3 * DIM)).reshape(many, SCORED, 3 * DIM)
    for back in range(3):
        d_embed[:, CONTEXT - back : SPAN - back] += d_back[:, :, back * DIM : (back + 1) * DIM]
    order = np.argsort(at.ravel().astype(np.uint16), kind="stable")
    firsts = np.cumsum(np.bincount(at.ravel(), minlength=len(ids))[:-1])
    whole = np.zeros(SHAPES["embed"], dtype=kind)
    rows = two(d_embed).take(order, axis=0, out=two(e_key), mode="clip")
    whole[ids] = np.add.reduceat(rows, np.concatenate([[0], firsts]), axis=0)
    far = np.where(_LATER, 0, (ones[:many] @ d_attend.reshape(many, -1)).reshape(SCORED, SPAN))
    return loss, {
        "embed": whole,
        "query": e_own.T @ two(d_query),
        "key": d_both[:, :DIM],
        "value": d_both[:, DIM:],
        "mix": d_mix,
        "own": d_three[:DIM],
        "last": d_three[DIM : 2 * DIM],
        "second": d_three[2 * DIM :],
        "bias": ones @ d_state,
        "distance": np.bincount(_PAST.ravel(), weights=far.ravel(), minlength=SPAN).astype(kind),
        "group": d_heads[0],
        "group_bias": ones @ p[0],
        "place": d_heads[1],
        "place_bias": in_group.T @ p[1],
    }


class Trainer:
    """Adam over windows. The weights lie in one row, and their averages beside it, so a step goes through each once."""

    def __init__(self, w: Weights, rate: float):
        self._row, self.rate, self.steps = flat(w), rate, 0
        self._mean, self._square, self._found, self._more = (np.zeros_like(self._row) for _ in range(4))
        self.w, self._by_name = _views(self._row), _views(self._found)
        self._room = Room(self._row.dtype)

    def step(self, inputs: np.ndarray, before: np.ndarray, targets: np.ndarray, rate: float | None = None) -> float:
        loss, found = gradients(self.w, inputs, before, targets, self._room)
        for k, g in found.items():
            self._by_name[k][...] = g
        self.steps += 1
        at = (rate or self.rate) * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        g, more = self._found, self._more
        np.subtract(g, self._mean, out=more)
        more *= np.float32(0.1)
        self._mean += more
        np.multiply(g, g, out=more)
        more -= self._square
        more *= np.float32(0.01)
        self._square += more
        np.sqrt(self._square, out=more)
        more += np.float32(1e-8)
        np.divide(self._mean, more, out=more)
        more *= np.float32(at)
        self._row -= more
        return loss


def lessons(ids: np.ndarray, nth: np.ndarray | None = None, batch: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of a whole text to learn from, a batch at a time: inputs, which of them lie before the text, and targets.

    nth: numbers of the windows wanted; all if None. Their scored parts cover each subword and the end once.
    """
    inputs, targets, at, _ = windows([ids])
    at = at if nth is None else at[nth]
    for k in range(0, len(at), batch):
        where = at[k : k + batch]
        keys, before = _cut(inputs, np.zeros(1, dtype=np.int64), where)
        spots = where[:, None] + np.arange(SCORED)
        wanted = np.where(spots < len(targets), targets[np.minimum(spots, len(targets) - 1)], -1)
        yield keys.astype("<u2"), before, wanted.astype("<i2")


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES]).astype(np.float32)


def _views(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for k, s in SHAPES.items():
        size = int(np.prod(s))
        out[k] = values[at : at + size].reshape(s)
        at += size
    return out


def unflat(values: np.ndarray) -> Weights:
    return {k: v.astype(np.float32) for k, v in _views(values).items()}
