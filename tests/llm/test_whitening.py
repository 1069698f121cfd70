"""Whitening against plain exact arithmetic, and the eigenvalue solver against matrices of known spectrum."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pulsegrid.llm import feast, whitening
from pulsegrid.llm.queries import QUERIES


def matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    a = (q * values) @ q.T
    return (a + a.T) / 2


SPECTRA = {
    "even": np.arange(64, 0, -1.0),
    "flat": np.full(64, 3.0),
    "random": np.random.default_rng(1).random(64),
    "steep": 10.0 ** -np.arange(40),
    "clusters": np.repeat([9.0, 5.0, 1.0, 0.5], [10, 12, 20, 6]),
    "close": 1 + 1e-9 * np.arange(50),
    "rank": np.concatenate([np.arange(5, 0, -1.0), np.zeros(30)]),
    "one": np.array([2.0]),
    "few": np.array([3.0, 2.0, 2.0, 0.0]),
    "signs": np.linspace(-5, 4, 30),
    "small": 1e-200 * np.arange(20, 0, -1.0),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_largest(name):
    a = matrix(SPECTRA[name])
    want = np.linalg.eigvalsh(a)[::-1][:16]
    e, v = feast.largest(a, 16)
    size = np.abs(a).max() * len(a)
    assert np.allclose(e, want, rtol=0, atol=1e-13 * size)
    assert np.allclose(v.T @ v, np.eye(len(e)), atol=1e-12)
    assert np.linalg.norm(a @ v - v * e, axis=0).max() <= 1e-13 * size


def test_inertia_counts():
    a = matrix(np.arange(1.0, 31))
    at = np.array([-1, 0.5, 1.5, 10.2, 29.9, 31])
    assert feast.Inertia(a).above(at).tolist() == [30, 30, 29, 20, 1, 0]


def plain(rows, most=16):
    """What is to be returned, by fractions and numpy's own solver."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in good]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    s = [sum(v[k] for v in fit) for k in range(d)]
    centred = [[n * v[k] - s[k] for k in range(d)] for v in fit]
    cov = np.array([[float(Fraction(sum(v[a] * v[b] for v in centred), n**3)) for b in range(d)] for a in range(d)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    off = [[n * v[k] - s[k] for k in range(d)] for v in x]
    return good, n, [sum(c * c for c in v) for v in off], np.array(off, dtype="f8") / n @ q, e, np.trace(cov)


def test_op11(spark, tmp_path):
    draw = np.random.default_rng(5)
    some = (draw.normal(size=(300, 24)) @ draw.normal(size=(24, 24))).astype("f4")
    rows = [(i, v.tolist()) for i, v in enumerate(some)]
    rows += [(400, rows[3][1]), (401, rows[3][1]), (402, (some[3] + 1e-5).tolist()), (403, None), (404, [float("nan")] * 24), (405, [1.0, None] * 12), (406, [float("inf")] + [0.0] * 23), (None, rows[7][1])]
    wide = [(500, [1.0] * 23), (501, [])]
    schema = "vec_id long, embedding array<float>"
    spark.createDataFrame(rows + wide, schema).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    good, n, deviation, projected, e, trace = plain(rows)
    got = QUERIES["op11_whitening"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    got = got.collect()
    assert len(got) == len(good) * 16
    of = {}
    for r in got:
        of.setdefault(r["vec_id"], {})[r["component"]] = r
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / trace, rel=1e-10)
    sign = [np.sign(of[0][c + 1]["whitened"] * projected[0, c]) for c in range(16)]
    for k, (i, _) in enumerate(good):
        for c in range(16):
            assert of[i][c + 1]["deviation"] == deviation[k]
            assert of[i][c + 1]["whitened"] == pytest.approx(sign[c] * projected[k, c] / math.sqrt(e[c]), abs=1e-8)


def test_awkward_vectors(spark):
    schema = "vec_id long, embedding array<double>, whitened int, `a.b` string, x int"
    few = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "q", 1), (2, [2.0, 4.0, 3.0], 1, "q", 1), (3, [1e15, 0.0, 0.0], 1, "q", 1), (4, [2.0**30, 0.0, 0.0], 1, None, None)], schema)
    model = whitening.fit(few)
    assert (model.n, model.width) == (3, 3)
    got = {r["vec_id"]: r for r in whitening.whiten(few, model).collect()}
    assert set(got) == {1, 2, 4} and got[4].asDict().keys() == {"vec_id", "embedding", "a.b", "x", "deviation", "whitened"}
    assert got[4]["deviation"] is None or got[4]["deviation"] > 0
    assert got[1]["whitened"][2] is None and got[1]["whitened"][0] is not None  # three points make a plane
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    model = whitening.fit(same)
    assert (model.n, model.trace, model.explained, model.identity_error) == (1, 0.0, [None, None], None)
    assert [r["whitened"] for r in whitening.whiten(same, model).collect()] == [[None, None]] * 2
    for none in (same.limit(0), same.select("vec_id", same["embedding"].cast("array<float>").alias("embedding")).filter("false")):
        assert whitening.fit(none) is None and whitening.whiten(none, None).count() == 0
    empty = spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")
    assert whitening.whiten(empty, whitening.fit(empty)).collect()[0]["whitened"] == []
