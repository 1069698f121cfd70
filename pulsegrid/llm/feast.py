"""The largest eigenvalues of a symmetric matrix and their vectors, by contour integration (FEAST, Polizzi 2009).

An interval of the spectrum is enclosed by a circle. The integral of the shifted inverse around it projects a random
subspace onto the eigenvectors inside; Gauss-Legendre points on the upper half circle make that a few complex solves. The
Rayleigh-Ritz step takes vectors from the subspace, which is projected again until residuals are down to rounding.

How many eigenvalues lie in an interval is known beforehand from the inertia of the shifted matrix (the signs of the
pivots of its tridiagonal form, which congruence keeps), and the extracted ones must be as many.
"""

from __future__ import annotations

import numpy as np

POINTS, ROUNDS = 8, 40
#: Least share of a value by which the next one must be less to begin another interval.
APART = 0.1
#: Gaps below this share of the norm may be rounding, so no interval ends in one.
LEAST_GAP = 1e-10


class Inertia:
    """Counts eigenvalues above a shift."""

    def __init__(self, matrix: np.ndarray):
        a = np.array(matrix, dtype=np.float64)
        n = len(a)
        for k in range(n - 2):  # Householder's reflections leave a tridiagonal matrix of the same inertia at every shift
            v = a[k + 1 :, k].copy()
            if not np.any(v[1:]):
                continue
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            block = a[k + 1 :, k + 1 :]
            p = block @ v
            p -= (p @ v) * v
            block -= 2 * (np.outer(v, p) + np.outer(p, v))
            row = a[k + 1 :, k] - 2 * v * (v @ a[k + 1 :, k])
            a[k + 1 :, k] = a[k, k + 1 :] = row
        self.diagonal, self.beside = np.diagonal(a).copy(), np.diagonal(a, 1) ** 2
        reach = np.abs(np.diagonal(a, 1))
        around = np.append(reach, 0) + np.concatenate([[0], reach])[:n]
        self.low, self.high = float((self.diagonal - around).min()), float((self.diagonal + around).max())
        self.tiny = max(np.finfo(np.float64).tiny * 1e16, np.finfo(np.float64).eps ** 2 * max(abs(self.low), abs(self.high)))

    def above(self, shift: np.ndarray) -> np.ndarray:
        """How many eigenvalues are greater than each shift."""
        shift = np.atleast_1d(np.asarray(shift, dtype=np.float64))
        pivot = self.diagonal[0] - shift
        many = (pivot > 0).astype(np.int64)
        for d, b in zip(self.diagonal[1:], self.beside, strict=True):
            pivot = np.where(np.abs(pivot) < self.tiny, -self.tiny, pivot)
            pivot = d - shift - b / pivot
            many += pivot > 0
        return many

    def near(self, many: int, steps: int = 60) -> np.ndarray:
        """About where the largest `many` eigenvalues lie, by halving; good enough to choose intervals."""
        low, high, order = np.full(many, self.low), np.full(many, self.high), np.arange(many)
        for _ in range(steps):
            middle = (low + high) / 2
            over = self.above(middle) > order
            low, high = np.where(over, middle, low), np.where(over, high, middle)
        return (low + high) / 2


def intervals(inertia: Inertia, many: int, size: float) -> list[tuple[float, float]]:
    """Intervals from the top that hold the largest `many` eigenvalues, with edges in wide gaps; clusters stay whole.

    size: the matrix's norm, which tells what a wide gap is.
    """
    n = len(inertia.diagonal)
    looked, gap = np.zeros(0), np.zeros(0)
    while len(looked) < n and not np.any(gap[many - 1 :] > LEAST_GAP * size):
        looked = inertia.near(min(n, max(many + 16, 2 * len(looked))))
        gap = looked[:-1] - looked[1:]
    wide = gap > np.maximum(APART * np.abs(looked[:-1]), LEAST_GAP * size)
    behind = gap[many - 1 :]
    # the widest gap behind the last one asked for, or all of the spectrum
    last = many - 1 + int(np.argmax(behind)) if np.any(behind > LEAST_GAP * size) else n - 1
    pad = max(0.05 * size, 1e-300)
    edges, found = [float(looked[0] + pad)], []
    for i in [*np.flatnonzero(wide[:last]), last]:
        edge = looked[i] - pad if i + 1 >= len(looked) else (looked[i] + looked[i + 1]) / 2
        found.append((float(edge), edges[-1]))
        edges.append(float(edge))
    return found


def inside(matrix: np.ndarray, low: float, high: float, many: int, size: float) -> tuple[np.ndarray, np.ndarray]:
    """The `many` eigenvalues between low and high, and their vectors (columns)."""
    n, middle, radius = len(matrix), (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(POINTS)
    turn = np.exp(-0.5j * np.pi * (nodes - 1))
    draw = np.random.default_rng(11)
    width = min(n, many + max(4, many // 2))
    goal = 8 * np.finfo(np.float64).eps * size * np.sqrt(n)
    while True:
        space, best = draw.standard_normal((n, width)), None
        for _ in range(ROUNDS):
            total = np.zeros((n, space.shape[1]))
            for w, z in zip(weights, turn, strict=True):
                solved = np.linalg.solve((middle + radius * z) * np.eye(n) - matrix, space.astype(np.complex128))
                total += 0.5 * w * (radius * z * solved).real
            basis, _ = np.linalg.qr(total)
            basis, _ = np.linalg.qr(basis)
            small = basis.T @ matrix @ basis
            values, turned = np.linalg.eigh((small + small.T) / 2)
            vectors = basis @ turned
            took = np.flatnonzero((values > low) & (values < high))
            if len(took) == many:
                worst = np.linalg.norm(matrix @ vectors[:, took] - vectors[:, took] * values[took], axis=0).max(initial=0)
                if best is None or worst < best[0]:
                    best = worst, values[took], vectors[:, took]
                elif worst <= 16 * goal:  # no longer getting better
                    return best[1:]
                if worst <= goal:
                    return best[1:]
            space = vectors
        if best is not None and best[0] <= 1e-10 * size:
            return best[1:]
        if width == n:
            raise ArithmeticError(f"{many} eigenvalues lie between {low} and {high}, but not as many were extracted")
        width = min(n, 2 * width)


def largest(matrix: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest `many` eigenvalues, falling, and unit eigenvectors as columns, whose largest entry is positive."""
    n = len(matrix)
    many = min(many, n)
    most = float(np.abs(matrix).max(initial=0))
    if not many or not most:
        return np.zeros(many), np.eye(n)[:, :many]
    unit = matrix / most
    size = float(np.linalg.norm(unit))
    inertia = Inertia(unit)
    vectors = []
    for low, high in intervals(inertia, many, size):
        above = inertia.above(np.array([low, high]))
        vectors.append(inside(unit, low, high, int(above[0] - above[1]), size)[1])
    # once more over all intervals together, so that vectors of different ones are at right angles to the last bit
    basis, _ = np.linalg.qr(np.concatenate(vectors, axis=1))
    small = basis.T @ unit @ basis
    e, turned = np.linalg.eigh((small + small.T) / 2)
    e, v = e[::-1][:many] * most, (basis @ turned)[:, ::-1][:, :many]
    sign = np.sign(v[np.abs(v).argmax(axis=0), np.arange(many)])
    return e, v * np.where(sign == 0, 1, sign)
