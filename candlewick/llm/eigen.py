"""Leading eigenvalues and eigenvectors of a symmetric matrix as small as a vector is long.

Householder reflections make it tridiagonal, Sturm counts bisect the leading eigenvalues, inverse iteration finds their
vectors, which are made orthogonal within each cluster of close eigenvalues and reflected back.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues closer than this share of the norm form a cluster.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit vectors of the reflections; reflection k acts on the rows after k."""
    a, reflections = np.array(matrix, float), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        v = v / size if size > 0 else v
        reflections.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = 2 * (rest @ v)
        w = p - (v @ p) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflections


def counts_below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: negative pivots of the Sturm sequence."""
    tiny = EPS * EPS * max(1e-150, np.abs(off).max(initial=0.0), np.abs(diagonal).max())
    pivot = diagonal[0] - at
    count = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = d - at - e * e / np.where(np.abs(pivot) < tiny, -tiny, pivot)
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, each to the last bit that bisection can settle."""
    n = len(diagonal)
    around = np.abs(np.append(off, 0)) + np.abs(np.insert(off, 0, 0))
    low, high = np.full(k, (diagonal - around).min()), np.full(k, (diagonal + around).max())
    slack = EPS * max(abs(low[0]), abs(high[0])) + 1e-300
    low, high = low - slack, high + slack
    below = n - 1 - np.arange(k)  # eigenvalues below the one sought
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        up = counts_below(diagonal, off, middle) > below
        low, high = np.where(up, low, middle), np.where(up, middle, high)
    return (low + high) / 2


def _solved(diagonal: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, tiny: float) -> np.ndarray:
    """(T - shift) y = b by elimination with row exchanges."""
    n = len(diagonal)
    rows = np.zeros((n, 3))
    y = b.copy()
    upper = np.append(off, 0.0)
    now = np.array([diagonal[0] - shift, upper[0], 0.0])
    for i in range(n - 1):
        under = np.array([off[i], diagonal[i + 1] - shift, upper[i + 1]])
        if abs(under[0]) > abs(now[0]):
            now, under = under, now
            y[i], y[i + 1] = y[i + 1], y[i]
        if abs(now[0]) < tiny:
            now[0] = tiny
        factor = under[0] / now[0]
        rows[i] = now
        y[i + 1] -= factor * y[i]
        now = np.array([under[1] - factor * now[1], under[2] - factor * now[2], 0.0])
    rows[-1] = now if abs(now[0]) >= tiny else [tiny, 0, 0]
    for i in range(n - 1, -1, -1):
        y[i] -= rows[i, 1] * (y[i + 1] if i + 1 < n else 0) + rows[i, 2] * (y[i + 2] if i + 2 < n else 0)
        y[i] /= rows[i, 0]
    return y


def _apart(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            v = v - (o @ v) * o
    return v / np.linalg.norm(v)


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors as columns."""
    n = len(matrix)
    k = min(k, n)
    diagonal, off, reflections = tridiagonal(matrix)
    values = leading_values(diagonal, off, k)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0), 1e-150)
    rng, found, vectors, cluster = np.random.Generator(np.random.PCG64(1)), [], [], 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            cluster = j
        shift = value - (j - cluster) * 4 * EPS * norm  # members of a cluster start from different shifts
        v = _apart(rng.standard_normal(n), found[cluster:])
        for _ in range(5):
            y = _solved(diagonal, off, shift, v, EPS * norm)
            v = _apart(y / np.abs(y).max(), found[cluster:])
        found.append(v)
        back = v.copy()
        for at in range(n - 3, -1, -1):
            u = reflections[at]
            back[at + 1 :] -= 2 * u * (u @ back[at + 1 :])
        vectors.append(_apart(back, vectors[cluster:]))
    return values, np.stack(vectors, axis=1)
