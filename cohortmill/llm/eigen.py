"""Leading eigenvalues and eigenvectors of a small symmetric matrix: Householder tridiagonalisation, bisection by Sturm counts, inverse iteration."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and reflectors (a row each) of the tridiagonal form of a symmetric matrix."""
    a = np.array(a, float)
    n = len(a)
    reflectors = np.zeros((max(n - 2, 0), n))
    for k in range(n - 2):
        x = a[k + 1 :, k]
        rest = np.abs(x[1:]).max(initial=0.0)
        if not rest:
            continue
        scale = max(abs(x[0]), rest)
        v = x / scale
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        reflectors[k, k + 1 :] = v
        # both sides at once: a - v w' - w v'
        sub = a[k + 1 :, k + 1 :]
        p = sub @ v
        w = 2 * (p - (v @ p) * v)
        sub -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def back(reflectors: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Rows that are eigenvectors of the tridiagonal form, as those of the matrix."""
    out = vectors.copy()
    for v in reflectors[::-1]:
        out -= 2 * np.outer(out @ v, v)
    return out


def count_above(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie above each value: signs of the pivots of T - value."""
    tiny = EPS * max(np.abs(d).max(initial=0.0), np.abs(e).max(initial=0.0)) * EPS + np.finfo(float).tiny
    q = d[0] - at
    n = (q > 0).astype(int)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - at - e[i - 1] ** 2 / q
        n += q > 0
    return n


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection of all of them at once to the last bits."""
    k = min(k, len(d))
    radius = np.zeros(len(d))
    radius[:-1] += np.abs(e)
    radius[1:] += np.abs(e)
    span = max(np.abs(d - radius).max(), np.abs(d + radius).max())
    low, high = np.full(k, (d - radius).min() - EPS * span), np.full(k, (d + radius).max() + EPS * span)
    want = np.arange(1, k + 1)
    for _ in range(1100):
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high) | (high - low <= EPS * span / 8)).all():
            break
        enough = count_above(d, e, mid) >= want
        low, high = np.where(enough, mid, low), np.where(enough, high, mid)
    return low + (high - low) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; a vanishing pivot is replaced by a very small one."""
    n = len(d)
    tiny = EPS * (np.abs(d).max() + (np.abs(e).max() if n > 1 else 0.0)) + np.finfo(float).tiny
    p, u, w = np.zeros(n), np.zeros(n), np.zeros(n)  # the three diagonals of the upper triangle
    b = b.copy()
    here, above = d[0] - shift, e[0] if n > 1 else 0.0
    for i in range(n - 1):
        under, own, far = e[i], d[i + 1] - shift, e[i + 1] if i + 2 < n else 0.0
        if abs(under) > abs(here):
            p[i], u[i], w[i] = under, own, far
            b[i], b[i + 1] = b[i + 1], b[i]
            f = here / under
            here, above = above - f * own, -f * far
        else:
            p[i], u[i] = here if abs(here) > tiny else tiny, above
            f = under / p[i]
            here, above = own - f * above, far
        b[i + 1] -= f * b[i]
    p[-1] = here if abs(here) > tiny else tiny
    x = np.zeros(n)
    for i in range(n - 1, -1, -1):
        x[i] = (b[i] - (u[i] * x[i + 1] if i + 1 < n else 0.0) - (w[i] * x[i + 2] if i + 2 < n else 0.0)) / p[i]
        if abs(x[i]) > 1e250:
            x *= 1e-250
            b *= 1e-250
    return x


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, steps: int = 6) -> np.ndarray:
    """A unit eigenvector of the tridiagonal matrix for each value, as rows. Values close to their neighbour are a cluster: each of its vectors is kept orthogonal to those before."""
    n = len(d)
    norm = np.abs(d).max() + 2 * (np.abs(e).max() if n > 1 else 0.0)
    rng = np.random.default_rng(13)
    out, begin, shift = np.zeros((len(values), n)), 0, np.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            begin = i
        # equal values get shifts that differ a little
        shift = min(value, shift - 2 * EPS * norm) if i > begin else value
        x = rng.standard_normal(n)
        for step in range(steps):
            x = _solve(d, e, shift, x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                x -= (out[begin:i] @ x) @ out[begin:i]
            x /= np.linalg.norm(x)
            residual = d * x - value * x
            residual[:-1] += e * x[1:]
            residual[1:] += e * x[:-1]
            if step and np.abs(residual).max() <= 4 * EPS * norm:
                break
        out[i] = x
    return out


def leading_eigen(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows; the largest entry of each is positive."""
    a = np.asarray(a, float)
    scale = np.abs(a).max(initial=0.0)
    if not scale:
        return np.zeros(min(k, len(a))), np.eye(len(a))[:k]
    d, e, reflectors = tridiagonal(a / scale)
    values = leading_values(d, e, k)
    vectors = back(reflectors, leading_vectors(d, e, values))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors *= np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(1)[:, None], 1) < 0, -1.0, 1.0)
    return values * scale, vectors
