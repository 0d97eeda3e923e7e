"""Singular values and right singular vectors of a small triangle by quotient differences.

Householder reflections make the matrix upper bidiagonal. The dqds iteration, a differential quotient-difference step
with shift, finds all singular values of the bidiagonal, tiny ones to high relative accuracy,
since it adds only what is positive. For each value the bidiagonal's square less the value is factorised
from both ends; the two factorisations are joined where the twist leaves least, and the
vector follows from multiplications alone. Vectors of values that lie close together are turned within
their common space until they are eigenvectors there; where values are all but equal, a few inverse
iterations find that space first.

The matrices here are as wide as a vector has entries; the rows of the data never come here.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
#: Values of a smaller relative distance share a space; those of a still smaller one can't be told apart.
CLOSE, SAME = 1e-3, 1e-8
#: Squares of a smaller share of the largest are nothing.
NOTHING = 1e-26
#: Fixed seed of the starts of inverse iterations.
_SEED = 13


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta such that (1 - beta v v') x is zero below its first entry."""
    v = x.copy()
    rest = float(np.linalg.norm(x[1:]))
    if rest == 0:
        return v, 0.0
    v[0] = x[0] + np.copysign(np.hypot(x[0], rest), x[0])
    return v, 2.0 / float(v @ v)


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, upper diagonal b and the orthogonal V such that matrix = U B V'."""
    work = np.array(matrix, dtype=float)
    n = work.shape[1]
    right = np.eye(n)
    for k in range(n):
        v, beta = _reflector(work[k:, k])
        if beta:
            work[k:, k:] -= beta * np.outer(v, v @ work[k:, k:])
        if k < n - 2:
            v, beta = _reflector(work[k, k + 1 :])
            if beta:
                work[k:, k + 1 :] -= beta * np.outer(work[k:, k + 1 :] @ v, v)
                right[:, k + 1 :] -= beta * np.outer(right[:, k + 1 :] @ v, v)
    return np.diagonal(work).copy(), np.diagonal(work, 1).copy(), right


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential step, or None if the shift was above the least value."""
    out_q, out_e = [], []
    d = q[0] - shift
    for k in range(len(e)):
        if d < 0:
            return None
        now = d + e[k]
        out_q.append(now)
        if now == 0:
            out_e.append(0.0)
            d = q[k + 1] - shift
        else:
            t = q[k + 1] / now
            out_e.append(e[k] * t)
            d = d * t - shift
    if d < 0:
        return None
    out_q.append(d)
    return out_q, out_e


def _least(q: list[float], e: list[float]) -> float:
    """A guess at the least value from the last two rows."""
    if len(q) < 2:
        return q[-1]
    a, b, c = q[-2], q[-1], e[-1]
    half = (a + b + c) / 2
    root = max(half * half - a * b, 0.0) ** 0.5
    return a * b / (half + root) if half + root > 0 else 0.0


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the upper bidiagonal, falling."""
    found: list[float] = []
    scale = float(max(np.max(np.abs(a), initial=0.0), np.max(np.abs(b), initial=0.0)))
    if scale == 0 or not len(a):
        return np.zeros(len(a))
    tiny = _EPS**2
    parts = [([float(x / scale) ** 2 for x in a], [float(x / scale) ** 2 for x in b], 0.0)]
    while parts:
        q, e, moved = parts.pop()
        rounds = 0
        while q:
            # A link that changes no value any more ends a part.
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= tiny * (moved + q[k]) or e[k] <= tiny * (moved + q[k + 1])), None)
            if cut is not None:
                parts.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            if q[0] < q[-1] and rounds == 0:  # the matrix turned over both diagonals has the same values; small ones settle sooner at the end
                q, e = q[::-1], e[::-1]
            shift = _least(q, e) * (1 - 1e-3 / (1 + rounds)) if rounds else 0.0
            step = _dqds_step(q, e, shift)
            while step is None:
                shift = shift / 4 if shift > tiny * moved else 0.0
                step = _dqds_step(q, e, shift) if shift else _dqds_step(q, e, 0.0)
            (q, e), moved, rounds = step, moved + shift, rounds + 1
            if rounds > 40 * (len(q) + 10):
                raise ArithmeticError("dqds did not settle")
    return np.sort(np.array(found))[::-1] * scale * scale


def _twisted(q: np.ndarray, low: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of the square tridiagonal L D L' (D = q, L's links = low) to an eigenvalue."""
    n = len(q)
    floor = _EPS * float(q.max()) * 1e-3
    safe = lambda x: x if abs(x) > floor * _EPS else np.copysign(floor * _EPS, x)
    down, s = np.empty(max(n - 1, 0)), np.empty(n)
    s[0] = -value
    for k in range(n - 1):
        down[k] = q[k] * low[k] / safe(s[k] + q[k])
        s[k + 1] = down[k] * low[k] * s[k] - value
    up, p = np.empty(max(n - 1, 0)), np.empty(n)
    p[-1] = q[-1] - value
    for k in range(n - 2, -1, -1):
        t = q[k] / safe(q[k] * low[k] ** 2 + p[k + 1])
        up[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -up[k] * z[k]
    length = np.linalg.norm(z)
    return z / length if np.isfinite(length) and length > 0 else z


def _space_of_equals(square: np.ndarray, value: float, starts: np.ndarray) -> np.ndarray:
    """Orthogonal vectors that span the space of all but equal values, by inverse iterations on all of them."""
    n, m = starts.shape
    rng = np.random.default_rng(_SEED)
    top = max(float(np.abs(np.diagonal(square)).max()), np.finfo(float).tiny)
    shifted = square - value * np.eye(n)
    shifted[np.arange(n), np.arange(n)] += top * _EPS * (4 + rng.random(n))
    space = np.where(np.isfinite(starts), starts, 0.0) + 1e-3 * rng.standard_normal((n, m)) / n**0.5
    for _ in range(4):
        space = np.linalg.solve(shifted, np.linalg.qr(space)[0])
        space /= np.abs(space).max()
    return np.linalg.qr(space)[0]


def _turned(square: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Eigenvectors within the space of the given vectors, values falling."""
    space = np.linalg.qr(vectors)[0]
    inner = space.T @ square @ space
    return space @ np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1]


def _groups(values: np.ndarray, close: float) -> list[tuple[int, int]]:
    """Ranges of falling values in which neighbours lie closer than ``close`` of the larger one."""
    top = float(values[0])
    edges = np.flatnonzero((values[:-1] - values[1:] > close * values[:-1]) & (values[:-1] > NOTHING * top)) + 1
    cuts = [0, *edges.tolist(), len(values)]
    return [(lo, hi) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi - lo > 1]


def right_vectors(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values, falling, and the right singular vectors as columns."""
    a, b, right = bidiagonal(triangle)
    values = squares(a, b)
    n = len(a)
    top = float(values[0]) if n else 0.0
    if top == 0:
        return values, np.eye(n)
    # Entries of the diagonal that are nothing would divide by zero: they are less than rounding.
    a = np.where(np.abs(a) < _EPS * top**0.5 * 1e-3, _EPS * top**0.5 * 1e-3, a)
    q, low = a * a, b / a[:-1]
    z = np.column_stack([_twisted(q, low, float(v)) for v in values])
    square = np.diag(a * a + np.concatenate(([0.0], b * b))) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    for lo, hi in _groups(values, SAME):
        z[:, lo:hi] = _space_of_equals(square, float(values[lo:hi].mean()), z[:, lo:hi])
    for lo, hi in _groups(values, CLOSE):
        z[:, lo:hi] = _turned(square, z[:, lo:hi])
    # What rounding left between the groups goes, from the largest value on.
    z, rest = np.linalg.qr(z)
    return values, right @ (z * np.where(np.diagonal(rest) < 0, -1.0, 1.0))
