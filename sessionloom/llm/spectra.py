"""Eigendecompositions kept up to date by rank-one updates, many of one size at a time.

An update of diag(values) + z z' is diagonal again at the roots of the secular equation
1 + sum z_i^2 / (values_i - x) = 0. Entries of z that are negligible, and all but one of those that
share a value, are deflated first; weights are recomputed from the roots, so vectors stay orthogonal.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
MOST_STEPS = 100


def _rotated(values, basis, z, active, tol):
    """Deflate equal values: of two neighbours that a rotation decouples, the upper one keeps the weight."""
    many, size = values.shape
    rows = np.arange(many)
    last = np.where(active[:, 0], 0, -1)
    for i in range(1, size):
        here = rows[active[:, i]]
        pair = here[last[here] >= 0]
        p = last[pair]
        low, high = z[pair, p], z[pair, i]
        length = np.hypot(low, high)
        c, s = high / length, low / length
        gap = values[pair, i] - values[pair, p]
        small = np.abs(gap * c * s) <= tol[pair]
        pair, p, c, s, gap = pair[small], p[small], c[small], s[small], gap[small]
        if len(pair):
            z[pair, i], z[pair, p] = length[small], 0.0
            active[pair, p] = False
            a, b = basis[pair, :, p], basis[pair, :, i]
            basis[pair, :, p] = c[:, None] * a - s[:, None] * b
            basis[pair, :, i] = s[:, None] * a + c[:, None] * b
            values[pair, p] += s * s * gap
            values[pair, i] -= s * s * gap
        last[here] = i


def _start(c, w_left, w_right, gap, left):
    """Root between two poles with the other terms held constant, from the nearer pole."""
    a = np.where(left, c * gap + w_left + w_right, -c * gap + w_left + w_right)
    b = np.where(left, w_left * gap, -w_right * gap)
    root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
    near = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
    far = np.where(a < 0, 2 * b / (a - root), (a + root) / (2 * c))
    return np.where(left, near, far)


def secular_roots(poles, weights, index, upper, total):
    """(origin, offset) of the roots above ``poles[row, index]`` and below ``upper``.

    One row per root: ``poles`` are infinite and ``weights`` 0 where deflated; ``upper`` is infinite
    for the last root, which lies within ``total``, the sum of weights. Steps solve the equation
    with the nearer pole's weight kept and the rest fitted to value and slope; a step outside the
    bracket halves it.
    """
    rows = np.arange(len(index))
    pole = poles[rows, index]
    last = np.isinf(upper)
    gap = np.where(last, total, upper - pole)
    at = np.where(last, -1, np.argmax(poles == upper[:, None], axis=1))
    w_left = weights[rows, index]
    w_right = np.where(last, 0.0, weights[rows, at])
    half = gap / 2
    terms = weights / ((poles - pole[:, None]) - half[:, None])
    middle = 1 + terms.sum(1)
    left = last | (middle >= 0)
    origin = np.where(left, pole, upper)
    below = np.where(left, 0.0, -half)
    above = np.where(left, half, 0.0)
    below = np.where(last & (middle < 0), half, below)
    above = np.where(last & (middle < 0), gap, above)
    rest = middle + w_left / half - w_right / half
    x = _start(rest, w_left, w_right, gap, left)
    x = np.where((x > below) & (x < above), x, (below + above) / 2)
    shifted = poles - origin[:, None]
    to_left, to_right = pole - origin, np.where(last, gap, upper - origin)

    todo = rows
    matrix, w = shifted, weights
    for _ in range(MOST_STEPS):
        now = x[todo]
        distance = matrix - now[:, None]
        terms = w / distance
        f = 1 + terms.sum(1)
        bound = 8 * EPS * (1 + np.abs(terms).sum(1))
        below[todo] = np.where(f < 0, now, below[todo])
        above[todo] = np.where(f > 0, now, above[todo])
        low, high = below[todo], above[todo]
        open_ = (np.abs(f) > bound) & (high - low > 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if not open_.any():
            break
        if not open_.all():
            todo, matrix, w, now, f = todo[open_], matrix[open_], w[open_], now[open_], f[open_]
            terms, distance, low, high = terms[open_], distance[open_], low[open_], high[open_]
        slope = (terms / distance).sum(1)
        d_left, d_right = to_left[todo] - now, to_right[todo] - now
        side = left[todo]
        kept = np.where(side, w_left[todo] / d_left**2, w_right[todo] / d_right**2)
        span = np.where(side, d_left - d_right, d_right - d_left)
        c = f - np.where(side, d_right, d_left) * slope - span * kept
        a = (d_left + d_right) * f - d_left * d_right * slope
        b = d_left * d_right * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        step = np.where(np.isfinite(step) & (step * f < 0), step, -f / slope)
        new = now + step
        x[todo] = np.where((new > low) & (new < high), new, (low + high) / 2)
    return origin, x


def rank_one(values: np.ndarray, basis: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values (ascending) and vectors (columns) of basis diag(values) basis' + u u', for many at once:
    values and u are (many, size), basis is (many, size, size)."""
    values, basis = values.copy(), basis.copy()
    many, size = values.shape
    z = np.matmul(u[:, None, :], basis)[:, 0, :]
    norm = np.sqrt((z * z).sum(1))
    tol = 8 * EPS * np.maximum(np.abs(values).max(1), norm * norm)
    active = np.abs(z) * norm[:, None] > tol[:, None]
    before = np.maximum.accumulate(np.where(active, values, -np.inf), axis=1)
    gaps = np.where(active[:, 1:], values[:, 1:] - before[:, :-1], np.inf)
    close = np.flatnonzero((gaps <= 2 * tol[:, None]).any(1))
    if len(close):
        part = [x[close] for x in (values, basis, z, active)]
        _rotated(*part, tol[close])
        values[close], basis[close], z[close], active[close] = part
    z[~active] = 0.0
    weights = z * z
    poles = np.where(active, values, np.inf)
    ahead = np.minimum.accumulate(poles[:, ::-1], axis=1)[:, ::-1]
    upper = np.concatenate([ahead[:, 1:], np.full((many, 1), np.inf)], axis=1)
    row, index = np.nonzero(active)
    if len(row):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            origin, offset = secular_roots(
                poles[row], weights[row], index, upper[row, index], weights.sum(1)[row]
            )
        # distance[k, j, i] = value i - root j, from the root's own origin, so without cancellation
        distance = np.full((many, size, size), 1.0)
        distance[row, index] = np.where(active[row], (values[row] - origin[:, None]) - offset[:, None], 1.0)
        both = active[:, :, None] & active[:, None, :]
        apart = values[:, None, :] - values[:, :, None]
        apart[:, np.arange(size), np.arange(size)] = -1.0
        ratio = np.where(both, distance / np.where(both, apart, 1.0), 1.0)
        weight = np.sqrt(np.abs(ratio.prod(axis=1)))
        turn = np.where(both, np.copysign(weight, z)[:, None, :] / distance, 0.0)
        length = np.sqrt((turn * turn).sum(2))
        turn /= np.where(length == 0, 1.0, length)[:, :, None]
        idle_row, idle = np.nonzero(~active)
        turn[idle_row, idle, idle] = 1.0
        basis = np.matmul(basis, turn.transpose(0, 2, 1))
        values[row, index] = origin + offset
    if (values[:, 1:] < values[:, :-1]).any():
        order = np.argsort(values, axis=1, kind="stable")
        values = np.take_along_axis(values, order, 1)
        basis = np.take_along_axis(basis, order[:, None, :], 2)
    return values, basis


class Spectra:
    """Counts, means and spectra of the centred scatter of several streams of vectors."""

    def __init__(self, many: int, size: int) -> None:
        self.count = np.zeros(many)
        self.mean = np.zeros((many, size))
        self.values = np.zeros((many, size))
        self.basis = np.tile(np.eye(size), (many, 1, 1))

    def take(self, rows: np.ndarray) -> None:
        """Centred rank-one updates: stream i takes rows i, i + many, ..."""
        many = len(self.count)
        for low in range(0, len(rows), many):
            some = rows[low : low + many]
            k = len(some)
            count = self.count[:k, None]
            off = some - self.mean[:k]
            u = off * np.sqrt(count / (count + 1))
            self.values[:k], self.basis[:k] = rank_one(self.values[:k], self.basis[:k], u)
            self.mean[:k] += off / (count + 1)
            self.count[:k] += 1

    def joined(self) -> "Spectra":
        """All streams as one: the upper half's eigenpairs and the difference of means enter the lower
        half by rank-one updates, until one is left."""
        while len(self.count) > 1:
            half = len(self.count) // 2
            low, high = slice(0, half), slice(half, 2 * half)
            a, b = self.count[low, None], self.count[high, None]
            total = a + b
            shift = self.mean[high] - self.mean[low]
            filled = np.where(total == 0, 1.0, total)
            values, basis = rank_one(self.values[low], self.basis[low], shift * np.sqrt(a * b / filled))
            for i in range(values.shape[1]):
                u = self.basis[high, :, i] * np.sqrt(np.maximum(self.values[high, i], 0.0))[:, None]
                values, basis = rank_one(values, basis, u)
            out = Spectra(0, self.mean.shape[1])
            rest = slice(2 * half, None)
            out.count = np.concatenate([total[:, 0], self.count[rest]])
            out.mean = np.concatenate([self.mean[low] + shift * b / filled, self.mean[rest]])
            out.values = np.concatenate([values, self.values[rest]])
            out.basis = np.concatenate([basis, self.basis[rest]])
            self = out
        return self
