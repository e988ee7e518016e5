"""Array arithmetic that runs inside Spark tasks on packed chunks of bounded length.

Everything works on a batch: the first axis runs over series (or chunks) that
share an order (p, q), the last one over time.
"""

from __future__ import annotations

import numpy as np

# Limits of the orders, bounds and start of a fit, tolerance.
MAX_P = 10
MAX_Q = 10
MAX_D = 2
COEF_BOUND = 2.0
START_COEF = 0.1
CONSTANT_SCALE = 10.0
CONSTANT_FLOOR = 1.0
XTOL_REL = 1e-6

# Of our own search over chunks: a fall of the loss that ends it, and the longest step.
FTOL_REL = 1e-9
MAX_MOVE = 0.5


def check_order(p: int, d: int, q: int) -> None:
    if not 0 <= p <= MAX_P or not 0 <= q <= MAX_Q or not 0 <= d <= MAX_D:
        raise ValueError(f"order ({p},{d},{q}) is outside 0..{MAX_P}, 0..{MAX_D}, 0..{MAX_Q}")


def length_class(n: int) -> int:
    """Series of one class are padded to a common length."""
    return 8 if n <= 256 else int(np.ceil(np.log2(n)))


def ma_filter(u: np.ndarray, theta: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Solve e_t = u_t - sum_j theta_j e_{t-j} along the last axis.

    ``u`` is (rows, n), ``theta`` (rows, q) and ``entry`` (rows, q) holds the
    values before the first one, newest first.  Time is folded into a square:
    all its rows are filtered from zero at once, then the entry values are
    handed from row to row through the unit responses.
    """
    rows, n = u.shape
    q = theta.shape[1]
    if q == 0 or n == 0:
        return u.copy()
    width = max(q, int(np.sqrt(n)))
    height = -(-n // width)
    square = np.zeros((rows, height + q, q + width))
    folded = np.zeros((rows, height * width))
    folded[:, :n] = u
    square[:, :height, q:] = folded.reshape(rows, height, width)
    for j in range(q):
        square[:, height + j, q - 1 - j] = 1.0  # unit responses, one row per entry value
    for t in range(q, q + width):
        past = square[:, :, t - q : t][:, :, ::-1]
        square[:, :, t] -= np.einsum("rhq,rq->rh", past, theta)
    unit = square[:, height:, q:]
    out = square[:, :height, q:]
    state = entry
    for h in range(height):
        if np.any(state):
            out[:, h, :] += np.einsum("rq,rqw->rw", state, unit)
        state = out[:, h, : -q - 1 : -1]
    return out.reshape(rows, -1)[:, :n]


def differenced(halo: np.ndarray, vals: np.ndarray, first: int, d: int):
    """(values before, own values, position of the first own value) after d differences."""
    levels = np.concatenate([halo, vals])
    w = np.diff(levels, d) if d else levels
    if first == 0:
        return w[:0], w, 0
    return w[: len(w) - len(vals)], w[len(w) - len(vals) :], first - d


class Batch:
    """Chunks of equal order, padded to one length: values, lags and the rows that count."""

    def __init__(self, chunks: list[tuple[np.ndarray, np.ndarray, int]], p: int, q: int, skip: int | None = None):
        """``chunks`` are (values before, own values, position of the first own one).

        Rows from position ``skip`` on count; the default is max(p, q).
        """
        self.p, self.q = p, q
        skip = max(p, q) if skip is None else skip
        self.lengths = np.array([len(own) for _, own, _ in chunks])
        n = int(self.lengths.max(initial=0))
        rows = len(chunks)
        padded = np.zeros((rows, p + n))
        self.counts = np.zeros((rows, n), dtype=bool)
        for i, (before, own, pos) in enumerate(chunks):
            keep = before[max(0, len(before) - p) :] if p else before[:0]
            padded[i, p - len(keep) : p] = keep
            padded[i, p : p + len(own)] = own
            self.counts[i, max(0, skip - pos) : len(own)] = True
        self.y = padded[:, p:]
        self.lags = [padded[:, p - j : p - j + n] for j in range(1, p + 1)]
        self.rows, self.n = rows, n

    def take(self, which: np.ndarray) -> "Batch":
        part = object.__new__(Batch)
        part.p, part.q, part.n = self.p, self.q, self.n
        part.lengths, part.counts, part.y = self.lengths[which], self.counts[which], self.y[which]
        part.lags = [lag[which] for lag in self.lags]
        part.rows = len(part.y)
        return part

    def residuals(self, phi, theta, c, entry=None):
        """Residuals; zero in rows that do not count."""
        u = self.y - c[:, None]
        for j, lag in enumerate(self.lags):
            u = u - phi[:, j, None] * lag
        u = np.where(self.counts, u, 0.0)
        entry = np.zeros((self.rows, self.q)) if entry is None else entry
        with np.errstate(all="ignore"):
            return np.where(self.counts, ma_filter(u, theta, entry), 0.0)

    def newest(self, series: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Last q values of each row, newest first; ``before`` stands in for missing ones."""
        joined = np.concatenate([before[:, ::-1], series], axis=1)
        at = self.lengths[:, None] + self.q - 1 - np.arange(self.q)[None, :]
        return np.take_along_axis(joined, at, axis=1)

    def sums(self, x, constant: bool, entry=None, slopes=None):
        """Loss, its gradient and the Gauss-Newton matrix, with the end states.

        ``x`` holds phi, theta and, with a constant, c.  ``entry`` and
        ``slopes`` are the residuals and their derivatives just before.
        """
        p, q = self.p, self.q
        k = x.shape[1]
        phi, theta = x[:, :p], x[:, p : p + q]
        c = x[:, p + q] if constant else np.zeros(self.rows)
        entry = np.zeros((self.rows, q)) if entry is None else entry
        slopes = np.zeros((self.rows, k, q)) if slopes is None else slopes
        with np.errstate(all="ignore"):
            e = self.residuals(phi, theta, c, entry)
            css = np.einsum("rn,rn->r", e, e)
            inputs = [-lag for lag in self.lags]
            past = np.concatenate([entry[:, ::-1], e], axis=1)
            inputs += [-past[:, q - j : q - j + self.n] for j in range(1, q + 1)]
            if constant:
                inputs.append(-np.ones_like(self.y))
            if not inputs:
                nothing = np.zeros((self.rows, 0))
                return css, nothing, np.zeros((self.rows, 0, 0)), self.newest(e, entry), slopes
            driven = np.where(self.counts[:, None, :], np.stack(inputs, axis=1), 0.0)
            flat = ma_filter(
                driven.reshape(self.rows * k, self.n),
                np.repeat(theta, k, axis=0),
                slopes.reshape(self.rows * k, q),
            )
            jac = np.where(self.counts[:, None, :], flat.reshape(self.rows, k, self.n), 0.0)
            grad = 2.0 * (jac @ e[:, :, None])[:, :, 0]
            gram = jac @ jac.transpose(0, 2, 1)
            ends = np.stack([self.newest(jac[:, i], slopes[:, i]) for i in range(k)], axis=1)
        css = np.where(np.isfinite(css), css, np.inf)
        return css, grad, gram, self.newest(e, entry), ends


def transfer(theta: np.ndarray, p: int, constant: bool, length: int, slopes: bool) -> np.ndarray:
    """Matrix that carries the state before a chunk to the state after ``length`` rows.

    The state holds q residuals and, with ``slopes``, q derivatives of each
    parameter, all newest first.
    """
    q = len(theta)
    k = (p + q + int(constant)) if slopes else 0
    step = np.zeros((q * (1 + k), q * (1 + k)))
    for block in range(1 + k):
        at = block * q
        step[at, at : at + q] = -theta
        for j in range(1, q):
            step[at + j, at + j - 1] = 1.0
        if block and p <= block - 1 < p + q:
            step[at, block - 1 - p] -= 1.0
    with np.errstate(all="ignore"):
        return np.linalg.matrix_power(step, length)


def bounds(mean: np.ndarray, p: int, q: int, constant: bool):
    """Start, lower and upper bounds of the parameters."""
    rows = len(mean)
    start = np.full((rows, p + q + constant), START_COEF)
    high = np.full_like(start, COEF_BOUND)
    if constant:
        start[:, -1] = mean
        high[:, -1] = np.maximum(CONSTANT_SCALE * np.abs(mean), CONSTANT_FLOOR)
    return start, -high, high


def trial_step(x, grad, gram, damping, low, high, coefs: int):
    """Damped Gauss-Newton step kept inside the bounds.

    The first ``coefs`` parameters move by at most ``MAX_MOVE``, so that a long
    step does not leave the valley of the start for an explosive solution.
    """
    k = x.shape[1]
    fixed = ((x <= low) & (grad > 0)) | ((x >= high) & (grad < 0))
    free = ~fixed
    a = gram * (free[:, :, None] & free[:, None, :])
    diag = np.einsum("rkk->rk", a)
    scale = np.maximum(diag, 1e-12)
    a = a + np.eye(k)[None] * np.where(free, damping[:, None] * scale + 1e-300, 1.0)[:, :, None]
    rhs = np.where(free, -0.5 * grad, 0.0)
    a = np.where(np.isfinite(a), a, 0.0) + np.eye(k)[None] * 1e-300
    try:
        step = np.linalg.solve(a, np.nan_to_num(rhs)[:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        step = np.stack([np.linalg.lstsq(m, v, rcond=None)[0] for m, v in zip(a, np.nan_to_num(rhs))])
    step = np.nan_to_num(step)
    if coefs:
        longest = np.abs(step[:, :coefs]).max(axis=1)
        step = step * np.minimum(1.0, MAX_MOVE / np.maximum(longest, 1e-300))[:, None]
    return np.clip(x + step, low, high)


def settle(x, f, trial, f_trial, damping):
    """(accepted, finished, new damping) of one trial."""
    better = f_trial < f
    moved = np.abs(trial - x) > XTOL_REL * np.maximum(np.abs(x), 1e-9)
    flat = np.abs(f - f_trial) <= FTOL_REL * np.abs(f)
    finished = ~moved.any(axis=1) | (better & flat) | (~better & (damping > 1e8))
    return better, finished, np.where(better, np.maximum(damping / 5.0, 1e-12), damping * 8.0)
