"""Searches for the parameters of many series at a time, each ended by its own rule and by no limit of rounds.

With the moving-average part held fixed, the residuals are linear in the autoregressive part and the constant.  These
are solved for exactly, so that a search moves in theta alone.
"""

from __future__ import annotations

from itertools import product

import numpy as np

from foreloom.operators import kernel as K

# A search ends where the curvature foresees no step that lowers the loss by more than this share of it ...
FALL_REL = 1e-10
# ... or where steps longer than this do not find a lower loss ...
STEP_LEAST = 1e-7
# ... or where steps longer than this lead out of what can be computed: the end is a point at that edge.
EDGE_STEP = 1e-3
# The recursion hands an error on; where it makes one grow by more than this over the series, the loss of a theta is
# rounding and no theta is looked for.
GROWTH = 1e6
# Longest first step.
RADIUS = 0.5
# Starts that are followed to their end, besides the fixed one; of a single coefficient all that lie lower than both
# neighbours are.
FOLLOWED = 3
# Roots whose products give the starts to choose from, and the starts of a single coefficient.
ROOTS = (-0.9, -0.5, 0.5, 0.9)
LINE = tuple(i / 10 for i in range(-9, 10))


def bounded_least_squares(r: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimise |r x - b| inside bounds: free variables are solved for, the first to meet a bound is held there, and a held
    one is let go while that lowers the sum.  Every turn lowers the sum or holds one more, so that it ends."""
    k = len(low)
    x = np.clip(np.zeros(k), low, high)
    held = np.zeros(k, bool)
    scale = np.maximum(np.sqrt((r * r).sum(axis=0)), 1e-300)
    best = np.inf
    while True:
        free = np.flatnonzero(~held)
        if len(free):
            rest = b - r[:, held] @ x[held]
            goal = np.linalg.lstsq(r[:, free] / scale[free], rest, rcond=1e-13)[0] / scale[free]
            step = goal - x[free]
            with np.errstate(divide="ignore", invalid="ignore"):
                room = np.where(step > 0, (high[free] - x[free]) / step, np.where(step < 0, (low[free] - x[free]) / step, np.inf))
            first = int(np.argmin(room))
            if room[first] < 1:
                x[free] = np.clip(x[free] + room[first] * step, low[free], high[free])
                x[free[first]] = high[free[first]] if step[first] > 0 else low[free[first]]
                held[free[first]] = True
                continue
            x[free] = goal
        rest = b - r @ x
        value = float(rest @ rest)
        pull = (r * rest[:, None]).sum(axis=0) / scale
        out = held & (((x <= low) & (pull > 1e-10 * np.sqrt(value))) | ((x >= high) & (pull < -1e-10 * np.sqrt(value))))
        if not out.any() or value >= best * (1 - 1e-12):
            return x
        best = value
        held[np.argmax(np.where(out, np.abs(pull), -1.0))] = False


class Projected:
    """The loss of a batch as a function of theta alone."""

    def __init__(self, batch: K.Batch, low: np.ndarray, high: np.ndarray, constant: bool):
        self.batch, self.constant, self.q = batch, constant, batch.q
        self.linear = batch.p + int(constant)
        order = [*range(batch.p), *([batch.p + batch.q] if constant else [])]
        self.low, self.high = low[:, order], high[:, order]
        columns = [batch.y, *batch.lags, *([np.ones_like(batch.y)] if constant else [])]
        self.columns = np.where(batch.counts[:, None, :], np.stack(columns, axis=1), 0.0)
        first = np.zeros_like(batch.y)
        first[np.arange(batch.rows), np.argmax(batch.counts, axis=1)] = 1.0
        self.columns = np.concatenate([self.columns, first[:, None, :]], axis=1)

    def take(self, which: np.ndarray) -> "Projected":
        part = object.__new__(Projected)
        part.batch, part.constant, part.q, part.linear = self.batch.take(which), self.constant, self.q, self.linear
        part.low, part.high, part.columns = self.low[which], self.high[which], self.columns[which]
        return part

    def solve(self, theta: np.ndarray):
        """(loss, linear parameters, residuals) at ``theta``."""
        rows, m, n = self.columns.shape
        counts = self.batch.counts
        with np.errstate(all="ignore"):
            flat = K.ma_filter(self.columns.reshape(rows * m, n), np.repeat(theta, m, axis=0), np.zeros((rows * m, self.q)))
            moved = np.where(counts[:, None, :], flat.reshape(rows, m, n), 0.0)
        growth = np.abs(moved[:, -1]).max(axis=1, initial=0.0)
        good = np.isfinite(moved).all(axis=(1, 2)) & (growth <= GROWTH)
        moved[~good] = 0.0
        target, others = moved[:, 0], moved[:, 1:-1]
        z = np.zeros((rows, self.linear))
        if self.linear and n >= self.linear:
            q, r = np.linalg.qr(others.transpose(0, 2, 1))
            at = np.flatnonzero(good)
            z[at] = self._inside(r[at], np.einsum("rnk,rn->rk", q[at], target[at]), at)
        elif self.linear:
            for i in np.flatnonzero(good):
                z[i] = bounded_least_squares(others[i].T, target[i], self.low[i], self.high[i])
        e = target - np.einsum("rk,rkn->rn", z, others)
        f = np.where(good, np.einsum("rn,rn->r", e, e), np.inf)
        return f, z, e

    def _inside(self, r: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The linear parameters of the rows ``at``: all at once, and one by one only where that leads out of the bounds."""
        low, high = self.low[at], self.high[at]
        z = np.zeros_like(b)
        with np.errstate(all="ignore"):
            diagonal = np.abs(np.diagonal(r, axis1=1, axis2=2))
            firm = diagonal.min(axis=1) > 1e-12 * np.sqrt((r * r).sum(axis=1)).min(axis=1)
            z[firm] = np.linalg.solve(r[firm], b[firm][:, :, None])[:, :, 0]
        inside = firm & ((z >= low) & (z <= high)).all(axis=1)
        for i in np.flatnonzero(~inside):
            z[i] = bounded_least_squares(r[i], b[i], low[i], high[i])
        return z

    def slope(self, theta: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Derivatives of the loss by theta; the linear parameters, being solved for, add nothing to them."""
        rows, n = e.shape
        q = self.q
        past = np.concatenate([np.zeros((rows, q)), e], axis=1)
        driven = np.stack([-past[:, q - j : q - j + n] for j in range(1, q + 1)], axis=1)
        driven = np.where(self.batch.counts[:, None, :], driven, 0.0)
        with np.errstate(all="ignore"):
            flat = K.ma_filter(driven.reshape(rows * q, n), np.repeat(theta, q, axis=0), np.zeros((rows * q, q)))
            jac = np.where(self.batch.counts[:, None, :], flat.reshape(rows, q, n), 0.0)
            return np.nan_to_num(2.0 * np.einsum("rqn,rn->rq", jac, e))

    def at(self, theta: np.ndarray):
        """(loss, slope) at ``theta``."""
        f, _, e = self.solve(theta)
        return f, self.slope(theta, e)

    def curvature(self, theta: np.ndarray, g: np.ndarray, high: float) -> np.ndarray:
        """Second derivatives, from differences of the slope along each axis."""
        rows, q = theta.shape
        out = np.empty((rows, q, q))
        for j in range(q):
            h = np.where(theta[:, j] + 1e-6 <= high, 1e-6, -1e-6)
            near = theta.copy()
            near[:, j] += h
            out[:, :, j] = np.nan_to_num((self.at(near)[1] - g) / h[:, None])
        return (out + out.transpose(0, 2, 1)) / 2


def regression_starts(batch: K.Batch) -> np.ndarray:
    """Theta from a regression on the residuals of a long autoregression."""
    p, q, n = batch.p, batch.q, batch.n
    out = np.zeros((batch.rows, q))
    for i in range(batch.rows):
        y = batch.y[i, : batch.lengths[i]]
        m = min(p + q + 3, (len(y) - 1) // 3)
        if m < 1:
            continue
        y = y - y.mean()
        lags = lambda x, k: np.stack([np.concatenate([np.zeros(j), x[: len(x) - j]]) for j in range(1, k + 1)], axis=1)
        long = lags(y, m)
        a = y - long @ np.linalg.lstsq(long[m:], y[m:], rcond=1e-10)[0]
        a[:m] = 0.0
        both = np.concatenate([lags(y, p) if p else np.zeros((len(y), 0)), lags(a, q)], axis=1)
        out[i] = np.linalg.lstsq(both[m:], y[m:], rcond=1e-10)[0][p:]
    return np.clip(np.nan_to_num(out), -0.98 * K.COEF_BOUND, 0.98 * K.COEF_BOUND)


def root_starts(q: int) -> np.ndarray:
    """Coefficients of (1 - r B)(1 - s B) for pairs of fixed roots, the rest zero; a single one in steps over its line."""
    if q == 1:
        return np.array(LINE)[:, None]
    found = {tuple([0.0] * q)}
    for r, s in product((*ROOTS, 0.0), repeat=2):
        theta = ([-(r + s), r * s] + [0.0] * q)[:q]
        if max(map(abs, theta)) <= K.COEF_BOUND:
            found.add(tuple(theta))
    return np.array(sorted(found))


def followed(thetas: np.ndarray, heights: np.ndarray) -> np.ndarray:
    """Which starts (number, q) of one series to follow, the lowest first, ties to the earlier.

    The lowest starts may all lie in one valley.  A single coefficient is a line, along which every valley shows.
    """
    order = np.argsort(heights, kind="stable")
    if thetas.shape[1] != 1:
        return order[:FOLLOWED]
    line = np.argsort(thetas[:, 0], kind="stable")
    high = np.concatenate([[np.inf], heights[line], [np.inf]])
    low = np.zeros(len(line), bool)
    low[line] = (high[1:-1] < high[:-2]) & (high[1:-1] <= high[2:])
    return order[low[order]]


def fit(batch: K.Batch, mean: np.ndarray, constant: bool, follow=None):
    """Minimise the loss of every series of a batch: parameters, losses, and whether the search ended at its rule.

    Several starts: the fixed one, and those of a regression start and fixed ones that are ``followed``.  The lowest end
    counts.
    ``follow`` is the search from a start, ``descend`` or ``simplex``.
    """
    follow = follow or descend
    start, low, high = K.bounds(mean, batch.p, batch.q, constant)
    whole = Projected(batch, low, high, constant)
    p, q, rows = batch.p, batch.q, batch.rows

    def joined(theta, z):
        return np.concatenate([z[:, :p], theta, z[:, p:]], axis=1)

    if q == 0:
        f, z, _ = whole.solve(np.zeros((rows, 0)))
        x = joined(np.zeros((rows, 0)), z)
        return x, _loss(batch, x, constant), np.isfinite(f)
    choice = np.stack([regression_starts(batch), *[np.repeat(s[None], rows, axis=0) for s in root_starts(q)]], axis=1)
    scores = np.stack([whole.solve(choice[:, i])[0] for i in range(choice.shape[1])], axis=1)
    wanted = [followed(c, s) for c, s in zip(choice, scores)]
    x, best, ended = start, np.full(rows, np.inf), np.zeros(rows, bool)
    for turn in range(-1, max(map(len, wanted), default=0)):
        of = np.array([i for i in range(rows) if turn < len(wanted[i])], dtype=int)
        theta = np.array([choice[i, wanted[i][turn]] if turn >= 0 else np.full(q, K.START_COEF) for i in of])
        part = whole.take(of)
        theta, done = follow(part, theta)
        _, z, _ = part.solve(theta)
        trial = joined(theta, z)
        f = _loss(part.batch, trial, constant)
        better = f < best[of]
        x[of[better]], best[of[better]], ended[of[better]] = trial[better], f[better], done[better]
    return x, best, ended


def _loss(batch: K.Batch, x: np.ndarray, constant: bool) -> np.ndarray:
    """The loss at whole parameters, by the recursion itself."""
    c = x[:, -1] if constant else np.zeros(batch.rows)
    e = batch.residuals(x[:, : batch.p], x[:, batch.p : batch.p + batch.q], c)
    with np.errstate(all="ignore"):
        css = np.einsum("rn,rn->r", e, e)
    return np.where(np.isfinite(css), css, np.inf)


def descend(loss: Projected, theta: np.ndarray):
    """Trust-region steps inside the bounds from ``theta``; (end, whether the loss there is finite).

    A step follows the curvature, negative parts turned round, no longer than the radius.  The radius shrinks where the
    loss is not lowered as foreseen.  Every step kept lowers the loss by more than rounding, every other one shrinks
    the radius to its least, so that each search ends.
    """
    bound = K.COEF_BOUND
    theta = np.clip(theta, -bound, bound)
    f, g = loss.at(theta)
    radius = np.full(len(theta), RADIUS)
    live = np.flatnonzero(np.isfinite(f))
    hessian = np.zeros((len(theta), theta.shape[1], theta.shape[1]))
    stale = np.ones(len(theta), bool)
    while len(live):
        part = loss.take(live)
        new = live[stale[live]]
        if len(new):
            hessian[new] = loss.take(new).curvature(theta[new], g[new], bound)
            stale[new] = False
        step, foreseen, rest = trust_step(theta[live], g[live], hessian[live], radius[live], bound)
        trial = np.clip(theta[live] + step, -bound, bound)
        ft, gt = part.at(trial)
        size = np.abs(trial - theta[live]).max(axis=1)
        kept, radius[live], over = settled(f[live], ft, foreseen, rest, size, radius[live])
        won = live[kept]
        theta[won], f[won], g[won] = trial[kept], ft[kept], gt[kept]
        stale[won] = True
        live = live[~over]
    return theta, np.isfinite(f)


def settled(f, f_trial, foreseen, rest, size, radius):
    """(kept, new radius, over) of trials: of losses before and after, the falls foreseen for the step and for one of any
    length, and the step's own length."""
    with np.errstate(all="ignore"):
        fall = np.subtract(f, f_trial)
        kept = fall > 1e-12 * np.asarray(f)
        ratio = np.where(np.asarray(foreseen) > 0, fall / foreseen, 0.0)
    longer = np.where((ratio > 0.75) & (size > 0.9 * np.asarray(radius)), 2 * np.asarray(radius), radius)
    radius = np.minimum(np.where(~kept | (ratio < 0.25), np.minimum(radius, size) / 4, longer), 2 * RADIUS)
    edge = ~np.isfinite(f_trial) & (np.asarray(size) < EDGE_STEP)
    over = (np.asarray(rest) <= FALL_REL * np.asarray(f)) | (radius < STEP_LEAST) | edge
    if np.ndim(f) == 0:
        return bool(kept), float(radius), bool(over)
    return kept, radius, over


def _free(theta, g, bound):
    return ~(((theta <= -bound) & (g > 0)) | ((theta >= bound) & (g < 0)))


def trust_step(theta, g, hessian, radius, bound):
    free = _free(theta, g, bound)
    a = hessian * (free[:, :, None] & free[:, None, :])
    values, vectors = np.linalg.eigh(a)
    pull = np.where(free, g, 0.0)
    along = np.einsum("rij,ri->rj", vectors, pull)
    least = 1e-9 * np.maximum(np.abs(values).max(axis=1, keepdims=True), 1e-300)
    move = -along / np.maximum(np.abs(values), least)
    step = np.where(free, np.nan_to_num(np.einsum("rij,rj->ri", vectors, move)), 0.0)
    rest = -0.5 * np.einsum("ri,ri->r", step, pull)  # what the whole step, of any length, would lower
    longest = np.abs(step).max(axis=1)
    step = step * np.minimum(1.0, radius / np.maximum(longest, 1e-300))[:, None]
    step = np.clip(theta + step, -bound, bound) - theta
    foreseen = -(np.einsum("ri,ri->r", step, pull) + 0.5 * np.einsum("ri,rij,rj->r", step, a, step))
    return step, foreseen, rest


# -- search without derivatives -----------------------------------------------

# First step of a simplex, and of one begun again at its end.
STEP, STEP_AGAIN = 0.25, 0.01
# A simplex ends when its corners are this near, relative to the larger of the best and START_COEF, and lie as high.
XTOL = 1e-6
# A simplex that ended is begun again as long as that lowers the loss by more than this share.
AGAIN_REL = 1e-8


def corners(theta: np.ndarray, step: float) -> np.ndarray:
    """(rows, q + 1, q): ``theta`` and a step along each axis, away from the nearer bound."""
    q = theta.shape[1]
    out = np.repeat(theta[:, None, :], q + 1, axis=1)
    for j in range(q):
        out[:, j + 1, j] += np.where(theta[:, j] > 0, -step, step)
    return out


def proposals(points: np.ndarray) -> np.ndarray:
    """All points that a turn may need, of simplexes whose corners stand in the order of their values: the worst corner
    reflected, twice as far, half as far, half way back, and the corners drawn half way to the best."""
    middle = points[:, :-1].mean(axis=1)
    away = middle - points[:, -1]
    single = np.stack([middle + a * away for a in (1.0, 2.0, 0.5, -0.5)], axis=1)
    drawn = (points[:, 1:] + points[:, :1]) / 2
    return np.clip(np.concatenate([single, drawn], axis=1), -K.COEF_BOUND, K.COEF_BOUND)


def ranked(points, values):
    order = np.argsort(values, axis=1, kind="stable")
    return np.take_along_axis(points, order[:, :, None], axis=1), np.take_along_axis(values, order, axis=1)


def turn(points, values, found, heights):
    """The simplexes after one turn, corners in the order of their values."""
    best, second, worst = values[:, 0], values[:, -2], values[:, -1]
    reflected, further, outer, inner = heights[:, :4].T
    out = np.full(len(values), 3)
    out = np.where(reflected < worst, 2, out)
    height = np.where(out == 2, outer, inner)
    pulled = ~(height < np.minimum(reflected, worst))
    out = np.where(reflected < second, 0, out)
    out = np.where((reflected < best) & (further < reflected), 1, np.where(reflected < best, 0, out))
    pulled &= ~(reflected < second) & ~(reflected < best)
    rows = np.arange(len(values))
    new, high = points.copy(), values.copy()
    new[:, -1], high[:, -1] = found[rows, out], heights[rows, out]
    new[pulled, 1:], high[pulled, 1:] = found[pulled, 4:], heights[pulled, 4:]
    new[pulled, 0], high[pulled, 0] = points[pulled, 0], values[pulled, 0]
    return ranked(new, high)


def together(points: np.ndarray) -> np.ndarray:
    """Whether the corners of a simplex are as near as it has to bring them."""
    spread = np.abs(points[:, 1:] - points[:, :1]).max(axis=(1, 2))
    return spread <= XTOL * np.maximum(np.abs(points[:, 0]).max(axis=1), K.START_COEF)


def simplex(loss: Projected, theta: np.ndarray):
    """Nelder-Mead on the projected loss, all series turn by turn; (end, whether the loss there is finite)."""

    def heights(which, points):
        m = points.shape[1]
        f = loss.take(np.repeat(which, m)).solve(points.reshape(-1, points.shape[2]))[0]
        return f.reshape(len(which), m)

    every = np.arange(len(theta))
    points, values = ranked(*(lambda c: (c, heights(every, c)))(corners(theta, STEP)))
    before = np.full(len(theta), np.inf)
    live = np.flatnonzero(np.isfinite(values[:, 0]))
    while len(live):
        found = proposals(points[live])
        points[live], values[live] = turn(points[live], values[live], found, heights(live, found))
        at_end = live[together(points[live])]
        if len(at_end):
            lower = values[at_end, 0] < before[at_end] * (1 - AGAIN_REL)
            lower |= ~np.isfinite(before[at_end])
            again, over = at_end[lower], at_end[~lower]
            before[again] = values[again, 0]
            if len(again):
                fresh = corners(points[again, 0], STEP_AGAIN)
                points[again], values[again] = ranked(fresh, heights(again, fresh))
            live = np.setdiff1d(live, over)
    return points[:, 0], np.isfinite(values[:, 0])


def computable(theta: np.ndarray, n: int) -> bool:
    """Whether the recursion keeps an error under ``GROWTH`` over ``n`` rows: its answer to a unit error, as far as it is
    short, and the largest root beyond that."""
    theta = np.atleast_1d(theta)
    answer = K.ma_filter(np.eye(1, min(n, 4096)), theta[None], np.zeros((1, len(theta))))
    if not np.isfinite(answer).all() or np.abs(answer).max(initial=0.0) > GROWTH:
        return False
    root = np.abs(np.roots(np.concatenate([[1.0], theta]))).max(initial=0.0)
    return n <= 4096 or root <= 1 or n * np.log(root) <= np.log(GROWTH)


def least_of_square(css: float, grad: np.ndarray, gram: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(least value, its place) of css + grad z + z gram z inside bounds."""
    if not len(grad):
        return css, grad
    scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
    values, vectors = np.linalg.eigh(gram / np.outer(scale, scale))
    root = np.sqrt(np.maximum(values, 1e-14 * max(values.max(), 1e-300)))
    r = root[:, None] * vectors.T * scale
    b = -0.5 * (vectors.T @ (grad / scale)) / root
    z = bounded_least_squares(r, b, low, high)
    return float(css + grad @ z + z @ gram @ z), z
