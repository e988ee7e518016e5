"""States of many whole series at once, on the arrays that Spark hands over: no object is made per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from foreloom.operators import kernel as K

# Values that are worked on at a time, each counted once per model: what is made of them takes several times their memory.
PORTION_VALUES = 500_000


class Lists:
    """A column of arrays as one array of values, and where the values of each row lie in it."""

    def __init__(self, array: pa.ListArray):
        bounds = np.asarray(array.offsets, dtype=np.int64)
        self.start, self.length = bounds[:-1], np.diff(bounds)
        self.values = array.values.to_numpy(zero_copy_only=False)

    def take(self, which: np.ndarray, width: int, first=0) -> np.ndarray:
        """``width`` values of each row from position ``first`` on, zero where a row has none."""
        at = np.reshape(first, (-1, 1)) + np.arange(width)
        there = (at >= 0) & (at < self.length[which, None])
        out = np.zeros((len(which), width))
        out[there] = self.values[(self.start[which, None] + at)[there]]
        return out


def portions(weights: np.ndarray):
    """Runs of consecutive rows, of at most ``PORTION_VALUES`` in all or of one row."""
    begin, held = 0, 0
    for at, weight in enumerate(weights):
        if at > begin and held + weight > PORTION_VALUES:
            yield begin, at
            begin, held = at, 0
        held += weight
    if begin < len(weights):
        yield begin, len(weights)


def _numbers(models: pa.StructArray, name: str) -> np.ndarray:
    return models.field(name).to_numpy(zero_copy_only=False)


def states_after(vals: Lists, parent: np.ndarray, models: pa.StructArray) -> pa.StructArray:
    """State of every model after the values of row ``parent`` of its series, from its ``state`` where it has one."""
    phi, theta = Lists(models.field("phi")), Lists(models.field("theta"))
    p, q, d = phi.length, theta.length, _numbers(models, "d").astype(np.int64)
    c = _numbers(models, "c").astype(float)
    n, n_vals = len(models), vals.length[parent]
    t, n_diff, css = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    known, old = np.zeros(n, bool), {}
    if models.type.get_field_index("state") >= 0:
        state = models.field("state")
        known = state.is_valid().to_numpy(zero_copy_only=False)
        old = {name: Lists(state.field(name)) for name in ("y_lags", "e_lags", "diff_buf")}
        t[known], n_diff[known] = _numbers(state, "t")[known], _numbers(state, "n_diff")[known]
        css[known] = _numbers(state, "css")[known]
    have = np.minimum(n_diff, d)  # levels before the first value that its differences can use
    size = np.maximum(n_vals - (d - have), 0)
    kind = np.where(size <= 256, 8, np.ceil(np.log2(np.maximum(size, 1)))).astype(np.int64)  # K.length_class
    held = np.where(d > 0, np.minimum(n_diff + n_vals, d + 1), 0)

    widths = {"y_lags": p, "e_lags": q, "diff_buf": np.where(d > 0, d + 1, 0)}
    bounds = {name: np.concatenate([[0], np.cumsum(width)]) for name, width in widths.items()}
    values = {name: np.zeros(int(bound[-1])) for name, bound in bounds.items()}

    def put(name: str, which: np.ndarray, rows: np.ndarray) -> None:
        values[name][bounds[name][which][:, None] + np.arange(rows.shape[1])] = rows

    groups, member = np.unique(np.stack([p, q, d, have, known, kind]), axis=1, return_inverse=True)
    for g, (p_g, q_g, d_g, have_g, known_g, _) in enumerate(groups.T.tolist()):
        which = np.flatnonzero(member.ravel() == g)
        x = vals.take(parent[which], int(n_vals[which].max()))
        own, lead = x, None
        if d_g:
            lead = np.zeros((len(which), d_g + 1))  # the levels before, the newest at the end
            if known_g:
                lead = old["diff_buf"].take(which, d_g + 1, n_diff[which] - d_g - 1)
            own = np.diff(np.concatenate([lead[:, 1:], x], axis=1), d_g)[:, d_g - have_g :]
        rows, width = own.shape
        y = np.concatenate([old["y_lags"].take(which, p_g)[:, ::-1] if known_g else np.zeros((rows, p_g)), own], axis=1)
        lags = old["e_lags"].take(which, q_g) if known_g else np.zeros((rows, q_g))
        skip, pos, length = max(p_g, q_g), t[which], size[which]
        at = np.arange(width)
        inside = at < length[:, None]
        counts = inside & (at >= (skip - pos)[:, None])
        entry = np.where((pos[:, None] - 1 - np.arange(q_g)) >= skip, lags, 0.0)
        coefficients = phi.take(which, p_g)
        with np.errstate(all="ignore"):
            u = own - c[which, None]
            for j in range(1, p_g + 1):
                u = u - coefficients[:, j - 1, None] * y[:, p_g - j : p_g - j + width]
            e = np.where(counts, K.ma_filter(np.where(counts, u, 0.0), theta.take(which, q_g), entry), 0.0)
            css[which] += np.sum(e * e, axis=1)
        ends = length[:, None] - 1
        put("y_lags", which, np.take_along_axis(y, p_g + ends - np.arange(p_g), axis=1))
        # residuals of rows that do not count stay in the lags, without a moving-average part
        e_all = np.concatenate([lags[:, ::-1], np.where(inside & ~counts, u, e)], axis=1)
        newest = np.take_along_axis(e_all, q_g + ends - np.arange(q_g), axis=1)
        put("e_lags", which, np.nan_to_num(newest, posinf=0.0, neginf=0.0))
        if d_g:
            levels = np.concatenate([lead, x], axis=1)
            slot = np.arange(d_g + 1)
            from_ = (d_g + 1 + n_vals[which] - held[which])[:, None] + slot
            kept = np.take_along_axis(levels, np.minimum(from_, levels.shape[1] - 1), axis=1)
            put("diff_buf", which, np.where(slot < held[which, None], kept, 0.0))

    def lists(name: str) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(bounds[name], pa.int32()), pa.array(values[name]))

    whole = {
        "t": pa.array(t + size, pa.int64()),
        "p": pa.array(p, pa.int32()),
        "q": pa.array(q, pa.int32()),
        "y_lags": lists("y_lags"),
        "e_lags": lists("e_lags"),
        "css": pa.array(np.where(np.isfinite(css), css, np.inf), pa.float64()),
        "d": pa.array(d, pa.int32()),
        "n_diff": pa.array(held, pa.int32()),
        "diff_buf": lists("diff_buf"),
    }
    return pa.StructArray.from_arrays(list(whole.values()), names=list(whole))


def fold_rows(batch: pa.RecordBatch, own: list[str], named: list[str]):
    """Batches with the columns ``own`` of a series, the fields ``named`` of each of its models, and its new state."""
    lengths = Lists(batch.column("vals")).length
    models = np.diff(np.asarray(batch.column("models").offsets, dtype=np.int64))
    for begin, end in portions(np.maximum(lengths, 1) * models):
        part = batch.slice(begin, end - begin)
        parent = np.repeat(np.arange(end - begin), models[begin:end])
        each = part.column("models").flatten()
        state = states_after(Lists(part.column("vals")), parent, each)
        columns = [part.column(c).take(pa.array(parent)) for c in own] + [each.field(c) for c in named] + [state]
        yield pa.RecordBatch.from_arrays(columns, names=[*own, *named, "state"])
