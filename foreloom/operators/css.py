"""Conditional sum of squares: losses, residuals, gradients and constant-size states.

Series arrive packed (``foreloom.plans.packed``).  A series that is one chunk is
evaluated in one pass.  A longer series is evaluated in two: every chunk first
reports the state it would end in when started from zero, these end states are
chained per series (one small row per chunk), and the second pass starts every
chunk from its exact entry state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreloom.operators import kernel as K
from foreloom.operators.folding import fold_rows
from foreloom.plans.joins import attach
from foreloom.plans.packed import Packed

STATE_FIELDS = (
    "t long, p int, q int, y_lags array<double>, e_lags array<double>, css double, "
    "d int, n_diff int, diff_buf array<double>"
)
STATE_TYPE = "struct<" + STATE_FIELDS.replace(" array", ":array").replace(" long", ":bigint").replace(
    " int", ":int"
).replace(" double", ":double") + ">"
STATE_NAMES = [f.split()[0] for f in STATE_FIELDS.split(", ")]


def ddl(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def model(
    df: DataFrame, phi: Column | list, theta: Column | list, c: Column | float = 0.0, d: Column | int = 0
) -> DataFrame:
    """Add the parameter columns of one model to a frame of keys."""

    def array(v):
        if isinstance(v, Column):
            return v
        return F.array(*[F.lit(float(x)) for x in v]).cast("array<double>")

    return df.select(
        "*",
        array(phi).alias("phi"),
        array(theta).alias("theta"),
        (c if isinstance(c, Column) else F.lit(float(c))).alias("c"),
        (d if isinstance(d, Column) else F.lit(d)).cast("int").alias("d"),
    )


def one_model(packed: Packed, phi, theta, c=0.0, d=0) -> DataFrame:
    """The same parameters for every series."""
    return model(packed.frame.where("chunk = 0").select(*packed.keys), phi, theta, c, d)


def with_models(packed: Packed, models: DataFrame, fields: list[str]) -> DataFrame:
    """Packed chunks with the models of their series as one array per row.

    The models of a series are few (a centre and its vertices, or the candidates
    of a search round), so a chunk's values travel once for all of them.
    """
    together = models.groupBy(*packed.keys).agg(F.collect_list(F.struct(*fields)).alias("models"))
    if packed.long:
        return attach(packed.frame, together, packed.keys, spread="chunk")
    return packed.frame.join(together, packed.keys)


def as_array(v) -> np.ndarray:
    return np.asarray(v if v is not None else [], dtype=float)


# Rows that a task works on at a time: what it makes of them takes many times the memory of the rows themselves.
PORTION_ROWS = 256


def portions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same rows in order, a bounded number at a time."""
    for pdf in batches:
        for at in range(0, len(pdf), PORTION_ROWS):
            yield pdf.iloc[at : at + PORTION_ROWS]


def by_order(work: list, order: Callable) -> Iterator[tuple[object, list]]:
    """Group work items of one batch by order and similar length."""
    groups: dict = {}
    for item in work:
        groups.setdefault(order(item), []).append(item)
    yield from groups.items()


def _levels_of(m, row):
    """Values before, own values and position of a chunk for a model, and its entry residuals."""
    p, q, d = len(m["phi"]), len(m["theta"]), int(m["d"])
    halo, vals, first = as_array(row.halo), as_array(row.vals), int(row.first)
    state = m["state"] if "state" in _names(m) else None
    if state is None:
        before, own, pos = K.differenced(halo, vals, first, d)
        return before, own, pos, np.zeros(q), None
    if first == 0:
        levels = as_array(state["diff_buf"])[: int(state["n_diff"])]
        levels = levels[len(levels) - min(d, len(levels)) :]
        own = np.diff(np.concatenate([levels, vals]), d) if d else vals
        before = as_array(state["y_lags"])[::-1]
        pos = int(state["t"])
        age = pos - 1 - np.arange(q)
        entry = np.where(age >= max(p, q), as_array(state["e_lags"]), 0.0)
        return before, own, pos, entry, state
    before, own, pos = K.differenced(halo, vals, first, d)
    warm = min(d, int(state["n_diff"]))
    return before, own, int(state["t"]) + pos + warm, np.zeros(q), state


def _names(m):
    return m.keys() if isinstance(m, dict) else m.__fields__


def _params(chunk_models):
    phi = np.array([as_array(m["phi"]) for m in chunk_models]).reshape(len(chunk_models), -1)
    theta = np.array([as_array(m["theta"]) for m in chunk_models]).reshape(len(chunk_models), -1)
    c = np.array([float(m["c"]) for m in chunk_models])
    return phi, theta, c


def _work(pdf: pd.DataFrame):
    out = []
    for row in pdf.itertuples(index=False):
        for m in row.models:
            before, own, pos, entry, state = _levels_of(m, row)
            if "entry" in _names(m) and m["entry"] is not None:
                entry = as_array(m["entry"])
            out.append((row, m, before, own, pos, entry, state))
    return out


def _order(item):
    m, own = item[1], item[3]
    return len(m["phi"]), len(m["theta"]), K.length_class(len(own))


def _evaluate(items, p, q, skip=None):
    batch = K.Batch([(i[2], i[3], i[4]) for i in items], p, q, skip)
    phi, theta, c = _params([i[1] for i in items])
    entry = np.array([i[5] for i in items]).reshape(len(items), q)
    return batch, batch.residuals(phi, theta, c, entry), entry


# -- states -------------------------------------------------------------------


def _state_after(item, e: np.ndarray, last: bool) -> tuple:
    """State fields after the own values of one chunk."""
    row, m, before, own, pos, entry, state = item
    phi, p, q, d = as_array(m["phi"]), len(m["phi"]), len(m["theta"]), int(m["d"])
    e = e[: len(own)]
    with np.errstate(all="ignore"):
        css = float(np.sum(e * e))
    skip = max(p, q)
    if pos < skip and q:
        # residuals of rows that do not count stay in the lags, without a moving-average part
        e = e.copy()
        joined = np.concatenate([np.zeros(p), before[max(0, len(before) - p) :], own])
        for i in range(min(skip - pos, len(own))):
            at = len(joined) - len(own) + i
            e[i] = joined[at] - float(m["c"]) - float(phi @ joined[at - p : at][::-1] if p else 0.0)
    start_css = 0.0
    old_e = entry[::-1]
    y_before = before
    levels = np.concatenate([as_array(row.halo), as_array(row.vals)])
    n_diff = int(row.first) + len(row.vals)
    if state is not None:
        start_css = float(state["css"]) if int(row.first) == 0 else 0.0
        if int(row.first) == 0:
            old_e = as_array(state["e_lags"])[::-1]
            levels = np.concatenate([as_array(state["diff_buf"])[: int(state["n_diff"])], levels])
        n_diff += int(state["n_diff"])
    css = start_css + css
    y_all = np.concatenate([np.zeros(p), y_before, own])
    e_all = np.concatenate([old_e, e])
    held = min(n_diff, d + 1) if d else 0
    buf = np.zeros(d + 1 if d else 0)
    if held:
        buf[:held] = levels[len(levels) - held :]
    return (
        pos + len(own),
        p,
        q,
        y_all[len(y_all) - p :][::-1].tolist(),
        np.nan_to_num(e_all[len(e_all) - q :][::-1], posinf=0.0, neginf=0.0).tolist(),
        css if np.isfinite(css) else float("inf"),
        d,
        held,
        buf.tolist(),
    )


def fold_states(packed: Packed, models: DataFrame, ids: list[str], carry: Sequence[str] = (), ends: bool = False) -> DataFrame:
    """State of every model after the packed values of its series.

    ``models`` has the keys, the ``ids``, phi, theta, c, d and, when the values
    continue an earlier history, ``state``.  Returns keys, ids and ``state``, and
    beside them the columns ``carry`` of the models and, with ``ends``, last_ts of the series.
    """
    fields = [*ids, "phi", "theta", "c", "d", *(["state"] if "state" in models.columns else [])]
    keys, carry = packed.keys, list(carry)
    if not packed.long:
        own = [*keys, *(["last_ts"] if ends else [])]
        if packed.tasks and keys:  # a broadcast of the series would leave the tasks to the bytes of the models
            models = models.repartition(packed.tasks, *keys)
        chunks = with_models(packed, models, list(dict.fromkeys([*fields, *carry])))
        named = [*ids, *carry]

        def whole(batches):
            for batch in batches:
                yield from fold_rows(batch, own, named)

        schema = f"{ddl(packed.frame, own)}, {_ids_ddl(models, named)}state {STATE_TYPE}"
        return chunks.select(*own, "vals", "models").mapInArrow(whole, schema).select(*keys, *named, "state", *own[len(keys) :])

    entering = _chained(packed, models, ids, fields)
    chunks = packed.frame.join(entering, [*keys, "chunk"])
    names = [*keys, "chunk", *ids, *STATE_NAMES]

    def run(batches):
        for pdf in portions(batches):
            rows = []
            for (p, q, _), items in by_order(_work(pdf), _order):
                _, e, _ = _evaluate(items, p, q)
                for item, e_i in zip(items, e):
                    after = _state_after(item, e_i, True)
                    rows.append(
                        (*[getattr(item[0], k) for k in keys], item[0].chunk, *[item[1][i] for i in ids], *after)
                    )
            yield pd.DataFrame(rows, columns=names)

    schema = f"{ddl(packed.frame, [*keys, 'chunk'])}, {_ids_ddl(models, ids)}{STATE_FIELDS}"
    per_chunk = chunks.select(*keys, "chunk", "first", "halo", "vals", "models").mapInPandas(run, schema)
    last = F.max_by(F.struct(*[n for n in STATE_NAMES if n != "css"]), "chunk").alias("s")
    merged = per_chunk.groupBy(*keys, *ids).agg(last, F.sum("css").alias("css"))
    out = merged.select(
        *keys, *ids, F.struct(*["css" if n == "css" else f"s.{n}" for n in STATE_NAMES]).alias("state")
    )
    if carry:
        out = out.join(models.select(*keys, *ids, *carry), [*keys, *ids]).select(*keys, *ids, *carry, "state")
    if ends:
        out = out.join(packed.frame.groupBy(*keys).agg(F.max("last_ts").alias("last_ts")), keys)
    return out


def _ids_ddl(models: DataFrame, ids: list[str]) -> str:
    return ddl(models, ids) + ", " if ids else ""


def _skip(p: int, q: int, warmup: str) -> int:
    """Rows at the start of a series that do not count."""
    return {"skip": max(p, q), "early": max(0, max(p, q) - 1), "none": 0}[warmup]


def _counted_from(work: list, warmup: str) -> list:
    """Work items of a variant: without warm-up a series starts from levels of zero, and its differences are as long as it."""
    if warmup != "none":
        return work
    out = []
    for row, m, before, own, pos, entry, state in work:
        d, first = int(m["d"]), int(row.first)
        if first == 0:
            own = np.diff(np.concatenate([np.zeros(d), as_array(row.vals)]), d) if d else own
        out.append((row, m, before, own, first, entry, state))
    return out


def _chained(packed: Packed, models: DataFrame, ids: list[str], fields: list[str], warmup: str = "skip") -> DataFrame:
    """Per chunk, its models with the exact residuals before the chunk as ``entry``.

    What a chunk makes of the residuals before it is an affine map: its ends from zero, and a matrix for the rest.
    """
    keys = packed.keys
    names = [*keys, "chunk", *ids, "n_counted", "ends"]

    def ends(batches):
        for pdf in portions(batches):
            rows = []
            for (p, q, _), items in by_order(_counted_from(_work(pdf), warmup), _order):
                batch, e, entry = _evaluate(items, p, q, _skip(p, q, warmup))
                last = batch.newest(e, entry)
                for item, end, counts in zip(items, last, batch.counts):
                    rows.append(
                        (
                            *[getattr(item[0], k) for k in keys],
                            item[0].chunk,
                            *[item[1][i] for i in ids],
                            int(counts.sum()),
                            end.tolist(),
                        )
                    )
            yield pd.DataFrame(rows, columns=names)

    schema = f"{ddl(packed.frame, [*keys, 'chunk'])}, {_ids_ddl(models, ids)}n_counted long, ends array<double>"
    chunks = with_models(packed, models, fields)
    reported = chunks.select(*keys, "chunk", "first", "halo", "vals", "models").mapInPandas(ends, schema)
    joined = reported.join(models, [*keys, *ids])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        theta = as_array(pdf["theta"].iloc[0])
        state, out, known = np.zeros(len(theta)), [], {}
        for chunk, n, end in zip(pdf["chunk"], pdf["n_counted"], pdf["ends"]):
            out.append(None if chunk == 0 else state.tolist())
            if n not in known:
                known[n] = K.transfer(theta, 0, False, int(n), False)
            with np.errstate(all="ignore"):
                carried = known[n] @ state if chunk else 0.0
            state = as_array(end) + carried
        return pdf.assign(entry=out)[[*keys, "chunk", *ids, "entry"]]

    schema = f"{ddl(reported, [*keys, 'chunk'])}, {_ids_ddl(models, ids)}entry array<double>"
    entries = joined.select(*keys, "chunk", *ids, "n_counted", "ends", "theta").groupBy(*keys, *ids)
    entering = entries.applyInPandas(chain, schema).join(models, [*keys, *ids])
    return entering.groupBy(*keys, "chunk").agg(
        F.collect_list(F.struct(*fields, "entry")).alias("models")
    )


def css_full_table(packed: Packed, phi, theta, c=0.0, d=0) -> DataFrame:
    """State after the whole history, the same parameters for every series."""
    return fold_states(packed, one_model(packed, phi, theta, c, d), [])


# -- losses and residuals -----------------------------------------------------

# rows that count: all after max(p, q), one row earlier, or every row
WARMUPS = ("skip", "early", "none")


def residual_arrays(packed: Packed, models: DataFrame, ids: list[str], warmup: str = "skip") -> DataFrame:
    """Per chunk the residuals of its own rows: keys, chunk, ids, pos0, e."""
    if warmup not in WARMUPS:
        raise ValueError(f"unknown warmup {warmup}")
    keys = packed.keys
    fields = [*ids, "phi", "theta", "c", "d"]
    if packed.long:
        chunks = packed.frame.join(_chained(packed, models, ids, fields, warmup), [*keys, "chunk"])
    else:
        chunks = with_models(packed, models, fields)
    names = [*keys, "chunk", *ids, "pos0", "skip", "e"]

    def run(batches):
        for pdf in portions(batches):
            rows = []
            for (p, q, _), items in by_order(_counted_from(_work(pdf), warmup), _order):
                skip = _skip(p, q, warmup)
                _, e, _ = _evaluate(items, p, q, skip)
                for item, e_i in zip(items, e):
                    rows.append(
                        (
                            *[getattr(item[0], k) for k in keys],
                            item[0].chunk,
                            *[item[1][i] for i in ids],
                            item[4],
                            skip,
                            e_i[: len(item[3])].tolist(),
                        )
                    )
            yield pd.DataFrame(rows, columns=names)

    schema = (
        f"{ddl(packed.frame, [*keys, 'chunk'])}, {_ids_ddl(models, ids)}pos0 long, skip int, e array<double>"
    )
    return chunks.select(*keys, "chunk", "first", "halo", "vals", "models").mapInPandas(run, schema)


def css_losses(packed: Packed, models: DataFrame, ids: list[str] = (), warmup: str = "skip") -> DataFrame:
    """Loss of every (series, model): keys, ids, css."""
    ids = list(ids)
    per_chunk = residual_arrays(packed, models, ids, warmup)
    squares = F.aggregate("e", F.lit(0.0), lambda s, x: s + F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x * x))
    return per_chunk.groupBy(*packed.keys, *ids).agg(F.sum(squares).alias("css"))


def css_loss(packed: Packed, phi, theta, c=0.0, d=0, warmup: str = "skip") -> DataFrame:
    return css_losses(packed, one_model(packed, phi, theta, c, d), [], warmup)


def residuals(packed: Packed, models: DataFrame, ids: list[str] = ()) -> DataFrame:
    """Residuals in long form: keys, ids, pos (in the differenced series), e; rows that count only."""
    ids = list(ids)
    per_chunk = residual_arrays(packed, models, ids)
    rows = per_chunk.select(*packed.keys, *ids, "pos0", "skip", F.posexplode("e").alias("i", "e"))
    rows = rows.select(*packed.keys, *ids, (F.col("pos0") + F.col("i")).alias("pos"), "skip", "e")
    return rows.where(F.col("pos") >= F.col("skip")).drop("skip")


def running_css(packed: Packed, models: DataFrame, ids: list[str] = ()) -> DataFrame:
    """The loss after every row: keys, ids, pos, css."""
    ids = list(ids)
    keys = packed.keys
    per_chunk = residual_arrays(packed, models, ids)
    exploded = per_chunk.select(*keys, *ids, "chunk", "pos0", F.posexplode("e").alias("i", "e"))
    w = Window.partitionBy(*keys, *ids, "chunk").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    inside = exploded.withColumn("css", F.sum(F.col("e") * F.col("e")).over(w))
    inside = inside.select(*keys, *ids, "chunk", (F.col("pos0") + F.col("i")).alias("pos"), "css")
    if not packed.long:
        return inside.drop("chunk")
    square = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    before = Window.partitionBy(*keys, *ids).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = per_chunk.select(*keys, *ids, "chunk", square.alias("sq"))
    offsets = totals.withColumn("off", F.coalesce(F.sum("sq").over(before), F.lit(0.0))).drop("sq")
    joined = inside.join(offsets, [*keys, *ids, "chunk"])
    return joined.select(*keys, *ids, "pos", (F.col("css") + F.col("off")).alias("css"))


# -- gradients ----------------------------------------------------------------

GRAD_FIELDS = "css double, grad array<double>, gram array<double>"


def loss_and_gradient(packed: Packed, points: DataFrame, ids: list[str]) -> DataFrame:
    """Loss, gradient and Gauss-Newton matrix (row-major) at given parameters.

    ``points`` has keys, ids, p, d, q, constant and x (phi, theta and c).
    """
    keys = packed.keys
    fields = list(dict.fromkeys([*ids, "p", "d", "q", "constant", "x"]))
    if packed.long:
        chunks = packed.frame.join(_chained_slopes(packed, points, ids, fields), [*keys, "chunk"])
    else:
        chunks = with_models(packed, points, fields)
    names = [*keys, *ids, "css", "grad", "gram"]

    def run(batches):
        for pdf in portions(batches):
            rows = []
            for (p, q, const, _), items in by_order(_point_work(pdf), _point_order):
                css, grad, gram, _, _ = _point_sums(items, p, q, const)
                for item, a, b, m in zip(items, css, grad, gram):
                    rows.append(
                        (
                            *[getattr(item[0], k) for k in keys],
                            *[item[1][i] for i in ids],
                            float(a),
                            b.tolist(),
                            m.ravel().tolist(),
                        )
                    )
            yield pd.DataFrame(rows, columns=names)

    schema = f"{ddl(packed.frame, keys)}, {_ids_ddl(points, ids)}{GRAD_FIELDS}"
    per_chunk = chunks.select(*keys, "chunk", "first", "halo", "vals", "models").mapInPandas(run, schema)
    if not packed.long:
        return per_chunk
    return sum_arrays(per_chunk, [*keys, *ids], "css", ["grad", "gram"])


def sum_arrays(df: DataFrame, keys: list[str], scalar: str, arrays: list[str]) -> DataFrame:
    """Element-wise sums of small arrays per group, added up before the shuffle."""
    together = F.concat(F.array(scalar), *arrays)
    parts = df.select(*keys, F.size(arrays[0]).alias("__k"), F.posexplode(together).alias("__i", "__v"))
    summed = parts.groupBy(*keys, "__k", "__i").agg(F.sum("__v").alias("__v"))
    back = summed.groupBy(*keys, "__k").agg(F.array_sort(F.collect_list(F.struct("__i", "__v"))).alias("__a"))
    values = F.transform("__a", lambda x: x["__v"])
    k = F.col("__k")
    return back.select(
        *keys,
        values[0].alias(scalar),
        F.slice(values, F.lit(2), k).alias(arrays[0]),
        F.slice(values, k + 2, k * k).alias(arrays[1]),
    )


def _point_work(pdf):
    out = []
    for row in pdf.itertuples(index=False):
        halo, vals, first = as_array(row.halo), as_array(row.vals), int(row.first)
        by_d = {}
        for m in row.models:
            d = int(m["d"])
            if d not in by_d:
                by_d[d] = K.differenced(halo, vals, first, d)
            out.append((row, m, *by_d[d]))
    return out


def _point_order(item):
    m, own = item[1], item[3]
    return int(m["p"]), int(m["q"]), bool(m["constant"]), K.length_class(len(own))


def _point_sums(items, p, q, const):
    batch = K.Batch([(i[2], i[3], i[4]) for i in items], p, q)
    k = p + q + int(const)
    x = np.array([as_array(i[1]["x"]) for i in items]).reshape(len(items), k)
    entry = slopes = None
    if "entry" in _names(items[0][1]):
        z = np.array(
            [as_array(i[1]["entry"]) if i[1]["entry"] is not None else np.zeros(q * (1 + k)) for i in items]
        ).reshape(len(items), q * (1 + k))
        entry, slopes = z[:, :q], z[:, q:].reshape(len(items), k, q)
    return batch.sums(x, const, entry, slopes)


def _chained_slopes(packed: Packed, points: DataFrame, ids: list[str], fields: list[str]) -> DataFrame:
    """Per chunk, its points with residuals and derivatives before the chunk as ``entry``."""
    keys = packed.keys
    names = [*keys, "chunk", *ids, "n_counted", "ends"]

    def ends(batches):
        for pdf in portions(batches):
            rows = []
            for (p, q, const, _), items in by_order(_point_work(pdf), _point_order):
                _, _, _, e_end, d_end = _point_sums(items, p, q, const)
                for item, a, b in zip(items, e_end, d_end):
                    n = len(item[3]) - max(0, max(p, q) - item[4])
                    rows.append(
                        (
                            *[getattr(item[0], k) for k in keys],
                            item[0].chunk,
                            *[item[1][i] for i in ids],
                            n,
                            np.concatenate([a, b.ravel()]).tolist(),
                        )
                    )
            yield pd.DataFrame(rows, columns=names)

    schema = f"{ddl(packed.frame, [*keys, 'chunk'])}, {_ids_ddl(points, ids)}n_counted long, ends array<double>"
    chunks = with_models(packed, points, fields)
    reported = chunks.select(*keys, "chunk", "first", "halo", "vals", "models").mapInPandas(ends, schema)
    joined = reported.join(points, [*keys, *ids])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        head = pdf.iloc[0]
        p, q, const = int(head["p"]), int(head["q"]), bool(head["constant"])
        theta = as_array(head["x"])[p : p + q]
        state, out, known = np.zeros(len(head["ends"])), [], {}
        for chunk, n, end in zip(pdf["chunk"], pdf["n_counted"], pdf["ends"]):
            out.append(state.tolist())
            if n not in known:
                known[n] = K.transfer(theta, p, const, int(n), True)
            with np.errstate(all="ignore"):
                state = as_array(end) + (known[n] @ state if q else 0.0)
        return pdf.assign(entry=out)[[*keys, "chunk", *ids, "entry"]]

    schema = f"{ddl(reported, [*keys, 'chunk'])}, {_ids_ddl(points, ids)}entry array<double>"
    needed = list(dict.fromkeys([*keys, "chunk", *ids, "n_counted", "ends", "p", "q", "constant", "x"]))
    entries = joined.select(*needed).groupBy(*keys, *ids).applyInPandas(chain, schema)
    entering = entries.join(points, [*keys, *ids])
    return entering.groupBy(*keys, "chunk").agg(F.collect_list(F.struct(*fields, "entry")).alias("models"))
