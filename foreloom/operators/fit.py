"""Fitting by least conditional sum of squares, and the automatic order search."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreloom.functions import criteria
from foreloom.functions.scalars import log10p1
from foreloom.operators import kernel as K
from foreloom.operators import search as S
from foreloom.operators.css import (
    GRAD_FIELDS,
    as_array,
    by_order,
    ddl,
    fold_states,
    loss_and_gradient,
    portions,
    with_models,
)
from foreloom.operators.stats import (
    _difference_means,
    choose_d,
    kpss_halo,
    log_rule,
    series_stats,
)
from foreloom.plans import ordered as O
from foreloom.plans.joins import attach
from foreloom.plans.packed import Packed, pack
from foreloom.session import cut

# Names of the search methods.  Gradient-based names share one search by slopes,
# derivative-free names share the simplex search; both move in theta alone and
# solve for the rest, and both end by their rules (``foreloom.operators.search``).
GRADIENT_METHODS = ("L-BFGS", "SLSQP", "MMA")
SIMPLEX_METHODS = ("Nelder-Mead", "Subplex")

FIT_FIELDS = "phi array<double>, theta array<double>, c double, residuals array<double>, css double, converged boolean"
FIT_NAMES = [f.split()[0] for f in FIT_FIELDS.split(", ")]


def fit_candidates(
    packed: Packed, candidates: DataFrame, ids: Sequence[str] = (), method: str = "L-BFGS", silent: bool = True
) -> DataFrame:
    """Fit every (series, candidate): keys, ids, p, d, q, constant and the fit result.

    ``candidates`` has keys, ids, p, d, q and constant.  A candidate that cannot
    be fitted has an infinite loss, or raises when ``silent`` is off.  ``converged``
    says that the search ended by its rule; no number of rounds ends one, so that it is
    false for a failed fit only.
    """
    if method not in (*GRADIENT_METHODS, *SIMPLEX_METHODS):
        raise ValueError(f"{method} is none of the search methods {(*GRADIENT_METHODS, *SIMPLEX_METHODS)}")
    ids = list(ids)
    wanted = candidates.select(*packed.keys, *ids, "p", "d", "q", "constant")
    if packed.long and packed.keys:
        # by length: one long series must not change how the others are fitted
        one = F.col("n_total") == F.size("vals")
        brief, rest = packed.frame.where(one), packed.frame.where(~one)
        of_rest = wanted.join(rest.where("chunk = 0").select(*packed.keys), packed.keys, "left_semi")
        short = fit_candidates(Packed(brief, packed.keys, False), wanted, ids, method, silent)
        return short.unionByName(_fit_long(Packed(rest, packed.keys, True), of_rest, ids, method, silent).select(*short.columns))
    if packed.long:
        return _fit_long(packed, wanted, ids, method, silent)
    keys, fields = packed.keys, [*ids, "p", "d", "q", "constant"]
    names = [*keys, *fields, *FIT_NAMES]

    def run(batches):
        for pdf in portions(batches):
            rows, work = [], []
            for row in pdf.itertuples(index=False):
                vals = as_array(row.vals)
                own_by_d = {}
                for m in row.models:
                    d = int(m["d"])
                    K.check_order(int(m["p"]), d, int(m["q"]))
                    if d not in own_by_d:
                        own_by_d[d] = np.diff(vals, d) if d else vals
                    work.append((row, m, own_by_d[d]))
            for (p, q, const, _), items in by_order(work, _fit_order):
                chunks = [(i[2][:0], i[2], 0) for i in items]
                batch = K.Batch(chunks, p, q)
                mean = np.array([i[2].mean() if len(i[2]) else 0.0 for i in items])
                x, css, ended = S.fit(batch, mean, const, S.descend if method in GRADIENT_METHODS else S.simplex)
                c = x[:, -1] if const else np.zeros(len(items))
                last = batch.newest(batch.residuals(x[:, :p], x[:, p : p + q], c), np.zeros((len(items), q)))
                counted = batch.counts.sum(axis=1)
                for i, item in enumerate(items):
                    ok = counted[i] > 0 and np.isfinite(css[i])
                    if not ok and not silent:
                        raise ValueError(f"failed to fit ARMA({p}, {q}): no finite loss")
                    result = (
                        (x[i, :p].tolist(), x[i, p : p + q].tolist(), float(c[i]), last[i].tolist(), float(css[i]), bool(ended[i]))
                        if ok
                        else ([], [], 0.0, [], float("inf"), False)
                    )
                    rows.append(
                        (*[getattr(item[0], k) for k in keys], *[item[1][f] for f in fields], *result)
                    )
            yield pd.DataFrame(rows, columns=names)

    schema = f"{ddl(packed.frame, keys) + ', ' if keys else ''}{ddl(wanted, fields)}, {FIT_FIELDS}"
    if keys:
        frame = with_models(packed, wanted, fields)
    else:
        together = wanted.agg(F.collect_list(F.struct(*fields)).alias("models"))
        frame = packed.frame.withColumn("models", together.scalar())
    return frame.select(*keys, "vals", "models").mapInPandas(run, schema)


def _fit_long(packed: Packed, candidates: DataFrame, ids: list[str], method: str, silent: bool) -> DataFrame:
    """Fits of series of many chunks, failed ones recorded as those of short series are."""
    over_chunks = _slopes_over_chunks if method in GRADIENT_METHODS else _simplex_over_chunks
    packed = packed.persist()
    fits = over_chunks(packed, candidates, ids)
    packed.frame.unpersist()
    good = F.col("css").isNotNull() & ~F.isnan("css") & (F.col("css") < float("inf"))
    if not silent and not fits.where(~good).isEmpty():
        raise ValueError("failed to fit: no finite loss")
    none = {"c": F.lit(0.0), "css": F.lit(float("inf")), "converged": F.lit(False)}
    none = {n: none.get(n, F.array().cast("array<double>")) for n in FIT_NAMES}
    return fits.select(*[c for c in fits.columns if c not in none], *[F.when(good, F.col(n)).otherwise(v).alias(n) for n, v in none.items()])


def _fit_order(item):
    m = item[1]
    return int(m["p"]), int(m["q"]), bool(m["constant"]), K.length_class(len(item[2]))


# The regression start of a long series comes from this many of its rows.
PILOT_ROWS = 20_000


def _starts(packed: Packed, candidates: DataFrame, every: list[str], ids: list[str]) -> DataFrame:
    """The starts that are followed, those of a short series: (every, start, theta, x, height, low, high, n).

    The fixed start, and those of a regression start and fixed ones that are followed, all of them scored in one pass
    over the chunks.
    """
    keys = packed.keys
    means = _difference_means(packed, (0, 1, 2))
    first = packed.frame.where("chunk = 0").select(*keys, "n_total", F.slice("vals", 1, PILOT_ROWS).alias("vals"))
    known = means.join(first, keys) if keys else means.crossJoin(first)
    all_of = [*every, "number", "theta", "low", "high", "n"]

    def begin(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                p, d, q, const = int(row.p), int(row.d), int(row.q), bool(row.constant)
                K.check_order(p, d, q)
                x, low, high = K.bounds(np.array([as_array(row.means)[d]]), p, q, const)
                vals = as_array(row.vals)
                own = np.diff(vals, d) if d else vals
                choice = [x[0, p : p + q]]
                if q:
                    choice += [S.regression_starts(K.Batch([(own[:0], own, 0)], p, q))[0], *S.root_starts(q)]
                head = [getattr(row, c) for c in every]
                rows += [(*head, i, v.tolist(), low[0].tolist(), high[0].tolist(), row.n_total - d) for i, v in enumerate(choice)]
            yield pd.DataFrame(rows, columns=all_of)

    schema = f"{ddl(candidates, every)}, number int, theta array<double>, low array<double>, high array<double>, n long"
    start = attach(candidates, known, keys, spread="p").select(*every, "means", "vals", "n_total")
    asked = cut(start.mapInPandas(begin, schema))
    scored = cut(asked.join(_heights(packed, asked, every, ids), [*every, "number"]))
    starts = F.array_sort(F.collect_list(F.struct("number", "theta", "height")))
    of = scored.groupBy(*every).agg(starts.alias("starts"))

    def choose(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                head = [getattr(row, c) for c in every]
                others = row.starts[1:]
                best = S.followed(np.array([as_array(r["theta"]) for r in others]), np.array([r["height"] for r in others])) if len(others) else []
                rows += [(*head, int(i)) for i in (0, *[others[j]["number"] for j in best])]
            yield pd.DataFrame(rows, columns=[*every, "number"])

    wanted = of.mapInPandas(choose, f"{ddl(candidates, every)}, number int")
    return cut(scored.join(wanted, [*every, "number"]).withColumnRenamed("number", "start"))


def _with_residuals(packed: Packed, ends: DataFrame, every: list[str], ids: list[str]) -> DataFrame:
    """The lowest end (every, start, x, css) of every search as a model, with its newest residuals."""
    solved = ends.groupBy(*every).agg(F.min_by(F.struct("x", "css"), F.struct("css", "start")).alias("e")).select(*every, "e.*")
    models = cut(
        solved.select(
            *every,
            F.slice("x", F.lit(1), F.col("p")).alias("phi"),
            F.slice("x", F.col("p") + 1, F.col("q")).alias("theta"),
            F.when(F.col("constant"), F.element_at("x", -1)).otherwise(0.0).alias("c"),
            "css",
            (F.col("css") < float("inf")).alias("converged"),
            F.concat_ws("/", "p", "q", "constant").alias("candidate"),
        )
    )
    states = fold_states(packed, models, [*ids, "candidate"])
    return cut(
        models.join(states, [*packed.keys, *ids, "candidate"]).select(
            *every, "phi", "theta", "c", F.col("state.e_lags").alias("residuals"),
            F.when(F.col("css") < float("inf"), F.col("state.css")).otherwise(F.col("css")).alias("css"), "converged",
        )
    )


def _slopes_over_chunks(packed: Packed, candidates: DataFrame, ids: list[str]) -> DataFrame:
    """The search by slopes of ``foreloom.operators.search`` over series of many chunks.

    The state of a search (a few numbers per series, candidate and start) is a row of a DataFrame that is written each
    turn: one pass over the chunks gives slopes and curvature where a search stands, one the loss at its trial.  The
    driver only asks whether searches go on.  The curvature is that of the residuals' slopes, the part of the linear
    parameters taken out.
    """
    every = [*packed.keys, *ids, "p", "d", "q", "constant"]
    own = [*every, "start"]
    base = ddl(candidates, every) + ", start int"
    place = "theta array<double>, x array<double>, css double, low array<double>, high array<double>, n long, radius double"
    place_names = [f.split()[0] for f in place.split(", ")]

    def propose(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                p, q, const = int(row.p), int(row.q), bool(row.constant)
                x, low, high = as_array(row.x), as_array(row.low), as_array(row.high)
                k = len(x)
                gram, slope = as_array(row.gram).reshape(k, k), as_array(row.grad)[p : p + q]
                z = [i for i in [*range(p), *([p + q] if const else [])] if low[i] < x[i] < high[i]]
                t = list(range(p, p + q))
                cross = gram[np.ix_(t, z)]
                curve = 2 * (gram[np.ix_(t, t)] - cross @ np.linalg.pinv(gram[np.ix_(z, z)]) @ cross.T)
                theta = as_array(row.theta)
                good = np.isfinite(curve).all() and np.isfinite(slope).all()
                step, foreseen, rest = (
                    (v[0] for v in S.trust_step(theta[None], slope[None], curve[None], np.array([row.radius]), K.COEF_BOUND))
                    if good else (np.zeros(q), 0.0, 0.0)
                )
                trial = np.clip(theta + step, -K.COEF_BOUND, K.COEF_BOUND)
                rows.append((*[getattr(row, c) for c in [*own, *place_names]], float(foreseen), float(rest), trial.tolist()))
            yield pd.DataFrame(rows, columns=[*own, *place_names, "foreseen", "rest", "trial"])

    def decide(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                size = float(np.abs(as_array(row.trial) - as_array(row.theta)).max(initial=0.0))
                kept, radius, done = S.settled(row.css, row.height, row.foreseen, row.rest, size, row.radius)
                theta, x, css = (row.trial, row.found, row.height) if kept else (row.theta, row.x, row.css)
                rows.append((*[getattr(row, c) for c in own], theta, x, css, row.low, row.high, row.n, radius, done))
            yield pd.DataFrame(rows, columns=[*own, *place_names, "done"])

    started = _starts(packed, candidates, every, ids).withColumn("radius", F.lit(S.RADIUS)).withColumnRenamed("height", "css")
    over = started.where("q = 0 OR css = double('inf')").select(*own, "x", "css")
    active = started.where("q > 0 AND css < double('inf')").select(*own, *place_names)
    while not active.isEmpty():
        here = loss_and_gradient(packed, active.select(*own, "x"), [*ids, "start", "p", "d", "q", "constant"]).drop("css")
        proposed = cut(active.join(here, own).mapInPandas(propose, f"{base}, {place}, foreseen double, rest double, trial array<double>"))
        asked = proposed.select(*own, F.col("trial").alias("theta"), "low", "high", "n", F.col("start").alias("number"))
        found = _heights(packed, asked, own, [*ids, "start"]).select(*own, "height", F.col("x").alias("found"))
        moved = cut(proposed.join(found, own).mapInPandas(decide, f"{base}, {place}, done boolean"))
        over = over.unionByName(moved.where("done").select(*own, "x", "css"))
        active = moved.where("not done").drop("done")
    return _with_residuals(packed, over, every, ids)


def _heights(packed: Packed, thetas: DataFrame, every: list[str], ids: list[str]) -> DataFrame:
    """The loss at each theta of ``thetas`` (every, number, theta, low, high, n) with the linear part solved for:
    every, number, height, x.  All points of all searches take one pass over the chunks.

    At parameters (0, theta, 0) the loss is a square in the linear ones, whose terms the chunks add up.
    """
    zeros = F.array_repeat(F.lit(0.0), F.col("p"))
    tail = F.when(F.col("constant"), F.array(F.lit(0.0))).otherwise(F.array().cast("array<double>"))
    points = thetas.withColumn("x", F.concat(zeros, "theta", tail))
    fields = ["number", "p", "d", "q", "constant"]
    sums = loss_and_gradient(packed, points.select(*every, "number", "x"), [*ids, *fields])
    met = points.select(*every, "number", "theta", "low", "high", "n").join(sums, [*every, "number"])
    names = [*every, "number", "height", "x"]

    def solve(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                p, q, const = int(row.p), int(row.q), bool(row.constant)
                theta, k = as_array(row.theta), p + q + const
                at = [*range(p), *([p + q] if const else [])]
                x, height = np.zeros(k), np.inf
                if np.isfinite(row.css) and S.computable(theta, int(row.n)):
                    gram = as_array(row.gram).reshape(k, k)[np.ix_(at, at)]
                    low, high = as_array(row.low)[at], as_array(row.high)[at]
                    height, x[at] = S.least_of_square(float(row.css), as_array(row.grad)[at], gram, low, high)
                    x[p : p + q] = theta
                rows.append((*[getattr(row, c) for c in every], row.number, height, x.tolist()))
            yield pd.DataFrame(rows, columns=names)

    return met.mapInPandas(solve, f"{ddl(thetas, [*every, 'number'])}, height double, x array<double>")


def _simplex_over_chunks(packed: Packed, candidates: DataFrame, ids: list[str]) -> DataFrame:
    """The simplex search of ``foreloom.operators.search`` over series of many chunks.

    A turn evaluates every point that any simplex may need in one pass over the chunks.  The simplexes are rows of a
    DataFrame that is written each turn; the driver only asks whether any is left.
    """
    searched = [*packed.keys, *ids, "p", "d", "q", "constant"]
    every = [*searched, "start"]
    base = ddl(candidates, searched) + ", start int"
    started = _starts(packed, candidates, searched, ids)
    kept = [*every, "low", "high", "n", "points", "heights", "before", "fresh"]
    kinds = "low array<double>, high array<double>, n long, points array<array<double>>, heights array<double>, before double, fresh boolean"

    def asked(batches):
        """The points to evaluate: corners of simplexes that are new, else what a turn may need."""
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                points = np.array([as_array(v) for v in row.points])
                wanted = points if row.fresh else S.proposals(points[None])[0]
                head = [getattr(row, c) for c in every]
                rows += [(*head, i, v.tolist(), row.low, row.high, row.n) for i, v in enumerate(wanted)]
            yield pd.DataFrame(rows, columns=[*every, "number", "theta", "low", "high", "n"])

    def turned(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                points = np.array([as_array(v) for v in row.points])[None]
                heights = np.array([r["height"] for r in sorted(row.found, key=lambda r: r["number"])])[None]
                before, done = row.before, False
                if row.fresh:
                    points, values = S.ranked(points, heights)
                    done = not np.isfinite(values[0, 0])
                    fresh = False
                else:
                    points, values = S.turn(points, as_array(row.heights)[None], S.proposals(points), heights)
                    fresh = bool(S.together(points)[0])
                    if fresh:
                        done = bool(np.isfinite(before)) and not values[0, 0] < before * (1 - S.AGAIN_REL)
                        before = float(values[0, 0])
                best = points[0, 0].tolist()
                if fresh and not done:
                    points = S.corners(points[:, 0], S.STEP_AGAIN)
                head = [getattr(row, c) for c in every]
                rows.append(
                    (*head, row.low, row.high, row.n, [v.tolist() for v in points[0]], values[0].tolist(), before, fresh, best, done)
                )
            yield pd.DataFrame(rows, columns=[*kept, "best", "done"])

    def first(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                theta = as_array(row.theta)
                points = S.corners(theta[None], S.STEP)[0] if len(theta) else np.zeros((1, 0))
                head = [getattr(row, c) for c in every]
                rows.append((*head, row.low, row.high, row.n, [v.tolist() for v in points], [], float("inf"), True))
            yield pd.DataFrame(rows, columns=kept)

    active = started.where("q > 0").select(*every, "theta", "low", "high", "n").mapInPandas(first, f"{base}, {kinds}")
    over = started.select(*every, "theta", "low", "high", "n").where("q = 0")
    while True:
        active = cut(active)
        if active.isEmpty():
            break
        wanted = cut(active.mapInPandas(asked, f"{base}, number int, theta array<double>, low array<double>, high array<double>, n long"))
        found = _heights(packed, wanted, every, [*ids, "start"]).groupBy(*every).agg(F.collect_list(F.struct("number", "height")).alias("found"))
        moved = cut(active.join(found, every).mapInPandas(turned, f"{base}, {kinds}, best array<double>, done boolean"))
        over = over.unionByName(moved.where("done").select(*every, F.col("best").alias("theta"), "low", "high", "n"))
        active = moved.where("not done").select(*kept)
    ends = cut(over.withColumn("number", F.lit(0)))
    solved = _heights(packed, ends, every, [*ids, "start"]).select(*every, "x", F.col("height").alias("css"))
    return _with_residuals(packed, cut(solved), searched, ids)


def arima_fit(
    df: DataFrame,
    keys: Sequence[str],
    order: tuple[int, int, int],
    ts: str = "ts",
    value: str = "value",
    include_mean: bool = True,
    method: str = "L-BFGS",
    log: bool = False,
    silent: bool = False,
) -> DataFrame:
    """Fit one order to every series: keys, p, d, q, constant and the fit result."""
    p, d, q = order
    K.check_order(p, d, q)
    rows = df.withColumn(value, log10p1(F.col(value))) if log else df
    packed = pack(rows, list(keys), ts, value)
    return fit_candidates(packed, same_order(packed, order, include_mean), method=method, silent=silent)


def same_order(packed: Packed, order: tuple[int, int, int], constant: bool) -> DataFrame:
    p, d, q = order
    series = packed.frame.where("chunk = 0").select(*packed.keys)
    return series.select(
        *packed.keys,
        F.lit(p).alias("p"),
        F.lit(d).alias("d"),
        F.lit(q).alias("q"),
        F.lit(constant).alias("constant"),
    )


def arima_fit_ar(
    df: DataFrame, keys: Sequence[str], p: int, ts: str = "ts", value: str = "value", include_mean: bool = True
) -> DataFrame:
    """Exact fit without moving-average part: keys, phi, c, css, n.

    Spark adds up the cross products of the lags (partial sums before the
    shuffle); only a (p+2)x(p+2) matrix per series reaches Python.
    """
    keys = list(keys)
    K.check_order(p, 0, 0)
    names = [f"__l{j}" for j in range(1, p + 1)]

    def columns(w):
        return {n: F.lag(value, j).over(w) for j, n in enumerate(names, start=1)} | {
            "__at": F.lag(F.lit(1), p).over(w) if p else F.lit(1)
        }

    rows = df.select(*keys, ts, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    lagged = O.look_back(rows, keys, [ts], columns, rows=max(1, p)).where(F.col("__at").isNotNull())
    terms = [F.col(n) for n in names] + ([F.lit(1.0)] if include_mean else []) + [F.col(value)]
    products = [F.sum(terms[i] * terms[j]) for i in range(len(terms)) for j in range(i, len(terms))]
    grouped = lagged.groupBy(*keys) if keys else lagged.groupBy()
    sums = grouped.agg(F.array(*products).alias("m"), F.count(value).alias("n"))
    k = len(terms)

    def solve(batches):
        for pdf in batches:
            phis, cs, losses = [], [], []
            for m in pdf["m"]:
                full = np.zeros((k, k))
                full[np.triu_indices(k)] = as_array(m)
                full = full + np.triu(full, 1).T
                b = np.linalg.lstsq(full[:-1, :-1], full[:-1, -1], rcond=None)[0] if k > 1 else np.zeros(0)
                losses.append(float(full[-1, -1] - 2 * b @ full[:-1, -1] + b @ full[:-1, :-1] @ b))
                phis.append(b[:p].tolist())
                cs.append(float(b[p]) if include_mean else 0.0)
            yield pdf.drop(columns=["m"]).assign(phi=phis, c=cs, css=losses)

    keyed = ddl(df, keys) + ", " if keys else ""
    return sums.mapInPandas(solve, f"{keyed}n long, phi array<double>, c double, css double")


def yule_walker(gammas: DataFrame, keys: Sequence[str], p: int) -> DataFrame:
    """Autoregressive coefficients from autocovariances (keys, lag, gamma): keys, phi."""
    keys = list(keys)
    gathered = F.array_sort(F.collect_list(F.struct("lag", "gamma")))
    grouped = gammas.where(F.col("lag") <= p).groupBy(*keys)
    one = grouped.agg(F.transform(gathered, lambda x: x["gamma"]).alias("g"))

    def solve(batches):
        for pdf in batches:
            out = []
            for g in pdf["g"]:
                g = as_array(g)
                toeplitz = g[np.abs(np.subtract.outer(np.arange(p), np.arange(p)))]
                if abs(g[0]) < 1e-12:
                    toeplitz = toeplitz + np.eye(p) * 1e-12
                out.append(np.linalg.lstsq(toeplitz, g[1 : p + 1], rcond=None)[0].tolist())
            yield pdf.drop(columns=["g"]).assign(phi=out)

    return one.mapInPandas(solve, f"{ddl(gammas, keys)}, phi array<double>")


def ma_initial_guess(
    df: DataFrame, keys: Sequence[str], p: int, q: int, c: float = 0.0, ts: str = "ts", value: str = "value"
) -> DataFrame:
    """First guess of theta: residuals of an AR(p), then an AR(q) on them."""
    from foreloom.operators.stats import autocovariance

    keys = list(keys)
    rows = df.select(*keys, ts, value)
    if p > 0:
        phi = yule_walker(autocovariance(rows, keys, p, ts, value), keys, p)

        def columns(w):
            return {f"__l{j}": F.coalesce(F.lag(value, j).over(w), F.lit(0.0)) for j in range(1, p + 1)}

        lagged = attach(O.look_back(rows, keys, [ts], columns, rows=p), phi, keys)
        predicted = sum((F.col("phi")[j - 1] * F.col(f"__l{j}") for j in range(1, p + 1)), F.lit(c))
    else:
        lagged, predicted = rows, F.lit(c)
    rest = lagged.select(*keys, ts, (F.col(value) - predicted).alias("__res"))
    out = yule_walker(autocovariance(rest, keys, q, ts, "__res"), keys, q)
    return out.withColumnRenamed("phi", "theta")


# -- automatic search ---------------------------------------------------------

# Orders tried first, and the moves around the current best.
FIRST_ORDERS = ((0, 0), (2, 2), (1, 0), (0, 1))
MOVES = ((1, 0), (0, 1), (1, 1), (-1, 0), (0, -1), (-1, -1), (-1, 1), (1, -1))


def prepare_search(
    df: DataFrame, keys: Sequence[str], ts: str = "ts", value: str = "value"
) -> tuple[Packed, DataFrame]:
    """Packed series (logged where the rule says so) and keys, n, use_log, d."""
    keys = list(keys)
    rows = df.select(*keys, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    rows = rows.where(F.col("value").isNotNull())
    stats = log_rule(series_stats(rows, keys)).select(*keys, "n", "use_log")
    marked = attach(rows, stats.select(*keys, "use_log"), keys)
    logged = F.when(F.col("use_log"), log10p1("value")).otherwise(F.col("value"))
    size = O.largest_group(rows, keys)
    packed = pack(marked.withColumn("value", logged), keys, halo=max(16, kpss_halo(size)))
    packed = packed.persist()
    plan = cut(stats.join(choose_d(packed), keys))
    return packed, plan


def with_aicc(fits: DataFrame, strict: bool = False) -> DataFrame:
    """Add the criterion; by default the order enters its parameter count twice."""
    k = F.col("constant").cast("int") if strict else criteria.param_count("p", "q", "constant")
    return fits.withColumn("aicc", criteria.aicc("css", "p", "q", k, "n"))


def best_candidate(fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Candidate with the lowest criterion per series; NaN loses, ties go to the smaller order."""
    rest = [c for c in fits.columns if c not in keys]
    rank = F.struct("aicc", "p", "q", "constant")
    return fits.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("b")).select(*keys, "b.*")


def autoarima_search(
    packed: Packed,
    plan: DataFrame,
    stop: str = "reference",
    strict_aicc: bool = False,
) -> DataFrame:
    """Every candidate that the search fits, with its round and criterion.

    The driver loops over rounds; what a round fits is a DataFrame of (series,
    order) pairs.  No pair is fitted twice and orders are bounded, so that the
    search ends by its rule.  With ``stop="reference"`` a series goes on only while the fit
    with the constant switched beats everything seen; ``stop="any"`` goes on
    while anything improved.
    """
    if stop not in ("reference", "any"):
        raise ValueError(f"unknown stop rule {stop}")
    keys = packed.keys
    base = plan.withColumn("include_c", F.col("d") < 2)
    orders = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q"), F.lit(False).alias("bare")) for p, q in FIRST_ORDERS])
    extra = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(True).alias("bare")))
    exploded = base.withColumn(
        "o", F.explode(F.when(F.col("d") <= 1, F.concat(orders, extra)).otherwise(orders))
    )
    first = exploded.select(
        *keys, "d", F.col("o.p").alias("p"), F.col("o.q").alias("q"), (F.col("include_c") & ~F.col("o.bare")).alias("constant")
    )

    def fitted(candidates: DataFrame, number: int) -> DataFrame:
        fits = fit_candidates(packed, candidates)
        scored = with_aicc(fits.join(base.select(*keys, "n"), keys), strict_aicc)
        return cut(scored.withColumn("round", F.lit(number)))

    tried = fitted(first, 0)
    active = base
    for number in count(1):
        current = best_candidate(tried, keys).select(*keys, "p", "q", F.col("aicc").alias("best"))
        current = cut(current.join(active.select(*keys, "d", "include_c"), keys))
        if current.isEmpty():
            break
        moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in MOVES]))
        around = current.withColumn("m", moves).select(
            *keys,
            "d",
            (F.col("p") + F.col("m.a")).alias("p"),
            (F.col("q") + F.col("m.b")).alias("q"),
            F.col("include_c").alias("constant"),
            F.lit(False).alias("switched"),
        )
        around = around.where(F.col("p").between(0, K.MAX_P) & F.col("q").between(0, K.MAX_Q))
        fresh = around.join(tried.select(*keys, "p", "q").distinct(), [*keys, "p", "q"], "left_anti")
        switched = current.select(*keys, "d", "p", "q", (~F.col("include_c")).alias("constant"), F.lit(True).alias("switched"))
        # one that was fitted before lost to the current best, or is it: it cannot win now
        switched = switched.join(tried.select(*keys, "p", "q", "constant").distinct(), [*keys, "p", "q", "constant"], "left_anti")
        wave = fresh.select(*switched.columns).unionByName(switched)
        added = fitted(wave.drop("switched"), number)
        turned = added.join(
            switched.select(*keys, "p", "q", "constant"), [*keys, "p", "q", "constant"], "left_semi"
        ).select(*keys, F.col("aicc").alias("turned"))
        others = added.join(
            switched.select(*keys, "p", "q", "constant"), [*keys, "p", "q", "constant"], "left_anti"
        )
        best_other = others.groupBy(*keys).agg(F.min("aicc").alias("other"))
        scores = current.join(turned, keys, "left").join(best_other, keys, "left")
        seen = F.least("best", "other")
        better = F.col("turned") < seen
        if stop == "any":
            better = F.least("turned", "other") < F.col("best")
        active = cut(scores.where(better).select(*keys, "d", "include_c"))
        tried = tried.unionByName(added)
    return tried


def autoarima_fit(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "ts",
    value: str = "value",
    stop: str = "reference",
    strict_aicc: bool = False,
) -> DataFrame:
    """Best model of every series: keys, p, d, q, constant, phi, theta, c, css, aicc, use_log, n."""
    keys = list(keys)
    packed, plan = prepare_search(df, keys, ts, value)
    tried = autoarima_search(packed, plan, stop, strict_aicc)
    best = best_candidate(tried, keys).drop("round", "n")
    out = cut(best.join(plan.select(*keys, "n", "use_log"), keys))
    packed.frame.unpersist()
    return out
