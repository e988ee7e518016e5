"""Vertices around the parameters of a model, and the test whether one of them has become better."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreloom.functions.scalars import array_norm, array_scale
from foreloom.operators.css import fold_states
from foreloom.plans.packed import Packed

# Step of a vertex, and the scale near the origin.
TOLERANCE = 0.05
NEAR_ORIGIN = 0.5
CENTRE = 0


def simplex_vertices(models: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per vertex: the columns of ``models`` with ``vertex_id`` and moved phi, theta.

    ``models`` has phi and theta.  Vertex i moves coefficient i away from 0; the
    last one scales all of them towards 0.
    """
    others = [c for c in models.columns if c not in ("phi", "theta")]
    p, q = F.size("phi"), F.size("theta")
    count = p + q
    norm = array_norm("phi", "theta")
    factor = F.when(norm > tolerance, 1.0 - tolerance / norm).otherwise(NEAR_ORIGIN)

    def moved(name: str, shift: Column) -> Column:
        def one(x, i):
            out = x + F.when(x >= 0, tolerance).otherwise(-tolerance)
            return F.when(i + shift + 1 == F.col("vertex_id"), out).otherwise(x)

        inward = array_scale(name, F.col("__factor"))
        return F.when(F.col("vertex_id") <= count, F.transform(name, one)).otherwise(inward)

    # the factor is a column of its own: inside a lambda, phi would mean the moved phi
    rows = models.withColumn("__factor", factor)
    rows = rows.withColumn("vertex_id", F.explode(F.sequence(F.lit(1), count + 1)))
    return rows.select(*others, "vertex_id", moved("phi", F.lit(0)).alias("phi"), moved("theta", p).alias("theta"))


def centre_and_vertices(models: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Centre (vertex 0) and vertices of every model in one frame."""
    around = simplex_vertices(models, tolerance)
    return models.withColumn("vertex_id", F.lit(CENTRE)).select(*around.columns).unionByName(around)


def initial_states(
    packed: Packed, models: DataFrame, tolerance: float = TOLERANCE, carry: Sequence[str] = (), ends: bool = False
) -> DataFrame:
    """States of the centre and all vertices after the whole history, in one pass; further columns as in ``fold_states``."""
    columns = ["phi", "theta", "c", "d", *carry]
    points = centre_and_vertices(models.select(*packed.keys, *columns), tolerance)
    return fold_states(packed, points, ["vertex_id"], columns, ends)


def breach_check(states: DataFrame, keys: Sequence[str], margin: float = 0.0) -> DataFrame:
    """keys, centre_css, best_vertex_css, breached.

    A model is breached when its centre has diverged, when a vertex has a lower
    loss (by the relative ``margin``), or when it has no coefficients at all.
    """
    css = F.col("state.css")
    centre = F.max(F.when(F.col("vertex_id") == CENTRE, css)).alias("centre_css")
    vertex = F.min(F.when(F.col("vertex_id") != CENTRE, css)).alias("best_vertex_css")
    size = F.max(F.col("state.p") + F.col("state.q")).alias("coefficients")
    grouped = states.groupBy(*keys).agg(centre, vertex, size)
    diverged = F.isnan("centre_css") | (F.col("centre_css") == float("inf"))
    better = F.col("best_vertex_css") < F.col("centre_css") * (1.0 - margin)
    return grouped.select(
        *keys,
        "centre_css",
        "best_vertex_css",
        (diverged | F.coalesce(better, F.lit(False)) | (F.col("coefficients") == 0)).alias("breached"),
    )
