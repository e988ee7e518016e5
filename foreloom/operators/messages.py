"""Aggregates pushed along the edges of a join graph, so that the join is never built.

The fact table carries s (sum of gradients) and c (count).  A message toward a
dimension is the sum of both per join key; a dimension absorbs a message by an
equi-join on its unique key and passes it on grouped by the next key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreloom.operators.joingraph import JoinGraph
from foreloom.plans.joins import null_safe_join

IDENTITY, SELECTION, FULL = "IDENTITY", "SELECTION", "FULL"


def filtered(graph: JoinGraph, name: str, parent: str | None = None) -> bool:
    """Whether a relation, or one behind it, has predicates."""
    return bool(graph.relations[name].predicates) or any(filtered(graph, n, name) for n in graph.neighbours(name, parent))


def surviving(graph: JoinGraph, name: str, parent: str | None = None) -> DataFrame:
    """Rows of a relation under its own predicates and, by semi-joins, under those of the relations behind it."""
    rows = graph.relations[name].rows()
    for child in graph.neighbours(name, parent):
        if filtered(graph, child, name):
            here, there = graph.edges[name][child]
            sent = selection_message(surviving(graph, child, name), there, here)
            rows = null_safe_join(rows, sent, here, "left_semi")
    return rows


def lift(graph: JoinGraph, target: Column | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Fact rows as (s, c) with the useful columns only, under the predicates of all relations."""
    relation = graph.relations[graph.target_relation]
    value = (F.col(graph.target) if target is None else target).cast("double")
    useful = [F.col(c) for c in graph.useful(relation.name)]
    return surviving(graph, relation.name).select(*useful, *extra, value.alias("s"), F.lit(1).cast("long").alias("c"))


def semiring_sum(facts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    grouped = facts.groupBy(*groups) if groups else facts.groupBy()
    return grouped.agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def message_kind(graph: JoinGraph, sender: str, incoming: Sequence[str]) -> str:
    """FULL from the fact table or after a FULL message, otherwise only surviving keys."""
    if sender == graph.target_relation or FULL in incoming:
        return FULL
    return SELECTION


def full_message(rows: DataFrame, keys: Sequence[str], names: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Sums of s and c per join key; keys are renamed to those of the receiver."""
    renamed = [F.col(k).alias(n) for k, n in zip(keys, names)]
    return rows.groupBy(*groups, *renamed).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def selection_message(rows: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Distinct keys that survive the predicates of the sender."""
    return rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)]).distinct()


def receive(
    graph: JoinGraph, name: str, message: DataFrame, keys: Sequence[str], kind: str = FULL, small: bool = False
) -> DataFrame:
    """A relation joined with one incoming message; selection messages only filter.

    ``small`` says that the relation was measured and may be broadcast.
    """
    rows = graph.relations[name].rows().select(*graph.useful(name))
    if kind == SELECTION:
        return rows.join(message, list(keys), "left_semi")
    return null_safe_join(message, F.broadcast(rows) if small else rows, list(keys))


def calibrate(
    graph: JoinGraph, facts: DataFrame, groups: Sequence[str] = (), small: dict[str, bool] | None = None
) -> dict[str, DataFrame]:
    """Rows of every relation with s and c, from the fact table outwards.

    Messages toward the fact table are identities (every dimension key is unique
    and present), so nothing is computed for them.  Each relation is reached by
    one grouped sum per edge, on already reduced rows.
    """
    absorbed = {graph.target_relation: facts}
    wanted = {n for n, r in graph.relations.items() if r.features}
    needed = {x for n in wanted if n != graph.target_relation for x in graph.path(n)}
    for parent, name in graph.walk():
        if parent is None or name not in needed:
            continue
        theirs, mine = graph.edges[parent][name]
        sent = full_message(absorbed[parent], theirs, mine, groups)
        absorbed[name] = receive(graph, name, sent, mine, FULL, bool(small and small.get(name)))
    return absorbed


def absorption(rows: DataFrame, features: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Sums of s and c per feature value (and group)."""
    return semiring_sum(rows, [*groups, *features])


def restrict_facts(graph: JoinGraph, facts: DataFrame, name: str, predicate: Column) -> DataFrame:
    """Fact rows whose row of a dimension satisfies a predicate: semi-joins along the path."""
    path = graph.path(name)
    rows = graph.relations[name].rows().where(predicate)
    for at in range(len(path) - 1, -1, -1):
        child = path[at]
        parent = path[at - 1] if at else graph.target_relation
        theirs, mine = graph.edges[parent][child]
        sent = selection_message(rows, mine, theirs)
        source = facts if parent == graph.target_relation else graph.relations[parent].rows()
        rows = source.join(sent, theirs, "left_semi")
    return rows
