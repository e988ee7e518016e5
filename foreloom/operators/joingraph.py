"""An acyclic graph of relations around one fact table, described once and read lazily."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreloom.functions.expressions import every
from foreloom.plans.joins import null_safe_join
from foreloom.plans.ordered import group_sizes

# kinds of features: ordered values, ordered sets of categories, single categories
NUM, LCAT, CAT = "NUM", "LCAT", "CAT"


class JoinGraphError(ValueError):
    pass


@dataclass
class Relation:
    name: str
    frame: DataFrame
    features: dict[str, str]
    predicates: list[Column] = field(default_factory=list)

    def rows(self) -> DataFrame:
        """The relation under its predicates."""
        return self.frame.where(every(self.predicates)) if self.predicates else self.frame


class JoinGraph:
    def __init__(self):
        self.relations: dict[str, Relation] = {}
        self.edges: dict[str, dict[str, tuple[list[str], list[str]]]] = {}
        self.statistics: dict[tuple[str, str], dict] = {}
        self.target_relation: str | None = None
        self.target: str | None = None

    # -- building -------------------------------------------------------------

    def add_relation(
        self,
        name: str,
        frame: DataFrame,
        X: Sequence[str] = (),
        y: str | None = None,
        categorical: Sequence[str] = (),
        category: Sequence[str] = (),
        replace: bool = False,
    ) -> "JoinGraph":
        """Register a relation: numeric features X, set-split ``categorical``, one-value ``category``."""
        if name in self.relations and not replace:
            raise JoinGraphError(f"relation {name} is registered; pass replace=True to change it")
        wanted = [*X, *categorical, *category, *([y] if y else [])]
        missing = [c for c in wanted if c not in frame.columns]
        if missing:
            raise JoinGraphError(f"columns {missing} are not in the frame of {name}")
        features = {**{c: NUM for c in X}, **{c: LCAT for c in categorical}, **{c: CAT for c in category}}
        self.relations[name] = Relation(name, frame, features)
        self.edges.setdefault(name, {})
        if y is not None:
            self.target, self.target_relation = y, name
        return self

    def add_join(self, left: str, right: str, left_keys: Sequence[str], right_keys: Sequence[str]) -> "JoinGraph":
        if len(left_keys) != len(right_keys):
            raise JoinGraphError(f"{left} and {right} need as many key columns on either side")
        for name, keys in ((left, left_keys), (right, right_keys)):
            if name not in self.relations:
                raise JoinGraphError(f"register {name} before joining it")
            unknown = [k for k in keys if k not in self.relations[name].frame.columns]
            if unknown:
                raise JoinGraphError(f"key columns {unknown} are not in the frame of {name}")
        self.edges[left][right] = (list(left_keys), list(right_keys))
        self.edges[right][left] = (list(right_keys), list(left_keys))
        return self

    def annotate(self, name: str, predicate: Column) -> "JoinGraph":
        self.relations[name].predicates.append(predicate)
        return self

    def copy(self) -> "JoinGraph":
        out = JoinGraph()
        for r in self.relations.values():
            out.relations[r.name] = Relation(r.name, r.frame, dict(r.features), list(r.predicates))
        out.edges = {a: dict(b) for a, b in self.edges.items()}
        out.statistics = dict(self.statistics)
        out.target, out.target_relation = self.target, self.target_relation
        return out

    # -- navigation -----------------------------------------------------------

    def neighbours(self, name: str, parent: str | None = None) -> list[str]:
        return [n for n in self.edges[name] if n != parent]

    def walk(self, root: str | None = None) -> Iterator[tuple[str | None, str]]:
        """(parent, relation) in depth-first order from the root."""
        root = root or self.target_relation or next(iter(self.relations))
        pending: list[tuple[str | None, str]] = [(None, root)]
        while pending:
            parent, name = pending.pop()
            yield parent, name
            pending += [(name, n) for n in reversed(self.neighbours(name, parent))]

    def path(self, name: str) -> list[str]:
        """Relations from the neighbour of the fact table to ``name``."""
        parents = {child: parent for parent, child in self.walk()}
        out = [name]
        while parents[out[0]] not in (None, self.target_relation):
            out.insert(0, parents[out[0]])
        return out

    def useful(self, name: str) -> list[str]:
        """Features and join keys of a relation, the only columns that training reads."""
        keys = [k for n in self.edges[name] for k in self.edges[name][n][0]]
        return list(dict.fromkeys([*self.relations[name].features, *keys]))

    # -- statistics -----------------------------------------------------------

    def edge_frame(self, left: str, right: str) -> DataFrame:
        """One row about an edge: multiplicities and missing keys, both ways.

        Each side is reduced to its distinct keys with counts; one full join of
        the two gives all four numbers.
        """
        left_keys, right_keys = self.edges[left][right]
        names = [f"k{i}" for i in range(len(left_keys))]
        a = group_sizes(self.relations[left].frame.select(*left_keys).toDF(*names), names, "a")
        b = group_sizes(self.relations[right].frame.select(*right_keys).toDF(*names), names, "b")
        both = null_safe_join(a, b, names, "full")
        return both.agg(
            F.max("a").alias("left_multiplicity"),
            F.max("b").alias("right_multiplicity"),
            F.count(F.when(F.col("b").isNull(), 1)).alias("left_missing"),
            F.count(F.when(F.col("a").isNull(), 1)).alias("right_missing"),
        ).select(F.lit(left).alias("left"), F.lit(right).alias("right"), "*")

    def edge_list(self) -> list[tuple[str, str]]:
        seen = []
        for a in self.edges:
            for b in self.edges[a]:
                if (b, a) not in seen:
                    seen.append((a, b))
        return seen

    def summary(self) -> DataFrame:
        """All edges with keys, multiplicities as 1 or M, and missing counts."""
        out = None
        for a, b in self.edge_list():
            one = self.edge_frame(a, b).select(
                "left",
                "right",
                F.lit(",".join(self.edges[a][b][0])).alias("left_keys"),
                F.lit(",".join(self.edges[a][b][1])).alias("right_keys"),
                "left_multiplicity",
                "right_multiplicity",
                F.when(F.col("left_multiplicity") > 1, "M").otherwise("1").alias("left_side"),
                F.when(F.col("right_multiplicity") > 1, "M").otherwise("1").alias("right_side"),
                "left_missing",
                "right_missing",
            )
            out = one if out is None else out.unionByName(one)
        return out

    def nodes(self) -> list[dict]:
        return [
            {"id": r.name, "attributes": sorted(self.useful(r.name)), "features": dict(r.features)}
            for r in self.relations.values()
        ]

    def measure(self) -> None:
        """Fill ``statistics`` per direction; one row per edge comes to the driver."""
        todo = [e for e in self.edge_list() if e not in self.statistics]
        for a, b in todo:
            row = self.edge_frame(a, b).first()
            self.statistics[a, b] = {"multiplicity": row["left_multiplicity"], "missing": row["left_missing"]}
            self.statistics[b, a] = {"multiplicity": row["right_multiplicity"], "missing": row["right_missing"]}

    # -- validation -----------------------------------------------------------

    def check_shape(self) -> None:
        if not self.relations:
            raise JoinGraphError("The join graph is empty!")
        seen: set[str] = set()
        pending: list[tuple[str, str | None]] = [(next(iter(self.relations)), None)]
        while pending:
            name, parent = pending.pop()
            if name in seen:
                raise JoinGraphError(f"{name} is reached twice: a cyclic graph cannot pass messages")
            seen.add(name)
            pending += [(n, name) for n in self.neighbours(name, parent)]
        if len(seen) != len(self.relations):
            raise JoinGraphError(f"disjoint graph: no path to {sorted(set(self.relations) - seen)}")
        if self.target is None or self.target_relation is None:
            raise JoinGraphError("no relation holds the target (y)")

    def validate(self) -> None:
        """Shape of the graph, and that every dimension side is unique and covers its fact side."""
        self.check_shape()
        self.measure()
        for parent, name in self.walk():
            if parent is None:
                continue
            if (self.statistics[name, parent]["multiplicity"] or 0) > 1:
                raise JoinGraphError(f"a key of {parent} meets several rows of {name}; the target has to be on the many side")
            if self.statistics[parent, name]["missing"]:
                raise JoinGraphError(f"incomplete dimension {name}: some keys of {parent} are missing there")

    def infer_features(self, name: str, exclude: Sequence[str] = (), few: int = 30) -> dict[str, str]:
        """Kinds by type and exact number of distinct values, counted in one pass.

        Numbers are numeric; every other type counts as its text, null values apart.
        """
        frame = self.relations[name].frame
        fields = [f for f in frame.schema if f.name not in exclude]
        texts = [f.name for f in fields if not isinstance(f.dataType, T.NumericType)]
        held = {}
        if texts:
            pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in texts])
            values = frame.select(F.explode(pairs).alias("x")).select("x.*").where("value IS NOT NULL").distinct()
            held = {r["feature"]: r["n"] for r in values.groupBy("feature").agg(F.count("*").alias("n")).collect()}
        return {
            f.name: NUM if isinstance(f.dataType, T.NumericType) else LCAT if held.get(f.name, 0) <= few else CAT for f in fields
        }

    # -- joins ----------------------------------------------------------------

    def full_join(self, columns: dict[str, Sequence[str]] | None = None, how: str = "inner") -> DataFrame:
        """Depth-first join of the graph; column ``relation__attribute`` for every kept attribute.

        ``columns`` limits the attributes per relation; join keys are added and
        relations that nothing is read from are left out, unless an inner join has predicates on them.
        """
        root = self.target_relation or next(iter(self.relations))
        needed = set(self.relations) if columns is None else {root}
        for name in columns or {}:
            if columns[name]:
                needed |= {name, *([] if name == root else self.path(name))}
        if how == "inner":  # predicates limit the join, whether or not something is read from their relation
            for name, r in self.relations.items():
                if r.predicates and name != root:
                    needed |= {name, *self.path(name)}
        out = None
        for parent, name in self.walk(root):
            if name not in needed:
                continue
            kept = self.relations[name].frame.columns if columns is None else columns.get(name, ())
            keys = [k for n in self.edges[name] for k in self.edges[name][n][0]]
            attributes = list(dict.fromkeys([*kept, *keys]))
            side = self.relations[name].rows().select(*[F.col(c).alias(f"{name}__{c}") for c in attributes])
            if out is None:
                out = side
                continue
            mine, theirs = self.edges[name][parent]
            cond = every([F.col(f"{parent}__{b}") == F.col(f"{name}__{a}") for a, b in zip(mine, theirs)])
            out = out.join(side, cond, how)
        return out
