"""Regression trees, boosting and forests grown over a join graph without joining it.

A tree level is one query: sums of (s, c) per node travel from the fact table to
the relations, become running sums per (node, feature) and yield the best split
of each node.  The driver holds one row per node.  Fact rows carry the number of
their node; a split on a dimension sends a flag per key back to the fact rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreloom.functions.scalars import rename_reserved
from foreloom.operators import messages as M
from foreloom.operators import splits as P
from foreloom.operators.joingraph import CAT, LCAT, NUM, JoinGraph, JoinGraphError, Relation
from foreloom.plans.joins import attach, heavy_keys
from foreloom.session import broadcast_rows, cut, fits, group_rows, planned_once

RESERVED = ("s", "c", "rowid", "tree", "node", "nodes", "rel", "feat", "kind", "num", "cat")
GROWTHS = ("bestfirst", "depthwise", "levelwise")
# a set split lists up to so many categories in the model; longer sets stay a table, which rows are joined with
MAX_LISTED = 1_000


def number_text(value: float) -> str:
    """A double literal; without an exponent SQL would read a decimal."""
    text = repr(float(value))
    return text if "e" in text else text + "E0"


@dataclass
class Split:
    relation: str
    feature: str
    kind: str
    value: object
    # the categories of a long set, in place of ``value``: one column __cat
    table: DataFrame | None = None

    @property
    def flag(self) -> str:
        """Column that says whether a row's category is in the table."""
        return f"__in_{id(self)}"

    def condition(self, column: Column) -> Column:
        """True for rows that go left; rows with a missing value go right unless the split is on missing."""
        if self.kind == P.NULL_SPLIT:
            return column.isNull()
        if self.table is not None:
            return F.coalesce(F.col(self.flag), F.lit(False))
        if self.kind == NUM:
            test = column.cast("double") <= F.lit(float(self.value))
        elif self.kind == CAT:
            test = column.cast("string") == F.lit(self.value)
        else:
            test = column.cast("string").isin(list(self.value))
        return F.coalesce(test, F.lit(False))

    def sql(self, name: str) -> str:
        def text(v):
            return "'" + str(v).replace("'", "''") + "'"

        if self.kind == P.NULL_SPLIT:
            return f"{name} IS NULL"
        if self.table is not None:
            raise ValueError(f"the left set of {name} is too long for SQL text; predict with the model instead")
        if self.kind == NUM:
            return f"{name} <= {number_text(self.value)}"
        if self.kind == CAT:
            return f"CAST({name} AS VARCHAR(4000)) = {text(self.value)}"
        return f"CAST({name} AS VARCHAR(4000)) IN ({', '.join(text(v) for v in self.value)})"


def flagged(rows: DataFrame, splits: Sequence[Split], name_of) -> DataFrame:
    """Rows with the flags of splits on long sets; ``name_of`` gives the column that a split reads."""
    for split in splits:
        if split.table is not None:
            lookup = split.table.select("__cat", F.lit(True).alias(split.flag))
            rows = attach(rows.withColumn("__cat", F.col(f"`{name_of(split)}`").cast("string")), lookup, ["__cat"], "left").drop("__cat")
    return rows


@dataclass
class Node:
    number: int
    depth: int
    s: float
    c: float
    split: Split | None = None
    gain: float = 0.0
    reach: float = float("inf")

    @property
    def children(self) -> tuple[int, int]:
        return 2 * self.number, 2 * self.number + 1


@dataclass
class Tree:
    nodes: dict[int, Node]
    chosen: set[int]
    rate: float

    def leaves(self) -> list[Node]:
        out, pending = [], [1]
        while pending:
            n = pending.pop()
            if n in self.chosen:
                pending += reversed(self.nodes[n].children)
            else:
                out.append(self.nodes[n])
        return out

    def leaf_value(self, node: Node) -> float:
        return self.rate * node.s / node.c if node.c else 0.0

    def leaf_of(self, number: int) -> Node:
        """Leaf that a (possibly deeper) node belongs to."""
        path = [number]
        while path[-1] > 1:
            path.append(path[-1] // 2)
        for n in reversed(path):
            if n not in self.chosen:
                return self.nodes[n]
        return self.nodes[number]

    def splits(self) -> list[Split]:
        return [self.nodes[n].split for n in self.chosen]

    def column(self, resolve, number: int = 1) -> Column:
        """Nested conditions; ``resolve`` gives the column that a split reads."""
        node = self.nodes[number]
        if number not in self.chosen:
            return F.lit(self.leaf_value(node))
        left, right = node.children
        test = node.split.condition(resolve(node.split))
        return F.when(test, self.column(resolve, left)).otherwise(self.column(resolve, right))

    def sql(self, name_of, number: int = 1) -> str:
        node = self.nodes[number]
        if number not in self.chosen:
            return number_text(self.leaf_value(node))
        left, right = node.children
        test = node.split.sql(name_of(node.split))
        return f"CASE WHEN {test} THEN {self.sql(name_of, left)} ELSE {self.sql(name_of, right)} END"


class DummyModel:
    """Predicts the mean of the target."""

    def __init__(self):
        self.constant: float | None = None
        self.count = 0
        self.trees: list[Tree] = []
        self.graph: JoinGraph | None = None
        self.restored: dict[str, dict[str, str]] = {}

    def fit(self, graph: JoinGraph, skip_check: bool = False, where: Column | None = None) -> "DummyModel":
        graph = self._prepare(graph, skip_check, where)
        total = M.semiring_sum(M.lift(graph)).first()
        self.constant, self.count = total["s"] / total["c"], total["c"]
        return self

    # -- preparation ----------------------------------------------------------

    def _prepare(self, graph: JoinGraph, skip_check: bool, where: Column | None) -> JoinGraph:
        """A working copy with clashing names renamed and the row filter attached."""
        if not skip_check:
            graph.validate()
        work = graph.copy()
        if where is not None:
            work.annotate(work.target_relation, where)
        self.restored = {}
        for name, r in list(work.relations.items()):
            clashing = [c for c in r.frame.columns if c in RESERVED]
            if not clashing:
                continue
            rows, names = rename_reserved(r.rows(), RESERVED)
            self.restored[name] = {new: old for old, new in names.items()}
            features = {names.get(f, f): kind for f, kind in r.features.items()}
            work.relations[name] = Relation(name, rows, features)
            for other in work.edges[name]:
                mine, theirs = work.edges[name][other]
                mine = [names.get(k, k) for k in mine]
                work.edges[name][other], work.edges[other][name] = (mine, theirs), (theirs, mine)
            if name == work.target_relation:
                work.target = names.get(work.target, work.target)
        self.graph = work
        return work

    def original(self, split: Split) -> str:
        return self.restored.get(split.relation, {}).get(split.feature, split.feature)

    # -- prediction -----------------------------------------------------------

    def base(self) -> float:
        return self.constant

    def to_column(self, qualified: bool = False) -> Column:
        """The model as an expression over plain or ``relation__feature`` columns."""

        def resolve(split):
            return F.col(f"{split.relation}__{split.feature}" if qualified else self.original(split))

        return self.to_column_of(resolve)

    def to_column_of(self, resolve) -> Column:
        out = F.lit(float(self.base()))
        for tree in self.trees:
            out = out + tree.column(resolve)
        return out

    def to_sql(self) -> str:
        parts = [number_text(self.base())] + [f"({t.sql(self.original)})" for t in self.trees]
        return " + ".join(parts)

    def used_features(self, working: bool = False) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for tree in self.trees:
            for s in tree.splits():
                name = s.feature if working else self.original(s)
                known = out.setdefault(s.relation, [])
                if name not in known:
                    known.append(name)
        return out

    def predict(self, data: DataFrame | JoinGraph, name: str = "prediction") -> DataFrame:
        """Add the prediction to a joined table, or to the fact rows of a join graph.

        From a graph only the features that the model uses are joined to the
        fact table, and only relations that hold one of them.
        """
        every = [s for tree in self.trees for s in tree.splits()]
        if isinstance(data, DataFrame):
            return flagged(data, every, self.original).select("*", self.to_column().alias(name)).select(*[F.col(f"`{c}`") for c in data.columns], name)
        # names that clash are changed as they were in training, and changed back
        again = DummyModel()
        graph = again._prepare(data, True, None)
        fact = graph.target_relation
        used = self.used_features(working=True)
        facts = graph.relations[fact].frame.columns
        used[fact] = list(facts)
        joined = flagged(graph.full_join(used), every, lambda s: f"{s.relation}__{s.feature}")
        value = self.to_column(qualified=True).alias(name)
        old = again.restored.get(fact, {})
        return joined.select(*[F.col(f"{fact}__{c}").alias(old.get(c, c)) for c in facts], value)

    def rmse(self, data: DataFrame, target: str | None = None) -> DataFrame:
        """One row: root of the mean squared error on a table."""
        target = target or self.restored.get(self.graph.target_relation, {}).get(self.graph.target, self.graph.target)
        error = F.col(target) - F.col("__predicted")
        return self.predict(data, "__predicted").agg(F.sqrt(F.avg(F.pow(error, F.lit(2.0)))).alias("rmse"))

    def sse(self, data: DataFrame, target: str) -> DataFrame:
        error = F.col(target) - F.col("__predicted")
        return self.predict(data, "__predicted").agg(F.sum(F.pow(error, F.lit(2.0))).alias("sse"))


class DecisionTree(DummyModel):
    def __init__(
        self,
        num_leaves: int = 31,
        learning_rate: float = 1.0,
        max_depth: int = 6,
        subsample: float = 1.0,
        growth: str = "bestfirst",
        seed: int = 0,
    ):
        super().__init__()
        if num_leaves < 1 or max_depth < 1:
            raise ValueError("num_leaves and max_depth should be positive")
        if not 0 < subsample <= 1 or not 0 < learning_rate <= 1:
            raise ValueError("subsample and learning_rate should be in (0, 1]")
        if growth not in GROWTHS:
            raise ValueError(f"growth should be one of {GROWTHS}")
        self.num_leaves, self.learning_rate, self.max_depth = num_leaves, learning_rate, max_depth
        self.subsample, self.growth, self.seed = subsample, growth, seed

    def fit(
        self,
        graph: JoinGraph,
        skip_check: bool = False,
        warm_start: bool = False,
        where: Column | None = None,
    ) -> "DecisionTree":
        """Grow one tree; with ``warm_start`` on what the model so far leaves unexplained."""
        self._train(graph, skip_check, warm_start, where, rounds=1)
        return self

    # -- training -------------------------------------------------------------

    def _train(self, graph, skip_check, warm_start, where, rounds):
        warm = warm_start and self.constant is not None
        work = self._prepare(graph, skip_check, where)
        self._sizes(work)
        facts = self._lifted(work, warm).persist()
        total = M.semiring_sum(facts).first()
        if not total["c"]:
            facts.unpersist()
            if warm:
                return
            raise JoinGraphError("there are no rows to train on")
        if not warm:
            self.constant, self.count, self.trees = total["s"] / total["c"], total["c"], []
            facts.unpersist()
            facts = facts.withColumn("s", F.col("s") - F.lit(self.constant)).persist()
            root = (0.0, total["c"])
        else:
            root = (total["s"], total["c"])
        # at most a few hundred thousand fact rows: adaptive planning would dominate
        with planned_once(facts.sparkSession, total["c"] <= broadcast_rows(facts.sparkSession)):
            self._boost(work, facts, root, rounds)

    def _boost(self, work: JoinGraph, facts: DataFrame, root: tuple[float, float], rounds: int) -> None:
        for number in range(rounds):
            grown, routed = self._grow(work, facts.withColumns({"tree": F.lit(0), "node": F.lit(1).cast("long")}), {0: root})
            tree = grown[0]
            self.trees.append(tree)
            if number == rounds - 1:
                break
            updated = self._updated(facts, routed, tree)
            updated = cut(updated) if (number + 1) % 10 == 0 else updated
            updated = updated.persist()
            # filled before the old version is released
            kept = updated.count()
            for old in (facts, *self._held):
                old.unpersist()
            facts = updated
            root = (root[0] * (1.0 - self.learning_rate), kept)
        for old in (facts, *self._held):
            old.unpersist()

    def _lifted(self, work: JoinGraph, warm: bool) -> DataFrame:
        if not warm:
            facts = M.lift(work)
        elif not self.used_features():
            facts = M.lift(work, F.col(work.target) - self.to_column())
        else:
            fact = work.target_relation
            used = self.used_features(working=True)
            mine = list(dict.fromkeys([*used.get(fact, []), *work.useful(fact), work.target]))
            every = [s for tree in self.trees for s in tree.splits()]
            joined = flagged(work.full_join({**used, fact: mine}), every, lambda s: f"{s.relation}__{s.feature}")
            left = F.col(f"{fact}__{work.target}").cast("double") - self.to_column(qualified=True)
            facts = joined.select(
                *[F.col(f"{fact}__{c}").alias(c) for c in work.useful(fact)],
                left.alias("s"),
                F.lit(1).cast("long").alias("c"),
            )
        return facts.sample(self.subsample, self.seed) if self.subsample < 1 else facts

    def _sizes(self, work: JoinGraph) -> None:
        """Which relations may be broadcast, and whether some feature has too many values for one task."""
        spark = work.relations[work.target_relation].frame.sparkSession
        limit = broadcast_rows(spark)
        self._small = {
            n: fits(r.frame.select(*work.useful(n)), limit)
            for n, r in work.relations.items()
            if n != work.target_relation
        }
        self._heavy: dict[str, DataFrame | None] = {}
        bound = group_rows(spark)
        self._long = False
        self._has_sets = any(kind == LCAT for r in work.relations.values() for kind in r.features.values())
        for n, r in work.relations.items():
            ordered = [f for f, kind in r.features.items() if kind != CAT]
            if not ordered or self._small.get(n):
                continue
            if fits(r.frame.select(*ordered), bound):
                continue
            row = r.frame.agg(*[F.approx_count_distinct(f).alias(f) for f in ordered]).first()
            self._long = self._long or max(row[f] for f in ordered) > bound * 0.9

    def _values(self, work: JoinGraph, facts: DataFrame) -> DataFrame:
        """Sums per (tree, node, relation, feature, value)."""
        absorbed = M.calibrate(work, facts, ["tree", "node"], self._small)
        parts = []
        for number, (name, r) in enumerate(work.relations.items()):
            if r.features:
                features = {f: (i, kind) for i, (f, kind) in enumerate(r.features.items())}
                parts.append((absorbed[name], number, features))
        return P.long_features(parts)

    def _grow(self, work: JoinGraph, facts: DataFrame, roots: dict[int, tuple[float, float]]):
        """Grow one tree per root; returns the trees and the fact rows with their deepest node."""
        spark = facts.sparkSession
        names = list(work.relations)
        forest = {t: {1: Node(1, 0, s, c)} for t, (s, c) in roots.items()}
        frontier = {t: [1] for t in roots}
        held = []
        for depth in range(self.max_depth):
            active = [(t, n) for t in frontier for n in frontier[t]]
            if not active or self.num_leaves == 1:
                break
            rows = [(t, n, float(forest[t][n].s), float(forest[t][n].c)) for t, n in active]
            totals = spark.createDataFrame(rows, "tree int, node long, total_s double, total_c double")
            values = self._values(work, self._open(facts, totals if depth else None))
            # the running sums over slices read the values several times, and the left sets must be cut from the
            # very sums that chose the split: sums of doubles differ in the last bit from run to run
            values = cut(values) if self._long or self._has_sets else values
            best = P.best_splits(P.scored_splits(values, totals, self._long)).collect()
            sets = self._sets(values, best)
            found = {t: [] for t in frontier}
            for b in best:
                node = forest[b["tree"]][b["node"]]
                gain = b["score"] - (node.s * node.s / node.c if node.c else 0.0)
                if gain <= 1e-12 * abs(b["score"]):
                    continue
                name = names[b["rel"]]
                feature = list(work.relations[name].features)[b["feat"]]
                listed, table = sets.get((b["tree"], b["node"]), (None, None))
                value = {NUM: b["num"], CAT: b["cat"], LCAT: listed}.get(b["kind"])
                node.split, node.gain = Split(name, feature, b["kind"], value, table), gain
                parent = forest[b["tree"]].get(b["node"] // 2)
                node.reach = min(gain, parent.reach if parent else float("inf"))
                left, right = node.children
                forest[b["tree"]][left] = Node(left, depth + 1, b["ls"], b["lc"])
                forest[b["tree"]][right] = Node(right, depth + 1, node.s - b["ls"], node.c - b["lc"])
                found[b["tree"]].append(node.number)
            expanding = {t: self._worthwhile(forest[t], found[t]) for t in frontier}
            frontier = {t: [c for n in expanding[t] for c in forest[t][n].children] for t in frontier}
            moved = [(t, n) for t in expanding for n in expanding[t]]
            if not moved:
                break
            facts, shuffled = self._route(work, facts, forest, moved)
            if shuffled and depth + 1 < self.max_depth:
                facts = facts.persist()
                held.append(facts)
        trees = {t: Tree(forest[t], self._chosen(forest[t]), self.learning_rate) for t in roots}
        self._held = held
        return trees, facts

    def _open(self, facts: DataFrame, totals: DataFrame | None) -> DataFrame:
        """Fact rows with their tree and node, those of the nodes in ``totals`` where it is given."""
        return facts if totals is None else facts.join(F.broadcast(totals.select("tree", "node")), ["tree", "node"], "left_semi")

    def _sets(self, values: DataFrame, best: list) -> dict:
        """Left sets of the chosen prefix splits: (categories, None), or (None, table) for a long one."""
        chosen = [b for b in best if b["kind"] == LCAT]
        if not chosen:
            return {}
        schema = "tree int, node long, rel int, feat int, place double, cat string"
        rows = [(b["tree"], b["node"], b["rel"], b["feat"], b["place"], b["cat"]) for b in chosen]
        picked = values.sparkSession.createDataFrame(rows, schema)
        left = cut(P.left_categories(values, picked))
        out: dict = {}
        sizes = {(r["tree"], r["node"]): r["n"] for r in left.groupBy("tree", "node").agg(F.count("*").alias("n")).collect()}
        brief = [k for k, n in sizes.items() if n <= MAX_LISTED]
        if brief:
            wanted = values.sparkSession.createDataFrame(brief, "tree int, node long")
            for r in left.join(F.broadcast(wanted), ["tree", "node"], "left_semi").collect():  # at most MAX_LISTED a node
                out.setdefault((r["tree"], r["node"]), ([], None))[0].append(r["cat"])
        for t, n in sizes:
            if (t, n) in out:
                out[t, n] = (sorted(out[t, n][0]), None)
            else:
                out[t, n] = (None, left.where((F.col("tree") == t) & (F.col("node") == n)).select(F.col("cat").alias("__cat")))
        return out

    # -- which splits are kept ------------------------------------------------

    def _by_rank(self, nodes: dict[int, Node]) -> list[Node]:
        split = [n for n in nodes.values() if n.split is not None]
        if self.growth == "bestfirst":
            # the best-first queue takes nodes in the order of the weakest gain on their path
            return sorted(split, key=lambda n: (-n.reach, n.depth, n.number))
        if self.growth == "levelwise":
            return sorted(split, key=lambda n: (n.depth, n.number))
        order, pending = [], [1]
        while pending:
            n = nodes.get(pending.pop())
            if n is not None and n.split is not None:
                order.append(n)
                pending += list(n.children)
        return order

    def _worthwhile(self, nodes: dict[int, Node], found: Sequence[int]) -> list[int]:
        """Nodes of this level that can still be among the kept splits."""
        if self.growth == "depthwise":
            return list(found)
        kept = {n.number for n in self._by_rank(nodes)[: self.num_leaves - 1]}
        return [n for n in found if n in kept]

    def _chosen(self, nodes: dict[int, Node]) -> set[int]:
        return {n.number for n in self._by_rank(nodes)[: self.num_leaves - 1]}

    # -- moving fact rows -----------------------------------------------------

    def _route(self, work: JoinGraph, facts: DataFrame, forest, moved: Sequence[tuple[int, int]]):
        """Fact rows with the child they go to; True if a dimension had to be joined by a shuffle."""
        fact = work.target_relation
        branches: dict[str, dict[str, list[tuple[int, int, Split]]]] = {}
        tests: dict[tuple[int, int], Column] = {}
        for t, n in moved:
            split = forest[t][n].split
            if split.relation == fact:
                tests[t, n] = split.condition(F.col(split.feature))
            else:
                head = work.path(split.relation)[0]
                branches.setdefault(head, {}).setdefault(split.relation, []).append((t, n, split))
        shuffled = False
        columns = facts.columns
        own = [forest[t][n].split for t, n in tests]
        facts = flagged(facts, own, lambda split: split.feature)
        for head, by_relation in branches.items():
            flags: list[str] = []
            lookup = self._flags(work, head, None, by_relation, flags)
            theirs, mine = work.edges[fact][head]
            keyed = lookup.select(*[F.col(m).alias(k) for k, m in zip(theirs, mine)], *flags)
            # rows without any flag need not travel
            keyed = keyed.where(reduce(or_, [F.coalesce(F.col(f), F.lit(False)) for f in flags]))
            facts = attach(facts, keyed, theirs, "left", self._small[head], heavy=lambda: self._heavy_of(facts, head, theirs))
            shuffled = shuffled or not self._small[head]
            for f in flags:
                t, n = (int(v) for v in f.split("_")[-2:])
                tests[t, n] = F.coalesce(F.col(f), F.lit(False))
        return self._placed(facts, tests).select(*columns), shuffled

    def _heavy_of(self, facts: DataFrame, head: str, keys: list[str]) -> DataFrame | None:
        """Heavy keys of the fact rows toward a relation, counted once: all levels and trees have the same rows."""
        if head not in self._heavy:
            self._heavy[head] = heavy_keys(facts, keys)
        return self._heavy[head]

    def _placed(self, facts: DataFrame, tests: dict[tuple[int, int], Column]) -> DataFrame:
        """Fact rows of the nodes tested move to a child."""
        expr = None
        for (t, n), test in tests.items():
            here = (F.col("tree") == t) & (F.col("node") == n)
            child = F.when(test, F.lit(2 * n).cast("long")).otherwise(F.lit(2 * n + 1).cast("long"))
            expr = F.when(here, child) if expr is None else expr.when(here, child)
        return facts.withColumn("node", expr.otherwise(F.col("node")))

    def _flags(self, work: JoinGraph, name: str, parent: str | None, by_relation, flags: list[str]) -> DataFrame:
        """Rows of a dimension with one flag per split on it or on relations behind it."""
        r = work.relations[name]
        own = []
        here = by_relation.get(name, [])
        for t, n, split in here:
            flag = f"__left_{t}_{n}"
            own.append(split.condition(F.col(split.feature)).alias(flag))
            flags.append(flag)
        rows = flagged(r.rows(), [split for _, _, split in here], lambda split: split.feature).select(*work.useful(name), *own)
        for other in work.neighbours(name, parent or work.target_relation):
            behind = [x for x in by_relation if x == other or other in work.path(x)]
            if not behind:
                continue
            before = len(flags)
            side = self._flags(work, other, name, by_relation, flags)
            theirs, mine = work.edges[name][other]
            new = flags[before:]
            keyed = side.select(*[F.col(m).alias(k) for k, m in zip(theirs, mine)], *new)
            rows = attach(rows, keyed, theirs, "left", self._small[other])
        return rows

    def _updated(self, facts: DataFrame, routed: DataFrame, tree: Tree) -> DataFrame:
        """Residuals after a tree: the value of the leaf of each row is taken off."""
        reached = {n for n in tree.nodes}
        value, cases = None, {}
        for n in reached:
            cases.setdefault(tree.leaf_of(n).number, []).append(n)
        for leaf, numbers in cases.items():
            v = F.lit(tree.leaf_value(tree.nodes[leaf]))
            cond = F.col("node").isin(numbers)
            value = F.when(cond, v) if value is None else value.when(cond, v)
        return routed.withColumn("s", F.col("s") - value.otherwise(F.lit(0.0))).select(*facts.columns)


class GradientBoosting(DecisionTree):
    """Trees added one after the other on what is left unexplained."""

    def __init__(
        self,
        num_leaves: int = 31,
        learning_rate: float = 1.0,
        max_depth: int = 6,
        n_estimators: int = 1,
        incremental_estimators: int | None = None,
        subsample: float = 1.0,
        growth: str = "bestfirst",
        seed: int = 0,
    ):
        super().__init__(num_leaves, learning_rate, max_depth, subsample, growth, seed)
        if n_estimators < 1:
            raise ValueError(f"{n_estimators} trees cannot be added")
        self.n_estimators = n_estimators
        self.incremental_estimators = incremental_estimators or n_estimators

    def fit(self, graph, skip_check=False, warm_start=False, where=None) -> "GradientBoosting":
        warm = warm_start and self.constant is not None
        rounds = self.incremental_estimators if warm else self.n_estimators
        self._train(graph, skip_check, warm_start, where, rounds)
        return self


class RandomForest(DecisionTree):
    """Trees on row samples, averaged; all trees grow in the same queries.

    A fact is one row that carries its node in every tree, 0 where it does not belong to a tree; rows of single trees
    exist inside the partial sums only.  Whether a row belongs to a tree follows from its content, by a hash or by
    ``members`` (a function from the number of a tree to a condition on the fact table), so that a partition that is
    computed again has the same rows.
    """

    def __init__(
        self,
        num_leaves: int = 31,
        max_depth: int = 6,
        subsample: float = 1.0,
        n_estimators: int = 1,
        growth: str = "bestfirst",
        seed: int = 0,
        members=None,
    ):
        super().__init__(num_leaves, 1.0, max_depth, subsample, growth, seed)
        if n_estimators < 1:
            raise ValueError(f"a forest of {n_estimators} trees cannot be grown")
        self.n_estimators, self.members = n_estimators, members

    def fit(self, graph, skip_check=False, where=None) -> "RandomForest":
        work = self._prepare(graph, skip_check, where)
        self._sizes(work)
        columns = work.relations[work.target_relation].rows().columns

        def member(i: int) -> Column:
            if self.members is not None:
                return self.members(i)
            drawn = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns], F.lit(self.seed + i)), F.lit(1_000_000))
            return drawn < int(self.subsample * 1_000_000)

        nodes = F.array(*[F.when(member(i), 1).otherwise(0).cast("long") for i in range(self.n_estimators)])
        facts = M.lift(work, extra=[nodes.alias("nodes")]).persist()
        self._constants: dict[int, float] = {}
        totals = {r["tree"]: (r["s"], r["c"]) for r in M.semiring_sum(self._open(facts, None), ["tree"]).collect()}
        if not totals:
            facts.unpersist()
            raise JoinGraphError("no tree of the forest has a row to train on")
        self._constants = {t: s / c for t, (s, c) in totals.items()}
        grown, _ = self._grow(work, facts, {t: (0.0, c) for t, (_, c) in totals.items()})
        self.constant = sum(self._constants.values()) / len(self._constants)
        self.count = sum(c for _, c in totals.values())
        self.trees = [grown[t] for t in sorted(grown)]
        for tree in self.trees:
            tree.rate = 1.0 / len(self.trees)
        for old in (facts, *self._held):
            old.unpersist()
        return self

    def _open(self, facts: DataFrame, totals: DataFrame | None) -> DataFrame:
        rest = [c for c in facts.columns if c not in ("nodes", "s")]
        rows = facts.select(*rest, "s", F.posexplode("nodes").alias("tree", "node")).where("node > 0")
        if self._constants:
            shift = F.element_at(F.create_map(*[F.lit(v) for kv in sorted(self._constants.items()) for v in kv]), F.col("tree"))
            rows = rows.withColumn("s", F.col("s") - shift)
        return super()._open(rows, totals)

    def _placed(self, facts: DataFrame, tests: dict[tuple[int, int], Column]) -> DataFrame:
        moved = []
        for t in range(self.n_estimators):
            now = F.col("nodes")[t]
            expr = None
            for (tree, n), test in tests.items():
                if tree == t:
                    child = F.when(test, F.lit(2 * n).cast("long")).otherwise(F.lit(2 * n + 1).cast("long"))
                    expr = F.when(now == n, child) if expr is None else expr.when(now == n, child)
            moved.append(now if expr is None else expr.otherwise(now))
        return facts.withColumn("nodes", F.array(*moved))
