"""Queries of the join graph and the learners on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreloom.operators import messages as M
from foreloom.operators import splits as P
from foreloom.operators.joingraph import JoinGraph
from foreloom.operators.trees import DecisionTree, DummyModel, GradientBoosting, RandomForest, Split, Tree, Node
from foreloom.plans.joins import attach
from foreloom.session import cut, group_rows, spread_over
from foreloom.suite import query


def star(t) -> JoinGraph:
    """Line items with their dimensions; nation hangs behind customer."""
    g = JoinGraph()
    g.add_relation("lineitem", t.lineitem, X=["l_quantity", "l_discount"], y="l_extendedprice")
    g.add_relation("part", t.part, X=["p_size", "p_retailprice"], categorical=["p_type"], category=["p_brand"])
    g.add_relation("supplier", t.supplier, X=["s_acctbal"])
    g.add_relation("orders", t.orders, X=["o_totalprice"])
    g.add_relation("customer", t.customer, categorical=["c_mktsegment"])
    g.add_relation("nation", t.nation, X=["n_regionkey"])
    g.add_join("lineitem", "part", ["l_partkey"], ["p_partkey"])
    g.add_join("lineitem", "supplier", ["l_suppkey"], ["s_suppkey"])
    g.add_join("lineitem", "orders", ["l_orderkey"], ["o_orderkey"])
    g.add_join("orders", "customer", ["o_custkey"], ["c_custkey"])
    g.add_join("customer", "nation", ["c_nationkey"], ["n_nationkey"])
    return g


def small_star(t) -> JoinGraph:
    """Line items, part and supplier only."""
    g = JoinGraph()
    g.add_relation("lineitem", t.lineitem, X=["l_quantity"], y="l_extendedprice")
    g.add_relation("part", t.part, X=["p_size"], categorical=["p_type"])
    g.add_relation("supplier", t.supplier, X=["s_nationkey"])
    g.add_join("lineitem", "part", ["l_partkey"], ["p_partkey"])
    g.add_join("lineitem", "supplier", ["l_suppkey"], ["s_suppkey"])
    return g


JOINED = """lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
            JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
            JOIN nation ON c_nationkey = n_nationkey"""
TOTAL = f"SELECT SUM(l_extendedprice) AS ts, COUNT(*) AS tc FROM {JOINED}"

# -- the graph ----------------------------------------------------------------


@query(
    "add_relation",
    "SELECT 'part' AS relation, p_partkey, p_size, p_retailprice, p_type, p_brand FROM part",
)
def _(t):
    g = star(t)
    rows = g.relations["part"].rows().select(*g.useful("part"))
    return rows.select(F.lit("part").alias("relation"), *rows.columns)


@query("useful_attributes", "SELECT l_quantity, l_discount, l_partkey, l_suppkey, l_orderkey FROM lineitem")
def _(t):
    g = star(t)
    return g.relations["lineitem"].rows().select(*g.useful("lineitem"))


@query("annotate", "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_retailprice <= 1500")
def _(t):
    g = star(t).annotate("part", F.col("p_size") > 10).annotate("part", F.col("p_retailprice") <= 1500)
    return g.relations["part"].rows().select("p_partkey", "p_size")


def _edge_sql(left, lk, right, rk):
    return f"""SELECT '{left}' AS "left", '{right}' AS "right", '{lk}' AS left_keys, '{rk}' AS right_keys,
        (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM {left} GROUP BY {lk})) AS left_multiplicity,
        (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM {right} GROUP BY {rk})) AS right_multiplicity,
        (SELECT CASE WHEN MAX(n) > 1 THEN 'M' ELSE '1' END FROM (SELECT COUNT(*) AS n FROM {left} GROUP BY {lk})) AS left_side,
        (SELECT CASE WHEN MAX(n) > 1 THEN 'M' ELSE '1' END FROM (SELECT COUNT(*) AS n FROM {right} GROUP BY {rk})) AS right_side,
        (SELECT COUNT(*) FROM (SELECT DISTINCT {lk} FROM {left} EXCEPT ALL SELECT DISTINCT {rk} FROM {right})) AS left_missing,
        (SELECT COUNT(*) FROM (SELECT DISTINCT {rk} FROM {right} EXCEPT ALL SELECT DISTINCT {lk} FROM {left})) AS right_missing"""


@query(
    "graph_summary",
    " UNION ALL ".join(
        [
            _edge_sql("lineitem", "l_partkey", "part", "p_partkey"),
            _edge_sql("lineitem", "l_suppkey", "supplier", "s_suppkey"),
            _edge_sql("lineitem", "l_orderkey", "orders", "o_orderkey"),
            _edge_sql("orders", "o_custkey", "customer", "c_custkey"),
            _edge_sql("customer", "c_nationkey", "nation", "n_nationkey"),
        ]
    ),
)
def _(t):
    return star(t).summary()


@query(
    "add_join",
    _edge_sql("orders", "o_custkey", "customer", "c_custkey"),
)
def _(t):
    g = JoinGraph().add_relation("orders", t.orders, y="o_totalprice").add_relation("customer", t.customer)
    return g.add_join("orders", "customer", ["o_custkey"], ["c_custkey"]).summary()


@query(
    "agg_key_multiplicity",
    "SELECT MAX(n) AS multiplicity FROM (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey)",
)
def _(t):
    return star(t).edge_frame("lineitem", "orders").select(F.col("left_multiplicity").alias("multiplicity"))


@query(
    "agg_missing_keys",
    """SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT l_orderkey FROM lineitem EXCEPT ALL SELECT DISTINCT o_orderkey FROM orders)) AS left_missing,
              (SELECT COUNT(*) FROM (SELECT DISTINCT o_orderkey FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem)) AS right_missing""",
)
def _(t):
    return star(t).edge_frame("lineitem", "orders").select("left_missing", "right_missing")


@query("validate_graph", "SELECT CAST(6 AS BIGINT) AS relations, COUNT(*) AS facts FROM lineitem")
def _(t):
    g = star(t)
    g.validate()
    return t.lineitem.agg(F.count("*").alias("facts")).select(F.lit(len(g.relations)).cast("long").alias("relations"), "facts")


@query(
    "infer_feature_types",
    """SELECT 'p_name' AS attribute, CASE WHEN COUNT(DISTINCT p_name) <= 30 THEN 'LCAT' ELSE 'CAT' END AS kind FROM part
       UNION ALL SELECT 'p_type', CASE WHEN COUNT(DISTINCT p_type) <= 30 THEN 'LCAT' ELSE 'CAT' END FROM part
       UNION ALL SELECT 'p_brand', CASE WHEN COUNT(DISTINCT p_brand) <= 30 THEN 'LCAT' ELSE 'CAT' END FROM part
       UNION ALL SELECT 'p_size', CASE WHEN COUNT(*) > 0 THEN 'NUM' END FROM part
       UNION ALL SELECT 'p_retailprice', CASE WHEN COUNT(*) > 0 THEN 'NUM' END FROM part""",
)
def _(t):
    kinds = star(t).infer_features("part", exclude=["p_partkey"])
    return t.spark.createDataFrame(list(kinds.items()), "attribute string, kind string")


@query(
    "join_full_graph",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, p_size, s_acctbal, o_totalprice, c_mktsegment, n_regionkey FROM {JOINED}",
)
def _(t):
    wanted = {
        "lineitem": ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
        "part": ["p_size"],
        "supplier": ["s_acctbal"],
        "orders": ["o_totalprice"],
        "customer": ["c_mktsegment"],
        "nation": ["n_regionkey"],
    }
    joined = star(t).full_join(wanted)
    return joined.select(*[F.col(f"{r}__{c}").alias(c) for r, cs in wanted.items() for c in cs])


# -- messages -----------------------------------------------------------------


@query(
    "lift",
    """SELECT l_quantity, l_discount, l_partkey, l_suppkey, l_orderkey,
              l_extendedprice - 50000.0 AS s, CAST(1 AS BIGINT) AS c FROM lineitem""",
)
def _(t):
    return M.lift(star(t), F.col("l_extendedprice") - 50000.0)


@query(
    "annotated_totals",
    f"""SELECT n_nationkey, ROUND(SUM(l_extendedprice), 2) AS s, COUNT(*) AS c FROM {JOINED}
        WHERE p_size > 25 AND n_regionkey <> 2 GROUP BY 1""",
)
def _(t):
    """Totals per nation under predicates on two dimensions, one of them behind two others."""
    g = star(t).annotate("part", F.col("p_size") > 25).annotate("nation", F.col("n_regionkey") != 2)
    rows = M.calibrate(g, M.lift(g))["nation"]
    return M.absorption(rows, ["n_nationkey"]).select("n_nationkey", F.round("s", 2).alias("s"), "c")


@query("agg_semiring_sum", "SELECT ROUND(SUM(l_extendedprice), 2) AS s, COUNT(*) AS c FROM lineitem")
def _(t):
    return M.semiring_sum(M.lift(star(t))).select(F.round("s", 2).alias("s"), "c")


@query(
    "agg_message",
    "SELECT l_orderkey AS o_orderkey, ROUND(SUM(l_extendedprice), 2) AS s, COUNT(*) AS c FROM lineitem GROUP BY 1",
)
def _(t):
    out = M.full_message(M.lift(star(t)), ["l_orderkey"], ["o_orderkey"])
    return out.select("o_orderkey", F.round("s", 2).alias("s"), "c")


@query(
    "send_message",
    "SELECT DISTINCT p_partkey AS l_partkey FROM part WHERE p_size > 25",
)
def _(t):
    """Selection message: keys of parts that survive a filter."""
    g = star(t).annotate("part", F.col("p_size") > 25)
    if M.message_kind(g, "part", []) != M.SELECTION:
        raise AssertionError("a dimension without full messages sends its keys only")
    return M.selection_message(g.relations["part"].rows(), ["p_partkey"], ["l_partkey"])


@query(
    "partition_fact",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'""",
)
def _(t):
    g = star(t)
    rows = M.restrict_facts(g, M.lift(g), "customer", F.col("c_mktsegment") == "MACHINERY")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")


@query(
    "calibrate",
    f"""SELECT n_nationkey, n_regionkey, ROUND(SUM(l_extendedprice), 2) AS s, COUNT(*) AS c FROM {JOINED} GROUP BY ALL""",
)
def _(t):
    """Sums at the far end of the graph: fact, orders, customer, nation."""
    g = star(t)
    rows = M.calibrate(g, M.lift(g))["nation"]
    return rows.select("n_nationkey", "n_regionkey", F.round("s", 2).alias("s"), "c")


@query(
    "agg_absorption",
    "SELECT p_size, ROUND(SUM(l_extendedprice), 2) AS s, COUNT(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
)
def _(t):
    g = star(t)
    out = M.absorption(M.calibrate(g, M.lift(g))["part"], ["p_size"])
    return out.select("p_size", F.round("s", 2).alias("s"), "c")


# -- splits -------------------------------------------------------------------

# scores are relative to the total, so that both sides round the same digits
_SCORE = "(ls * ls / lc + (ts - ls) * (ts - ls) / (tc - lc)) / (ts * ts / tc)"


def _root(t, g):
    """Feature sums of all rows as one node, the node's totals, and whether a feature has too many values for one task."""
    facts = M.lift(g).withColumns({"tree": F.lit(0), "node": F.lit(1).cast("long")})
    model = DecisionTree()
    model._sizes(g)  # only relations measured to be small are broadcast
    values = model._values(g, facts)
    totals = M.semiring_sum(facts, ["tree", "node"]).select(
        "tree", "node", F.col("s").alias("total_s"), F.col("c").cast("double").alias("total_c")
    )
    return values, totals, model._long


def _relative(scored, totals):
    out = scored.join(F.broadcast(totals), ["tree", "node"])
    ratio = F.col("score") / (F.col("total_s") * F.col("total_s") / F.col("total_c"))
    return out.withColumn("rel_score", F.round(ratio, 9))


def _lone(t, **features):
    g = JoinGraph().add_relation("lineitem", t.lineitem, y="l_extendedprice")
    g.add_relation("part", t.part, **features)
    return g.add_join("lineitem", "part", ["l_partkey"], ["p_partkey"])


@query(
    "split_num",
    f"""WITH g AS (SELECT p_size AS v, SUM(l_extendedprice) AS s, COUNT(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
        w AS (SELECT v, SUM(s) OVER (ORDER BY v) AS ls, SUM(c) OVER (ORDER BY v) AS lc, SUM(s) OVER () AS ts, SUM(c) OVER () AS tc FROM g)
        SELECT CAST(v AS DOUBLE) AS num, ROUND(ls, 2) AS ls, CAST(lc AS BIGINT) AS lc, ROUND({_SCORE}, 9) AS rel_score FROM w WHERE lc < tc""",
)
def _(t):
    scored = _relative(*_scored(t, _lone(t, X=["p_size"])))
    return scored.select("num", F.round("ls", 2).alias("ls"), "lc", "rel_score")


def _scored(t, g):
    values, totals, long = _root(t, g)
    # many rows are added up in partitions of bounded size; the running sums over slices read the sums several times
    rows = sum(r.frame.count() for r in g.relations.values())
    if long or rows > group_rows(t.spark):
        with spread_over(t.spark, rows):
            values = cut(values)
    return P.scored_splits(values, totals, long), totals


@query(
    "split_cat",
    f"""WITH w AS (SELECT p_brand AS cat, SUM(l_extendedprice) AS ls, COUNT(*) AS lc, (SELECT SUM(l_extendedprice) FROM lineitem) AS ts,
                          (SELECT COUNT(*) FROM lineitem) AS tc FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
        SELECT cat, ROUND(ls, 2) AS ls, lc, ROUND({_SCORE}, 9) AS rel_score FROM w WHERE lc < tc""",
)
def _(t):
    scored = _relative(*_scored(t, _lone(t, category=["p_brand"])))
    return scored.select("cat", F.round("ls", 2).alias("ls"), "lc", "rel_score")


@query(
    "split_lcat",
    f"""WITH g AS (SELECT p_type AS v, SUM(l_extendedprice) AS s, COUNT(*) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
        w AS (SELECT v, SUM(s) OVER o AS ls, SUM(c) OVER o AS lc, SUM(s) OVER () AS ts, SUM(c) OVER () AS tc FROM g
              WINDOW o AS (ORDER BY s / c, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT v AS cat, ROUND(ls, 2) AS ls, CAST(lc AS BIGINT) AS lc, ROUND({_SCORE}, 9) AS rel_score FROM w WHERE lc < tc""",
)
def _(t):
    scored = _relative(*_scored(t, _lone(t, categorical=["p_type"])))
    return scored.select("cat", F.round("ls", 2).alias("ls"), "lc", "rel_score")


@query(
    "split_null",
    f"""WITH j AS (SELECT CASE WHEN p_size > 40 THEN NULL ELSE p_size END AS v, l_extendedprice AS x FROM lineitem JOIN part ON l_partkey = p_partkey),
        w AS (SELECT SUM(CASE WHEN v IS NULL THEN x END) AS ls, COUNT(*) FILTER (v IS NULL) AS lc, SUM(x) AS ts, COUNT(*) AS tc FROM j)
        SELECT ROUND(ls, 2) AS ls, lc, ROUND({_SCORE}, 9) AS rel_score FROM w""",
)
def _(t):
    g = JoinGraph().add_relation("lineitem", t.lineitem, y="l_extendedprice")
    part = t.part.withColumn("p_size", F.when(F.col("p_size") <= 40, F.col("p_size")))
    g.add_relation("part", part, X=["p_size"]).add_join("lineitem", "part", ["l_partkey"], ["p_partkey"])
    scored = _relative(*_scored(t, g)).where(F.col("kind") == P.NULL_SPLIT)
    return scored.select(F.round("ls", 2).alias("ls"), "lc", "rel_score")


@query(
    "sibling_totals",
    """WITH j AS (SELECT p_size, l_extendedprice AS x FROM lineitem JOIN part ON l_partkey = p_partkey),
            v AS (SELECT DISTINCT p_size FROM j)
       SELECT CAST(v.p_size AS DOUBLE) AS num, ROUND(SUM(x), 2) AS rs, COUNT(*) AS rc FROM v JOIN j ON j.p_size > v.p_size GROUP BY v.p_size""",
)
def _(t):
    """Right side of every split as node total minus left side."""
    scored, totals = _scored(t, _lone(t, X=["p_size"]))
    out = scored.join(F.broadcast(totals), ["tree", "node"])
    rest = (F.col("total_c") - F.col("lc")).cast("long")
    return out.select("num", F.round(F.col("total_s") - F.col("ls"), 2).alias("rs"), rest.alias("rc"))


_BATCHED = """SELECT '{f}' AS feature, v, SUM(s) OVER (ORDER BY v) AS ls, SUM(c) OVER (ORDER BY v) AS lc, SUM(s) OVER () AS ts, SUM(c) OVER () AS tc
              FROM (SELECT CAST({f} AS DOUBLE) AS v, SUM(l_extendedprice) AS s, COUNT(*) AS c FROM {j} GROUP BY 1)"""
_FEATURES = ["l_quantity", "l_discount", "p_size", "p_retailprice", "s_acctbal", "o_totalprice", "n_regionkey"]


def _numeric_star(t):
    g = star(t)
    for r in g.relations.values():
        r.features = {f: k for f, k in r.features.items() if k == "NUM"}
    return g


@query(
    "split_batched",
    f"""WITH w AS ({' UNION ALL '.join(_BATCHED.format(f=f, j=JOINED) for f in _FEATURES)}),
        s AS (SELECT feature, v, lc, {_SCORE} AS score FROM w WHERE lc < tc),
        r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY feature ORDER BY score DESC, v) AS rn FROM s)
        SELECT feature, v AS num, CAST(lc AS BIGINT) AS lc, ROUND(score, 9) AS rel_score FROM r WHERE rn = 1""",
)
def _(t):
    """Best split of every feature of every relation, in one query over the graph."""
    g = _numeric_star(t)
    scored = _relative(*_scored(t, g))
    named = [(i, j, f) for i, r in enumerate(g.relations.values()) for j, f in enumerate(r.features)]
    names = t.spark.createDataFrame(named, "rel int, feat int, feature string")
    best = scored.groupBy("rel", "feat").agg(
        F.min_by(F.struct("num", "lc", "rel_score"), F.struct(-F.col("score"), "num")).alias("b")
    )
    return best.join(F.broadcast(names), ["rel", "feat"]).select("feature", "b.*")


@query(
    "top_split",
    f"""WITH w AS ({' UNION ALL '.join(_BATCHED.format(f=f, j=JOINED) for f in _FEATURES)}),
        s AS (SELECT feature, v, lc, {_SCORE} AS score FROM w WHERE lc < tc)
        SELECT v AS num, CAST(lc AS BIGINT) AS lc, ROUND(score, 9) AS rel_score FROM s ORDER BY score DESC LIMIT 1""",
)
def _(t):
    scored, totals = _scored(t, _numeric_star(t))
    return _relative(P.best_splits(scored), totals).select("num", "lc", "rel_score")


# -- models -------------------------------------------------------------------


@query("dummy_model", "SELECT l_orderkey, l_linenumber, ROUND((SELECT AVG(l_extendedprice) FROM lineitem), 6) AS prediction FROM lineitem")
def _(t):
    g = small_star(t)
    return _predicted(DummyModel().fit(g, skip_check=True), g)


def _predicted(model, g):
    out = model.predict(g)
    return out.select("l_orderkey", "l_linenumber", F.round("prediction", 6).alias("prediction"))


@query(
    "decision_tree",
    f"""WITH j AS (SELECT l_orderkey, l_linenumber, CAST(p_size AS DOUBLE) AS v, l_extendedprice AS x FROM lineitem JOIN part ON l_partkey = p_partkey),
        g AS (SELECT v, SUM(x) AS s, COUNT(*) AS c FROM j GROUP BY 1),
        w AS (SELECT v, SUM(s) OVER (ORDER BY v) AS ls, SUM(c) OVER (ORDER BY v) AS lc, SUM(s) OVER () AS ts, SUM(c) OVER () AS tc FROM g),
        b AS (SELECT *, ls * ls / lc + (ts - ls) * (ts - ls) / (tc - lc) AS score FROM w WHERE lc < tc ORDER BY score DESC, v LIMIT 1)
        SELECT l_orderkey, l_linenumber,
               ROUND(CASE WHEN j.v <= b.v THEN b.ls / b.lc ELSE (b.ts - b.ls) / (b.tc - b.lc) END, 6) AS prediction FROM j, b""",
)
def _(t):
    """A stump on one dimension feature, so that SQL can follow."""
    g = _lone(t, X=["p_size"])
    return _predicted(DecisionTree(num_leaves=2, max_depth=1).fit(g, skip_check=True), g)


def _stump(name: str, rows: str, value: str, where: str = "TRUE") -> str:
    """CTE ``name``(v, ls, lc, ts, tc): the best cut of ``rows`` by v, and sums of ``value`` on its left and in all."""
    return f"""{name} AS (
      SELECT *, ls * ls / lc + (ts - ls) * (ts - ls) / (tc - lc) AS score FROM (
        SELECT v, SUM(s) OVER (ORDER BY v) AS ls, SUM(c) OVER (ORDER BY v) AS lc, SUM(s) OVER () AS ts, SUM(c) OVER () AS tc
        FROM (SELECT v, SUM({value}) AS s, COUNT(*) AS c FROM {rows} WHERE {where} GROUP BY 1))
      WHERE lc < tc ORDER BY score DESC, v LIMIT 1)"""


def _leaf(name: str, v: str = "j.v") -> str:
    return f"CASE WHEN {v} <= {name}.v THEN {name}.ls / {name}.lc ELSE ({name}.ts - {name}.ls) / ({name}.tc - {name}.lc) END"


_SIZED = "j AS (SELECT l_orderkey, l_linenumber, l_shipdate, CAST(p_size AS DOUBLE) AS v, l_extendedprice AS x FROM lineitem JOIN part ON l_partkey = p_partkey)"
_FINE = "l_orderkey, l_linenumber"


@query(
    "decision_tree_deep",
    f"""WITH {_SIZED}, {_stump("b", "j", "x")},
        l AS (SELECT j.v, x FROM j, b WHERE j.v <= b.v), {_stump("bl", "l", "x")},
        r AS (SELECT j.v, x FROM j, b WHERE j.v > b.v), {_stump("br", "r", "x")}
        SELECT {_FINE}, ROUND(CASE WHEN j.v <= b.v THEN {_leaf("bl")} ELSE {_leaf("br")} END, 6) AS prediction FROM j, b, bl, br""",
)
def _(t):
    """Two levels on one dimension feature, four leaves."""
    g = _lone(t, X=["p_size"])
    return _predicted(DecisionTree(num_leaves=4, max_depth=2).fit(g, skip_check=True), g)


@query(
    "gradient_boosting",
    f"""WITH {_SIZED}, m AS (SELECT AVG(x) AS a FROM j), j0 AS (SELECT j.*, x - a AS s0 FROM j, m), {_stump("b", "j0", "s0")},
        j1 AS (SELECT j.*, s0 - 0.5 * ({_leaf("b")}) AS s1 FROM j0 j, b), {_stump("d", "j1", "s1")},
        j2 AS (SELECT j.*, s1 - 0.5 * ({_leaf("d")}) AS s2 FROM j1 j, d), {_stump("e", "j2", "s2")}
        SELECT {_FINE}, ROUND(a + 0.5 * ({_leaf("b")}) + 0.5 * ({_leaf("d")}) + 0.5 * ({_leaf("e")}), 6) AS prediction FROM j, m, b, d, e""",
)
def _(t):
    """Three stumps, each on half of what the ones before explain."""
    g = _lone(t, X=["p_size"])
    return _predicted(GradientBoosting(num_leaves=2, max_depth=1, learning_rate=0.5, n_estimators=3).fit(g, skip_check=True), g)


@query("gradient_boosting_deep")
def _(t):
    g = small_star(t)
    return _predicted(GradientBoosting(num_leaves=4, max_depth=2, learning_rate=0.5, n_estimators=3).fit(g, skip_check=True), g)


@query(
    "warm_start",
    f"""WITH {_SIZED}, m AS (SELECT AVG(x) AS a FROM j), j0 AS (SELECT j.*, x - a AS s0 FROM j, m), {_stump("b", "j0", "s0")},
        j1 AS (SELECT j.*, s0 - 0.5 * ({_leaf("b")}) AS s1 FROM j0 j, b), {_stump("d", "j1", "s1", "l_shipdate > TIMESTAMP '1998-01-01'")}
        SELECT {_FINE}, ROUND(a + 0.5 * ({_leaf("b")}) + 0.5 * ({_leaf("d")}), 6) AS prediction FROM j, m, b, d""",
)
def _(t):
    """A tree on all rows, one more on the newer ones."""
    g = _lone(t, X=["p_size"])
    model = GradientBoosting(2, 0.5, 1, n_estimators=1, incremental_estimators=1).fit(g, skip_check=True)
    newer = F.col("l_shipdate") > F.lit("1998-01-01").cast("timestamp_ntz")
    return _predicted(model.fit(g, skip_check=True, warm_start=True, where=newer), g)


def _drawn(i: int) -> str:
    return f"(l_orderkey * 7919 + l_linenumber * 104729 + {i} * 15485) % 1000 < 500"


def _forest_sql(trees: int) -> str:
    parts = [f"WITH {_SIZED}"]
    for i in range(trees):
        parts.append(f"m{i} AS (SELECT AVG(x) AS a FROM j WHERE {_drawn(i)}), j{i} AS (SELECT j.*, x - a AS s FROM j, m{i} WHERE {_drawn(i)})")
        parts.append(_stump(f"b{i}", f"j{i}", "s"))
    value = " + ".join(f"m{i}.a + {_leaf(f'b{i}')}" for i in range(trees))
    tables = ", ".join(f"m{i}, b{i}" for i in range(trees))
    return f"{', '.join(parts)} SELECT {_FINE}, ROUND(({value}) / {trees}, 6) AS prediction FROM j, {tables}"


@query("random_forest", _forest_sql(3))
def _(t):
    """Three stumps on samples of the rows that arithmetic on the keys draws."""
    g = _lone(t, X=["p_size"])
    model = RandomForest(num_leaves=2, max_depth=1, subsample=0.5, n_estimators=3, members=lambda i: F.expr(_drawn(i)))
    return _predicted(model.fit(g, skip_check=True), g)


def fixed_tree(rate: float = 0.5) -> GradientBoosting:
    """A hand-made model with two levels over part and supplier."""
    model = GradientBoosting(num_leaves=4, max_depth=2)
    nodes = {
        1: Node(1, 0, 0.0, 10.0, Split("part", "p_size", "NUM", 25.0)),
        2: Node(2, 1, 0.0, 5.0, Split("part", "p_type", "LCAT", ["ECONOMY", "PROMO"])),
        3: Node(3, 1, 50.0, 5.0),
        4: Node(4, 2, -20.0, 2.0),
        5: Node(5, 2, 30.0, 3.0),
    }
    model.constant = 100.0
    model.trees = [Tree(nodes, {1, 2}, rate)]
    return model


_CASE = "CASE WHEN p_size <= 25 THEN CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN -5.0 ELSE 5.0 END ELSE 5.0 END"


@query("model_to_case", f"SELECT p_partkey, CAST(100.0 + {_CASE} AS DOUBLE) AS prediction FROM part")
def _(t):
    """The generated SQL text of a model, run as SQL."""
    t.part.createOrReplaceTempView("foreloom_model_input")
    return t.spark.sql(f"SELECT p_partkey, {fixed_tree().to_sql()} AS prediction FROM foreloom_model_input")


@query(
    "predict",
    f"SELECT l_orderkey, l_linenumber, CAST(100.0 + {_CASE} AS DOUBLE) AS prediction FROM lineitem JOIN part ON l_partkey = p_partkey",
)
def _(t):
    """Only the one relation that the model reads is joined to the fact rows."""
    return fixed_tree().predict(small_star(t)).select("l_orderkey", "l_linenumber", "prediction")


@query(
    "update_residuals",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, ROUND(l_extendedprice - ({_CASE}), 6) AS s
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def _(t):
    """Fact rows routed by flags of the dimension, then the leaf value taken off."""
    g = JoinGraph().add_relation("lineitem", t.lineitem, X=["l_quantity", "l_orderkey", "l_suppkey"], y="l_extendedprice")
    g.add_relation("part", t.part, X=["p_size"], categorical=["p_type"])
    g.add_join("lineitem", "part", ["l_partkey"], ["p_partkey"])
    model = fixed_tree()
    model._sizes(g)
    tree = model.trees[0]
    base = M.lift(g)
    facts = base.withColumns({"tree": F.lit(0), "node": F.lit(1).cast("long")})
    for number in (1, 2):
        facts, _ = model._route(g, facts, {0: tree.nodes}, [(0, number)])
    out = model._updated(base, facts, tree)
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", F.round("s", 6).alias("s"))


@query("rmse_of_model", f"SELECT ROUND(SQRT(AVG(POW(p_retailprice - (100.0 + {_CASE}), 2))), 6) AS rmse FROM part")
def _(t):
    return fixed_tree().rmse(t.part, "p_retailprice").select(F.round("rmse", 6).alias("rmse"))


@query("model_sse", f"SELECT ROUND(SUM(POW(p_retailprice - (100.0 + {_CASE}), 2)), 2) AS sse FROM part")
def _(t):
    return fixed_tree().sse(t.part, "p_retailprice").select(F.round("sse", 2).alias("sse"))
