"""Merkle manifest of a dataset: nodes labelled with the intervals of leaf ranks that they cover."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreloom.llm.common import discard, held_out, park
from foreloom.llm.prefix import prefixes

#: Children of a node.
ARITY = 3
#: Levels of a band; a block of a band holds up to ARITY ** BAND nodes, which bounds the arrays of a row.
BAND = 4
WIDTH = ARITY**BAND

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return digest(*[_field(c) for c in columns])


def _runs(level: Column) -> Column:
    """The nodes above ``level`` (array of lo, hi, digest): each covers the intervals of its run and hashes its digests."""
    places = F.sequence(F.lit(0), F.ceil(F.size(level) / ARITY).cast("int") - 1)
    cut = F.transform(places, lambda i: F.slice(level, i * ARITY + 1, ARITY))
    return F.transform(
        cut,
        lambda run: F.struct(
            run[0]["lo"].alias("lo"),
            F.element_at(run, -1)["hi"].alias("hi"),
            F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest"),
        ),
    )


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, held, level0 .. level4): one row for each block of a band of levels.

    ``nodes`` is (tree, at, lo, hi, digest, data), ``at`` from 0 in the order of the tree's level.  A first block that
    is not full is its whole tree, whose levels end where one node remains; all other blocks take every level.
    """
    held = F.struct("at", "lo", "hi", "digest", "data")
    out = nodes.groupBy("tree", F.floor(F.col("at") / WIDTH).alias("block")).agg(F.sort_array(F.collect_list(held)).alias("held"))
    out = out.withColumn("level0", F.transform("held", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["digest"].alias("digest"))))
    whole = (F.col("block") == 0) & (F.size("held") < WIDTH)
    for k in range(BAND):
        under = F.col(f"level{k}")
        over = F.when(under.isNotNull() & (~whole | (F.size(under) > 1)), _runs(under))
        out = out.withColumn(f"level{k + 1}", over)
    return out


def _tops(blocks: DataFrame) -> DataFrame:
    """The last node of every block, as the nodes of the next band."""
    top = F.coalesce(*[F.col(f"level{k}") for k in range(BAND, -1, -1)])[0]
    return blocks.select(
        "tree", F.col("block").alias("at"), top["lo"].alias("lo"), top["hi"].alias("hi"), top["digest"].alias("digest"),
        F.lit(None).cast("string").alias("data"),
    )


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The bands of blocks of all trees from their leaves up, until each tree has one node; every band is written once."""
    bands = []
    while True:
        blocks = park(_blocks(nodes), "merkle-band")
        bands.append(blocks)
        # a band that only hands single nodes on is the last one
        if blocks.where((F.col("block") > 0) | (F.size("held") > 1)).isEmpty():
            return bands
        nodes = _tops(blocks)


def _inside(parent: Column):
    return lambda x: (x["lo"] >= parent["lo"]) & (x["hi"] <= parent["hi"])


def _sides(node: Column) -> Column:
    """Of a node of a block, for each level of the band: the digests beside it in its run, left and right.

    The parent is the node whose interval contains the node's own; the siblings are what is left of the parent's
    interval without it.
    """
    out = []
    place = F.pmod(node["at"], F.lit(WIDTH)).cast("int")
    for k in range(BAND):
        level, above = F.col(f"level{k}"), F.col(f"level{k + 1}")
        parent = F.get(above, F.floor(place / ARITY ** (k + 1)).cast("int"))
        run = F.slice(level, F.floor(place / ARITY ** (k + 1)).cast("int") * ARITY + 1, ARITY)
        run = F.filter(run, _inside(parent))
        text = lambda those: F.array_join(F.transform(those, lambda x: x["digest"]), "")
        left = text(F.filter(run, lambda x: x["hi"] <= node["lo"]))
        right = text(F.filter(run, lambda x: x["lo"] >= node["hi"]))
        out.append(F.when(above.isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def descend(bands: list[DataFrame], above: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(tree, at, digest, data, path, labels): every leaf with the siblings on its way to what stands ``above``.

    ``above`` is (tree, at, path, labels) for the single node that each tree ends in.  Band by band, blocks are joined
    with the node of the next band that covers them; rows move a block at a time.
    """
    for blocks in reversed(bands):
        up = above.select(
            F.col("tree").alias("_tree"), F.col("at").alias("_at"), F.col("path").alias("_path"), *[F.col(x) for x in labels]
        ).hint("merge")
        met = blocks.join(up, (F.col("tree") == F.col("_tree")) & (F.col("block") == F.col("_at")))
        nodes = F.transform("held", lambda x: F.struct(x["at"].alias("at"), x["digest"].alias("digest"), x["data"].alias("data"), _sides(x).alias("sides")))
        rows = met.select("tree", "_path", *labels, F.explode(nodes).alias("node"))
        above = rows.select(
            "tree", "node.at", "node.digest", "node.data", F.concat("node.sides", "_path").alias("path"), *labels
        )
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def proof(path: Column) -> Column:
    """Digest of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _named(source: Column) -> Column:
    """A key that is never null; null comes first, all others in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


@dataclass
class Manifest:
    """The written bands of a dataset's trees and of the tree over their roots."""

    kind: str
    bands: list[DataFrame]
    over: list[DataFrame]

    @property
    def root(self) -> DataFrame:
        """(root): one row, none of an empty dataset."""
        return _tops(self.over[-1]).select(F.col("digest").alias("root"))

    def nodes(self) -> DataFrame:
        """(source, level, lo, hi, digest) for every node of the sources' trees, leaves at level 0.

        ``lo`` and ``hi`` (exclusive) are the leaf ranks that a node covers, so that descendants, ancestors and
        siblings follow from the intervals alone.
        """
        out = None
        for b, blocks in enumerate(self.bands):
            # a band's lowest nodes are the tops of the band below
            for k in range(0 if b == 0 else 1, BAND + 1):
                rows = blocks.where(F.col(f"level{k}").isNotNull()).select("tree", F.lit(b * BAND + k).alias("level"), F.inline(f"level{k}"))
                out = rows if out is None else out.unionAll(rows)
        source = F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).cast(self.kind)
        return out.select(source.alias("source"), "level", "lo", "hi", "digest")

    def proofs(self) -> DataFrame:
        """(leaf, data, path, subroot, root) for every leaf; ``data`` is what was stored beside it."""
        final = _tops(self.over[-1]).select("tree", "at", F.col("digest").alias("root"))
        empty = F.array().cast("array<struct<left:string,right:string>>")
        sources = descend(self.over, final.select("tree", "at", empty.alias("path"), "root"), ("root",))
        # the digest beside a source in the upper tree is its own root
        sources = sources.select(
            F.col("data").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("digest").alias("subroot"), "root"
        )
        return descend(self.bands, sources, ("subroot", "root")).select(F.col("digest").alias("leaf"), "data", "path", "subroot", "root")


def manifest(leaves: DataFrame) -> Manifest:
    """Trees over ``leaves`` (source, order, leaf, data): one a source, leaves in the order of ``order``, null first.

    Leaves of equal order come by their digest; equal rows give equal leaves, so that their order says nothing.  A
    null source is a source of its own and the first one.  Without leaves there are no nodes and no root.
    """
    kind = leaves.schema["source"].dataType.simpleString()
    leaves = park(leaves.select(_named(F.col("source")).alias("tree"), "order", "leaf", "data"), "merkle-leaves")
    ranked = prefixes(leaves, ["tree"], [F.col("order").asc_nulls_first(), F.col("leaf"), F.col("data")])
    at = F.col("rank") - 1
    bands = climb(ranked.select("tree", at.alias("at"), at.alias("lo"), F.col("rank").alias("hi"), F.col("leaf").alias("digest"), "data"))
    discard(leaves)
    roots = _tops(bands[-1]).select("tree", "digest")
    ranked = prefixes(roots, [], [F.col("tree")])
    over = climb(
        ranked.select(
            F.lit("").alias("tree"), at.alias("at"), at.alias("lo"), F.col("rank").alias("hi"), "digest", F.col("tree").alias("data")
        )
    )
    return Manifest(kind, bands, over)


def verified(docs: DataFrame, tampered: Column | None = None, change=None) -> DataFrame:
    """Every document with its place in the manifest, and whether its present state still folds to the root.

    (doc_id, leaf, subroot, root, proof_sha256) are of the documents as they are; ``folded_root`` is recomputed from
    the leaf of the document after ``change`` (a function of the text) where ``tampered`` holds, with the siblings of
    the manifest; ``verified`` says whether it is the root.  By default, where 2 divides the CRC-32 of the id as text
    (a null id as the empty text), line feeds are deleted.

    Null in a column is a value of its own, told apart from the empty text; repeated rows are leaves of their own and
    take the same proof up to their places; other columns of ``docs`` are neither hashed nor returned, whatever their
    names.  An empty table gives an empty result.
    """
    named = docs.select(*[F.col(f"`{c}`").alias(c) for c in FIELDS])
    if tampered is None:
        tampered = held_out(F.col("doc_id"), 2, 0)
    change = change or (lambda text: F.replace(text, F.lit("\n"), F.lit("")))
    columns = [F.col(c) for c in FIELDS]
    altered = leaf_of([*columns[:-1], F.when(tampered, change(F.col("text"))).otherwise(F.col("text"))])
    kind = named.schema["doc_id"].dataType.simpleString()
    leaves = named.select(
        F.col("source"), F.col("doc_id").alias("order"), leaf_of(columns).alias("leaf"),
        # the id as text stands behind the altered leaf, whose length is fixed
        F.concat(altered, F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))).alias("data"),
    )
    out = manifest(leaves).proofs()
    doc_id = F.when(F.length("data") > 64, F.substring("data", 66, 1 << 30))
    out = out.select(
        doc_id.cast(kind).alias("doc_id"), "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        folded(F.substring("data", 1, 64), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 is written out over the bytes of the decimal id, bit by bit; levels are built by recursion.
SQL = """
WITH RECURSIVE raw AS (
  SELECT doc_id, source, lang, n_chars, text,
         list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)::BIGINT[]),
             lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents
), leaves AS (
  SELECT doc_id, source,
         sha256(concat(d, s, l, n, coalesce(strlen(text)::VARCHAR || ':' || text, '-'))) AS leaf,
         sha256(concat(d, s, l, n, coalesce(strlen(cut)::VARCHAR || ':' || cut, '-'))) AS altered,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n_leaves
  FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id, '-') AS d,
               coalesce(strlen(source)::VARCHAR || ':' || source, '-') AS s,
               coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') AS l,
               coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars, '-') AS n,
               CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut
        FROM raw)
), up(source, lvl, pos, n, h) AS (
  SELECT source, 0, pos, n_leaves, leaf FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, lvl, pos // 3
), subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1
), top(lvl, pos, n, h) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 3, max((n + 2) // 3), sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3
), low AS (
  SELECT d.doc_id, p.lvl, coalesce(string_agg(p.h, '' ORDER BY p.pos) FILTER (p.pos < d.pos // (3 ** p.lvl)::BIGINT), '') AS lft,
         coalesce(string_agg(p.h, '' ORDER BY p.pos) FILTER (p.pos > d.pos // (3 ** p.lvl)::BIGINT), '') AS rgt
  FROM leaves d JOIN up p ON p.source IS NOT DISTINCT FROM d.source AND p.n > 1 AND p.pos // 3 = d.pos // (3 ** (p.lvl + 1))::BIGINT
  GROUP BY d.doc_id, p.lvl
), high AS (
  SELECT s.source, p.lvl, coalesce(string_agg(p.h, '' ORDER BY p.pos) FILTER (p.pos < s.pos // (3 ** p.lvl)::BIGINT), '') AS lft,
         coalesce(string_agg(p.h, '' ORDER BY p.pos) FILTER (p.pos > s.pos // (3 ** p.lvl)::BIGINT), '') AS rgt
  FROM subroots s JOIN top p ON p.n > 1 AND p.pos // 3 = s.pos // (3 ** (p.lvl + 1))::BIGINT
  GROUP BY s.source, p.lvl
), steps AS (
  SELECT doc_id, lvl, lft, rgt FROM low
  UNION ALL
  SELECT d.doc_id, 1000 + h.lvl, h.lft, h.rgt FROM leaves d JOIN high h ON h.source IS NOT DISTINCT FROM d.source
), paths AS (
  SELECT d.doc_id, d.source, d.leaf, d.altered, coalesce(string_agg(s.lft || s.rgt, '' ORDER BY s.lvl), '') AS beside,
         list(s.lft ORDER BY s.lvl) FILTER (s.lvl IS NOT NULL) AS ls, list(s.rgt ORDER BY s.lvl) FILTER (s.lvl IS NOT NULL) AS rs
  FROM leaves d LEFT JOIN steps s ON s.doc_id = d.doc_id GROUP BY ALL
), fold(doc_id, k, h) AS (
  SELECT doc_id, 0, altered FROM paths
  UNION ALL
  SELECT f.doc_id, f.k + 1, sha256(p.ls[f.k + 1] || f.h || p.rs[f.k + 1]) FROM fold f JOIN paths p ON p.doc_id = f.doc_id AND f.k < len(p.ls)
)
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(p.beside) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM paths p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
JOIN fold f ON f.doc_id = p.doc_id AND f.k = coalesce(len(p.ls), 0)
CROSS JOIN (SELECT h FROM top WHERE n = 1) t
"""
