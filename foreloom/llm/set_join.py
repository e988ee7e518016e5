"""Exact Jaccard join of documents on word shingles, with skips by position and by answers already computed."""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreloom.llm.collocations import LETTERS, WORDS, Polynomial
from foreloom.llm.common import discard, mixed, park, raw, slices, small
from foreloom.llm.components import components, joined
from foreloom.llm.prefix import numbered

SLICES = 64


@dataclass(frozen=True)
class Join:
    """Parameters of the join.

    ``sketch_bits``: the table of shingle counts that orders the shingles has two to this many places, at any size of
    the input; what it mixes up costs time, never a link.  ``bitmap``: bits of the parity map of a set.  ``block``:
    sets of an index list that one task holds.
    """

    words: int = 3
    percent: int = 90
    sketch_bits: int = 20
    bitmap: int = 2048
    block: int = 256

    def apart(self, sizes):
        """The most elements in which two linked sets can differ, given the sum of their sizes."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def probe(self, n):
        """Length of the prefix in which a set meets every linked set that is not larger."""
        return n - -(-n * self.percent // 100) + 1

    def index(self, n):
        """Length of the prefix in which a set meets every linked set that is not smaller."""
        return n - -(-n * 2 * self.percent // (100 + self.percent)) + 1


class Shingles:
    """Sets of hashed word shingles of many texts at a time, without a Python step per word."""

    WINDOW = 1 << 20
    GAP = re.compile(rb"[ \t-\r]")
    WORD = re.compile(rb"[^ \t-\r]")

    def __init__(self, words: int):
        self.words = words
        self.letters, self.sequence = Polynomial(LETTERS[0]), Polynomial(WORDS[0])
        self.gap = np.zeros(256, bool)
        self.gap[[32, *range(9, 14)]] = True

    def codes(self, data: bytes):
        x = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(x) + 2, np.int8)
        inside[1:-1] = ~self.gap[x]
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return starts, mixed(self.letters.of(self.letters.prefix(x.astype(np.uint64) + np.uint64(1)), starts, ends))

    def together(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(distinct hashes of each text in order, offsets): ASCII case is folded; fewer words than a shingle are one."""
        n, k = self.words, len(texts)
        data = b"\n".join(t.lower() for t in texts) + b"\n"
        starts, codes = self.codes(data)
        places = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        first = np.searchsorted(starts, places)
        count = np.diff(first)
        of = np.repeat(np.arange(k), count)
        line = self.sequence.prefix(codes)
        at = np.flatnonzero(of[: max(len(of) - n + 1, 0)] == of[n - 1 :])
        short = np.flatnonzero((count > 0) & (count < n))
        whole = mixed(self.sequence.of(line, first[short], first[short] + count[short])) + count[short].astype(np.uint64)
        fp = np.concatenate([mixed(self.sequence.of(line, at, at + n)), mixed(whole)])
        of = np.concatenate([of[at], short])
        order = np.lexsort((fp, of))
        fp, of = fp[order], of[order]
        new = np.ones(len(fp), bool)
        new[1:] = (fp[1:] != fp[:-1]) | (of[1:] != of[:-1])
        fp, of = fp[new], of[new]
        return fp, np.searchsorted(of, np.arange(k + 1))

    def long(self, text: bytes) -> np.ndarray:
        """The set of a long text, read in parts that overlap by a shingle less one word."""
        text, n, begin, found = text.lower(), self.words, 0, []
        while begin < len(text):
            cut = self.GAP.search(text, min(begin + self.WINDOW, len(text)))
            own = end = cut.start() if cut else len(text)
            for _ in range(n - 1):
                word = self.WORD.search(text, end)
                stop = self.GAP.search(text, word.start()) if word else None
                end = stop.start() if stop else len(text)
            part = text[begin:end] + b"\n"
            starts, codes = self.codes(part)
            at = np.arange(max(len(codes) - n + 1, 0))
            at = at[starts[at] < own - begin]
            found.append(np.unique(mixed(self.sequence.of(self.sequence.prefix(codes), at, at + n))))
            begin = own if own > begin else len(text)
        out = np.unique(np.concatenate(found))
        return out if len(out) else self.together([text])[0]

    def stretches(self, texts: list[bytes]):
        """(number of the first text, hashes, offsets) of stretches of texts."""
        at = size = 0
        for i, t in enumerate([*texts, None]):
            if t is None or len(t) > self.WINDOW or size + len(t) > self.WINDOW:
                if i > at:
                    yield at, *self.together(texts[at:i])
                at, size = i, 0
                if t is not None and len(t) > self.WINDOW:
                    found = self.long(t)
                    yield i, found, np.array([0, len(found)])
                    at = i + 1
                    continue
            size += len(t or b"") + 1


def bitmaps(fp: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """For each set the parity of its elements by place: two maps differ in no more places than the sets in elements."""
    k = len(offsets) - 1
    place = (mixed(fp + np.uint64(11)) >> np.uint64(32)).astype(np.int64) % bits
    flat = np.bincount(np.repeat(np.arange(k), np.diff(offsets)) * bits + place, minlength=k * bits)
    return np.packbits((flat & 1).astype(np.uint8).reshape(k, bits), axis=1)


SCANNED = "row long, doc_id {id}, n long, sig binary, bits binary, slice int, counts binary"


def _scanned(rows: DataFrame, p: Join) -> DataFrame:
    """(row, doc_id, n, sig, bits) for every row, and per task the counts of its shingles in slices of the table."""

    def run(batches):
        shingles, total, kind = Shingles(p.words), np.zeros(1 << p.sketch_bits, np.int64), None
        for part in (part for batch in batches for part in slices(batch)):
            texts, kind = [raw(t) for t in part.column(1).to_pylist()], part.column(2).type
            for at, fp, offsets in shingles.stretches(texts):
                k, n = len(offsets) - 1, np.diff(offsets)
                total += np.bincount((fp >> np.uint64(64 - p.sketch_bits)).astype(np.int64), minlength=len(total))
                sigs = [hashlib.blake2b(fp[offsets[i] : offsets[i + 1]].tobytes(), digest_size=16).digest() if n[i] else None for i in range(k)]
                parity = bitmaps(fp, offsets, p.bitmap)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(at, k), part.column(2).slice(at, k), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()),
                        pa.array([m.tobytes() if s else None for m, s in zip(parity, sigs)], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
                    ],
                    NAMES,
                )
        if kind is None:
            return
        held = total.astype(np.uint32).reshape(SLICES, -1)
        some = np.flatnonzero(held.any(1))
        none = lambda t: pa.nulls(len(some), t)
        packed = [zlib.compress(held[s].tobytes(), 1) for s in some.tolist()]
        yield pa.RecordBatch.from_arrays(
            [none(pa.int64()), none(kind), none(pa.int64()), none(pa.binary()), none(pa.binary()), pa.array(some, pa.int32()), pa.array(packed, pa.binary())],
            NAMES,
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "text", "doc_id").mapInArrow(run, SCANNED.format(id=kind))


NAMES = ["row", "doc_id", "n", "sig", "bits", "slice", "counts"]


def _levels(scanned: DataFrame, p: Join):
    """A byte for each place of the table, growing with the count of the shingles there; its size is a parameter."""

    def run(batches):
        held = {}
        for x in batches:
            for s, counts in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                new = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
                held[s] = held[s] + new if s in held else new
        for s, counts in held.items():
            level = np.minimum(np.round(8 * np.log2(1 + counts)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["slice", "levels"])

    each = (1 << p.sketch_bits) // SLICES
    parts = scanned.where("slice IS NOT NULL").select("slice", "counts").repartition(SLICES, "slice")
    out = bytearray(each * SLICES)
    for x in parts.mapInArrow(run, "slice int, levels binary").collect():  # as many bytes as the table has places
        out[x["slice"] * each : (x["slice"] + 1) * each] = x["levels"]
    return scanned.sparkSession.sparkContext.broadcast(bytes(out))


def _prefixes(rows: DataFrame, levels, p: Join) -> DataFrame:
    """(row, n, prefix): the shingles of a set that come first in the order of counts, as many as a probe needs."""

    def run(batches):
        shingles, level = Shingles(p.words), np.frombuffer(levels.value, np.uint8)
        for part in (part for batch in batches for part in slices(batch)):
            for at, fp, offsets in shingles.stretches([raw(t) for t in part.column(1).to_pylist()]):
                k, n = len(offsets) - 1, np.diff(offsets)
                of = np.repeat(np.arange(k), n)
                order = np.lexsort((fp, level[(fp >> np.uint64(64 - p.sketch_bits)).astype(np.int64)], of))
                place = np.arange(len(fp)) - np.repeat(offsets[:-1], n)
                take = np.where(n > 0, p.probe(n), 0)
                ends = np.concatenate([[0], np.cumsum(take)]).astype(np.int32)
                first = fp[order][place < np.repeat(take, n)]
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(first.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, k), pa.array(n, pa.int64()), lists], ["row", "n", "prefix"])

    return rows.select("row", "text").mapInArrow(run, "row long, n long, prefix array<long>")


def _sets(texts: DataFrame, p: Join) -> DataFrame:
    """(row, set): all hashes of a text in order."""

    def run(batches):
        shingles = Shingles(p.words)
        for part in (part for batch in batches for part in slices(batch)):
            for at, fp, offsets in shingles.stretches([raw(t) for t in part.column(1).to_pylist()]):
                k = len(offsets) - 1
                held = [fp[offsets[i] : offsets[i + 1]].tobytes() for i in range(k)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, k), pa.array(held, pa.binary())], ["row", "set"])

    return texts.select("row", "text").mapInArrow(run, "row long, set binary")


def _verified(pairs: DataFrame, texts: DataFrame, p: Join) -> DataFrame:
    """(a, b, apart, linked) for pairs (a, b): in how many elements their full sets differ, and whether that is a link."""

    def run(batches):
        for x in batches:
            apart, linked = [], []
            for one, two in zip(x.column(2).to_pylist(), x.column(3).to_pylist()):
                one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                both = len(np.intersect1d(one, two, assume_unique=True))
                union = len(one) + len(two) - both
                apart.append(union - both)
                linked.append(100 * both >= p.percent * union)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(apart, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "apart", "linked"])

    pairs = park(pairs, "join-pairs")
    ids = park(pairs.select(F.col("a").alias("row")).unionAll(pairs.select("b")).distinct(), "join-ids")
    sets = park(_sets(texts.join(small(ids), "row", "left_semi"), p), "join-sets")
    one = sets.select(F.col("row").alias("a"), F.col("set").alias("one")).hint("merge")
    two = sets.select(F.col("row").alias("b"), F.col("set").alias("two")).hint("merge")
    met = pairs.join(two, "b").join(one, "a").select("a", "b", "one", "two")
    out = park(met.mapInArrow(run, "a long, b long, apart long, linked boolean"), "join-verified")
    discard(pairs, ids, sets)
    return out


def _lists(prefixes: DataFrame, classes: DataFrame, p: Join) -> tuple[DataFrame, DataFrame]:
    """(members, leaders) of the index lists.

    A list holds the sets of a shingle and a band of sizes; sets whose sizes may be linked share a band.  Lists with
    the same first set are one: ``members`` is (first, band, row, n, pos), ``pos`` the least place of the lists'
    shingles in the set's prefix.  ``leaders`` (a, b) is the first set of the longest list of each set b.
    """
    own = classes.select(F.col("rep").alias("row")).hint("merge")
    at = F.posexplode("prefix").alias("pos", "token")
    entries = park(prefixes.join(own, "row", "left_semi").select("row", "n", at), "join-entries")
    indexed = F.col("pos") < _index(F.col("n"), p)
    held = entries.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.max(indexed).alias("any"))
    held = park(held.where("c > 1 AND any").select("token"), "join-tokens")
    shared = entries.join(held.hint("merge"), "token")
    # a band is a little wider than the sizes of linked sets lie apart, so that rounding does no harm
    band = F.floor(F.log(F.col("n").cast("double")) / (F.log(F.lit(100.0 / p.percent)) * (1 + 1e-9)))
    rows = shared.select("token", "row", "n", "pos", indexed.alias("any"), F.explode(F.array(band, band + 1)).alias("band"))
    rows = park(rows, "join-shared")
    lists = rows.groupBy("token", "band").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("c"), F.max("any").alias("any"))
    lists = park(lists.where("c > 1 AND any").select("token", "band", "first", "c"), "join-lists")
    members = rows.join(lists.hint("merge"), ["token", "band"]).groupBy("first", "band", "row").agg(
        F.min("pos").alias("pos"), F.first("n").alias("n"), F.max("c").alias("c")
    )
    members = park(members, "join-members")
    discard(entries, held, rows, lists)
    best = members.where("first <> row").groupBy("row").agg(F.max_by("first", F.struct("c", "first")).alias("a"))
    return members, best.select("a", F.col("row").alias("b"))


def _index(n: Column, p: Join) -> Column:
    return n - F.ceil(n * (2 * p.percent) / (100 + p.percent) - 1e-9) + 1


def differ(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return np.bitwise_count(one ^ two).sum(1, dtype=np.int64)


def maps(column, p) -> np.ndarray:
    """Parity maps of a column as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), p.bitmap // 64)


def _plausible(pairs: DataFrame, classes: DataFrame, p: Join) -> DataFrame:
    """Of pairs (a, b) those that sizes and parity maps do not rule out."""

    def run(batches):
        for x in batches:
            if len(x):
                n = x.column(2).to_numpy() + x.column(3).to_numpy()
                keep = differ(maps(x.column(4), p), maps(x.column(5), p)) <= p.apart(n)
                yield x.select([0, 1]).filter(pa.array(keep))

    of = lambda end: classes.select(F.col("rep").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"bits{end}")).hint("merge")
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    met = met.where(F.abs(F.col("na") - F.col("nb")) <= F.floor((F.col("na") + F.col("nb")) * (100 - p.percent) / (100 + p.percent) + 1e-9))
    return met.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(run, "a long, b long")


class _Held:
    """The sets of an arrow column of lists of (row, component, n, pos, apart, bits), flat."""

    def __init__(self, column, p: Join):
        held = column.flatten()
        self.offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
        self.row, self.component, self.n, self.pos, self.apart = (held.field(c).to_numpy() for c in ("row", "component", "n", "pos", "apart"))
        self.maps = maps(held.field("bits"), p)


def _survive(x: _Held, y: _Held, i: np.ndarray, j: np.ndarray, p: Join):
    """Of places (i, j) those that may be links between components, with the places in which their maps differ.

    By position: all shingles ahead of the first common one differ.  By the answers of the first set: where it differs
    from one in ``apart`` elements (-1: not known) and from the other in so many that the distance between the two
    is too large, the answer follows from these and the sets themselves are not looked at.
    """
    sizes = x.n[i] + y.n[j]
    most = p.apart(sizes)
    fit = (x.component[i] != y.component[j]) & (x.row[i] != y.row[j])
    fit &= np.abs(x.n[i] - y.n[j]) <= most
    fit &= x.pos[i] + y.pos[j] <= most
    known = (x.apart[i] >= 0) & (y.apart[j] >= 0)
    fit &= ~known | (np.abs(x.apart[i] - y.apart[j]) <= most)
    i, j, most = i[fit], j[fit], most[fit]
    value = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 15):
        part = slice(at, at + (1 << 15))
        value[part] = differ(x.maps[i[part]], y.maps[j[part]])
    fit = value <= most
    return i[fit], j[fit], value[fit]


def forest(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the pairs that join components not yet joined by nearer ones."""
    root, keep = {}, []

    def top(v):
        while root.get(v, v) != v:
            root[v] = root.get(root[v], root[v])
            v = root[v]
        return v

    order = np.argsort(value, kind="stable")
    for k, u, v in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        u, v = top(u), top(v)
        if u != v:
            root[u] = v
            keep.append(k)
    return np.array(keep, np.int64)


def _candidates(members: DataFrame, roots: DataFrame, answers: DataFrame, classes: DataFrame, p: Join, whole: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a list and may be linked.

    Only lists with several components are looked at, cut into blocks by position.  Blocks whose positions together
    are beyond what linked sets of their sizes allow are not paired.  Unless ``whole``, a task hands on no more pairs
    than it takes to connect what may be linked.
    """
    placed = members.join(roots.select(F.col("node").alias("row"), "component").hint("merge"), "row", "left")
    placed = placed.withColumn("component", F.coalesce("component", "row"))
    placed = placed.join(answers.select(F.col("a").alias("first"), F.col("b").alias("row"), "apart").hint("merge"), ["first", "row"], "left")
    apart = F.when(F.col("row") == F.col("first"), F.lit(0)).otherwise(F.coalesce("apart", F.lit(-1)))
    placed = park(placed.select("first", "band", "row", "component", "n", "pos", apart.cast("long").alias("apart")), "join-placed")
    several = placed.groupBy("first", "band").agg(
        F.count(F.lit(1)).alias("size"), (F.min("component") < F.max("component")).alias("open"),
        F.min("n").alias("low"), F.max("n").alias("high"),
    )
    several = park(several.where("open").select("first", "band", "size"), "join-open")
    rows = placed.join(several.hint("merge"), ["first", "band"])
    rows = rows.join(classes.select(F.col("rep").alias("row"), "bits").hint("merge"), "row")
    # positions run from 0 to a tenth of a set: four steps of them, each split further where a list is long
    step = F.least(F.lit(3), F.floor(F.col("pos") * 4 / F.greatest(F.col("n") * (100 - p.percent) / 100, F.lit(1))))
    parts = F.ceil(F.col("size") / (2 * p.block))
    block = F.when(F.col("size") <= p.block, F.lit(0)).otherwise(step * parts + F.pmod(F.xxhash64("row"), parts))
    held = F.struct("row", "component", "n", "pos", "apart", "bits")
    packed = rows.groupBy("first", "band", block.cast("long").alias("block")).agg(
        F.collect_list(held).alias("held"), F.min("pos").alias("pos"), F.max("n").alias("n"),
        F.min("component").alias("low"), F.max("component").alias("high"), F.first("size").alias("size"),
    )
    packed = park(packed, "join-blocks")
    discard(placed, several)

    def pairs_of(x: _Held, y: _Held, i, j):
        i, j, value = _survive(x, y, i, j, p)
        if not whole and len(i):
            keep = forest(x.component[i], y.component[j], value)
            i, j = i[keep], j[keep]
        return x.row[i], y.row[j]

    def handed(found):
        ends = sorted({(min(a, b), max(a, b)) for one, two in found for a, b in zip(one.tolist(), two.tolist())})
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

    def inside(batches):
        for batch in batches:
            x, found = _Held(batch.column(0), p), []
            sizes = np.diff(x.offsets)
            for m in np.unique(sizes).tolist():
                i, j = np.triu_indices(m, 1)
                if not len(i):
                    continue
                starts = x.offsets[:-1][sizes == m]
                per = max(1, (1 << 19) // len(i))
                for at in range(0, len(starts), per):
                    s = starts[at : at + per, None]
                    found.append(pairs_of(x, x, (s + i).ravel(), (s + j).ravel()))
            yield handed(found)

    def across(batches):
        for batch in batches:
            x, y, found = _Held(batch.column(0), p), _Held(batch.column(1), p), []
            for r in range(len(batch)):
                a, b = np.arange(x.offsets[r], x.offsets[r + 1]), np.arange(y.offsets[r], y.offsets[r + 1])
                found.append(pairs_of(x, y, np.repeat(a, len(b)), np.tile(b, len(a))))
            yield handed(found)

    out = packed.where("low < high").select("held").mapInArrow(inside, "a long, b long")
    wide = packed.where(F.col("size") > p.block)
    names = wide.select("first", "band", "block", "pos", "n", "low", "high")
    other = names.select("first", "band", *[F.col(c).alias(f"{c}2") for c in ("block", "pos", "n", "low", "high")])
    which = names.join(other, ["first", "band"]).where("block < block2 AND NOT (low = high AND low2 = low AND high2 = low)")
    which = which.where(F.col("pos") + F.col("pos2") <= (F.col("n") + F.col("n2")) * (100 - p.percent) / (100 + p.percent))
    one = wide.select("first", "band", "block", F.col("held").alias("x")).hint("merge")
    two = wide.select("first", "band", F.col("block").alias("block2"), F.col("held").alias("y")).hint("merge")
    work = which.select("first", "band", "block", "block2").join(one, ["first", "band", "block"]).join(two, ["first", "band", "block2"])
    out = out.unionAll(work.select("x", "y").mapInArrow(across, "a long, b long"))
    return out.distinct()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: Join = Join()) -> DataFrame:
    """(row, doc_id, n_shingles, component) for every document of ``numbered`` documents.

    Documents are linked when the Jaccard similarity of their shingle sets is at least ``percent`` / 100; component is
    the smallest id that links reach.  The join is exact: shingles are ordered by a table of counts of fixed size, the
    rarest first, and sets are indexed by the shingles that come first.  Equal sets are one class.  The first set of
    a list is compared with the others on full sets; their answers place most sets in components, and rule out further
    pairs by how far their ends are from it.  What is left between components is compared by parity maps, which never
    lose a link, and confirmed on full sets.

    Null text, or text without words: an empty set, linked with nothing.  A null id takes part, and comes after all
    others; a component of null ids alone has a null component.  Repeated rows are linked.  An empty table gives an
    empty result; other columns are not read.
    """
    rows = docs.select(F.col("_row").alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    scanned = park(_scanned(rows, p), "join-scan")
    levels = _levels(scanned, p)
    full = scanned.where("n > 0")
    classes = full.groupBy("sig").agg(F.min("row").alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = park(classes, "join-classes")
    members, leaders = _lists(_prefixes(rows, levels, p), classes, p)
    texts = rows.select("row", "text")
    answers = _verified(_plausible(leaders, classes, p), texts, p)
    roots = park(components(answers.where("linked").select("a", "b")), "join-roots")
    tried = answers.select("a", "b")
    for whole in (False, True):
        found = _candidates(members, roots, answers, classes, p, whole)
        found = park(found.join(tried.withColumn("known", F.lit(True)).hint("merge"), ["a", "b"], "left"), "join-found")
        fresh = _verified(found.where("known IS NULL").select("a", "b"), texts, p)
        links = fresh.where("linked").select("a", "b")
        if not links.isEmpty():
            roots = park(joined(roots, links), "join-roots")
        if found.where("known").isEmpty() and fresh.where("NOT linked").isEmpty():
            break  # what may be linked was connected by pairs that are: nothing is left between components
        tried = tried.unionByName(fresh.select("a", "b"))
    discard(members)
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select(F.col("sig").alias("_sig"), F.coalesce("component", "rep").alias("root"))
    named = park(named, "join-named")
    first = scanned.where("slice IS NULL").select(F.col("row").alias("_first"), F.col("doc_id").alias("component"))
    heads = named.select("root").distinct().join(first, F.col("root") == F.col("_first")).select("root", "component")
    named = park(named.join(park(heads, "join-heads"), "root").select("_sig", "component"), "join-named")
    out = scanned.where("slice IS NULL").join(named, F.col("sig") == F.col("_sig"), "left")
    component = F.when(F.col("_sig").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("row", "doc_id", F.col("n").alias("n_shingles"), component.alias("component"))


def similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: Join = Join()) -> DataFrame:
    """``jaccard_components`` of documents as they come."""
    named = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return jaccard_components(numbered(named), "doc_id", "text", p)


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT s.doc_id, s.h, n.n FROM s JOIN n USING (doc_id) WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1)),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 90
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT e.a, r.c FROM r JOIN e ON e.b = r.doc_id WHERE r.c < e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
