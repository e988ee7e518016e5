"""Near-duplicate documents by SetSketch registers."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreloom.llm.common import WordHashes, discard, mixed, park, raw, slices, small
from foreloom.llm.components import components, joined
from foreloom.llm.prefix import numbered
from foreloom.llm.set_join import bitmaps, differ, forest, maps


@dataclass(frozen=True)
class Sketch:
    """Parameters of the search.

    A register is 1 - floor(log_base(minimum)) over the elements' exponential values of rate ``rate``, cut to 0 .. 65535.
    ``bands`` times ``rows`` registers; two sets at the threshold of 0.8 miss all bands with probability
    (1 - 0.8^rows)^bands, about 7e-5 here, and fall under ``doubt`` in the estimate at about four standard errors.
    ``bitmap`` is the number of bits of a set's parity map, by which pairs that cannot be links are told without their
    texts.
    """

    words: int = 4
    percent: int = 80
    bands: int = 24
    rows: int = 5
    base: float = 1.001
    rate: float = 20.0
    doubt: float = 0.65
    block: int = 256
    bitmap: int = 2048

    def apart(self, sizes):
        """The most elements in which two linked sets can differ, given the sum of their sizes."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    @property
    def registers(self) -> int:
        return self.bands * self.rows


def shingles(text: bytes, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; ASCII case is folded, words end at ASCII white space.

    With fewer words than a shingle the whole sequence is the only one; no words: empty.
    """
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = hashes.of(found)
    if len(h) < words:
        # of another length than any full shingle, and told apart from it by the length in its hash
        x = mixed(np.array([len(h)], np.uint64))
        for w in h:
            x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + w)
        return x
    x = h[: len(h) - words + 1].copy()
    for k in range(1, words):
        x = mixed(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) + h[k : len(h) - words + 1 + k]
    return np.unique(mixed(x))


class Registers:
    """The registers of sets of hashes, many sets at a time."""

    CHUNK = 1 << 14

    def __init__(self, p: Sketch):
        self.p = p
        seeds = mixed(np.arange(1, 2 * p.registers + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.factor, self.shift = seeds[: p.registers] | np.uint64(1), seeds[p.registers :]

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """Least hash of every set (none empty) under each register's hash function: multiply, add, fold the high bits."""
        out = np.empty((len(sets), self.p.registers), np.uint64)
        at = 0
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= self.CHUNK):
                size += len(sets[end])
                end += 1
            whole = np.concatenate(sets[at:end])
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.int64)
            for j in range(self.p.registers):
                x = whole * self.factor[j] + self.shift[j]
                x ^= x >> np.uint64(32)
                out[at:end, j] = np.minimum.reduceat(x * self.factor[-1 - j], starts)
            at = end
        return out

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        p = self.p
        u = (self.minima(sets).astype(np.float64) + 0.5) / 2.0**64
        least = -np.log1p(-np.minimum(u, 1 - 1e-16)) / p.rate  # exponential minimum of the set
        return np.clip(np.floor(1 - np.log(least) / math.log(p.base)) + 32768, 0, 65535).astype(np.uint16)


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, base: float) -> np.ndarray:
    """Jaccard similarity of pairs by joint maximum likelihood.

    From the counts of registers that are larger on one side, larger on the other, or equal, with the set sizes
    known; the likelihood has one peak and is climbed by ternary search between 0 and the most that the sizes allow.
    """
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    even = a.shape[-1] - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (base - 1) / base) / math.log(base)

    def value(j):
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(np.maximum(up, tiny)) + less * np.log(np.maximum(down, tiny)) + even * np.log(np.maximum(1 - up - down, tiny))

    low, high = np.zeros_like(u), np.minimum(u / v, v / u)
    for _ in range(24):
        third = (high - low) / 3
        left, right = low + third, high - third
        up = value(left) < value(right)
        low, high = np.where(up, left, low), np.where(up, high, right)
    return (low + high) / 2


SKETCHED = "row long, doc_id {id}, n_shingles long, sig binary, regs binary, bits binary"


def sketched(rows: DataFrame, p: Sketch) -> DataFrame:
    """Set size, a digest of the set, its registers and its parity map for each (row, text, doc_id)."""

    def run(batches):
        hashes, registers = WordHashes(), Registers(p)
        for whole in batches:
            for part in slices(whole):
                sets = [shingles(raw(t), p.words, hashes) for t in part.column(1).to_pylist()]
                sigs = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                new = {}
                for s, k in zip(sets, sigs):
                    if k is not None:
                        new.setdefault(k, s)
                regs = dict(zip(new, registers.of(list(new.values())))) if new else {}
                flat = np.concatenate([*new.values(), np.empty(0, np.uint64)])
                ends = np.cumsum([0, *map(len, new.values())])
                bits = {k: m.tobytes() for k, m in zip(new, bitmaps(flat, ends, p.bitmap))} if new else {}
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sigs, pa.binary()),
                        pa.array([regs[k].astype(">u2").tobytes() if k is not None else None for k in sigs], pa.binary()),
                        pa.array([bits.get(k) for k in sigs], pa.binary()),
                    ],
                    ["row", "doc_id", "n_shingles", "sig", "regs", "bits"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", F.coalesce("text", F.lit("")).alias("text"), "doc_id").mapInArrow(run, SKETCHED.format(id=kind))


def _estimate(pairs: DataFrame, classes: DataFrame, p: Sketch) -> DataFrame:
    """Of pairs (a, b) of classes those that neither the registers nor the parity maps rule out."""

    def run(batches):
        for x in batches:
            if not len(x):
                continue
            regs = [np.frombuffer(b"".join(x.column(i).to_pylist()), ">u2").reshape(len(x), -1) for i in (2, 3)]
            n = [x.column(i).to_numpy() for i in (4, 5)]
            keep = likely(regs[0], regs[1], n[0].astype(np.float64), n[1].astype(np.float64), p.base) >= p.doubt
            keep &= differ(maps(x.column(6), p), maps(x.column(7), p)) <= p.apart(n[0] + n[1])
            yield x.select([0, 1]).filter(pa.array(keep))

    ra = classes.select(F.col("rep").alias("a"), F.col("regs").alias("ra"), F.col("n").alias("na"), F.col("bits").alias("ba"))
    rb = classes.select(F.col("rep").alias("b"), F.col("regs").alias("rb"), F.col("n").alias("nb"), F.col("bits").alias("bb"))
    joined = pairs.join(rb, "b").join(ra, "a").where(
        (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.percent)
    )
    return joined.select("a", "b", "ra", "rb", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, p: Sketch) -> DataFrame:
    """Of pairs (a, b) those whose full sets meet the threshold; ``texts`` is (row, text)."""

    def run(batches):
        hashes = WordHashes()
        for x in batches:
            keep, last = [], (None, None)
            for a, ta, tb in zip(x.column(0).to_pylist(), x.column(2).to_pylist(), x.column(3).to_pylist()):
                if last[0] != a:
                    last = (a, shingles(raw(ta), p.words, hashes))
                sa, sb = last[1], shingles(raw(tb), p.words, hashes)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * both >= p.percent * (len(sa) + len(sb) - both))
            yield x.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("row")).unionAll(pairs.select(F.col("b").alias("row"))).distinct()
    wanted = park(texts.join(small(park(ids, "wanted")), "row", "left_semi"), "texts")
    ta = wanted.select(F.col("row").alias("a"), F.col("text").alias("ta"))
    tb = wanted.select(F.col("row").alias("b"), F.col("text").alias("tb"))
    out = park(pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "verified")
    discard(wanted)
    return out


def _across(members: DataFrame, classes: DataFrame, p: Sketch, whole: bool) -> DataFrame:
    """Candidate pairs in buckets that hold several components: (a, b) with a plausible estimate across components.

    A bucket's members are cut into blocks of one component or of several small ones; pairs of blocks that may cross
    components are compared inside a task, register by register and then by their parity maps, and only what passes
    leaves it.  Unless ``whole``, a task hands on no more than it takes to connect what passes.
    """
    size = F.lit(p.block)
    per = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("held"))
    several = per.groupBy("key").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("key")
    per = per.join(several, "key", "left_semi")
    # large components get blocks of their own, the others of a bucket share blocks
    big = F.when(F.col("held") >= size, F.col("component"))
    rows = members.join(per.select("key", "component", "held"), ["key", "component"])
    rows = rows.select("key", "band", "component", "rep", F.coalesce(big, F.lit(-1)).alias("own"))
    groups = rows.groupBy("key", "own").agg(F.count(F.lit(1)).alias("size"))
    groups = groups.withColumn("blocks", F.ceil(F.col("size") / size).cast("int"))
    rows = rows.join(groups.select("key", "own", "blocks"), ["key", "own"])
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    rows = rows.join(classes.select("rep", "regs", "bits", "n"), "rep")
    packed = rows.groupBy("key", "own", "block").agg(
        F.min("band").alias("band"), F.collect_list(F.struct("rep", "component", "n", "regs", "bits")).alias("held")
    )
    packed = park(packed, "blocks")
    names = packed.select("key", "own", "block")
    left, right = names.select("key", F.col("own").alias("o1"), F.col("block").alias("b1")), names.select("key", F.col("own").alias("o2"), F.col("block").alias("b2"))
    which = left.join(right, "key").where(
        (F.struct("o1", "b1") <= F.struct("o2", "b2")) & ((F.col("o1") != F.col("o2")) | (F.col("o1") == -1))
    )
    a = packed.select("key", F.col("own").alias("o1"), F.col("block").alias("b1"), "band", F.col("held").alias("x"))
    b = packed.select("key", F.col("own").alias("o2"), F.col("block").alias("b2"), F.col("held").alias("y"))
    work = which.join(a, ["key", "o1", "b1"]).join(b, ["key", "o2", "b2"]).select("x", "y", "band")

    def side(column):
        held = column.values
        regs = np.frombuffer(b"".join(held.field("regs").to_pylist()), ">u2").reshape(len(held), -1).astype(np.uint16)
        named = [held.field(c).to_numpy() for c in ("rep", "component", "n")]
        return column.offsets.to_numpy(), *named[:2], named[2].astype(np.float64), regs, maps(held.field("bits"), p)

    def plausible(x, y, i, j, band):
        """Of places (i, j) on the two sides those that may be links, with the places in which their maps differ."""
        fit = x[2][i] != y[2][j]  # of different components
        fit &= (np.minimum(x[3][i], y[3][j]) * 100 >= np.maximum(x[3][i], y[3][j]) * p.percent)
        i, j, band = i[fit], j[fit], band[fit]
        # registers agree about as often as the sets do, so far fewer cannot reach the estimate asked for
        agree = x[4][i] == y[4][j]
        fit = agree.sum(1) >= 0.75 * p.doubt * p.registers
        # a pair that meets in several buckets is taken in the first of its bands
        fit &= agree.reshape(-1, p.bands, p.rows).all(2).argmax(1) == band
        i, j = i[fit], j[fit]
        value = likely(x[4][i], y[4][j], x[3][i], y[3][j], p.base)
        fit = value >= p.doubt
        i, j = i[fit], j[fit]
        apart = differ(x[5][i], y[5][j])
        fit = apart <= p.apart((x[3][i] + y[3][j]).astype(np.int64))
        return i[fit], j[fit], apart[fit]

    def run(batches):
        for batch in batches:
            x, y, bands = side(batch.column(0)), side(batch.column(1)), batch.column(2).to_numpy()
            out, held, waiting = set(), [], 0
            for r in range(len(batch)):
                a, b = np.arange(x[0][r], x[0][r + 1]), np.arange(y[0][r], y[0][r + 1])
                held.append((np.repeat(a, len(b)), np.tile(b, len(a)), np.full(len(a) * len(b), bands[r])))
                waiting += len(a) * len(b)
                if waiting < 1 << 16 and r + 1 < len(batch):
                    continue
                i, j, value = plausible(x, y, *(np.concatenate(c) for c in zip(*held)))
                held, waiting = [], 0
                if not whole and len(i):
                    keep = forest(x[2][i], y[2][j], value)
                    i, j = i[keep], j[keep]
                one, two = x[1][i], y[1][j]
                out.update(zip(np.minimum(one, two).tolist(), np.maximum(one, two).tolist()))
            ends = sorted(out)
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.int64()) for k in (0, 1)], ["a", "b"])

    return work.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: Sketch = Sketch()) -> DataFrame:
    """(row, doc_id, n_shingles, component, kept) for every document of ``numbered`` documents.

    Documents are linked when their shingle sets have a Jaccard similarity of at least ``percent`` / 100; component is
    the smallest id that links reach.  Equal sets are one class from the start, so copies are compared once.  Every
    class is compared with the first one of each of its buckets; where a bucket then still holds several components,
    all of its pairs across components are compared by their registers and parity maps.  Every link is confirmed on the
    full sets.

    Null text, or text without words: an empty set, linked with nothing, kept.  A null id takes part, and comes after
    all others; a component of null ids alone has a null component.  Repeated rows: one is kept.  An empty table
    gives an empty result.
    """
    rows = docs.select(F.col("_row").alias("row"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    sk = park(sketched(rows, p), "sketches")
    full = sk.where("n_shingles > 0")
    classes = park(
        full.groupBy("sig").agg(F.min("row").alias("rep"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("bits").alias("bits")), "classes"
    )
    band = F.posexplode(
        F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 1 + 2 * p.rows * i, 2 * p.rows)) for i in range(p.bands)])
    )
    keys = classes.select("rep", band.alias("band", "key"))
    counts = keys.groupBy("key").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("held")).where("held > 1")
    members = park(keys.join(park(counts, "buckets").select("key", "first"), "key").select("key", "band", "rep", "first"), "members")
    star = members.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    texts = rows.select("row", F.coalesce("text", F.lit("")).alias("text"))
    tried = park(_estimate(star, classes, p), "pairs")
    roots = park(components(_verified(tried, texts, p)), "roots")
    for whole in (False, True):
        of = F.coalesce(F.col("component"), F.col("rep")).alias("component")
        placed = park(members.join(roots, F.col("rep") == F.col("node"), "left").select("key", "band", "rep", of), "placed")
        found = _across(placed, classes, p, whole).join(tried.withColumn("known", F.lit(True)), ["a", "b"], "left")
        found = park(found, "across")
        fresh = park(found.where("known IS NULL").select("a", "b"), "fresh")
        linked = _verified(fresh, texts, p)
        if not linked.isEmpty():
            roots = park(joined(roots, linked), "roots")
        if found.where("known").isEmpty() and fresh.join(linked, ["a", "b"], "left_anti").isEmpty():
            break  # what passed was connected by pairs that are links: nothing is left between components
        tried = tried.unionAll(fresh)
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("component", "rep").alias("root"))
    named = park(named, "named")
    first = sk.select(F.col("row").alias("_first"), F.col("doc_id").alias("component"))
    heads = park(named.select("root").distinct().join(first, F.col("root") == F.col("_first")).select("root", "component"), "heads")
    named = park(named.join(heads, "root").select(F.col("sig").alias("_sig"), "root", "component"), "named")
    out = sk.join(named, F.col("sig") == F.col("_sig"), "left")
    lone = F.col("_sig").isNull()
    return out.select(
        "row", "doc_id", "n_shingles",
        F.when(lone, F.col("doc_id")).otherwise(F.col("component")).alias("component"),
        (lone | (F.col("row") == F.col("root"))).alias("kept"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: Sketch = Sketch()) -> DataFrame:
    """The documents that stay, one of each component, with the columns they came with."""
    rows = numbered(docs, doc_id)
    gone = near_duplicates(rows, doc_id, text, p).where(~F.col("kept")).select(F.col("row").alias("_row"))
    return rows.join(gone, "_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
