"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreloom.llm.common import WordHashes, discard, park, slices, word_count
from foreloom.llm.prefix import prefixes

#: ASCII letters (as lower case) and digits stay, every other ASCII character ends a word; other bytes stay.
_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class Overlap:
    """Parameters of the search.

    ``masks``: 1 is a word that must agree, 0 one that may differ.  An overlap is the stretch of a hit's diagonal with
    the most agreements, where a disagreement costs ``identity`` / (1 - ``identity``); so at least that share agrees.
    It counts when the words that agree are half of the item's, at least ``least`` of them, or ``enough``; items of
    fewer than ``least`` words have to be there whole, those under ``shortest`` are no evidence and never reported.
    """

    masks: tuple[str, ...] = ("1101011", "1110101", "10110011")
    identity: float = 0.75
    least: int = 8
    enough: int = 25
    shortest: int = 5
    block_words: int = 2_000_000

    def needed(self, words: int) -> int:
        return min(words, max(self.least, min(self.enough, math.ceil(words / 2))))


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Seeds:
    """The items of one block: their words, and where each masked window of theirs stands, sorted by hash."""

    def __init__(self, texts: list[str | None], p: Overlap):
        hashes = WordHashes()
        self.p = p
        self.items = [hashes.of(words(t)) for t in texts]
        spans = sorted({len(i) for i in self.items if p.shortest <= len(i) < max(map(len, p.masks))})
        # items shorter than a mask are looked up whole
        self.masks = [(np.flatnonzero([c == "1" for c in m]), len(m), 0) for m in p.masks] + [(np.arange(n), n, n) for n in spans]
        parts = []
        for m, (_, span, only) in enumerate(self.masks):
            for i, item in enumerate(self.items):
                if len(item) >= max(span, p.shortest) and (not only or len(item) == only):
                    h = self.hashed(item, m)
                    parts.append((h, np.full(len(h), i), np.arange(len(h))))
        none = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
        self.hash, self.item, self.at = (np.concatenate(x) for x in zip(none, *parts))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item, self.at = self.hash[order], self.item[order], self.at[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.hash >> np.uint64(42)] = True

    def hashed(self, h: np.ndarray, m: int) -> np.ndarray:
        places, span, only = self.masks[m]
        n = len(h) - span + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = np.full(n, 0x9E3779B97F4A7C15 * (2 * m + 1) % 2**64, np.uint64)
        for k in places:
            out = (out ^ h[k : k + n]) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(29)
        return out

    def hits(self, h: np.ndarray) -> set[tuple[int, int]]:
        """(item, first word of the item's place) of every seed that ``h`` has."""
        out: set[tuple[int, int]] = set()
        for m in range(len(self.masks)):
            x = self.hashed(h, m)
            at = np.flatnonzero(self.bits[x >> np.uint64(42)])
            low, high = np.searchsorted(self.hash, x[at], "left"), np.searchsorted(self.hash, x[at], "right")
            for p, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
                out.update(zip(self.item[a:b].tolist(), (p - self.at[a:b]).tolist()))
        return out

    def stretch(self, h, low: int, high: int, item: np.ndarray, first: int) -> tuple[int, int, int] | None:
        a, b = max(first, low), min(first + len(item), high)
        if a >= b:
            return None
        agree = h[a:b] == item[a - first : b - first]
        gain = np.where(agree, 1.0, -self.p.identity / (1 - self.p.identity))
        total = np.concatenate([[0.0], np.cumsum(gain)])
        least = np.minimum.accumulate(total)
        end = int(np.argmax(total[1:] - least[:-1])) + 1
        start = int(np.argmin(total[:end]))
        return a + start, end - start, int(agree[start:end].sum())


FOUND = "array<struct<item_id:{item},start:int,words:int,agree:int>>"


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", p: Overlap = Overlap()) -> DataFrame:
    """``docs`` with ``found``: for each item that a document holds, its best overlap (first word, words, agreeing words).

    Words are runs of letters and digits in lower case.  The benchmark is cut into blocks of at most ``block_words``
    words; each block travels to the tasks as one bounded broadcast, and documents pass all blocks in one scan, so
    neither side is shuffled.

    Null or empty texts hold nothing; null and empty items are in nothing.  Rows are answered one by one, so repeated
    rows and null ids stay as they are.  Empty tables give empty results.  Items with equal text are all reported.
    """
    spark = docs.sparkSession
    kind = "bigint" if benchmark.schema[item_id].dataType.simpleString() in ("int", "bigint", "smallint", "tinyint") else "string"
    items = benchmark.select(F.col(item_id).cast(kind).alias("item_id"), F.col(item_text).alias("item")).withColumn("n", word_count(F.col("item")) + 1)
    items = items.where(F.col("item").isNotNull())
    items = park(prefixes(items, [], [F.col("item_id").asc_nulls_last(), F.col("item")], ("n",)), "items")
    placed = items.withColumn("block", F.floor(F.col("before_n") / p.block_words).cast("int"))
    blocks = sorted(r[0] for r in placed.select("block").distinct().collect())  # one number for 2 million words
    out = docs.withColumn("found", F.array().cast(FOUND.format(item=kind)))
    schema = out.schema
    here, last = docs.columns.index(text), len(docs.columns)
    typed = pa.list_(pa.struct([("item_id", pa.int64() if kind == "bigint" else pa.string()), ("start", pa.int32()), ("words", pa.int32()), ("agree", pa.int32())]))

    def searching(block: int):
        held = placed.where(F.col("block") == block).orderBy("rank").select("item_id", "item").collect()  # bounded by block_words
        ids = [r[0] for r in held]
        sent = spark.sparkContext.broadcast((ids, Seeds([r[1] for r in held], p)))

        def run(batches):
            ids, seeds = sent.value
            hashes = WordHashes()
            for whole in batches:
                for part in slices(whole, here):
                    each = [words(t) for t in part.column(here).to_pylist()]
                    h = hashes.of([w for x in each for w in x])
                    ends = np.cumsum([len(x) for x in each])
                    best: list[dict] = [{} for _ in each]
                    for item, first in seeds.hits(h):
                        size = len(seeds.items[item])
                        for d in range(int(np.searchsorted(ends, max(first, 0), "right")), int(np.searchsorted(ends, min(first + size - 1, len(h) - 1), "right")) + 1):
                            low = int(ends[d - 1]) if d else 0
                            got = seeds.stretch(h, low, int(ends[d]), seeds.items[item], first)
                            if got and got[2] >= p.needed(size) and got[2] > best[d].get(item, (0, 0, 0))[2]:
                                best[d][item] = (got[0] - low, got[1], got[2])
                    old = part.column(last).to_pylist()
                    new = [
                        o + [{"item_id": ids[i], "start": s, "words": w, "agree": a} for i, (s, w, a) in sorted(f.items())] for o, f in zip(old, best)
                    ]
                    yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(new, typed)], schema=pa.schema([*list(part.schema)[:last], pa.field("found", typed)]))

        return run

    for block in blocks:
        out = out.mapInArrow(searching(block), schema)
    discard(items)
    return out


def flagged(docs: DataFrame, benchmark: DataFrame, p: Overlap = Overlap()) -> DataFrame:
    """(doc_id, item_ids, n_items, most_words, contaminated, kept), a row a document."""
    found = contamination(docs.select("doc_id", "text"), benchmark, p=p)
    ids = F.array_sort(F.transform("found", lambda x: x["item_id"]))
    return found.select(
        "doc_id", ids.alias("item_ids"), F.size("found").cast("long").alias("n_items"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["agree"])), F.lit(0)).cast("long").alias("most_words"),
        (F.size("found") > 0).alias("contaminated"), (F.size("found") == 0).alias("kept"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", p: Overlap = Overlap()) -> DataFrame:
    """The documents that hold no item, with the columns they came with."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # a column may be called found already
    plain = docs.toDF(*names)
    found = contamination(plain, benchmark, names[docs.columns.index(doc_id)], names[docs.columns.index(text)], p=p)
    return found.where(F.size("found") == 0).select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns)])
