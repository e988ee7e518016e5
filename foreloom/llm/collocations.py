"""Phrase collocations from Rabin-Karp fingerprints of all n-grams."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreloom.llm.common import mixed, park, slices
from foreloom.llm.prefix import numbered, prefixes

#: A piece ends at these bytes; words of a piece are parted by blanks and tabs.
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
PART = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
LETTER = re.compile(rb"[^ \t.,;:!?\n\x0b\x0c\r]")


@dataclass(frozen=True)
class Mining:
    """Parameters of the search; lengths are in words.

    ``bits`` is the width of fingerprints.  ``filter_bits`` is the size of the table of frequent fingerprints that
    travels to every task (its logarithm, in bits): n-grams whose parts are not in it need no count of their own, and
    a part that is in it by chance costs a row and no more.  ``window`` bounds the bytes hashed at a time.
    """

    longest: int = 3
    least: int = 10
    inside_percent: int = 50
    top: int = 2000
    bits: int = 64
    filter_bits: int = 26
    window: int = 1 << 19


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as they were asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


class Polynomial:
    """Fingerprints of stretches of a sequence of numbers from one prefix polynomial: sum of x[j] * base^(j - start)."""

    def __init__(self, base: int):
        self.powers = Powers(base)

    def prefix(self, x: np.ndarray) -> np.ndarray:
        up, _ = self.powers.to(len(x) + 1)
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[:-1], dtype=np.uint64, out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = self.powers.to(len(prefix))
        return (prefix[end] - prefix[start]) * down[start]


#: Odd bases: of letters and of words, once for the fingerprints and once for their check sums.
LETTERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORDS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def lang_code(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8, key=bytes([seed])).digest(), "little")


class Hasher:
    """Words of bytes and the fingerprints of their n-grams, without a Python step per word."""

    def __init__(self, p: Mining):
        self.p = p
        self.letters = [Polynomial(b) for b in LETTERS]
        self.words = [Polynomial(b) for b in WORDS]
        kind = np.zeros(256, np.uint8)
        kind[list(BLANKS)] = 1
        kind[list(ENDS)] = 2
        self.kind = kind
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        self.lower = lower

    def tokens(self, data: bytes):
        """(starts, ends, piece numbers) of the words in ``data``."""
        x = self.kind[np.frombuffer(data, np.uint8)]
        inside = np.zeros(len(x) + 2, np.int8)
        inside[1:-1] = x == 0
        edge = np.diff(inside)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return starts, ends, np.cumsum(x == 2)[starts] if len(starts) else starts

    def word_codes(self, data: bytes, starts, ends) -> list[np.ndarray]:
        """Two independent codes for every word."""
        x = self.lower[np.frombuffer(data, np.uint8)].astype(np.uint64) + np.uint64(1)
        return [mixed(poly.of(poly.prefix(x), starts, ends) + np.uint64(k)) for k, poly in enumerate(self.letters)]

    def grams(self, codes, piece, n: int):
        """(places of the first words, fingerprints, checks) of all n-grams inside pieces."""
        last = len(piece) - n + 1
        if last <= 0:
            none = np.empty(0, np.uint64)
            return np.empty(0, np.int64), none, none
        at = np.flatnonzero(piece[:last] == piece[n - 1 :])
        fp, check = (mixed(poly.of(poly.prefix(c), at, at + n)) for poly, c in zip(self.words, codes))
        return at, fp, check


def keyed(fp: np.ndarray, lang: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Fingerprints told apart by language and length, cut to the width asked for."""
    x = mixed(fp + lang * np.uint64(2 * n + 1))
    return x if bits == 64 else x >> np.uint64(64 - bits)


class Texts:
    """Batches of (row, text, lang) as stretches of bytes that hold many short texts, or a part of a long one."""

    def __init__(self, p: Mining):
        self.p, self.hasher, self.langs = p, Hasher(p), {}

    def code(self, lang: str) -> tuple[int, int]:
        if lang not in self.langs:
            if len(self.langs) > 100_000:
                self.langs.clear()
            self.langs[lang] = lang_code(lang, 1), lang_code(lang, 2)
        return self.langs[lang]

    def stretches(self, batch: pa.RecordBatch):
        """(bytes, places of texts in them, rows, langs, offsets of texts, ends of the words that are the part's own)."""
        parts, size = [], 0
        texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
        for row, text, lang in zip(batch.column(0).to_pylist(), texts.to_pylist(), batch.column(2).to_pylist()):
            for begin, end, own in self.cuts(text):
                if parts and size + end - begin > self.p.window:
                    yield self.joined(parts)
                    parts, size = [], 0
                parts.append((row, text[begin:end], lang, begin, own - begin))
                size += end - begin + 1
        if parts:
            yield self.joined(parts)

    def cuts(self, text: bytes):
        """(begin, end, own): parts that end between words; n-grams that begin before ``own`` belong to the part."""
        begin = 0
        while len(text) - begin > self.p.window:
            cut = PART.search(text, begin + self.p.window)
            if cut is None:
                break
            end = own = cut.start()
            for _ in range(self.p.longest - 1):  # the next words are read along
                word = LETTER.search(text, end)
                stop = PART.search(text, word.start()) if word else None
                end = stop.start() if stop else len(text)
            yield begin, end, own
            begin = own
        yield begin, len(text), len(text)

    def joined(self, parts):
        data = b"\n".join(p[1] for p in parts) + b"\n"
        sizes = np.array([len(p[1]) + 1 for p in parts], np.int64)
        places = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        codes = [self.code(p[2]) for p in parts]
        return (
            data, places, np.array([p[0] for p in parts], np.int64), np.array([c[0] for c in codes], np.uint64),
            np.array([c[1] for c in codes], np.uint64), np.array([p[3] for p in parts], np.int64), np.array([p[4] for p in parts], np.int64),
        )


class Sums:
    """Occurrences added up by key inside a task; handed on when the distinct ones are many."""

    MOST = 1 << 20

    def __init__(self):
        self.held, self.size = [], 0

    def add(self, key, check, row, start, end):
        """Take occurrences in; yields batches of sums whenever the memory for them is used up."""
        ones = np.ones(len(key), np.int32)
        self.held.append((key, ones, check & CHECK, row, start.astype(np.int32), (end - start).astype(np.int32)))
        self.size += len(key)
        if self.size >= self.MOST:
            self.reduce()
            if self.size > self.MOST // 2:
                yield from self.batches()

    def reduce(self):
        """One entry a key, with the first occurrence as pointer."""
        key, count, check, row, start, length = (np.concatenate(c) for c in zip(*self.held))
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        first = order[head]
        count = np.add.reduceat(count[order], head)
        check = np.add.reduceat(check[order], head) & CHECK
        self.held = [(key[head], count, check, row[first], start[first], length[first])]
        self.size = len(head)

    def batches(self):
        if not self.size:
            return
        self.reduce()
        key, count, check, row, start, length = self.held[0]
        self.held, self.size = [], 0
        columns = [key.view(np.int64), count.astype(np.int64), check.view(np.int64), row, start, length]
        for at in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], NAMES)


#: Check sums are kept modulo 2^40, so that sums of them stay in 64 bits.
CHECK = np.uint64((1 << 40) - 1)
NAMES = ["fp", "f", "check", "row", "start", "length"]
COUNTED = "fp long, f long, check long, row long, start int, length int"


def _counted(rows: DataFrame, n: int, p: Mining, known: list) -> DataFrame:
    """Partial counts of all n-grams whose parts are in the tables ``known``: (fp, f, check, row, start, length).

    ``n`` 0 counts the words of a language as a whole, under the fingerprint of the language.
    """

    def run(batches):
        texts, sums = Texts(p), Sums()
        tables = [np.frombuffer(t.value, np.uint8) for t in known]
        for part in (part for batch in batches for part in slices(batch)):
            for data, places, row, lang, lang2, offset, own in texts.stretches(part):
                starts, ends, piece = texts.hasher.tokens(data)
                if not len(starts):
                    continue
                of = np.searchsorted(places, starts, "right") - 1
                codes = texts.hasher.word_codes(data, starts, ends)
                at = np.arange(len(starts))
                for k in range(1, max(n, 1)):  # the first and the last k words of each
                    place, fp, _ = texts.hasher.grams(codes, piece, k)
                    good = np.zeros(len(starts) + 1, bool)
                    good[place] = _in(tables[k - 1], keyed(fp, lang[of[place]], k, p.bits))
                    at = at[good[at] & good[np.minimum(at + n - k, len(starts))]]
                if n == 0:
                    at = at[starts < (places + own)[of]]
                    key, check = lang[of[at]], lang2[of[at]]  # languages are few: no cut to ``bits``
                    end = ends[at]
                else:
                    first, fp, check = texts.hasher.grams(codes, piece, n)
                    pick = np.zeros(len(starts) + 1, bool)
                    pick[at] = True
                    pick &= np.append(starts < (places + own)[of], False)
                    chosen = pick[first]
                    at, fp, check = first[chosen], fp[chosen], check[chosen]
                    key, end = keyed(fp, lang[of[at]], n, p.bits), ends[at + n - 1]
                    check = mixed(check + lang2[of[at]])
                begin = starts[at] - places[of[at]] + offset[of[at]]
                yield from sums.add(key, check, row[of[at]], begin, begin + end - starts[at])
        yield from sums.batches()

    return rows.mapInArrow(run, COUNTED)


def _totals(parts: DataFrame) -> DataFrame:
    """Counts and check sums by fingerprint, with one of the occurrences as pointer.

    Tasks hand on sums, so that nothing more is added up before the shuffle.  Any occurrence serves as pointer; the
    columns of a pointer come from one row, as all of them take the first that arrives.
    """
    pointer = [F.first(c).alias(c) for c in ("row", "start", "length")]
    return parts.repartition("fp").groupBy("fp").agg(F.sum("f").alias("f"), F.sum("check").alias("check"), *pointer)


def _in(table: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Whether the bits of fingerprints are set."""
    at = mixed(fp) >> np.uint64(64 - (len(table) * 8).bit_length() + 1)
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _table(fps: DataFrame, p: Mining):
    """A bit table of fixed size of the fingerprints, made in slices by tasks and sent to all."""
    bits, slices = p.filter_bits, 32
    each = (1 << bits) // 8 // slices
    place = F.col("place")

    def marks(batches):
        for x in batches:
            at = mixed(x.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["place"])

    def pack(batches):
        held = {}
        for x in batches:
            at = x.column(0).to_numpy()
            which = at // (each * 8)
            for k in np.unique(which).tolist():
                bit = held.setdefault(k, np.zeros(each, np.uint8))
                here = at[which == k] - k * each * 8
                np.bitwise_or.at(bit, here >> 3, (1 << (here & 7)).astype(np.uint8))
        for k, bit in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([bit.tobytes()], pa.binary())], ["slice", "bits"])

    spread = fps.select("fp").mapInArrow(marks, "place long").repartition(slices, F.floor(place / (each * 8)))
    out = bytearray(each * slices)
    for part in spread.mapInArrow(pack, "slice long, bits binary").collect():  # at most the size of the table
        out[part["slice"] * each : (part["slice"] + 1) * each] = part["bits"]
    return fps.sparkSession.sparkContext.broadcast(bytes(out))


def _read(frequent: DataFrame, rows: DataFrame, p: Mining) -> DataFrame:
    """(lang, n, phrase, f, fp, right): the phrases that the pointers of frequent fingerprints show.

    ``right`` says whether the check sum of all occurrences is what the phrase itself gives so many times; if not,
    several phrases share the fingerprint.  Texts move once, and only the stretches that pointers show leave the join.
    """

    def run(batches):
        hasher, texts = Hasher(p), Texts(p)
        low = bytes(hasher.lower)
        for x in batches:
            sizes, f, check = (x.column(k).to_numpy() for k in (1, 3, 4))
            pieces = [t.translate(low) for t in x.column(5).to_pylist()]
            lang = np.array([texts.code(v)[1] for v in x.column(0).to_pylist()], np.uint64)
            own = lang.copy()  # the check of one occurrence; of a whole language it is the language's
            for n in range(1, p.longest + 1):
                these = np.flatnonzero(sizes == n)
                if not len(these):
                    continue
                data = b"\n".join(pieces[k] for k in these.tolist()) + b"\n"
                starts, ends, piece = hasher.tokens(data)
                _, _, found = hasher.grams(hasher.word_codes(data, starts, ends), piece, n)
                own[these] = mixed(found + lang[these])
            right = (own * f.astype(np.uint64) - check.astype(np.uint64)) & CHECK == 0
            phrases = [b" ".join(t.split()).decode("utf-8", "replace") if n else "" for t, n in zip(pieces, sizes.tolist())]
            yield pa.RecordBatch.from_arrays(
                [x.column(0), x.column(1), pa.array(phrases, pa.string()), x.column(3), x.column(2), pa.array(right, pa.bool_())],
                ["lang", "n", "phrase", "f", "fp", "right"],
            )

    held = frequent.groupBy("row").agg(F.collect_list(F.struct("n", "fp", "f", "check", "start", "length")).alias("held"))
    texts = rows.select(F.col("row").alias("_row"), F.col("text").cast("binary").alias("bytes"), "lang").hint("merge")
    shown = F.transform(
        "held",
        lambda x: F.struct(
            x["n"].alias("n"), x["fp"].alias("fp"), x["f"].alias("f"), x["check"].alias("check"),
            F.substring("bytes", x["start"] + 1, x["length"]).alias("piece"),
        ),
    )
    met = held.join(texts, F.col("row") == F.col("_row")).select("lang", shown.alias("shown"))
    met = met.select("lang", F.explode("shown").alias("x")).select("lang", "x.*")
    return met.mapInArrow(run, "lang string, n int, phrase string, f long, fp long, right boolean")


def _spelled(rows: DataFrame, wrong: DataFrame, n: int, p: Mining) -> DataFrame:
    """Exact counts (lang, n, phrase, f) of the n-grams whose fingerprints ``wrong`` holds, counted as text."""
    table = _table(wrong, p)

    def run(batches):
        texts = Texts(p)
        bits = np.frombuffer(table.value, np.uint8)
        for batch in (part for batch in batches for part in slices(batch)):
            named = dict(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            for data, places, row, lang, _, _, own in texts.stretches(batch):
                starts, ends, piece = texts.hasher.tokens(data)
                at, fp, _ = texts.hasher.grams(texts.hasher.word_codes(data, starts, ends), piece, n)
                of = np.searchsorted(places, starts[at], "right") - 1
                key = keyed(fp, lang[of], n, p.bits)
                pick = _in(bits, key) & (starts[at] < (places + own)[of])
                low, found = data.translate(bytes(texts.hasher.lower)), {}
                for i, o, k in zip(at[pick].tolist(), of[pick].tolist(), key[pick].view(np.int64).tolist()):
                    name = (named[int(row[o])], b" ".join(low[starts[i] : ends[i + n - 1]].split()), k)
                    found[name] = found.get(name, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k[0] for k in found], pa.string()), pa.array([k[1].decode("utf-8", "replace") for k in found], pa.string()),
                        pa.array([k[2] for k in found], pa.int64()), pa.array(list(found.values()), pa.int64()),
                    ],
                    ["lang", "phrase", "fp", "f"],
                )

    found = rows.mapInArrow(run, "lang string, phrase string, fp long, f long").join(wrong.select("fp"), "fp", "left_semi")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).select("lang", F.lit(n).alias("n"), "phrase", "f")


def frequencies(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", p: Mining = Mining()) -> DataFrame:
    """(lang, n, phrase, f) for all n-grams of up to ``longest`` words that occur at least ``least`` times in a language.

    The row with n 0 and an empty phrase has the number of all words of its language.  Texts are read once for each
    length; a count keeps one pointer, and only frequent phrases are read back from the texts that these point to.
    """
    rows = numbered(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")))
    und = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = rows.select(F.col("_row").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"), und.alias("lang"))
    known, frequent = [], None
    for n in range(p.longest + 1):
        total = _totals(_counted(rows, n, p, known))
        total = park((total if n == 0 else total.where(F.col("f") >= p.least)).withColumn("n", F.lit(n)), "frequent")
        if 0 < n < p.longest:
            known.append(_table(total, p))
        frequent = total if frequent is None else frequent.unionByName(total)
    read = park(_read(frequent, rows, p), "phrases")
    out = read.where("right").select("lang", "n", "phrase", "f")
    for n in [x.n for x in read.where(~F.col("right")).select("n").distinct().collect()]:  # at most one for each length
        spelled = _spelled(rows, read.where(~F.col("right") & (F.col("n") == n)), n, p)
        out = out.unionByName(park(spelled.where(F.col("f") >= p.least), "spelled"))
    return out


def _score(a: Column, left: Column, right: Column) -> Column:
    """Whole millionths of a * a / (left * right), rounded down; products have up to 31 digits, so none is cut."""
    a, left, right = (c.cast("decimal(12,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", p: Mining = Mining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    A candidate is a phrase of two to ``longest`` words that occurs ``least`` times or more; of its cuts into two parts
    the one with the lowest score counts, the shortest first part among equals.  Phrases inside a longer candidate
    that has ``inside_percent`` per cent of their occurrences are left out.

    Null text: no words.  Null language: ``und``.  A language without candidates has no rows, an empty table neither.
    Repeated rows count as often as they stand there; ids serve as names of rows only, null or not.  Other columns
    are not read, whatever their names.
    """
    found = park(frequencies(docs, text, lang, doc_id, p), "frequencies")
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    size = F.col("n")
    candidates = found.where("n >= 2").select("lang", "phrase", F.col("f").alias("a"), "n", F.split("phrase", " ").alias("words"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, size).alias("right"))
    counts = found.where("n >= 1").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias("_f"))
    for side, name in (("left", "l"), ("right", "r")):
        on = (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_part"))
        cuts = cuts.join(counts.hint("merge"), on).drop("_lang", "_part", side).withColumnRenamed("_f", name)
    cut = F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "a", "l", "r")
    scored = cuts.groupBy("lang", "phrase").agg(F.min(cut).alias("cut")).select("lang", "phrase", "cut.*")
    inner = candidates.where("n > 2").select("lang", "a", "words", "n", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("lang", "a", "words", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at"))
    inner = inner.select("lang", "a", part(F.col("at"), F.col("m")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(inner.hint("merge"), ["lang", "phrase"], "left")
    kept = kept.where(F.coalesce(F.col("most") * 100 < F.col("a") * p.inside_percent, F.lit(True))).drop("most", "k")
    ranked = prefixes(kept, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]).where(F.col("rank") <= p.top)
    totals = found.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS m)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE m >= 2 AND f >= 10),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN g x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ')
  JOIN g y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:k.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT lang, phrase, max(a) AS most
  FROM (SELECT lang, a, array_to_string(w[i:i + 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE m = 3)) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n.n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
WHERE o.most IS NULL OR 100 * o.most < 50 * a
QUALIFY rank <= 2000
"""
