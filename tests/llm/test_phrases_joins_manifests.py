"""Collocations, the exact set join and the Merkle manifest against plain Python, with the awkward inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreloom.llm import collocations, merkle, near_dedup, set_join
from foreloom.llm.prefix import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, rank long, _row string, digest string, fp int"
EXTRA = ("x", 1, "y", "z", 2)
PLAIN = "alpha beta gamma, delta beta gamma; alpha\tbeta gamma\nOmega psi! one"


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


AWKWARD = [
    (1, PLAIN, "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n ", None, "b", 0),
    (5, PLAIN, "en", "a", 1),
    (5, PLAIN, "en", "a", 1),
    (None, "no id here", "fr", "c", 1),
    (None, None, None, None, None),
    (6, "x " * 40000 + "tail end", "en", "a", 1),
    (7, "y" * 1_200_000, "en", "a", 1),
    (8, "Ünï Çödé " * 5, "fr", "é", 1),
]


# --- collocations


def grams_of(rows, longest):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall(r"[^ \t]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang or "und", " ".join(words[i : i + m])] += 1
    return f, n


def plain_collocations(rows, p):
    f, n = grams_of(rows, p.longest)
    cands = {k: a for k, a in f.items() if a >= p.least and " " in k[1]}
    out = []
    for (lang, phrase), a in cands.items():
        w = phrase.split(" ")
        cuts = [(a * a * 1_000_000 // (f[lang, " ".join(w[:k])] * f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(
            o_lang == lang and len(o.split(" ")) > len(w) and f" {phrase} " in f" {o} " and 100 * b >= p.inside_percent * a
            for (o_lang, o), b in cands.items()
        )
        if not inside:
            out.append((lang, phrase, a, f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[: p.top])]
    return sorted(ranked)


def found_collocations(df, p):
    return sorted(map(tuple, collocations.collocations(df, p=p).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def made_rows(n=300, seed=3):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["Été", "ßa"]
    out = []
    for i in range(n):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", "\n"]) for _ in range(draw.randrange(60)))
        out.append((i, text, draw.choice(["en", "en", "fr", None]), "s", 1))
    return out


def test_collocations_against_plain_counts(spark):
    rows = made_rows()
    for p in (collocations.Mining(filter_bits=14), collocations.Mining(longest=4, least=6, top=25, filter_bits=14)):
        assert found_collocations(table(spark, rows), p) == plain_collocations(rows, p)


def test_fingerprints_that_collide_are_counted_as_text(spark):
    rows = made_rows(120)
    p = collocations.Mining(bits=9, filter_bits=14)
    read = collocations.frequencies(table(spark, rows), p=p)
    f, n = grams_of(rows, p.longest)
    want = {(lang, phrase): c for (lang, phrase), c in f.items() if c >= p.least} | {(lang, ""): c for lang, c in n.items()}
    assert {(r.lang, r.phrase): r.f for r in read.collect()} == want
    assert found_collocations(table(spark, rows), p) == plain_collocations(rows, p)


def test_long_texts_are_cut_without_loss(spark):
    rows = made_rows(4, seed=9)
    rows = [(i, " ".join([t] * 40), lang, s, c) for i, t, lang, s, c in rows]
    p = collocations.Mining(window=200, filter_bits=14)
    assert found_collocations(table(spark, rows), p) == plain_collocations(rows, p)


def test_collocations_on_awkward_rows(spark):
    p = collocations.Mining(least=3, filter_bits=14)
    assert found_collocations(table(spark, AWKWARD), p) == plain_collocations(AWKWARD, p)
    assert collocations.collocations(table(spark, [])).count() == 0
    f = {(r.lang, r.phrase): r.f for r in collocations.frequencies(table(spark, AWKWARD), p=p).where("n = 0").collect()}
    assert f[("en", "")] == 3 * 12 + 40002 + 1 and f[("fr", "")] == 13


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3_000_000_000, 4_000_000_000, 5_000_000_000)], "a long, l long, r long")
    got = df.select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 3_000_000_000**2 * 1_000_000 // (4_000_000_000 * 5_000_000_000)


# --- exact join


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def plain_components(rows, p):
    sets = [shingle_set(r[1], p.words) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= p.percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {rows[i][0]: (len(sets[i]), rows[top(i)][0]) for i in range(len(rows))}


def found_components(df, p):
    return {r.doc_id: (r.n_shingles, r.component) for r in set_join.similar(df, p=p).collect()}


def near_copies(groups, copies, words, changes, seed):
    """Groups of texts that differ in a few words, around the threshold, some ends of which only meet by others."""
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"g{g}w{draw.randrange(10 * words)}" for _ in range(words)]
        for _ in range(copies):
            own = list(base)
            for _ in range(draw.randrange(changes + 1)):
                own[draw.randrange(words)] = f"n{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(own), "en", "s", 1))
            if draw.random() < 0.3:
                base = own
    draw.shuffle(rows)
    return sorted([(i, *r[1:]) for i, r in enumerate(rows)])


@pytest.mark.parametrize("p", [set_join.Join(sketch_bits=10), set_join.Join(sketch_bits=10, block=4, percent=80), set_join.Join(sketch_bits=10, words=2, bitmap=64)])
def test_join_against_all_pairs(spark, p):
    rows = near_copies(6, 25, 80, 4, 5)
    want = plain_components(rows, p)
    assert len({c for _, c in want.values()}) > 6 and found_components(table(spark, rows), p) == want


def test_join_on_one_large_group(spark):
    """Most pairs of the group are a little too far apart; blocks are small, so that pairs of blocks are compared."""
    rows = near_copies(1, 150, 120, 7, 8)
    p = set_join.Join(sketch_bits=10, block=8)
    assert found_components(table(spark, rows), p) == plain_components(rows, p)


def test_join_on_awkward_rows(spark):
    p = set_join.Join(sketch_bits=10)
    out = set_join.similar(table(spark, AWKWARD), p=p).collect()
    assert len(out) == len(AWKWARD)
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.n_shingles, r.component))
    assert got[5] == [got[1][0]] * 2 and got[1][0][1] == 1
    assert got[2] == [(0, 2)] and got[3] == [(0, 3)] and got[4] == [(0, 4)]
    assert sorted(got[None]) == [(0, None), (1, None)] and got[7] == [(1, 7)] and got[6][0] == (3, 6)
    assert set_join.similar(table(spark, []), p=p).count() == 0


def test_sets_of_long_texts_are_those_of_the_whole():
    rows = made_rows(1, seed=2)
    text = (" ".join(["a b\tc", rows[0][1], "d  e\n\n"]) * 30).encode()
    whole, offsets = set_join.Shingles(3).together([text])
    parts = set_join.Shingles(3)
    parts.WINDOW = 50
    assert np.array_equal(parts.long(text), whole) and offsets.tolist() == [0, len(whole)]
    assert len(parts.long(b"z" * 500)) == 1 and len(parts.long(b" " * 500)) == 0


def test_parity_maps_never_overstate():
    draw = np.random.default_rng(1)
    a, b = (np.unique(draw.integers(0, 400, 200).astype(np.uint64)) for _ in range(2))
    maps = set_join.bitmaps(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 64)
    x, y = maps.view(np.uint64)
    assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


# --- manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, change):
    def leaf(r, text):
        return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def way(tree, at):
        out = []
        for lvl in tree[:-1]:
            run = at // 3 * 3
            out.append((lvl[run:at], lvl[at + 1 : run + 3]))
            at //= 3
        return out

    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = own, levels([leaf(r, r[1]) for r in own])
    top = levels([trees[s][1][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        own, tree = trees[s]
        for i, r in enumerate(own):
            path = way(tree, i) + way(top, k)
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 and r[1] is not None
            state = leaf(r, change(r[1]) if tampered else r[1])
            for left, right in path:
                state = H(*left, state, *right)
            siblings = H(*[x for left, right in path for x in (*left, *right)])
            out.append((r[0], leaf(r, r[1]), tree[-1][0], top[-1][0], siblings, state, state == top[-1][0]))
    return sorted(out, key=repr)


def found_manifest(df):
    return sorted(map(tuple, merkle.verified(df).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 4, 82, 250])
def test_manifest_against_plain_trees(spark, n):
    draw = random.Random(n)
    rows = [(i, f"text {i}\nline" if i % 3 else f"flat {i}", draw.choice(["en", None]), draw.choice(["a", "a", "a", "b", "é", None]), i) for i in range(n)]
    assert found_manifest(table(spark, rows)) == plain_manifest(rows, lambda t: t.replace("\n", ""))


def test_manifest_of_many_sources(spark):
    rows = [(i, "a\nb", None, f"s{i % 100}", 1) for i in range(130)]
    assert found_manifest(table(spark, rows)) == plain_manifest(rows, lambda t: t.replace("\n", ""))


def test_manifest_on_awkward_rows(spark):
    rows = [r for r in AWKWARD if r[0] != 7]
    assert found_manifest(table(spark, rows)) == plain_manifest(rows, lambda t: t.replace("\n", ""))
    assert merkle.verified(table(spark, [])).count() == 0


def test_nodes_cover_intervals(spark):
    rows = [(i, str(i), "en", "a" if i < 100 else None, 1) for i in range(105)]
    named = table(spark, rows).select("source", F.col("doc_id").alias("order"), merkle.leaf_of([F.col("doc_id")]).alias("leaf"), F.lit(None).cast("string").alias("data"))
    nodes = merkle.manifest(named).nodes().collect()
    assert {x.source for x in nodes} == {"a", None}
    by = {(x.source, x.level, x.lo): x for x in nodes}
    assert len(by) == len(nodes) and max(x.level for x in nodes if x.source == "a") == 5
    for x in nodes:
        assert 0 <= x.lo < x.hi <= (100 if x.source else 5)
        if x.level:
            run = [by[x.source, x.level - 1, lo] for lo in range(x.lo, x.hi, 3 ** (x.level - 1))]
            assert run[-1].hi == x.hi and x.digest == H(*[c.digest for c in run])


# --- near copies by registers, on groups as above


@pytest.mark.parametrize("rows", [near_copies(1, 120, 100, 12, 3), near_copies(5, 20, 90, 8, 6)])
def test_near_copies_in_small_blocks(spark, rows):
    """Links around the threshold of 0.8 in blocks so small that pairs of blocks are compared."""
    p = near_dedup.Sketch(block=8)
    got = {r.doc_id: (r.n_shingles, r.component) for r in near_dedup.near_duplicates(numbered(table(spark, rows)), p=p).collect()}
    assert got == plain_components(rows, p)
