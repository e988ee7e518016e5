"""Quality scores: random Fourier features of document statistics, ridge by partition-summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreloom.llm.common import discard, held_out, park, slices


@dataclass(frozen=True)
class Ridge:
    """Parameters: ``sample`` bounds the labelled rows learned from, ``parts`` the partitions whose sums are added."""

    features: int = 320
    width: float = 4.0
    ridge: float = 1e-2
    sample: int = 24_000
    parts: int = 12
    seed: int = 11


N = 16


def statistics(text: str | None) -> list[float]:
    """Sixteen statistics of a whole text; all finite, for the empty text as well."""
    t = text or ""
    words = t.split()
    n, chars = len(words), len(t)
    if not n:
        return [0.0] * N
    sizes = np.fromiter(map(len, words), np.int32, n)
    counts = Counter(words)
    lines = t.split("\n")
    again = sum(a == b for a, b in zip(words, words[1:]))
    upper = sum(map(str.isupper, words))
    ends = t.count(".") + t.count("!") + t.count("?")
    marks = sum(t.count(c) for c in "*$&%#")
    spaces = n + len(lines)
    return [
        np.log1p(n), float(sizes.mean()), float(np.log1p(sizes.max())), float(sizes.std()),
        len(counts) / n, counts.most_common(1)[0][1] / n, again / n, upper / n,
        marks / n, t.count("!") / n, t.count("|") / n, sum(t.count(c) for c in "0123456789") / chars,
        ends / n, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), t.count(",") / spaces,
    ]


def measured(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``_x``, the statistics, in place of the text."""
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text"))

    def run(batches):
        for whole in batches:
            for part in slices(whole, len(kept)):
                x = [statistics(t) for t in part.column(len(kept)).to_pylist()]
                field = pa.field("_x", pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(x, field.type)], schema=pa.schema([*list(part.schema)[:-1], field]))

    return rows.mapInArrow(run, rows.drop("_text").withColumn("_x", F.array(F.lit(0.0))).schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # isotonic: raw scores and the shares of label 1
    shares: np.ndarray

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases)
        return np.hstack([waves, np.ones((len(x), 1))])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.mapped(x) @ self.weights, self.knots, self.shares)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of labels on scores: block means at block centres, between which one interpolates."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of x, sum of y, rows
    for a, b in zip(x[order], y[order]):
        blocks.append([a, b, 1.0])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    b = np.array(blocks)
    # half a row of either label keeps every share inside (0, 1)
    return b[:, 0] / b[:, 2], (b[:, 1] + 0.5) / (b[:, 2] + 1.0)


def fit(docs: DataFrame, labels: DataFrame, learn, p: Ridge = Ridge(), doc_id="doc_id", text="text", label="quality") -> Model:
    """Fit on at most ``sample`` labelled rows that ``learn`` admits, drawn by a hash of the id.

    A fifth of the sample calibrates.  The normal equations are summed inside ``parts`` partitions; only the sums come
    to the driver.  With one label alone every document gets its share; without labels 0.5.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_y").isin(0, 1) & learn(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(p.sample)
    rows = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).join(F.broadcast(known), F.col("_d") == F.col("_id"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("_id")), F.lit(5)) == 0
    seen = park(measured(rows.select("_id", "_y", fold.alias("_fold"), "_t"), "_t"), "measured")
    stats = seen.agg(
        F.count(F.lit(1)).alias("n"), F.avg("_y").alias("y"),
        *[f(F.get("_x", F.lit(i))).alias(f"{k}{i}") for i in range(N) for k, f in (("m", F.avg), ("s", F.stddev_pop))],
    ).first()
    rng = np.random.default_rng(p.seed)
    n = stats["n"]
    mean = np.array([stats[f"m{i}"] or 0.0 for i in range(N)])
    scale = np.array([max(stats[f"s{i}"] or 0.0, 1e-6) for i in range(N)])
    model = Model(
        mean, scale, rng.normal(size=(N, p.features)) / p.width, rng.uniform(0, 2 * np.pi, p.features),
        np.zeros(p.features + 1), np.zeros(1), np.full(1, 0.5 if not n else (stats["y"] * n + 0.5) / (n + 1)),
    )
    if not n or stats["y"] in (0.0, 1.0):
        discard(seen)
        return model

    def sums(batches):
        a, b = np.zeros((p.features + 1,) * 2), np.zeros(p.features + 1)
        for x in batches:
            if len(x):
                z = model.mapped(np.stack(x.column(0).to_numpy(zero_copy_only=False)))
                a += z.T @ z
                b += z.T @ x.column(1).to_numpy().astype(float)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], ["a", "b"])

    part = F.pmod(F.xxhash64("_id"), F.lit(p.parts))
    learned = seen.where(~F.col("_fold")).repartition(p.parts, part).sortWithinPartitions("_id").select("_x", "_y")
    got = learned.mapInArrow(sums, "a binary, b binary").toArrow()  # ``parts`` rows, each as large as the equations
    a = sum(np.frombuffer(v).reshape(p.features + 1, -1) for v in got.column("a").to_pylist())
    b = sum(np.frombuffer(v) for v in got.column("b").to_pylist())
    model.weights = np.linalg.solve(a + p.ridge * np.eye(len(b)), b)
    held = seen.where("_fold").orderBy("_id").select("_x", "_y").toArrow()  # a fifth of the sample
    if held.num_rows:
        x, y = np.array(held.column("_x").to_pylist()), held.column("_y").to_numpy().astype(float)
        model.knots, model.shares = isotonic(model.mapped(x) @ model.weights, y)
    discard(seen)
    return model


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``_score`` in place of the text; null and empty texts have statistics of zero and a score like any other."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text"))

    def run(batches):
        for whole in batches:
            for part in slices(whole, len(kept)):
                s = sent.value.scores(np.array([statistics(t) for t in part.column(len(kept)).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s)], schema=pa.schema([*list(part.schema)[:-1], pa.field("_score", pa.float64())]))

    return rows.mapInArrow(run, rows.drop("_text").withColumn("_score", F.lit(0.0)).schema)


def quality(docs: DataFrame, labels: DataFrame, p: Ridge = Ridge(), cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document; rows are answered one by one."""
    model = fit(docs, labels, lambda i: ~held_out(i, 5, 0), p)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= cut).cast("int").alias("predicted"))
