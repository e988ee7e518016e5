"""Language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreloom.llm.common import held_out, raw, slices


@dataclass(frozen=True)
class Sgd:
    """Parameters: ``sample`` bounds the documents learned from, ``buckets`` the table of subword embeddings."""

    buckets: int = 4096
    size: int = 16
    sample: int = 3000
    epochs: int = 20
    batch: int = 32
    rate: float = 20.0
    precision: float = 0.99
    seed: int = 3


#: ASCII letters stay, every other ASCII character ends a word; other bytes are taken for letters.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def subwords(text: str | None, buckets: int) -> np.ndarray:
    """Share of each bucket among the two- to four-byte pieces of the words of a whole text, with word boundaries."""
    b = np.frombuffer(b" " + raw((text or "").lower()).translate(_LETTERS) + b" ", np.uint8).astype(np.uint32)
    letter = b != 32
    total = np.zeros(buckets, np.float64)
    for n in (2, 3, 4):
        m = len(b) - n + 1
        if m <= 0:
            continue
        x = np.full(m, n, np.uint32)
        inside = letter[:m] | letter[1 : m + 1] if n == 2 else letter[1 : m + 1].copy()
        for k in range(n):
            x = x * np.uint32(16777619) ^ b[k : k + m]
            if 1 <= k < n - 1:
                inside &= letter[k : k + m]
        x = (x ^ (x >> np.uint32(15))) * np.uint32(2654435761)
        total += np.bincount((x[inside] >> np.uint32(8)) % np.uint32(buckets), minlength=buckets)
    return total / max(total.sum(), 1.0)


@dataclass
class Model:
    names: list[str]
    table: np.ndarray  # logits of every bucket: embeddings times softmax weights
    bias: np.ndarray
    heat: float
    least: float  # calibrated probability under which a prediction is better refused

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = (x @ self.table + self.bias) / self.heat
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        best = z.argmax(1)
        return best, z[np.arange(len(z)), best]


def sgd(x: np.ndarray, y: np.ndarray, classes: int, p: Sgd) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on embeddings and softmax weights; gives bucket logits and the bias."""
    rng = np.random.default_rng(p.seed)
    e = rng.normal(size=(x.shape[1], p.size)).astype(np.float32) * 0.1
    w = rng.normal(size=(p.size, classes)).astype(np.float32) * 0.1
    bias = np.zeros(classes, np.float32)
    share = 1 / np.maximum(np.bincount(y, minlength=classes), 1)
    weight = (share[y] * len(y) / classes).astype(np.float32)
    scale = float(np.sqrt((x**2).sum(1).mean()))  # averaged bags are short vectors
    steps, step = p.epochs * -(-len(x) // p.batch), 0
    for _ in range(p.epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), p.batch):
            i = order[at : at + p.batch]
            h = x[i] @ e
            z = h @ w + bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(i)), y[i]] -= 1
            z *= np.minimum(weight[i], 10)[:, None] / len(i)
            rate = p.rate * (1 - step / steps)
            step += 1
            back = z @ w.T
            w -= rate / 20 * (h.T @ z) / max(scale, 1e-3)
            e -= rate * (x[i].T @ back) / max(scale, 1e-3)
            bias -= rate / 200 * z.sum(0)
    return (e @ w).astype(np.float64), bias.astype(np.float64)


def fit(docs: DataFrame, learn, p: Sgd = Sgd(), doc_id="doc_id", text="text", lang="lang") -> Model | None:
    """Fit on at most ``sample`` documents with a language that ``learn`` admits, drawn by a hash of the id.

    A fifth of the sample sets the heat of the softmax and the least probability at which its predictions keep the
    asked precision.  None if no document has a language.
    """
    rows = docs.where(F.col(lang).isNotNull() & learn(F.col(doc_id))).select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"))
    drawn = rows.orderBy(F.xxhash64("_id"), "_id", "_lang").limit(p.sample).groupBy("_id").agg(F.min("_lang").alias("_lang"))
    known = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).join(F.broadcast(drawn), F.col("_d") == F.col("_id")).select("_id", "_lang", "_t")

    def run(batches):
        for whole in batches:
            for part in slices(whole, 2):
                x = [subwords(t, p.buckets).astype(np.float32).tobytes() for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], ["_id", "_lang", "_x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = known.mapInArrow(run, f"_id {kind}, _lang string, _x binary").toArrow().sort_by("_id")  # bounded by sample
    names = sorted(set(got.column("_lang").to_pylist()))
    if not names:
        return None
    x = np.stack([np.frombuffer(v, np.float32) for v in got.column("_x").to_pylist()])
    y = np.array([names.index(v) for v in got.column("_lang").to_pylist()])
    check = np.arange(len(y)) % 5 == 4
    table, bias = sgd(x[~check], y[~check], len(names), p)
    model = Model(names, table, bias, 1.0, 0.0)
    if check.any():
        xs, ys = x[check].astype(float), y[check]
        z = xs @ table + bias

        def loss(heat):
            s = z / heat
            return (np.logaddexp.reduce(s, axis=1) - s[np.arange(len(ys)), ys]).mean()

        model.heat = float(min(np.geomspace(0.05, 20, 121), key=loss))
        best, sure = model.predict(xs)
        order = np.argsort(-sure, kind="stable")
        right = np.cumsum(best[order] == ys[order]) / np.arange(1, len(ys) + 1)
        good = np.flatnonzero(right >= p.precision)
        model.least = float(sure[order][good[-1]]) if len(good) else 1.0
    return model


def predicted(docs: DataFrame, model: Model | None, text: str = "text", buckets: int = Sgd.buckets) -> DataFrame:
    """``docs`` with ``_pred``, ``_score`` and ``_rejected`` in place of the text.

    ``und`` with score 0 for null texts and texts without a letter, and for all if nothing was learned.  Other texts
    get the likeliest language; ``_rejected`` tells that its probability is under the calibrated least.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text"))

    def run(batches):
        model = sent.value
        for whole in batches:
            for part in slices(whole, len(kept)):
                texts = part.column(len(kept)).to_pylist()
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                known = [i for i, t in enumerate(texts) if t and model and any(map(str.isalpha, t))]
                for at in range(0, len(known), 512):
                    here = known[at : at + 512]
                    best, sure = model.predict(np.stack([subwords(texts[i], buckets) for i in here]))
                    for i, b, s in zip(here, best, sure):
                        pred[i], score[i] = model.names[b], float(s)
                rejected = [s < model.least if model else True for s in score]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    schema=pa.schema([*list(part.schema)[:-1], pa.field("_pred", pa.string()), pa.field("_score", pa.float64()), pa.field("_rejected", pa.bool_())]),
                )

    schema = rows.drop("_text").withColumn("_pred", F.lit("")).withColumn("_score", F.lit(0.0)).withColumn("_rejected", F.lit(False)).schema
    return rows.mapInArrow(run, schema)


def languages(docs: DataFrame, p: Sgd = Sgd()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every document."""
    model = fit(docs, lambda i: ~held_out(i, 4, 2), p)
    out = predicted(docs.select("doc_id", "text"), model, buckets=p.buckets)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"), F.col("_rejected").alias("rejected"))
