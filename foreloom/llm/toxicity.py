"""Toxicity by a support vector machine on a subsequence string kernel, with Nystroem landmarks."""

from __future__ import annotations

import math
import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreloom.llm.common import held_out, slices

# What stands for a letter inside a word, and the characters that have a code of their own.
LIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßéèêëçñíóáúàâîïôû"
SENTENCE = re.compile(r"[.!?]+\s|\n+")
SPACED = re.compile(r"(?<!\S)(?:\S\s){3,}\S(?!\S)")


@dataclass(frozen=True)
class Kernel:
    """Parameters.

    The kernel counts common subsequences of three characters that span at most ``span``, each weighted by ``decay`` to
    the power of its span, and is normalised.  It is applied to the units of a sentence: words between boundary marks,
    without the signs inserted in them, letter by letter spellings taken as one.  A linear machine on it finds the toxic
    units of the bags; units over a gate go to a second one, on the Gaussian exp(sharp * (kernel - 1)).
    ``toxic`` and ``clean`` bound the labelled documents the fit reads, ``most_units`` its clean units, ``landmarks``
    the approximation of the kernels.  The gate lets a share ``passing`` of the clean units through, more if it would
    stop more than one in a hundred of the toxic units found.
    """

    span: int = 6
    decay: float = 0.6
    landmarks: int = 300
    toxic: int = 1500
    clean: int = 3000
    most_units: int = 20_000
    rounds: int = 3
    penalty: float = 1e-4
    sharp: float = 3.0
    passing: float = 0.05
    tops: int = 3


BASE = 64
_CODES = np.full(1 << 16, 3, np.uint32)  # any other letter
for _i, _c in enumerate(LETTERS):
    _CODES[ord(_c)] = 4 + _i
_CODES[ord("^")], _CODES[ord("$")] = 1, 2


def unit(token: str) -> str:
    """A token without the signs around and inside it, look-alikes read as letters."""
    if token.isalpha():
        return token
    a, b = 0, len(token)
    while a < b and not token[a].isalpha():
        a += 1
    while b > a and not token[b - 1].isalpha():
        b -= 1
    inner = token[a:b]
    return inner if inner.isalpha() else "".join(filter(str.isalpha, inner.translate(LIKE)))


def tokens(text: str | None) -> set[str]:
    """Distinct tokens of a text in lower case, spaced-out spellings joined to one token besides."""
    if not text:
        return set()
    text = text.lower()
    out = set(text.split())
    for m in SPACED.finditer(text):
        out.add("".join(m.group().split()))
    return out


class Features:
    """Weighted subsequences of units, as codes below BASE**3."""

    def __init__(self, k: Kernel):
        self.k = k
        self.gaps = [(a, b) for a in range(1, k.span) for b in range(1, k.span - a)]

    def of(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit number, code, value), summed per unit and code and scaled to length 1 per unit."""
        text = "".join(f"^{u}$" for u in units)
        code = _CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)].astype(np.int64)
        owner = np.repeat(np.arange(len(units)), [len(u) + 2 for u in units])
        where, value = [], []
        for a, b in self.gaps:
            n = len(code) - a - b
            if n <= 0:
                continue
            inside = owner[:n] == owner[a + b :]
            x = (owner[:n] * BASE + code[:n]) * BASE * BASE + code[a : a + n] * BASE + code[a + b :]
            where.append(x[inside])
            value.append(np.full(len(where[-1]), self.k.decay ** (a + b + 1)))
        key, at = np.unique(np.concatenate([np.empty(0, np.int64), *where]), return_inverse=True)
        summed = np.bincount(at, np.concatenate([np.empty(0), *value]), minlength=len(key))
        who, what = key // BASE**3, key % BASE**3
        length = np.sqrt(np.bincount(who, summed**2, minlength=len(units)))
        return who, what, summed / length[who]

    def linear(self, units: list[str], table: np.ndarray) -> np.ndarray:
        """Sum of a unit's values by the weights in ``table``."""
        who, what, value = self.of(units)
        return np.bincount(who, value * table[what], minlength=len(units))


    def most(self, units: list[str], table: np.ndarray) -> np.ndarray:
        """What ``linear`` is at most, where that is positive: the sum over the length without repeats, which is no longer."""
        k = self.k
        sizes = np.fromiter(map(len, units), np.int64, len(units)) + 2
        text = "^" + "$^".join(units) + "$"
        code = _CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 65535)].astype(np.int32)
        owner = np.repeat(np.arange(len(units), dtype=np.int32), sizes)
        total = np.zeros(len(code), np.float32)
        square = np.zeros(len(units))
        first, second = code * np.int32(BASE * BASE), code * np.int32(BASE)
        for a, b in self.gaps:
            n = len(code) - a - b
            value = k.decay ** (a + b + 1)
            square += np.maximum(sizes - a - b, 0) * value**2
            if n > 0:
                x = table[first[:n] + second[a : a + n] + code[a + b :]]
                x *= owner[:n] == owner[a + b :]
                total[:n] += np.float32(value) * x
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(total, starts) / np.sqrt(square)


class Landmarks:
    """Kernel values against fixed units."""

    CHUNK = 256

    def __init__(self, f: Features, units: list[str]):
        self.f = f
        who, what, value = f.of(units)
        codes, at = np.unique(what, return_inverse=True)
        self.where = np.zeros(BASE**3, np.int32)  # 0: in no landmark
        self.where[codes] = np.arange(1, len(codes) + 1)
        self.dense = np.zeros((len(codes) + 1, len(units)), np.float32)
        self.dense[at + 1, who] = value
        self.codes = codes

    def kernel(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), self.dense.shape[1]), np.float32)
        for i in range(0, len(units), self.CHUNK):
            who, what, value = self.f.of(units[i : i + self.CHUNK])
            row = self.where[what]
            who, row, value = who[row > 0], row[row > 0], value[row > 0]
            if len(who):
                starts = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
                out[i + who[starts]] = np.add.reduceat(self.dense[row] * value[:, None].astype(np.float32), starts, axis=0)
        return out

    def table(self, weights: np.ndarray) -> np.ndarray:
        """The landmarks' weighted sum, written out by code."""
        out = np.zeros(BASE**3, np.float32)
        out[self.codes] = self.dense[1:] @ weights
        return out


def _root(kmm: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh((kmm + kmm.T).astype(float) / 2)
    good = values > 1e-6
    return vectors[:, good] / np.sqrt(values[good])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, start: np.ndarray | None = None) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps on the active rows; the last coefficient is the offset."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = penalty * 1e-3

    def loss(w):
        return (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + (ridge * w * w).sum()

    now = loss(w)
    while True:
        active = y * (x @ w) < 1
        xa, wa = x[active], weight[active]
        hess = (xa * wa[:, None]).T @ xa + np.diag(ridge)
        step = np.linalg.solve(hess, xa.T @ (wa * y[active]) - hess @ w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        new = loss(w + size * step)
        if now - new <= 1e-7 * max(now, 1e-12):
            return w
        w, now = w + size * step, new


@dataclass
class Model:
    kernel: Kernel
    table: np.ndarray  # first machine: the weight of every subsequence
    offset: float
    marks: list[str]  # second machine: landmarks, their weights, offset
    weights: np.ndarray
    offset2: float
    gate: float
    top: np.ndarray  # logistic weights of the best units' scores, the last the constant
    low: float

    def unit_scores(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), self.low)
        if not len(units) or not self.marks:
            return out
        f = Features(self.kernel)
        if not hasattr(self, "_held"):
            self._held = Landmarks(f, self.marks)
        over = np.arange(len(units))
        if self.offset < self.gate:  # then only units with a positive sum can be over the gate
            over = np.flatnonzero(f.most(units, self.table) + self.offset > self.gate)
        if len(over):
            over = over[f.linear([units[i] for i in over], self.table) + self.offset > self.gate]
        if len(over):
            near = np.exp(self.kernel.sharp * (self._held.kernel([units[i] for i in over]) - 1))
            out[over] = np.maximum(near @ self.weights + self.offset2, self.low)
        return out

    def scorer(self, limit: int = 300_000):
        """A function from texts to scores that remembers the units it has seen, up to a bound."""
        seen: dict[str, float] = {}

        def score(texts):
            found = [tokens(t) for t in texts]
            if len(seen) > limit:
                seen.clear()
            new = list(set().union(*(f.difference(seen) for f in found)))
            for at in range(0, len(new), 20_000):
                part = new[at : at + 20_000]
                names = [unit(t) for t in part]
                real = [i for i, u in enumerate(names) if len(u) > 1]
                value = dict.fromkeys(part, self.low)
                for i, s in zip(real, self.unit_scores([names[i] for i in real])):
                    value[part[i]] = float(s)
                seen.update(value)
            tops = np.array([self.tops(list(map(seen.__getitem__, f))) for f in found]).reshape(len(found), self.kernel.tops + 1)
            return 1 / (1 + np.exp(-np.clip(tops @ self.top[:-1] + self.top[-1], -30, 30)))

        return score

    def tops(self, scores: list[float]) -> list[float]:
        """The best scores, cut to the range that the machine separates, and the log of how many there were."""
        best = sorted(scores, reverse=True)[: self.kernel.tops]
        return [min(max(s, self.low), 1.5) for s in best] + [self.low] * (self.kernel.tops - len(best)) + [math.log1p(len(scores))]


def sentences(docs: DataFrame, labels: DataFrame, k: Kernel, learn, doc_id="doc_id", text="text", label="toxic") -> DataFrame:
    """(doc_id, label, units) of the sentences of a bounded sample of labelled documents that ``learn`` admits.

    The sample is taken by a hash of the id, up to ``toxic`` and ``clean`` documents; labels are a narrow table, so
    the choice costs no text.
    """
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.where(F.col("_label").isin(0, 1) & learn(F.col("_id"))).groupBy("_id").agg(F.max("_label").alias("_label"))
    drawn = [known.where(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id").limit(n) for v, n in ((1, k.toxic), (0, k.clean))]
    drawn = drawn[0].unionAll(drawn[1])  # at most toxic + clean rows
    rows = docs.where(F.col(text).isNotNull()).join(F.broadcast(drawn), F.col(doc_id) == F.col("_id")).select("_id", "_label", F.col(text).alias("_text"))

    def run(batches):
        for whole in batches:
            for part in slices(whole, 2):
                out = [
                    (i, y, sorted({u for u in map(unit, tokens(s)) if len(u) > 1}))
                    for i, y, t in zip(*(part.column(c).to_pylist() for c in range(3)))
                    for s in SENTENCE.split(t)
                ]
                out = [o for o in out if o[2]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], part.schema.field(0).type), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.string()))],
                    ["doc_id", "label", "units"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, label int, units array<string>")


def fit(docs: DataFrame, labels: DataFrame, learn, k: Kernel = Kernel(), doc_id="doc_id", text="text", label="toxic") -> Model:
    """Fit on labelled sentences; ``learn`` maps the id column to the rows that may be learned from.

    A sentence has its document's label.  Those of clean documents are clean; those of a toxic document are a bag that
    holds at least one toxic unit, which is searched: at first units that toxic documents have far more often than
    clean ones, then by turns the machine's best unit of every toxic document.  Without both labels the model answers
    the share of toxic documents, or 0.5 if there are none at all.
    """
    found = sentences(docs, labels, k, learn, doc_id, text, label)
    per_doc = found.groupBy("doc_id", "label").agg(F.array_distinct(F.flatten(F.collect_list("units"))).alias("units"))

    def run(batches):
        batches = list(batches)
        # in the order of ids, however tasks delivered them
        table = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending"), ("label", "ascending")]) if batches else None
        model = learned(table, k)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # the rows of the sample, at most toxic + clean documents, meet in one task; only the model reaches the driver
    told = per_doc.select("doc_id", "label", "units").coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(told["model"]) if told else learned(None, k)


def learned(table: pa.Table | None, k: Kernel) -> Model:
    """The fit itself, on the sample's (label, units) in the order of ids."""
    y = np.array(table.column("label").to_pylist(), int) if table else np.zeros(0, int)
    low = -1.5
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(k, np.zeros(BASE**3, np.float32), 0.0, [], np.zeros(0), 0.0, 0.0, np.array([0.0] * (k.tops + 1) + [np.log(share / (1 - share))]), low)
    flat = table.column("units").combine_chunks()
    ends = flat.offsets.to_numpy()
    coded = flat.values.dictionary_encode()
    vocabulary, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    del table, flat, coded
    owner = np.repeat(np.arange(len(y)), np.diff(ends))
    pos = np.bincount(at[y[owner] == 1], minlength=len(vocabulary)).astype(float)
    neg = np.bincount(at[y[owner] == 0], minlength=len(vocabulary)).astype(float)
    # how much of a unit's presence in toxic documents its presence in clean ones does not explain
    rate = (y == 1).sum() / (y == 0).sum()
    excess = (pos - rate * neg) / (pos + rate * neg + 1)
    names = np.array(vocabulary, object)
    order = np.lexsort((np.arange(len(names)), -pos * np.maximum(excess, 0)))
    rng = np.random.default_rng(7)
    clean = np.flatnonzero(neg > 0)
    clean = rng.permutation(clean)[: k.most_units]
    # landmarks: half the units that mark toxic documents best, half clean ones
    marks = np.concatenate([order[: k.landmarks // 2], clean[: k.landmarks - k.landmarks // 2]])
    marks = marks[np.sort(np.unique(marks, return_index=True)[1])]
    f = Features(k)
    held = Landmarks(f, list(names[marks]))
    root = _root(held.kernel(list(names[marks])))

    def mapped(which):
        return held.kernel(list(names[which])) @ root

    x_clean = mapped(clean)
    w_clean = neg[clean] ** 0.7
    bags = [np.unique(at[ends[i] : ends[i + 1]]) for i in np.flatnonzero(y == 1)]
    witness = np.flatnonzero((pos >= max(3, 0.004 * (y == 1).sum())) & (excess > 0.7))  # in order of number
    # a bag's units share its credit, so that the vocabulary of a toxic document with many copies does not stand out
    for _ in range(3):
        mark = np.zeros(len(names), bool)
        mark[witness] = True
        credit = np.zeros(len(names))
        for b in bags:
            own = b[mark[b]]
            credit[own] += 1 / max(len(own), 1)
        witness = witness[credit[witness] >= max(1.0, 0.002 * len(bags))]
    if not len(witness):
        witness = order[: max(1, k.landmarks // 4)]
    first, pull = witness, np.minimum(credit[witness] + 1.0, 50.0)
    told = np.zeros(len(names), bool)
    told[first] = True
    bags = [b for b in bags if not told[b].any()]  # only bags without such a unit are searched further
    weight = pull
    beta = None
    for turn in range(k.rounds):
        x = np.vstack([mapped(witness), x_clean])
        sign = np.concatenate([np.ones(len(witness)), -np.ones(len(clean))])
        each = np.concatenate([weight / weight.sum(), w_clean / w_clean.sum()])
        beta = _svm(x, sign, each, k.penalty, beta)
        collapsed = held.table(root @ beta[:-1])
        offset = float(beta[-1])
        if turn + 1 == k.rounds:
            break
        every = np.unique(np.concatenate([np.empty(0, int), *bags]))
        score = np.full(len(names), -9.0)
        for i in range(0, len(every), 20_000):
            part = every[i : i + 20_000]
            score[part] = f.linear(list(names[part]), collapsed) + offset
        best = np.array([b[np.argmax(score[b])] for b in bags], int)
        best = best[score[best] > 0]  # a bag without any such unit is taken for a wrong label
        if not len(best):
            break
        # the units that gave themselves away at first stay, or a bag's best one would push its others out
        witness, times = np.unique(np.concatenate([best, first]), return_counts=True)
        weight = np.minimum(times.astype(float), 50.0)
        weight[np.searchsorted(witness, first)] = pull
    # second machine: the witnesses against the clean units that the first one finds hard, and some others
    linear = np.concatenate([f.linear(list(names[i : i + 20_000]), collapsed) for i in range(0, len(names), 20_000)]) + offset
    gate = float(min(np.quantile(linear[clean], 1 - k.passing), np.quantile(linear[witness], 0.01))) if len(clean) else -9.0
    hard = np.flatnonzero((neg > 0) & (linear > gate))
    hard = hard[np.argsort(-linear[hard], kind="stable")][: k.most_units]
    hard = np.setdiff1d(np.concatenate([hard, clean[:2000]]), witness)
    spread = np.argsort(-neg[hard], kind="stable")
    marks = np.concatenate([witness[np.argsort(-weight, kind="stable")][: k.landmarks * 2 // 3], hard[spread][: k.landmarks // 3]])
    held = Landmarks(f, list(names[marks]))

    def sharp(which):
        return np.exp(k.sharp * (held.kernel(list(names[which])).astype(float) - 1))

    root = _root(sharp(marks))
    x = np.vstack([sharp(witness), sharp(hard)]) @ root
    sign = np.concatenate([np.ones(len(witness)), -np.ones(len(hard))])
    each = np.concatenate([weight / weight.sum(), neg[hard] / neg[hard].sum() if len(hard) else []])
    beta = _svm(x, sign, each, k.penalty)
    model = Model(k, collapsed, offset, list(names[marks]), root @ beta[:-1], float(beta[-1]), gate, np.zeros(k.tops + 2), low)
    score = np.concatenate([model.unit_scores(list(names[i : i + 20_000])) for i in range(0, len(names), 20_000)])
    tops = np.array([model.tops(list(score[at[ends[i] : ends[i + 1]]])) for i in range(len(y))])
    model.top = _logistic(tops, y)
    del model._held  # what workers make again is not sent to them
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps with halving; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])

    def loss(w):
        z = x @ w
        return np.logaddexp(0, -(2 * y - 1) * z).sum() + ridge * (w @ w)

    while True:
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - y) + 2 * ridge * w
        hess = (x * (q * (1 - q))[:, None]).T @ x + 2 * ridge * np.eye(len(w))
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        if loss(w) - loss(w - size * step) < 1e-8:
            return w
        w = w - size * step


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``_score`` (0 to 1) in place of the text.

    Null, empty and wordless texts get the score of a text without any toxic unit.  Rows are answered one by one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("_text"))

    def run(batches):
        score = sent.value.scorer()
        for whole in batches:
            for part in slices(whole, len(kept)):
                s = score(part.column(len(kept)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(s, pa.float64())], schema=pa.schema([*list(part.schema)[:-1], pa.field("_score", pa.float64())])
                )

    return rows.mapInArrow(run, rows.drop("_text").withColumn("_score", F.lit(0.0)).schema)


def learnable(doc_id):
    return ~held_out(doc_id, 5, 0)


def toxicity(docs: DataFrame, labels: DataFrame, k: Kernel = Kernel()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = fit(docs, labels, learnable, k)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted")
    )


def keep_civil(docs: DataFrame, labels: DataFrame, k: Kernel = Kernel()) -> DataFrame:
    """The documents that are not predicted toxic, with the columns they came with."""
    model = fit(docs, labels, learnable, k)
    copy = docs.withColumn("_scored_", F.col("text"))
    return scored(copy, model, "_scored_").where("_score < 0.5").select(*[F.col(f"`{c}`") for c in docs.columns])
