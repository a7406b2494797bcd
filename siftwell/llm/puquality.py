"""Quality classification by positive-unlabelled learning.

A small network is trained to the non-negative unbiased risk: trusted positives (label 1), the
corpus's own text as unlabelled rows, and a class prior estimated from both. Labels 0 are not used.

The prior: where a classifier of positives against unlabelled rows has odds r, the ratio of
densities is r times a constant and reaches 1/prior where negatives are absent; its median over
positives is taken for that.

Both sets are bounded samples that a hash of doc_id picks (POSITIVES, UNLABELLED rows at most, in
expectation). A null text counts as empty and is scored like any other. Texts are measured whole.
Without positives every score is 0.5. Repeated labels of a document count once. An empty table
gives no rows. Only doc_id, text and quality are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import fold, joined_bytes, kept, slices, trimmed, unit_hash

POSITIVES, UNLABELLED = 20_000, 20_000
HIDDEN = 16
STEPS, RATE = 400, 0.02
#: Words whose repeats are counted together.
SPAN = 64
#: Bytes that damp the shares of short texts.
SHORT = 100
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
#: Text that is measured at once.
TEXT_BYTES = 1 << 19

_CLASSES = np.zeros(256, np.int64)  # byte classes: 0 other; ASCII marks one by one
_CLASSES[ord("A") : ord("Z") + 1] = 1
_CLASSES[ord("a") : ord("z") + 1] = 2
_CLASSES[ord("0") : ord("9") + 1] = 3
_CLASSES[[9, 11, 12, 13, 32]] = 4
_CLASSES[10] = 5
_CLASSES[128:] = 6
_MARKS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASSES[_MARKS] = 7 + np.arange(len(_MARKS))
N_CLASSES = 7 + len(_MARKS)
N_FEATURES = N_CLASSES + 5


def features(texts: list[str | None], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scale-free measures of each text: bytes by class, repeats of words and lines, lengths."""
    n = len(texts)
    size = np.diff(offsets)
    hist = np.bincount(np.repeat(np.arange(n) * N_CLASSES, size) + _CLASSES[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    words, distinct, doubled, lines, line_kinds = np.zeros((5, n))
    for k, t in enumerate(texts):
        if not t:
            continue
        w = t.split()
        words[k] = len(w)
        distinct[k] = sum(len(set(w[a : a + SPAN])) for a in range(0, len(w), SPAN))
        doubled[k] = sum(map(str.__eq__, w, w[1:]))
        l = t.split("\n")
        lines[k], line_kinds[k] = len(l), len(set(l))
    share = np.sqrt(hist / (size + SHORT)[:, None])
    letters = hist[:, 1] + hist[:, 2] + hist[:, 6]
    damped = words + SHORT / 5  # short texts look like plain prose until they have shown otherwise
    rest = [(distinct + 0.85 * SHORT / 5) / damped, doubled / damped, (line_kinds + 2) / (lines + 2), (letters + SHORT) / damped, hist[:, 1] / (letters + SHORT)]
    rest = np.stack(rest, axis=1)
    return np.concatenate([share, rest], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w1, b1, w2, b2 = self.weights
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1)
        return h, h @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x)[1])

    def pull(self, x: np.ndarray, h: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        dh = dz[:, None] * self.weights[2] * (1 - h * h)
        return [np.clip((x - self.mean) / self.scale, -8, 8).T @ dh, dh.sum(axis=0), h.T @ dz, np.array([dz.sum()])]


def _network(x: np.ndarray, seed: int) -> Network:
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    weights = [rng.standard_normal((d, HIDDEN)) * d**-0.5, np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * HIDDEN**-0.5, np.zeros(1)]
    return Network(x.mean(axis=0), x.std(axis=0) + 0.02, weights, 0.5)


def _descend(net: Network, gradient, steps: int = STEPS, decay: float = 1e-4) -> None:
    m, v = ([np.zeros_like(w) for w in net.weights] for _ in range(2))
    for t in range(1, steps + 1):
        rate = RATE * (1 - 0.9 * t / steps)
        for k, g in enumerate(gradient()):
            g = g + decay * net.weights[k]
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net.weights[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """The share of positives among unlabelled rows."""
    x = np.concatenate([pos, unl])
    net = _network(x, 1)
    want = np.concatenate([np.ones(len(pos)), np.zeros(len(unl))])
    weight = np.concatenate([np.full(len(pos), 0.5 / len(pos)), np.full(len(unl), 0.5 / len(unl))])

    def gradient():
        h, z = net.forward(x)
        return net.pull(x, h, (_sigmoid(z) - want) * weight)

    _descend(net, gradient, 200, 1e-3)
    ratio = np.exp(np.clip(net.forward(pos)[1], -10, 10))  # both sets weigh the same, so the odds are the density ratio
    return float(np.clip(1.0 / np.median(ratio), 0.05, 0.98))


def trained(pos: np.ndarray, unl: np.ndarray, prior: float | None = None) -> Network:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the logistic loss."""
    prior = class_prior(pos, unl) if prior is None else prior
    net = _network(unl, 2)
    net.prior = prior

    def gradient():
        hp, zp = net.forward(pos)
        hu, zu = net.forward(unl)
        # loss(+) = log(1 + exp(-z)), loss(-) = log(1 + exp(z))
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        dp_plus, dp_minus, du_minus = (_sigmoid(zp) - 1) / len(pos), _sigmoid(zp) / len(pos), _sigmoid(zu) / len(unl)
        if negative >= 0:
            a, b = net.pull(pos, hp, prior * dp_plus - prior * dp_minus), net.pull(unl, hu, du_minus)
            return [x + y for x, y in zip(a, b)]
        # the estimated risk of negatives fell below zero: climb back on that part alone
        a, b = net.pull(pos, hp, prior * dp_minus), net.pull(unl, hu, -du_minus)
        return [x + y for x, y in zip(a, b)]

    _descend(net, gradient, decay=1e-4 + 0.5 / len(pos))  # few positives, smoother network
    return net


def measured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch, "text"):
                part = batch.slice(i, j - i)
                x = features(part.column("text").to_pylist(), *joined_bytes(part.column("text")))
                rows = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), rows], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


def _matrix(df: DataFrame) -> np.ndarray:
    col = df.orderBy("doc_id").select("x").toArrow().column("x").combine_chunks()
    return np.asarray(col.flatten()).reshape(len(col), N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame) -> Network | None:
    """From labels of the learning fold alone."""
    held = lambda: F.coalesce(fold("doc_id", FOLDS), F.lit(0)) == HELD_OUT
    good = labels.where((F.col("quality") == 1) & ~held()).select("doc_id").distinct()
    n_good, n_docs = good.count(), docs.count()
    if not n_good or not n_docs:
        return None
    picked = good.where(unit_hash(F.col("doc_id"), 5) < POSITIVES / n_good)
    pos = _matrix(measured(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")))  # POSITIVES ids at most
    unl = _matrix(measured(docs.where(~held() & (unit_hash(F.col("doc_id"), 6) < UNLABELLED / n_docs))))
    return trained(pos, unl) if len(pos) and len(unl) else None


def _scores(part: pa.RecordBatch, net: Network | None) -> np.ndarray:
    x = features(part.column("text").to_pylist(), *joined_bytes(part.column("text")))
    return np.full(len(x), 0.5) if net is None else net.score(x)


def scored(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch, "text"):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_scores(part, shared.value))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their columns; all of them without a model.

    Only the texts go to Python, and one number a row comes back.
    """
    if net is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept("puquality")
        for col in texts:
            part = pa.RecordBatch.from_arrays([col], ["text"])
            out = [_scores(part.slice(i, j - i), shared.value) for i, j in slices(part, "text", TEXT_BYTES)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))
        trimmed()

    return docs.where(score(docs["text"]) >= threshold)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = scored(docs, fit(docs, labels))
    return out.select("doc_id", (F.coalesce(fold("doc_id", FOLDS), F.lit(0)) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
