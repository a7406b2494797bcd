"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its hashed byte n-grams (letters only, ASCII letters
lower-cased). Document frequencies come from all learning rows. Each language has several
centroids, found by spherical clustering of a bounded sample of its rows. A text's language is
that of the centroid of largest cosine; a text farther from it than nearly all rows that the
centroid was made from is marked as rejected (it keeps the nearest language).

A null text, and one without letters, is `und` with score 0. Learning rows need a text and a
language. Ties go to the language that sorts first. Texts of any length are read whole. An empty
table gives no rows; without learning rows every text is `und`. Repeated rows count each time.
Only doc_id, text and lang are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import fold, joined_bytes, slices, unit_hash

ORDERS = (2, 3)
DIMS = 4096
#: Learning rows that a language's centroids are made from at most, and the bytes of their texts.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 24 << 20
CENTROIDS = 4
#: Share of a centroid's own rows that are within its rejection distance.
ACCEPTED = 0.995
SHARPNESS = 25.0
#: Documents whose vectors are held at once.
ROWS = 256
FOLDS, HELD_OUT = 4, 2

_LETTERS = np.array([32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c | 32 if c < 128 else c for c in range(256)], np.uint8)


def gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, a row a document."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros(n * DIMS, np.int64)
    doc = np.repeat(np.arange(n) * DIMS, size)
    end = np.repeat(offsets[1:], size)
    b = _LETTERS[data].astype(np.uint32)
    for order in ORDERS:
        if len(b) < order:
            continue
        code = np.zeros(len(b) - order + 1, np.uint32)
        with np.errstate(over="ignore"):
            for k in range(order):
                code = code * np.uint32(257) + b[k : len(b) - order + 1 + k]
            code = (code + np.uint32(order)) * np.uint32(2654435761)
        inside = np.arange(len(code)) + order <= end[: len(code)]
        blank = b[: len(code)] == 32
        blank &= b[1 : len(code) + 1] == 32  # runs of blanks say nothing
        use = inside & ~blank
        out += np.bincount(doc[: len(code)][use] + (code[use] >> np.uint32(20)), minlength=n * DIMS)
    return out.reshape(n, DIMS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return (x / np.maximum(norm, 1e-12)).astype(np.float32)


def _by_rows(batch: pa.RecordBatch):
    for i, j in slices(batch, "text"):
        for a in range(i, j, ROWS):
            part = batch.slice(a, min(ROWS, j - a))
            yield part, gram_counts(*joined_bytes(part.column("text")))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each n-gram, and documents. The driver gets one row a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for part, counts in _by_rows(batch):
                total += (counts > 0).sum(axis=0)
                rows += part.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.append(rows, total))], ["dim", "n"])

    df, n = np.zeros(DIMS), 0
    for dim, count in train.select("text").mapInArrow(run, "dim long, n long").groupBy("dim").agg(F.sum("n")).collect():
        if dim < 0:
            n = count
        else:
            df[dim] = count
    return df, n


def clustered(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from a spread-out start: centroids, and their rejection distances."""
    k = min(k, len(x))
    centre = [x.mean(axis=0)]
    nearest = x @ centre[0]
    for _ in range(k - 1):
        centre.append(x[int(np.argmin(nearest))])
        nearest = np.maximum(nearest, x @ centre[-1])
    c = np.stack(centre)
    for _ in range(8):
        c = c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
        own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(k)])
    c = c / np.maximum(np.sqrt((c * c).sum(axis=1, keepdims=True)), 1e-12)
    cos = x @ c.T
    own = np.argmax(cos, axis=1)
    far = np.array([1.0 - np.quantile(cos[own == i, i], 1 - ACCEPTED) if (own == i).any() else 0.0 for i in range(k)])
    return c, far


@dataclass
class Model:
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    lang_of: np.ndarray
    reach: np.ndarray

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score and rejection of each row."""
        cos = weighted(counts, self.idf) @ self.centroids.T
        best = np.full((len(counts), len(self.langs)), -1.0)
        for i, l in enumerate(self.lang_of.tolist()):
            best[:, l] = np.maximum(best[:, l], cos[:, i])
        lang = np.argmax(best, axis=1)
        e = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
        near = np.argmax(cos, axis=1)
        return lang, 1.0 / e.sum(axis=1), 1.0 - cos[np.arange(len(cos)), near] > self.reach[near] + 1e-6


def fit(train: DataFrame, centroids: int = CENTROIDS) -> Model | None:
    """From text and lang. Each language's sample is picked by a hash and clustered in a task of its own."""
    train = train.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    df, n = document_frequencies(train)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 0.1
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).collect()
    share = F.lit(0.0)
    for lang, rows, size in sizes:
        share = F.when(F.col("lang") == lang, min(1.0, SAMPLE_ROWS / rows, SAMPLE_BYTES / max(1, size))).otherwise(share)
    sample = train.where(unit_hash(F.col("doc_id"), 1) < share)

    def group(table: pa.Table) -> pa.Table:
        xs = [weighted(c, idf) for b in table.combine_chunks().to_batches() for _, c in _by_rows(b)]
        c, far = clustered(np.concatenate(xs), centroids)
        return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * len(c)), "far": pa.array(far.astype(np.float64)), "c": pa.array(c.astype(np.float32).tolist(), pa.list_(pa.float32()))})

    rows = sample.groupBy("lang").applyInArrow(group, "lang string, far double, c array<float>").collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    return Model(idf, langs, np.array([r["c"] for r in rows], np.float32), np.array([langs.index(r["lang"]) for r in rows]), np.array([r["far"] for r in rows]))


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every document, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part, counts in _by_rows(batch):
                letters = [any(map(str.isalpha, t or "")) for t in part.column("text").to_pylist()]
                if m is None:
                    lang, score, far = ["und"] * len(letters), np.zeros(len(letters)), np.ones(len(letters), bool)
                else:
                    at, score, far = m.predict(counts)
                    lang = [m.langs[k] if ok else "und" for k, ok in zip(at.tolist(), letters)]
                    score, far = np.where(letters, score, 0.0), far | ~np.array(letters)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang), pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the learning fold, predict every document."""
    held = F.coalesce(fold("doc_id", FOLDS), F.lit(0)) == HELD_OUT
    model = fit(docs.where(~held))
    return predicted(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
