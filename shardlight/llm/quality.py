"""Quality classifier: a factorisation machine over hashed words, structure statistics and the metadata that a text has of itself (its
length and shape); labels, lang, source and doc_id are no features.

score = sigmoid(w0 + <w, x> + sum over pairs <v_i, v_j> x_i x_j); the pair sum is half of (sum v x)^2 - sum v^2 x^2,
linear in the number of features. Features: log counts of hashed words, scaled to unit length, and one-hot
buckets of statistics over the whole text. It is fitted on at most ``max_rows`` hash-chosen labelled rows.

Null text is empty; empty text has statistics only; without labelled rows every score is the prior 0.5; repeated
labels of a document each count; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, word_hashes

BITS, BUCKETS = 15, 12
#: Everything but white space is part of a word: marks around it count.
SOLID = np.array([c not in b" \t\n\v\f\r" for c in range(256)])
_CLASSES = {
    "upper": np.array([65 <= c <= 90 for c in range(256)]),
    "digit": np.array([48 <= c <= 57 for c in range(256)]),
    "mark": np.array([33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in range(256)]),
    "stop": np.array([c in b".,;:'\"" for c in range(256)]),
    "table": np.array([c in b"|<>{}[]=\t" for c in range(256)]),
    "shout": np.array([c in b"!?#$%&*@~^" for c in range(256)]),
    "line": np.array([c == 10 for c in range(256)]),
    "high": np.array([c >= 128 for c in range(256)]),
}
_MATRIX = np.stack(list(_CLASSES.values())).astype(np.float64)
N_STATS = len(_CLASSES) + 4
N_FEATURES = (1 << BITS) + N_STATS * BUCKETS


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, counts = np.unique(word_hashes(raw, SOLID), return_counts=True)
    size, n = max(1, len(raw)), max(1, int(counts.sum()))
    ratios = _MATRIX @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / size
    level = np.r_[
        np.where(ratios > 0, np.clip(BUCKETS - 1 + np.log2(np.maximum(ratios, 1e-9)), 1, BUCKETS - 1), 0),
        len(words) / n * (BUCKETS - 1),
        np.log2(1 + len(raw)) * 0.6,
        np.clip(size / n, 0, BUCKETS - 1),
        counts.max(initial=0) / n * (BUCKETS - 1),
    ]
    stats = (1 << BITS) + np.arange(N_STATS) * BUCKETS + np.clip(level, 0, BUCKETS - 1).astype(np.int64)
    value = 1 + np.log(counts)
    value = value / max(1e-9, np.sqrt((value**2).sum()))
    return np.r_[(words >> np.uint64(64 - BITS)).astype(np.int64), stats], np.r_[value, np.full(N_STATS, 0.3)]


class Machine:
    """w0, w and v of a factorisation machine."""

    def __init__(self, rank: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(N_FEATURES)
        self.v = rng.normal(0, 0.05, (N_FEATURES, rank))

    def margin(self, i: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[i] * x[:, None]
        return self.w0 + self.w[i] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum())

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> None:
        """Logistic loss, AdaGrad over minibatches in a seeded order."""
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1e-6, np.full(N_FEATURES, 1e-6), np.full(self.v.shape, 1e-6)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // batch)):
                i = np.concatenate([rows[k][0] for k in part])
                x = np.concatenate([rows[k][1] for k in part])
                starts = np.cumsum([0, *(len(rows[k][0]) for k in part)])[:-1]
                owner = np.repeat(np.arange(len(part)), np.diff(np.r_[starts, len(i)]))
                vx = self.v[i] * x[:, None]
                total = np.add.reduceat(vx, starts)
                margin = self.w0 + np.add.reduceat(self.w[i] * x, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
                error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]) / len(part)
                kinds, at = np.unique(i, return_inverse=True)
                dw = np.bincount(at, error[owner] * x) + decay * self.w[kinds]
                each = (error[owner] * x)[:, None] * (total[owner] - vx)
                dv = np.stack([np.bincount(at, each[:, f]) for f in range(self.v.shape[1])], 1) + decay * self.v[kinds]
                d0 = error.sum()
                g0 += d0**2
                gw[kinds] += dw**2
                gv[kinds] += dv**2
                self.w0 -= rate * d0 / np.sqrt(g0)
                self.w[kinds] -= rate * dw / np.sqrt(gw[kinds])
                self.v[kinds] -= rate * 0.5 * dv / np.sqrt(gv[kinds])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> Machine:
    """Fit on labelled rows outside the held-out fold, max_rows at most in expectation, chosen by hash."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    share = min(1.0, max_rows / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62)) < int(share * (1 << 62)))  # fine enough for any number of labels
    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("quality", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in got], pa.binary())], names=["quality", "i", "x"])

    rows = sorted(sample.mapInArrow(read, "quality int, i binary, x binary").collect(), key=lambda r: (r["i"], r["x"], r["quality"]))
    machine = Machine()
    if rows:
        machine.fit([(np.frombuffer(r["i"], "<i4"), np.frombuffer(r["x"], "<f4").astype(float)) for r in rows], np.array([float(r["quality"] > 0) for r in rows]))
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """docs with the columns score and predicted added; all columns stay."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    names = docs.columns
    at = names.index("text")

    def say(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margin = np.array([model.value.margin(*features(t)) for t in batch.column(at).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = docs.drop("score", "predicted").schema.add("score", "double").add("predicted", "integer")
    return docs.mapInArrow(say, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    machine = learn(docs, labels, max_rows)
    fold = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), "text")
    return score(fold, machine, threshold).drop("text")


def kept(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 6000) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    own = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return score(own, learn(docs, labels, max_rows), threshold).where(F.col("predicted") == 1).select("row.*")
