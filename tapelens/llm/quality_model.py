"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

1. Every word gets a sparse random index vector from its hash. One pass over all texts adds the
   index vectors of a word's neighbours to its context vector (words are hashed into BUCKETS
   rows, so the table has one size whatever the corpus). Partial tables are summed in two
   distributed steps; one table of fixed size reaches the driver.
2. A document is the mean of its words' vectors, with its length.
3. A two-layer network is fitted on a bounded sample of labelled documents, and a temperature
   on rows kept apart turns its output into calibrated probabilities.

Null and empty texts have the zero vector and are scored like all others. Without labels of
both classes every score is the share of label 1 (0.5 without any label).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapelens.llm.common import arrow_map, bounded_sample, mix, packed, pick, quality_labels, slices, summed_parts, word_hashes, words_of

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
FIT_ROWS = 20_000
HIDDEN, STEPS, RATE, DECAY = 32, 400, 0.02, 1e-4
THRESHOLD = 0.3
SCORE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
POOL_SCHEMA = pa.schema([("doc_id", pa.int64()), ("pooled", pa.list_(pa.float32()))])


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Positions and signs of the NONZERO entries of every bucket's index vector."""
    h = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(1)).reshape(BUCKETS, NONZERO)
    return (h % np.uint64(DIM)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def bucket_lists(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets of all texts one after another, and the number of words of each text."""
    words = [words_of(t or "") for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = word_hashes([w for ws in words for w in ws])
    return (flat % np.uint64(BUCKETS)).astype(np.int64), counts


def context_table(buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the neighbours' index vectors for each bucket (BUCKETS * DIM)."""
    where, sign = index_vectors()
    doc = np.repeat(np.arange(len(counts)), counts)
    out = np.zeros(BUCKETS * DIM)
    for gap in range(1, WINDOW + 1):
        same = doc[gap:] == doc[:-gap]
        a, b = buckets[:-gap][same], buckets[gap:][same]
        for at, near in ((a, b), (b, a)):
            for k in range(NONZERO):
                out += np.bincount(at * DIM + where[near, k], sign[near, k], BUCKETS * DIM)
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit-length context vectors (BUCKETS, DIM) gathered from every text of the table."""
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for part in slices(batch):
                total += context_table(*bucket_lists(part.column(0).to_pylist()))
        yield packed(total)

    parts = pick(docs, text="text").mapInArrow(gather, "part binary")
    total = summed_parts(parts, np.add, np.zeros(BUCKETS * DIM)).reshape(BUCKETS, DIM)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(vectors: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Mean word vector, its length, and the log of the word count, for each text."""
    buckets, counts = bucket_lists(texts)
    ends = np.cumsum(counts)
    mean = np.zeros((len(counts), DIM), np.float32)
    for i, (end, n) in enumerate(zip(ends, counts)):
        if n:
            mean[i] = np.bincount(buckets[end - n : end], minlength=BUCKETS).astype(np.float32) @ vectors / n if n > BUCKETS \
                else vectors[buckets[end - n : end]].mean(axis=0)
    size = np.log1p(counts)[:, None].astype(np.float32)
    return np.hstack([mean * 4, np.linalg.norm(mean, axis=1, keepdims=True) * 4, size / 4])


@dataclass
class Network:
    """Two dense layers with tanh between, and the temperature that divides the logit."""

    weights: list[np.ndarray]
    shift: np.ndarray
    scale: np.ndarray
    temperature: float = 1.0
    constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((x - self.shift) / self.scale @ w1 + b1) @ w2 + b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on four fifths of the rows; the temperature on the fifth."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    if len(np.unique(y)) < 2:
        return Network([], x, x, constant=float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    apart = rng.permutation(len(y)) % 5 == 4
    xs, ys = x[~apart], y[~apart]
    net = Network([rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)],
                  xs.mean(axis=0), xs.std(axis=0) + 1e-6)
    m, v = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    z = (xs - net.shift) / net.scale
    for t in range(1, STEPS + 1):
        w1, b1, w2, b2 = net.weights
        h = np.tanh(z @ w1 + b1)
        d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40))) - ys) / len(ys)
        back = np.outer(d, w2) * (1 - h * h)
        grads = [z.T @ back + DECAY * w1, back.sum(axis=0), h.T @ d + DECAY * w2, d.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            net.weights[i] = net.weights[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    if apart.any():
        net.temperature = fit_temperature(net.logit(x[apart]), y[apart])
    return net


def fit_temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search on its logarithm."""
    def loss(log_t: float) -> float:
        z = logit / np.exp(log_t)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    lo, hi, g = -2.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_model(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts, network from about `rows` labelled ones that are not held out."""
    vectors = word_vectors(docs)
    sample = bounded_sample(quality_labels(labels).filter(~held_out()), "doc_id", rows)
    chosen = pick(docs, doc_id="doc_id", text="text").join(F.broadcast(sample), "doc_id")  # at most about `rows` ids
    pooled = arrow_map(chosen.select("doc_id", "text"), POOL_SCHEMA,
                       lambda c: {"doc_id": c["doc_id"], "pooled": list(pool(vectors, c["text"]))})
    got = pooled.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    x = np.array(got["pooled"].tolist(), np.float64).reshape(len(got), DIM + 2)
    return vectors, train(x, got["label"].to_numpy(float))


def scored(docs: DataFrame, model: tuple[np.ndarray, Network]) -> DataFrame:
    """(doc_id, score) of every whole text."""
    vectors, net = model
    return arrow_map(pick(docs, doc_id="doc_id", text="text"), SCORE_SCHEMA,
                     lambda c: {"doc_id": c["doc_id"], "score": net.probability(pool(vectors, c["text"]))})
