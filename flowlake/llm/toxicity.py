"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, word pairs and pairs with one word between them that occur in a text,
hashed to ``2 ** BITS`` slots and counted once each. Every slot has its own learning rate and an
L1 penalty, so most weights are exactly zero; the rest is a compact table that may be broadcast
(at most 4 MB).

The fit reads at most ``max_labelled`` labelled documents (a documented bound; those with the
least hash of their id), hashes them in parallel and learns in one task. Scoring reads every text.

Null and empty texts have no features and get the score of the bias alone. Null labels are not
learned from; several labels of one id count as their maximum, several texts of one id as the
least text. Very long texts are read whole; repeated rows are scored row by row. Without labelled
rows every score is 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from flowlake.llm.common import broadcast_value, map_batches, plus, texts_in

BITS = 20
MAX_LABELLED = 16_000
PUNCTUATION = b".,;:!?\"'()[]{}*|#$%&<>"
FIRST, SECOND, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def word_codes(text: str, known: dict[bytes, int]) -> np.ndarray:
    """32-bit codes of the words of a text, in lower case and without punctuation around them."""
    words = text.lower().encode("utf-8", "replace").split()
    for w in set(words).difference(known):
        known[w] = zlib.crc32(w.strip(PUNCTUATION))
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def features(codes: np.ndarray) -> np.ndarray:
    """Distinct slots of the words, pairs and skip pairs."""
    shift = np.uint64(64 - BITS)
    single = (codes + np.uint64(1)) * FIRST
    parts = [single * SECOND, single[:-1] * SECOND ^ single[1:] * SKIP, single[:-2] * SKIP ^ single[2:] * FIRST]
    return np.unique(np.concatenate(parts) * FIRST >> shift).astype(np.int32)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader; slot ``2 ** BITS`` is the bias."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 8.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, slots: np.ndarray, label: int) -> None:
        at = np.append(slots, 2**BITS)
        w, n = self.weights(at), self.n[at]
        g = sigmoid(w.sum()) - label
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED, epochs: int = 6) -> np.ndarray:
    """Weights of all slots and, last, the bias."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        words: dict[bytes, int] = {}
        slots = [features(word_codes(t, words)) for t in texts_in(batch)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("y"), pa.array(slots, pa.list_(pa.int32()))], ["doc_id", "y", "slots"]
        )

    ready = map_batches(texts, hashed, "doc_id bigint, y int, slots array<int>")

    def learn(batches):
        rows = []
        for batch in batches:
            lists = batch.column("slots")
            rows += [(d, y, lists[i].values.to_numpy()) for i, (d, y) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("y").to_pylist(), strict=True))]
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        model = Ftrl()
        for _ in range(epochs):
            for _, y, slots in rows:
                model.learn(slots, y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at])], ["slot", "weight"])

    out = np.zeros(2**BITS + 1, dtype=np.float32)
    learned = ready.repartition(1).mapInArrow(learn, "slot int, weight double").toPandas()
    out[learned["slot"].to_numpy()] = learned["weight"].to_numpy()
    return out


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, replacing a column of that name."""
    kept = docs.select([c for c in docs.columns if c != "score"])
    shared = broadcast_value(docs.sparkSession, weights)
    words: dict[bytes, int] = {}

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = shared.value
        if len(words) > 300_000:
            words.clear()
        sums = [w[-1] + float(w[features(word_codes(t, words))].sum()) for t in texts_in(batch, text)]
        scores = sigmoid(np.array(sums)) if w.any() else np.zeros(len(sums))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return map_batches(kept, use, plus(kept, score=DoubleType()))
