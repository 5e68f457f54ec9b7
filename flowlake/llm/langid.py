"""Language identification by unigram pieces, summed over all segmentations.

For each language, the pieces of a fixed public vocabulary have probabilities. The probability of
a word is the sum over all ways to cut it into pieces (forward algorithm); a text's is the product
over its words (runs of letters, lower case, with a word-start mark).

Learning counts words per language over all learning documents, then takes expected piece counts
by forward-backward under a common start distribution (one step of expectation maximisation, which
visits distinct words of a task instead of all words). Piece counts are added up in Spark; their
number is bounded by languages x pieces. Counts are smoothed towards the pooled distribution.

A null text or one without a letter is ``und`` with score 0, as is every text if nothing was
learned. Null languages are not learned from. The score is the posterior of the predicted
language; ties go to the language first in order. Very long texts are read whole, repeated rows
are judged row by row, and a broadcast holds languages x pieces numbers (``MAX_LANGUAGES``).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from flowlake.llm.common import broadcast_value, map_batches, plus, texts_in
from flowlake.llm.pieces import CACHED, CELLS, MARK, MODEL, Lattice, Vocabulary, by_length, load

LETTERS = re.compile(r"[^\W\d_]+")
GAIN = 40.0  # factor per character that keeps sums near 1; taken out again at the end
UNKNOWN = 1e-7
DISTINCT_AT_ONCE = 100_000
MAX_LANGUAGES = 200  # times 32,000 pieces, at 8 bytes: 51 MB at most reach the driver and each task
LONG = 48


def words_in(text: str) -> list[str]:
    """Runs of letters; numerals that are no decimal digits (fractions, Roman numerals, circled ones) part words."""
    found = LETTERS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for word in found for part in "".join([c if c.isalpha() else " " for c in word]).split()]


def weights_of(probabilities: np.ndarray, lattice: Lattice) -> list[np.ndarray]:
    """Scaled probability (languages, words, starts) of the piece of each length and start."""
    padded = np.concatenate([probabilities, np.zeros((len(probabilities), 1))], axis=1)
    out = [padded[:, ids] * GAIN ** (k + 1) for k, ids in enumerate(lattice.ids)]
    out[0] = np.where(lattice.ids[0] < 0, UNKNOWN * GAIN, out[0])
    return out


def forward(weights: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(scaled sums over segmentations of every prefix, log of what each was divided by)."""
    shape = weights[0].shape[:2]
    sums = np.zeros((length + 1, *shape))
    sums[0] = 1.0
    taken = np.zeros((length + 1, *shape))  # logs, in force from that end on
    for end in range(1, length + 1):
        reach = min(len(weights), end)
        total = np.zeros(shape)
        for size in range(1, reach + 1):
            total += sums[end - size] * weights[size - 1][:, :, end - size]
        sums[end] = total
        if end % 16 == 0 and end < length:  # bring the window that later steps read back to 1
            low = max(0, end - len(weights))
            top = sums[low : end + 1].max(axis=0)
            sums[low : end + 1] /= top
            taken[end] = np.log(top)
    return sums, taken


def log_probabilities(probabilities: np.ndarray, vocab: Vocabulary, words: list[str]) -> np.ndarray:
    """(words, languages) log probability of each word, summed over its segmentations."""
    out = np.empty((len(words), len(probabilities)))
    for places, group in by_length([MARK + w for w in words], CELLS // max(1, len(probabilities))):
        lattice = Lattice(vocab, group)
        sums, taken = forward(weights_of(probabilities, lattice), lattice.length)
        out[places] = (np.log(np.maximum(sums[-1], 1e-300)) + taken.sum(axis=0) - lattice.length * np.log(GAIN)).T
    return out


def expected_counts(start: np.ndarray, vocab: Vocabulary, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected piece counts of words that occur ``counts`` (words, languages) times."""
    out = np.zeros((counts.shape[1], len(vocab.pieces)))
    # very long words are learned from in parts, so that their sums stay in range
    parts = [(w[i : i + LONG], k) for k, w in enumerate(words) for i in range(0, len(w), LONG)]
    owner = np.array([k for _, k in parts])
    for places, group in by_length([MARK + w for w, _ in parts]):
        lattice = Lattice(vocab, group)
        length = lattice.length
        weights = [w[0] for w in weights_of(start[None, :], lattice)]
        ahead = np.zeros((length + 1, lattice.width))
        ahead[0] = 1.0
        for end in range(1, length + 1):
            for size in range(1, min(len(weights), end) + 1):
                ahead[end] += ahead[end - size] * weights[size - 1][:, end - size]
        behind = np.zeros((length + 1, lattice.width))
        behind[length] = 1.0
        for begin in range(length - 1, -1, -1):
            for size in range(1, min(len(weights), length - begin) + 1):
                behind[begin] += weights[size - 1][:, begin] * behind[begin + size]
        total, times = np.maximum(ahead[length], 1e-300), counts[owner[places]]
        for size, ids in enumerate(lattice.ids, 1):
            share = ahead[: length + 1 - size].T * weights[size - 1] * behind[size:].T / total[:, None]
            here = ids >= 0
            for k in range(counts.shape[1]):
                out[k] += np.bincount(ids[here], (share * times[:, k : k + 1])[here], minlength=out.shape[1])
    return out


def start_distribution(vocab: Vocabulary) -> np.ndarray:
    """Falling with the rank of a piece in the vocabulary."""
    start = np.zeros(len(vocab.pieces))
    start[vocab.key_ids] = 1.0 / (100.0 - vocab.scores[vocab.key_ids])
    return start / start.sum()


def learn(docs: DataFrame, vocab: Vocabulary, text: str = "text", lang: str = "lang", smoothing: float = 200.0) -> tuple[list[str], np.ndarray]:
    """(languages, their piece probabilities) of all rows with a language."""
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    shared = broadcast_value(spark, vocab)

    def run(batches):
        voc = shared.value
        start = start_distribution(voc)
        pending: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def flush():
            names = sorted(pending)
            words = sorted(set().union(*pending.values()))
            counts = np.array([[pending[n][w] for n in names] for w in words], dtype=float)
            if words:
                for n, row in zip(names, expected_counts(start, voc, words, counts), strict=True):
                    sums[n] = sums.get(n, 0) + row
            pending.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for name, t in zip(langs, texts_in(batch), strict=True):
                pending.setdefault(name, Counter()).update(words_in(t))
                if sum(map(len, pending.values())) > DISTINCT_AT_ONCE:
                    flush()
        flush()
        for name, row in sums.items():
            ids = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(ids, pa.int32()), pa.array(row[ids])], ["lang", "piece", "n"])

    counted = labelled.mapInArrow(run, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    names = [r[0] for r in labelled.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(names)
    counts = np.zeros((len(names), len(vocab.pieces)))
    at = {n: k for k, n in enumerate(names)}
    rows = counted.toPandas()  # at most languages x pieces rows
    if len(rows):
        counts[rows["lang"].map(at).to_numpy(), rows["piece"].to_numpy()] = rows["n"].to_numpy()
    pooled = counts.sum(axis=0) + start_distribution(vocab) * 1000.0
    pooled /= pooled.sum()
    return names, (counts + smoothing * pooled) / (counts.sum(axis=1, keepdims=True) + smoothing)


class Judge:
    def __init__(self, vocab: Vocabulary, names: list[str], probabilities: np.ndarray):
        self.vocab, self.names, self.probabilities = vocab, names, probabilities
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(names)))

    def judge(self, texts: list[str]) -> tuple[list[str], list[float]]:
        cut = [words_in(t) for t in texts]
        if len(self.index) > CACHED:
            self.index, self.table = {}, self.table[:0]
        index = self.index
        new = list({w for words in cut for w in words if w not in index})
        if new and self.names:
            for w in new:
                index[w] = len(index)
            self.table = np.concatenate([self.table, log_probabilities(self.probabilities, self.vocab, new)])
        langs, scores = [], []
        for words in cut:
            if not words or not self.names:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.table[[index[w] for w in words]].sum(axis=0)
            best = int(np.argmax(total))
            langs.append(self.names[best])
            scores.append(float(1.0 / np.exp(np.minimum(total - total[best], 0)).sum()))
        return langs, scores


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocab: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, replacing columns of these names."""
    kept = docs.select([c for c in docs.columns if c not in ("lang_pred", "score")])
    shared = broadcast_value(docs.sparkSession, (vocab, *model))
    state: dict[str, Judge] = {}

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = state.setdefault("judge", Judge(*shared.value)).judge(texts_in(batch, text))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"]
        )

    return map_batches(kept, use, plus(kept, lang_pred=StringType(), score=DoubleType()))


def fit_predict(docs: DataFrame, learn_if: Column, model: str = MODEL) -> DataFrame:
    """Learn from the rows of ``learn_if`` and predict all rows."""
    vocab = load(model)
    return predict(docs, learn(docs.where(learn_if), vocab), vocab)
