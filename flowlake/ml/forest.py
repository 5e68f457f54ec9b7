"""Random forest of classes over binned rows: one pass of all rows a level, counts summed by a shuffle.

Rows are stored once as blocks of byte bins. In a pass a task walks each tree's bag of a block down
to the open nodes and counts bins and classes there; the counts of a node meet in one group, which
picks its split. The driver holds the trees only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.session import cut_lineage, released

BINS = 32
# Values of a column in a summary of some of its rows.
RANKS = 1000
# Bins of a block of rows, counts of a task in one pass, and counts that travel together.
BLOCK_CELLS = 1 << 20
PASS_CELLS = 1 << 24
CHUNK_CELLS = 1 << 17
LEAST_GAIN = 1e-12
# Types of counts on their way to the group of their nodes, by bytes.
_WIDTHS = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: float}
# Poisson(1) by 16 random bits: how often a row is in a tree's bag.
_DRAWN = np.searchsorted(np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)]) * 65536, np.arange(65536) + 0.5).astype(np.uint8)


def _thinned(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order with their rows; of more than ``RANKS`` those at even ranks, with the rows since the last one."""
    order = np.argsort(values, kind="stable")
    values, upto = values[order], np.cumsum(counts[order])
    ends = np.flatnonzero(np.append(values[1:] != values[:-1], True))
    if len(ends) > RANKS:
        ends = ends[np.unique(np.searchsorted(upto[ends], upto[-1] * np.arange(1, RANKS + 1) / RANKS))]
    return values[ends], np.diff(upto[ends], prepend=0)


def thresholds(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most ``bins - 1`` thresholds between ordered values: between all, or of about equal row counts."""
    cuts = np.arange(len(values) - 1)
    if len(values) > bins:
        upto = np.cumsum(counts)
        cuts = np.unique([np.abs(upto[:-1] - upto[-1] * i / bins).argmin() for i in range(1, bins)])
    with np.errstate(invalid="ignore", over="ignore"):
        middle = (values[cuts] + values[cuts + 1]) / 2
    return np.where(np.isfinite(middle), middle, values[cuts])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    if column.null_count:
        raise ValueError("rows without features")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _splits(dataset: DataFrame) -> list[np.ndarray]:
    """Thresholds of every feature by one pass; ranks are off by at most two in ``RANKS`` rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            if batch.num_rows:
                kept.append([_thinned(column, np.ones(len(column), dtype=np.int64)) for column in _matrix(batch, "x").T])
        for feature, parts in enumerate(zip(*kept)):
            values, counts = _thinned(*(np.concatenate(p) for p in zip(*parts)))
            yield pa.RecordBatch.from_pydict({"feature": pa.array([feature], pa.int32()), "vals": [values.tobytes()], "counts": [counts.tobytes()]})

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        values = np.concatenate([np.frombuffer(v) for v in rows["vals"]])
        counts = np.concatenate([np.frombuffer(c, dtype=np.int64) for c in rows["counts"]])
        order = np.lexsort((counts, values))  # as rows come in any order
        found = thresholds(*_all_values(values[order], counts[order]))
        return pd.DataFrame({"feature": rows["feature"].iloc[:1], "cuts": [found.tobytes()]})

    summed = dataset.mapInArrow(summarise, "feature int, vals binary, counts binary")
    found = summed.groupBy("feature").applyInPandas(cut, "feature int, cuts binary").collect()
    return [np.frombuffer(r["cuts"]) for r in sorted(found, key=lambda r: r["feature"])]


def _all_values(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordered values once each, with their rows."""
    ends = np.flatnonzero(np.append(values[1:] != values[:-1], True))
    return values[ends], np.diff(np.cumsum(counts)[ends], prepend=0)


def _binned(x: np.ndarray, splits: Sequence[np.ndarray]) -> np.ndarray:
    """Bins by feature and row."""
    out = np.empty((len(splits), len(x)), dtype=np.uint8)
    for i, cuts in enumerate(splits):
        out[i] = np.searchsorted(cuts, x[:, i])
    return out


def _blocks(dataset: DataFrame, splits: list[np.ndarray], classes: int) -> DataFrame:
    """Rows as blocks of bins, feature by feature, and classes."""
    rows = max(1, BLOCK_CELLS // len(splits))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done, kept = TaskContext.get().partitionId() << 32, 0, []

        def block(parts: list) -> pa.RecordBatch:
            bins, label = np.concatenate([p[0] for p in parts], axis=1), np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_pydict({"block": [first + done], "bins": [bins.tobytes()], "label": [label.tobytes()]})

        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            if not ((label >= 0) & (label < classes) & (label == np.floor(label))).all():
                raise ValueError("labels must be whole numbers from 0")
            if len(label):
                kept.append((_binned(_matrix(batch, "x"), splits), label.astype(np.int16)))
            if sum(len(p[1]) for p in kept) >= rows:
                yield block(kept)
                done, kept = done + 1, []
        if kept:
            yield block(kept)

    return dataset.mapInArrow(pack, "block bigint, bins binary, label binary")


@dataclass
class Tree:
    """By node: feature (-1: leaf), last bin of the left child, left child (the right one follows), rows by class."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    counts: np.ndarray

    @classmethod
    def root(cls, classes: int) -> Tree:
        return cls(np.array([-1]), np.array([BINS]), np.array([0]), np.zeros((1, classes)))

    def walk(self) -> tuple:
        """What a walk over cells needs, as plain arrays: broadcasts are pickled by reference."""
        classes = self.counts.shape[1]
        return self.feature, (self.bin * classes + classes - 1).astype(_cell_type(classes)), self.left

    def split(self, nodes: np.ndarray, feature: np.ndarray, last: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Give ``nodes`` two children each, with their rows by class; returns the children."""
        children = len(self.feature) + np.arange(2 * len(nodes))
        self.feature[nodes], self.bin[nodes], self.left[nodes] = feature, last, children[::2]
        self.feature = np.concatenate([self.feature, np.full(len(children), -1)])
        self.bin = np.concatenate([self.bin, np.full(len(children), BINS)])
        self.left = np.concatenate([self.left, children])
        self.counts = np.concatenate([self.counts, counts])
        return children


def _descend(tree: tuple, cells: np.ndarray, length: int, rows: np.ndarray, steps: int, drop: bool) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of ``rows`` after ``steps``, and these rows; with ``drop`` those in leaves may be left out.

    A leaf is its own left child and no cell is above its last one.
    """
    feature, last, left = tree
    offset, node = np.maximum(feature, 0) * length, np.zeros(len(rows), dtype=np.intp)
    for step in range(steps):
        spot = offset.take(node, mode="clip")
        spot += rows
        right = cells.take(spot, mode="clip") > last.take(node, mode="clip")
        node = left.take(node, mode="clip")
        node += right
        if drop and step % 3 == 2 and step < steps - 1:
            live = np.flatnonzero(feature.take(node, mode="clip") >= 0)
            if len(live) < 0.8 * len(node):
                node, rows = node.take(live), rows.take(live)
    return node, rows


def _cells(bins: np.ndarray, label: np.ndarray | int, classes: int) -> np.ndarray:
    """Bin and class of every feature and row as one number, feature by feature."""
    kind = _cell_type(classes)
    return (bins.astype(kind) * kind(classes) + np.asarray(label).astype(kind)).reshape(-1)


def _cell_type(classes: int) -> type:
    return np.uint8 if (BINS + 1) * classes <= 256 else np.uint16


def _count(cells: np.ndarray, length: int, block: int, tree: tuple, number: int, level: int, slot: np.ndarray, subset: np.ndarray, total: np.ndarray, seed: int) -> None:
    """Add a block's rows in the tree's bag to ``total``: by chosen feature, open node and cell."""
    draws = np.random.SFC64([seed, number, block]).random_raw(length // 4 + 1).view(np.uint16)[:length]
    times = _DRAWN.take(draws, mode="clip")
    node, rows = _descend(tree, cells, length, np.flatnonzero(times != 0), level, True)
    at = slot.take(node, mode="clip")
    seen = np.flatnonzero(at >= 0)
    if len(seen) < len(at):
        at, rows = at.take(seen), rows.take(seen)
    weight, base = times.take(rows).astype(float), at * total.shape[2]
    for drawn, sums in zip(np.ascontiguousarray(subset.T) * length, total):
        spot = drawn.take(at, mode="clip")
        spot += rows
        key, flat = base + cells.take(spot, mode="clip"), sums.reshape(-1)
        if len(flat) <= 4 * len(key):
            flat += np.bincount(key, weights=weight, minlength=len(flat))
        else:
            np.add.at(flat, key, weight)


def _narrow(total: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes each as hold the largest."""
    most = total.max(initial=0.0)
    return total.astype(next((t for t in _WIDTHS.values() if t is float or most <= np.iinfo(t).max), float))


def _gini(weighted: np.ndarray) -> np.ndarray:
    total = np.maximum(weighted.sum(axis=-1, keepdims=True), 1e-300)
    return 1.0 - ((weighted / total) ** 2).sum(axis=-1)


def best_splits(counts: np.ndarray, class_weights: np.ndarray, least_rows: int) -> tuple[np.ndarray, ...]:
    """Per node of ``counts`` (node, feature, bin, class): feature's place (-1: none), last bin to the left, rows by class left and in all."""
    left = counts.cumsum(axis=2)
    total = left[:, :1, -1:, :]
    right = total - left
    here, below, above = (c * class_weights for c in (total, left, right))
    size = np.maximum(here.sum(axis=-1), 1e-300)
    gain = _gini(here) - (below.sum(axis=-1) * _gini(below) + above.sum(axis=-1) * _gini(above)) / size
    allowed = (left.sum(axis=-1) >= least_rows) & (right.sum(axis=-1) >= least_rows)
    gain = np.where(allowed, gain, -1.0).reshape(len(counts), -1)
    best = gain.argmax(axis=1)
    place, last = np.divmod(best, counts.shape[2])
    every = np.arange(len(counts))
    return np.where(gain[every, best] > LEAST_GAIN, place, -1), last, left[every, place, last], total[:, 0, 0]


class HistogramForest(Estimator):
    """Random forest with weights by class: Poisson(1) bags, a random root of the features a node, Gini gain."""

    def __init__(self, trees: int, depth: int, class_weights: Sequence[float], least_rows: int = 1, seed: int = 42):
        super().__init__()
        self.trees, self.depth, self.least_rows, self.seed = trees, depth, least_rows, seed
        self.class_weights = np.array(class_weights, dtype=float)

    def _fit(self, dataset: DataFrame) -> ForestModel:
        # Read twice instead of being stored: numbers take several times the disk of their bins.
        rows = dataset.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        with released(dataset.sparkSession):
            splits = _splits(rows)
            if not splits:
                raise ValueError("no rows to train on")
            blocks = cut_lineage(_blocks(rows, splits, len(self.class_weights)), "blocks")
            return ForestModel(splits, self._grow(blocks, len(splits)), self.class_weights)

    def _grow(self, blocks: DataFrame, features: int) -> list[Tree]:
        classes = len(self.class_weights)
        chosen = math.ceil(math.sqrt(features)) if self.trees > 1 else features
        forest = [Tree.root(classes) for _ in range(self.trees)]
        of_tree, nodes = np.arange(self.trees), np.zeros(self.trees, dtype=np.intp)  # open nodes, by tree
        for level in range(self.depth):
            rng = np.random.default_rng([self.seed, level])
            at_once, together = (max(1, n // (chosen * BINS * classes)) for n in (PASS_CELLS, CHUNK_CELLS))
            next_trees, next_nodes = [], []
            for first in range(0, len(nodes), at_once):
                trees_here, nodes_here = of_tree[first : first + at_once], nodes[first : first + at_once]
                subset = np.sort(rng.random((len(nodes_here), features)).argsort(axis=1)[:, :chosen], axis=1)
                numbers, starts = np.unique(trees_here, return_index=True)
                part = {int(t): (forest[t], n, s) for t, n, s in zip(numbers, np.split(nodes_here, starts[1:]), np.split(subset, starts[1:]))}
                for t, chunk, found in self._pass(blocks, part, level, together):
                    ids, drawn = (p[chunk : chunk + together] for p in part[t][1:])
                    place, last, left, total = found
                    if level == 0:
                        forest[t].counts[:] = total
                    cut = np.flatnonzero(place >= 0)
                    counts = np.stack([left[cut], total[cut] - left[cut]], axis=1).reshape(-1, classes)
                    children = forest[t].split(ids[cut], drawn[cut, place[cut]], last[cut], counts)
                    mixed = ((counts * self.class_weights > 0).sum(axis=1) > 1) & (counts.sum(axis=1) >= 2 * self.least_rows)
                    next_trees.append(np.full(mixed.sum(), t))
                    next_nodes.append(children[mixed])
            if not sum(map(len, next_nodes)):
                break
            of_tree, nodes = np.concatenate(next_trees), np.concatenate(next_nodes)
            order = np.argsort(of_tree, kind="stable")
            of_tree, nodes = of_tree[order], nodes[order]
        return forest

    def _pass(self, blocks: DataFrame, part: dict, level: int, together: int) -> list[tuple]:
        """Splits of the open nodes of ``part`` (tree: nodes, drawn features) by one pass over all rows."""
        seed, weights, least = self.seed, self.class_weights, self.least_rows
        shape = (BINS, len(weights))
        shared = blocks.sparkSession.sparkContext.broadcast({number: (forest_tree.walk(), *rest) for number, (forest_tree, *rest) in part.items()})

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            work = {}
            for number, (tree, ids, subset) in shared.value.items():
                slot = np.full(len(tree[0]), -1)
                slot[ids] = np.arange(len(ids))
                work[number] = (tree, slot, subset, np.zeros((subset.shape[1], len(ids), math.prod(shape))))
            for batch in batches:
                for block, bins, label in zip(batch["block"], batch["bins"], batch["label"]):
                    kinds = np.frombuffer(label, dtype=np.int16)
                    cells = _cells(np.frombuffer(bins, dtype=np.uint8).reshape(-1, len(kinds)), kinds, shape[1])
                    for number, (tree, slot, subset, total) in work.items():
                        _count(cells, len(kinds), block, tree, number, level, slot, subset, total, seed)
            for number, (_, _, _, total) in work.items():
                starts = range(0, total.shape[1], together)
                sums = [_narrow(total[:, s : s + together]).tobytes() for s in starts]
                yield pd.DataFrame({"tree": number, "chunk": list(starts), "counts": sums})

        def choose(rows: pd.DataFrame) -> pd.DataFrame:
            subset = shared.value[int(rows["tree"].iloc[0])][2]
            nodes = min(together, len(subset) - int(rows["chunk"].iloc[0]))
            summed = np.zeros(subset.shape[1] * nodes * math.prod(shape))
            for c in rows["counts"]:
                summed += np.frombuffer(c, dtype=_WIDTHS[len(c) // len(summed)])
            found = best_splits(summed.reshape(subset.shape[1], -1, *shape).swapaxes(0, 1), weights, least)
            kept = [a.astype(t).tobytes() for a, t in zip(found, ("i4", "i4", "f8", "f8"))]
            return pd.DataFrame([[rows["tree"].iloc[0], rows["chunk"].iloc[0], *kept]], columns=["tree", "chunk", "place", "last", "left", "total"])

        # As many tasks as cores, however many rows: each hands on counts of all open nodes.
        tasks = blocks.sparkSession.sparkContext.defaultParallelism
        counted = blocks.coalesce(tasks).mapInPandas(count, "tree int, chunk int, counts binary")
        picked = counted.groupBy("tree", "chunk").applyInPandas(choose, "tree int, chunk int, place binary, last binary, left binary, total binary")
        out = []
        for r in sorted(picked.collect(), key=lambda r: (r["tree"], r["chunk"])):
            place, last = (np.frombuffer(r[c], dtype="i4") for c in ("place", "last"))
            left, total = (np.frombuffer(r[c]).reshape(len(place), -1) for c in ("left", "total"))
            out.append((r["tree"], r["chunk"], (place, last, left, total)))
        shared.unpersist()
        return out


class ForestModel(Model):
    """Adds rawPrediction (sum of the trees' class shares), probability and prediction."""

    def __init__(self, splits: list[np.ndarray], trees: list[Tree], class_weights: np.ndarray):
        super().__init__()
        self.splits, self.trees, self.class_weights = splits, trees, class_weights

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = self.class_weights
        shared = dataset.sparkSession.sparkContext.broadcast((self.splits, [(t.walk(), self._shares(t), self._steps(t)) for t in self.trees]))

        @F.pandas_udf("raw array<double>, probability array<double>, prediction double")
        def classify(vectors: pd.Series) -> pd.DataFrame:
            splits, trees = shared.value
            cells = _cells(_binned(np.stack(vectors.to_numpy()), splits), 0, len(weights))
            rows = np.arange(len(vectors))
            raw = sum(share[_descend(tree, cells, len(rows), rows, steps, False)[0]] for tree, share, steps in trees)
            chance = raw / np.maximum(raw.sum(axis=1, keepdims=True), 1e-300)
            return pd.DataFrame({"raw": list(raw), "probability": list(chance), "prediction": raw.argmax(axis=1).astype(float)})

        scored = dataset.withColumn("_forest", classify(vector_to_array("features")))
        return scored.withColumns(
            {"rawPrediction": array_to_vector("_forest.raw"), "probability": array_to_vector("_forest.probability"), "prediction": F.col("_forest.prediction")}
        ).drop("_forest")

    def _shares(self, tree: Tree) -> np.ndarray:
        weighted = tree.counts * self.class_weights
        return weighted / np.maximum(weighted.sum(axis=1, keepdims=True), 1e-300)

    @staticmethod
    def _steps(tree: Tree) -> int:
        steps, level = 0, np.array([0])
        while (level := level[tree.feature[level] >= 0]).size:
            steps, level = steps + 1, np.concatenate([tree.left[level], tree.left[level] + 1])
        return steps
