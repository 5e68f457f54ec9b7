"""Integer k-means and exact top-k against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest

from flowlake.llm import centroids, topk
from pyspark.sql import functions as F

SCHEMA = "vec_id bigint, embedding array<double>, label string"


def kept(row, dim):
    v = row[1]
    return v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)


def plain_kmeans(rows, k, rounds, dim, scale):
    data = [(r[0], [math.floor(scale * x) for x in r[1]]) for r in rows if kept(r, dim)]
    first = sorted(data, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centres))

    for _ in range(rounds):
        members = [[] for _ in centres]
        for _, v in data:
            members[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else c for m, c in zip(members, centres, strict=True)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in data), key=str), centres


def plain_topk(rows, modulus, k, scale):
    usable = [(i, r[0], [math.floor(scale * x) for x in r[1]]) for i, r in enumerate(rows) if r[1] is not None and kept(r, len(r[1]))]
    out = []
    for i, q, v in usable:
        if q is None or q % modulus:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=False)), 2**63 if c is None else c) for j, c, w in usable if j != i]
        out += [(q, n + 1, None if c == 2**63 else c, -s) for n, (s, c) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def vectors(dim=6, n=400, seed=3):
    r = random.Random(seed)
    middles = [[r.uniform(-2, 2) for _ in range(dim)] for _ in range(7)]
    rows = [(i, [m + r.gauss(0, 0.3) for m in r.choice(middles)], "x") for i in range(n)]
    return [
        *rows, *rows[:20], *[(1000 + i, rows[0][1], None) for i in range(150)], (1, None, "x"), (2, [], "x"), (3, [1.0] * (dim - 1), "x"),
        (4, [None] + [1.0] * (dim - 1), "x"), (5, [float("nan")] * dim, "x"), (6, [float("inf")] * dim, "x"), (None, [0.5] * dim, "x"), (7, [0.0] * dim, "x"),
    ]


@pytest.mark.parametrize("leading", [1, 3, 6])
def test_kmeans_is_that_of_measuring_all(spark, leading):
    rows = vectors()
    found, centres = centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(5), 9, 3, 6, 64, leading)
    want, want_centres = plain_kmeans(rows, 9, 3, 6, 64)
    assert centres == want_centres
    got = found.collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    if leading == 3:
        assert sum(r["measured"] for r in got) < 0.5 * 9 * len(got)  # most centroids are never measured


def test_kmeans_columns_and_few_vectors(spark):
    rows = [(i, [float(i)] * 4, "x") for i in range(3)]
    found, centres = centroids.cluster(spark.createDataFrame(rows, SCHEMA), 16, 3, 4)
    assert len(centres) == 3
    out = centroids.with_inertia(found, centres).collect()
    assert {(r["distance"], r["inertia"]) for r in out} == {(0, 0)}
    assert {r["centroid_sha256"] for r in out} == {hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres}
    none, centres = centroids.cluster(spark.createDataFrame([(1, None, "x")], SCHEMA))
    assert centres == [] and centroids.with_inertia(none, centres).count() == 0


def test_bounds_never_exceed_distances():
    r = np.random.default_rng(5)
    ints, centres = r.integers(-(1 << 25), 1 << 25, (500, 16)), r.integers(-(1 << 25), 1 << 25, (20, 16))
    centres[:10] = ints[:10]
    axes = centroids.rotation(ints.T.astype(float) @ ints)
    low = centroids.bounds(*centroids.rotated(ints, axes, 5), *centroids.rotated(centres, axes, 5))
    true = ((ints[:, None].astype(object) - centres[None]) ** 2).sum(axis=2)
    assert (low <= true.astype(float)).all()


@pytest.mark.parametrize(("k", "bins", "at_once"), [(5, 1024, 2048), (5, 2, 7), (30, 16, 3), (1000, 64, 50)])
def test_topk_is_that_of_sorting_all(spark, k, bins, at_once):
    rows = vectors(5, 300)
    found = topk.search(spark.createDataFrame(rows, SCHEMA).repartition(4), F.col("vec_id") % 20 == 0, k, 256, bins, at_once)
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_topk(rows, 20, k, 256)


def test_topk_of_nothing_and_of_one(spark):
    assert topk.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(spark.createDataFrame([(50, [1.0], "x")], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(spark.createDataFrame([(1, [1.0], "x")], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_scores_beyond_doubles_stay_exact():
    big = (1 << 26) - 1
    a, b = np.full((1, 64), big), np.array([[big] * 63 + [big - 1]])
    assert topk.scores_of(a, b)[0, 0] == 63 * big * big + big * (big - 1)
