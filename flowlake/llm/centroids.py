"""Exact integer k-means over vectors, filtered by a PCA rotation.

Components become integers, ``floor(scale * x)``. The second moments of all vectors, added up in
one pass, give an orthogonal rotation whose leading axes hold most of the spread. Every vector is
stored once with its integers, its ``LEADING`` leading rotated coordinates and the norm of the
others. By the triangle inequality the squared distance to a centroid is at least the squared
distance of the leading coordinates plus the squared difference of the residual norms. A vector's
centroid of the least bound is measured first; only centroids whose bound does not exceed that
distance are measured too, in integers. The bound is lowered by more than its rounding error, so
the result is that of measuring all, whatever the rotation: it depends neither on the order of
the rows nor on their partitions.

A round is one pass over the stored vectors without a shuffle of them: every task adds up its
integer sums per centroid, Spark adds those of all tasks, and k rows reach the driver. Centroids
(k rows) are the only thing sent to the tasks.

Ties go to the smaller centroid number. Vectors that are null, of another length, or hold a null,
NaN, infinite or (see ``vectors.whole_numbers``) too large component are left out. Fewer vectors
than centroids give as many centroids as there are vectors; no vector gives no rows. Repeated rows
count as often as they occur; a null id is hashed as empty text. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import broadcast_value
from flowlake.llm.vectors import matrix, whole_numbers
from flowlake.session import cut_lineage

CLUSTERS = 16
ROUNDS = 3
LEADING = 8
SLACK = 1e-9  # of the squared norms: far above the rounding error of a bound, far below one
ROWS_AT_ONCE = 4096
STORED = "vec_id bigint, ints array<int>, lead array<double>, rest double"


def rotation(moments: np.ndarray) -> np.ndarray:
    """Orthogonal axes (columns) by falling spread."""
    _, axes = np.linalg.eigh(moments)
    return np.ascontiguousarray(axes[:, ::-1])


def bounds(lead: np.ndarray, rest: np.ndarray, centre_lead: np.ndarray, centre_rest: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances, vectors by centroids, safe against rounding."""
    gap = lead[:, None, :] - centre_lead[None]
    low = np.einsum("vcd,vcd->vc", gap, gap) + (rest[:, None] - centre_rest[None]) ** 2
    size = (lead**2).sum(axis=1) + rest**2
    centre_size = (centre_lead**2).sum(axis=1) + centre_rest**2
    return low - SLACK * (1.0 + size[:, None] + centre_size[None])


def nearest(ints, lead, rest, centres, centre_lead, centre_rest) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, number of distances measured) of every vector, exactly."""
    low = bounds(lead, rest, centre_lead, centre_rest)
    rows, first = np.arange(len(ints)), np.argmin(low, axis=1)
    gap = ints - centres[first]
    best, found = np.einsum("vd,vd->v", gap, gap), first.astype(np.int64)
    left = low <= best[:, None]
    left[rows, first] = False
    survivors, which = np.nonzero(left)
    if len(survivors):
        gap = ints[survivors] - centres[which]
        other = np.einsum("vd,vd->v", gap, gap)
        order = np.lexsort((which, other, survivors))
        lead_of = order[np.concatenate([[True], np.diff(survivors[order]) > 0])]  # the best survivor of each vector
        v, d, c = survivors[lead_of], other[lead_of], which[lead_of]
        better = (d < best[v]) | ((d == best[v]) & (c < found[v]))
        best[v[better]], found[v[better]] = d[better], c[better]
    return found, best, len(ints) + len(survivors)


def rotated(ints: np.ndarray, axes: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading coordinates, norm of the others)."""
    turned = ints.astype(np.float64) @ axes
    return turned[:, :leading], np.sqrt((turned[:, leading:] ** 2).sum(axis=1))


def moments_of(kept: DataFrame, dim: int) -> np.ndarray:
    """Sum of the outer products of all vectors; dim x dim numbers reach the driver."""

    def add(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column(0), dim).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["axis", "row"])

    parts = kept.select("ints").mapInArrow(add, "axis int, row array<double>")
    cells = parts.select("axis", F.posexplode("row").alias("other", "x")).groupBy("axis", "other").agg(F.sum("x").alias("x"))
    out = np.zeros((dim, dim))
    for axis, other, x in cells.collect():
        out[axis, other] = x
    return (out + out.T) / 2


def stored_vectors(vectors: DataFrame, dim: int, scale: int, leading: int) -> tuple[DataFrame, np.ndarray]:
    """(stored table of integers, leading coordinates and residual norm; the rotation)."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding"), scale).alias("ints"))
    kept = whole.where(F.size("ints") == dim)
    axes = rotation(moments_of(kept, dim))
    shared = broadcast_value(vectors.sparkSession, axes)

    def turn(batches):
        for batch in batches:
            lead, rest = rotated(matrix(batch.column("ints"), dim), shared.value, leading)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(lead), pa.list_(pa.float64())), pa.array(rest)], ["vec_id", "ints", "lead", "rest"])

    return cut_lineage(kept.mapInArrow(turn, STORED), "centroid-vectors"), axes


def first_centres(stored: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose id has the smallest hash, in the order of the hashes."""
    mark = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = stored.select(mark.alias("mark"), "ints").orderBy("mark", "ints").limit(k).collect()
    return np.array([r["ints"] for r in rows], dtype=np.int64)


def updated(stored: DataFrame, centres: np.ndarray, axes: np.ndarray, leading: int) -> np.ndarray:
    """Centroids after one round: the floored mean of each one's vectors, itself where it has none."""
    shared = broadcast_value(stored.sparkSession, (centres, *rotated(centres, axes, leading)))
    k, dim = centres.shape

    def add(batches):
        sums, sizes = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for ints, lead, rest in parts_of(batch, dim, leading):
                found, _, _ = nearest(ints, lead, rest, *shared.value)
                order = np.argsort(found, kind="stable")
                clusters, at = np.unique(found[order], return_index=True)
                sums[clusters] += np.add.reduceat(ints[order], at, axis=0)
                sizes += np.bincount(found, minlength=k)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(sizes), pa.array(list(sums), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = stored.mapInArrow(add, "cluster int, n bigint, sums array<bigint>").where("n > 0")
    columns = [F.sum(F.element_at("sums", i + 1)).alias(f"s{i}") for i in range(dim)]
    out = centres.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *columns).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(dim)]
    return out


def parts_of(batch: pa.RecordBatch, dim: int, leading: int):
    for start in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(start, ROWS_AT_ONCE)
        yield (
            matrix(part.column("ints"), dim).astype(np.int64),
            matrix(part.column("lead"), min(leading, dim)),
            part.column("rest").to_numpy(),
        )


def assigned(stored: DataFrame, centres: np.ndarray, axes: np.ndarray, leading: int) -> DataFrame:
    """(vec_id, cluster, distance, measured) of every stored vector."""
    shared = broadcast_value(stored.sparkSession, (centres, *rotated(centres, axes, leading)))
    dim = centres.shape[1]

    def use(batches):
        for batch in batches:
            ids, at = batch.column("vec_id"), 0
            for ints, lead, rest in parts_of(batch, dim, leading):
                found, best, measured = nearest(ints, lead, rest, *shared.value)
                each = np.zeros(len(found), np.int64)
                each[0] = measured
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, len(found)), pa.array(found.astype(np.int32)), pa.array(best), pa.array(each)], ["vec_id", "cluster", "distance", "measured"]
                )
                at += len(found)

    return stored.mapInArrow(use, "vec_id bigint, cluster int, distance bigint, measured bigint")


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = 64, scale: int = 64, leading: int = LEADING
) -> tuple[DataFrame, list[list[int]]]:
    """(rows (vec_id, cluster, distance, measured), final centroids); ``measured`` sums to the distances computed."""
    stored, axes = stored_vectors(vectors, dim, scale, leading)
    centres = first_centres(stored, k)
    if not len(centres):
        return stored.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("measured")), []
    for _ in range(rounds):
        centres = updated(stored, centres, axes, leading)
    rows = cut_lineage(assigned(stored, centres, axes, leading), "centroid-clusters")
    return rows, centres.tolist()


def with_inertia(rows: DataFrame, centres: list[list[int]]) -> DataFrame:
    """Adds cluster_inertia, inertia (null where they exceed 64 bits) and centroid_sha256."""
    spark = rows.sparkSession
    sums = {r[0]: r[1] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # one row per centroid
    long = lambda n: int(n) if n < 2**63 else None
    facts = [
        (i, long(sums.get(i, 0)), long(sum(sums.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres)
    ]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
