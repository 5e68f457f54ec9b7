"""Exact top-k by inner product through histograms of scores.

Components become integers, ``floor(scale * x)``, so scores are exact. Queries come in blocks of a
bounded number of vectors; for a block, every task scores its share of all vectors against all
queries of the block. The first pass counts, for each query, how many scores fall into each of
``BINS`` bins between the least and greatest possible score; the bin of the kth best score is
looked up in the counts of all tasks and divided anew, until it is a single score or all of it is
wanted. A last pass returns the scores above that limit and, of those equal to it, each task's k
smallest ids (no other can be among the k smallest of all); ranks follow score, then id.

A task leaves out bins that lie below its own kth best score, as the kth best of all cannot be
lower, so a query costs at most k counts per task, not ``BINS``. Only the queries of a block and
their bounds (both of bounded number) pass the driver; vectors are read where they are stored and
never shuffled, and the results of a block are written before the next one starts.

All candidates may tie: a limit shared by many rows costs k rows per task. Vectors that are null
or hold a null, NaN, infinite or (see ``vectors.whole_numbers``) too large component take no part.
Vectors of unequal length are compared as if the shorter one ended in zeros. A row is never its
own candidate; another row with the same id and vector is. A null id is no query and comes last
among ties. Fewer candidates than k: all of them. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlake.llm.common import broadcast_value
from flowlake.llm.vectors import matrix, whole_numbers
from flowlake.session import cut_lineage, scratch_path

QUERIES_AT_ONCE = 2048  # on average in a block
BINS = 1024
CELLS = 1 << 21  # scores held at once by a task
NO_ID = np.int64(2**63 - 1)


def scores_of(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact inner products, vectors by queries, in 64 bits."""
    d = min(vectors.shape[1], queries.shape[1])
    vectors, queries = vectors[:, :d], queries[:, :d]
    most = int(np.abs(vectors).max(initial=0)) * int(np.abs(queries).max(initial=0)) * d
    if most < 2**53:  # every partial sum is a whole number that a double holds
        return (vectors.astype(np.float64) @ queries.T.astype(np.float64)).astype(np.int64)
    return vectors.astype(np.int64) @ queries.T.astype(np.int64)


class Block:
    """Queries of one block: stored row numbers (ascending), ids, vectors and what is known of their kth score.

    The kth best score is one of the ``span`` scores from ``low`` on, counted in bins of ``width``;
    ``above`` scores lie beyond them. A span of 0 is settled: ``low`` is the limit.
    """

    def __init__(self, rows: list[int], ids: list[int], vectors: np.ndarray):
        self.rows, self.ids, self.vectors = np.array(rows, np.int64), np.array(ids, np.int64), vectors
        self.low = self.span = self.above = np.zeros(len(rows), np.int64)
        self.width = np.ones(len(rows), np.int64)

    def scored(self, batch: pa.RecordBatch):
        """(ids, scores, whether the row is the query) of a bounded number of vectors at a time."""
        step = max(1, CELLS // max(1, len(self.rows)))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            rows = part.column("row").to_numpy()
            ids = part.column("vec_id").fill_null(int(NO_ID)).to_numpy()
            scores = scores_of(matrix(part.column("ints")), self.vectors)
            own = np.zeros(scores.shape, dtype=bool)
            at = np.minimum(np.searchsorted(self.rows, rows), len(self.rows) - 1)
            same = np.flatnonzero(self.rows[at] == rows)
            own[same, at[same]] = True
            yield ids, scores, own


def histogram(shared, k: int, bins: int):
    """Task side of a counting pass: rows (query, bin, n), at most k for a query."""

    def run(batches):
        block = shared.value
        size = len(block.rows)
        counts = np.zeros(size * bins, dtype=np.int64)
        for batch in batches:
            for _, scores, own in block.scored(batch):
                past = scores - block.low
                counted = (past >= 0) & (past < block.span) & ~own
                cell = past // block.width + np.arange(size) * bins
                counts += np.bincount(cell[counted], minlength=size * bins)
        counts = counts.reshape(size, bins)
        better = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
        query, which = np.nonzero((counts > 0) & (better < (k - block.above)[:, None]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.array(which.astype(np.int32)), pa.array(counts[query, which])], ["query", "bin", "n"]
        )

    return run


def best_of_task(shared, k: int):
    """Task side of the last pass: all rows above the limit, the k smallest ids at it."""

    def run(batches):
        block = shared.value
        query, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        for batch in batches:
            for vec_ids, found, own in block.scored(batch):
                at, q = np.nonzero((found >= block.low) & ~own)
                query, ids, scores = np.append(query, q), np.append(ids, vec_ids[at]), np.append(scores, found[at, q])
                order = np.lexsort((ids, -scores, query))
                query, ids, scores = query[order], ids[order], scores[order]
                first = np.searchsorted(query, query, side="left")
                kept = np.arange(len(query)) - first < k
                query, ids, scores = query[kept], ids[kept], scores[kept]
        known = pa.array(ids, mask=ids == NO_ID)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), known, pa.array(scores)], ["query", "vec_id", "score"])

    return run


def located(stored: DataFrame, block: Block, largest: int, k: int, bins: int) -> Block:
    """``block`` with ``low`` at the kth best score of each query, or so that exactly k reach it."""
    size = len(block.rows)
    reach = np.array([math.isqrt(int((v.astype(object) ** 2).sum()) * largest) + 1 for v in block.vectors], dtype=np.int64)
    block.low, block.span, block.above = -reach, 2 * reach + 1, np.zeros(size, np.int64)
    block.width = -(-block.span // bins)
    open_ = np.ones(size, dtype=bool)
    while open_.any():
        counted = stored.mapInArrow(histogram(broadcast_value(stored.sparkSession, block), k, bins), "query int, bin int, n bigint")
        total = counted.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        better = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        ranked = total.select("query", "bin", "n", F.coalesce(F.sum("n").over(better), F.lit(0)).alias("before"))
        wanted, found = k - block.above, {}
        for q, which, n, before in ranked.where(F.col("before") < k).collect():  # at most k rows for a query
            if before < wanted[q] and (q not in found or which < found[q][0]):
                found[q] = (which, n, before)
        low, width, span, above = block.low.copy(), block.width.copy(), np.zeros(size, np.int64), block.above.copy()
        for q in np.flatnonzero(open_).tolist():
            which, n, before = found.get(q, (0, 0, 0))
            if before + n < wanted[q]:  # fewer candidates than k
                open_[q] = False
                continue
            low[q], above[q] = block.low[q] + which * block.width[q], block.above[q] + before
            open_[q] = block.width[q] > 1 and above[q] + n > k
            if open_[q]:
                span[q], width[q] = block.width[q], -(-block.width[q] // bins)
        block.low, block.width, block.span, block.above = low, width, span, above
    return block


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, bins: int = BINS, queries_at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of every row of ``vectors`` (vec_id, embedding) with ``is_query``."""
    spark = vectors.sparkSession
    known = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        whole_numbers(F.col("embedding"), scale).alias("ints"),
        (F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()).alias("is_query"),
    ).where(F.col("ints").isNotNull())
    stored = cut_lineage(known, "topk-vectors")  # row numbers stay what they are from here on
    square = F.aggregate("ints", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    queries, largest = stored.agg(F.count_if("is_query"), F.coalesce(F.max(square), F.lit(0))).first()
    out, schema = scratch_path(spark, "topk-found"), "query_id bigint, rank int, vec_id bigint, score bigint"
    blocks = -(-queries // queries_at_once)
    for number in range(blocks):
        chosen = stored.where("is_query").where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == number).select("row", "vec_id", "ints")
        rows = sorted(chosen.collect())
        if not rows:
            continue
        wide = max(len(r["ints"]) for r in rows)
        block = Block([r["row"] for r in rows], [r["vec_id"] for r in rows], np.array([r["ints"] + [0] * (wide - len(r["ints"])) for r in rows], dtype=np.int64).reshape(len(rows), wide))
        block = located(stored, block, largest, k, bins)
        best = stored.select("row", "vec_id", "ints").mapInArrow(best_of_task(broadcast_value(spark, block), k), "query int, vec_id bigint, score bigint")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(block.ids.tolist())], "query int, query_id bigint")
        ranked.join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out) if blocks else spark.createDataFrame([], schema)
