"""Weighted rendezvous sharding of records by a stable key.

Every shard draws a number from md5(key:shard); the shard with the best weighted draw wins.
A shard added later only competes with its own draws, so rows move into it and nowhere else.

Slots number the rows of a shard without gaps. They come from counts per (shard, bucket): the
buckets' running totals are offsets, and rows are numbered only inside a bucket, so no shard is
ever sorted as a whole. Equal (key, size, crc) rows are counted before the shuffle and spread
out again over their copies.

Null keys are the text "null"; null texts have no bytes and crc 0; repeated rows get a slot
each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, shard: Column) -> Column:
    """Number in (0, 1] of a key and shard: 52 bits of an md5."""
    digest = F.md5(F.concat(key, F.lit(":"), shard.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1.0) / float(2**52)


def best_draws(key: Column, weights: list[float]) -> Column:
    """struct(cost, shard) of the winner: least -ln(draw) / weight, then the lower shard."""
    if not weights or any(not math.isfinite(w) or w <= 0 for w in weights):
        raise ValueError("weights must be positive and at least one")
    equal = len(set(weights)) == 1

    def cost(j: Column) -> Column:
        # with equal weights the order of -ln(u) / w is the falling order of u
        return -draw(key, j) if equal else -F.log(draw(key, j)) / F.element_at(F.array(*map(F.lit, weights)), j + 1)

    return F.array_min(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), lambda j: F.struct(cost(j).alias("cost"), j.alias("shard"))))


def assign(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shards: int = 40,
    weights: list[float] | None = None,
    new_weight: float = 1.0,
    overhead: int = 16,
    rows_per_bucket: int = 50_000,
) -> DataFrame:
    """Rows (key, size, text_crc32, shard, slot, grown_shard) of every row of ``df``."""
    weights = weights or [1.0] * shards
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = (
        df.select(
            F.col(key).alias("_key"),
            (F.octet_length(body) + overhead).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
        )
        .groupBy("_key", "size", "text_crc32")
        .agg(F.count("*").alias("_copies"))
    )
    name = F.coalesce(F.col("_key").cast("string"), F.lit("null"))
    rows = rows.withColumn("_best", best_draws(name, weights)).withColumn("shard", F.col("_best.shard"))
    newcomer = F.struct(
        (-draw(name, F.lit(len(weights))) if len({*weights, new_weight}) == 1 else -F.log(draw(name, F.lit(len(weights)))) / F.lit(new_weight)).alias("cost"),
        F.lit(len(weights)).alias("shard"),
    )
    if len({*weights, new_weight}) != 1 and len(set(weights)) == 1:
        old = F.struct((-F.log(draw(name, F.col("shard"))) / F.lit(weights[0])).alias("cost"), F.col("shard"))
    else:
        old = F.col("_best")
    rows = rows.withColumn("grown_shard", F.least(old, newcomer)["shard"])

    total = df.count()
    buckets = max(1, math.ceil(total / len(weights) / rows_per_bucket)) if total else 1
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_key", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    held = rows.groupBy("shard", "_bucket").agg(F.sum("_copies").alias("_held"))
    # one row per shard and bucket: rows / rows_per_bucket of them in all
    offsets = held.withColumn(
        "_start", F.sum("_held").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ).select("shard", "_bucket", F.coalesce("_start", F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy(F.col("_key").asc_nulls_first(), "size", "text_crc32")
    numbered = rows.withColumn("_before", F.coalesce(F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = numbered.join(offsets, ["shard", "_bucket"]).select(
        F.col("_key").alias(key),
        "size",
        "text_crc32",
        F.col("shard").cast("int"),
        F.explode(F.sequence(F.col("_start") + F.col("_before"), F.col("_start") + F.col("_before") + F.col("_copies") - 1)).alias("slot"),
        F.col("grown_shard").cast("int"),
    )
    return placed
