"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification.

Items are put into size classes (powers of two of their distinct word shingles). Every class has
``perms`` hash functions of its own; under each, an item's minimum names one of its shingles. If a
document contains a share c of an item's shingles, each minimum lies in the document with
probability c, so a document of any length meets at least one of them except with probability
(1 - c) ** perms (0.2 ** 16 < 1e-11 at the default). A document of n shingles can only hold items
of at most n / threshold; it is looked up in the classes up to that size and in no others, and not
at all if it is too small for the least class. Candidates are then verified: the share of the item's
shingles found in the document's exact shingle set decides.

Words are runs of letters and digits in lower case; shingles are five words, shorter texts form
one shingle of all their words. Null and empty texts and items without a word match nothing.
Equal texts are searched under one key and all their rows returned; repeated item ids are told
apart by text, one row for each. Other columns, whatever their names, pass through untouched.

Items are broadcast while their count and shingles are bounded, candidates (text key, item) while
their counted number is; beyond that, both are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import once, text_key
from flowlake.session import cut_lineage

WORDS = 5
BROADCAST_ITEMS = 20_000  # with 16 minima each, below 10 MB
BROADCAST_SHINGLES = 1_000_000  # of all items together, 8 MB
BROADCAST_PAIRS = 200_000  # candidates, below 20 MB


def plain_words(text: Column) -> Column:
    bare = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def shingles(text: Column, width: int = WORDS) -> Column:
    """Hashes of all word shingles of a text, in order, with repetitions."""

    def cut(w: Column) -> Column:
        return (
            F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
            .when(F.size(w) < width, F.array(F.xxhash64(F.array_join(w, " "))))
            .otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(width)])))
        )

    return once(plain_words(text), cut)


def size_class(n: Column) -> Column:
    return F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int")


def item_table(items: DataFrame, text: str = "text", width: int = WORDS) -> DataFrame:
    """(item_id, item_set, item_size, size_class) of items with a word."""
    sets = items.select("item_id", F.array_distinct(shingles(F.col(text), width)).alias("item_set"))
    sets = sets.where(F.size("item_set") > 0).withColumn("item_size", F.size("item_set"))
    return sets.withColumn("size_class", size_class(F.col("item_size")))


def signatures(items: DataFrame, perms: int = 16) -> DataFrame:
    """(h, item_no, size_class): the shingles that an item's minima under its class's hash functions name."""
    minima = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.lit(perms)),
            lambda p: F.array_min(F.transform("item_set", lambda s: F.struct(F.xxhash64(p, F.col("size_class"), s).alias("rank"), s.alias("h"))))["h"],
        )
    )
    return items.select("item_no", "size_class", F.explode(minima).alias("h"))


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    threshold: float = 0.8,
    perms: int = 16,
    width: int = WORDS,
) -> tuple[DataFrame, bool]:
    """(rows (text_key, item_id, item_size, shared) of every document text that contains an item, whether they may be broadcast)."""
    table = item_table(items, width=width).withColumn("item_no", F.xxhash64("item_id", "item_set"))
    table = table.groupBy("item_no").agg(*[F.first(c).alias(c) for c in ("item_id", "item_set", "item_size", "size_class")])
    table = cut_lineage(table, "decontaminate-items")
    count, shingled, least = table.agg(F.count("*"), F.coalesce(F.sum("item_size"), F.lit(0)), F.coalesce(F.min("size_class"), F.lit(0))).first()
    small = F.broadcast if count <= BROADCAST_ITEMS and shingled <= BROADCAST_SHINGLES else (lambda df: df)

    def need(size: Column) -> Column:
        """Shared shingles that an item of this size asks for."""
        return F.ceil(threshold * size - 1e-9)

    keyed = docs.select(text_key(F.col(text)).alias("text_key"), F.col(text).alias("_text"))
    seen = keyed.select("text_key", shingles(F.col("_text"), width).alias("_hashes"))
    seen = seen.where(F.size("_hashes") >= need(F.lit(2**least)))
    reach = F.floor(F.log2((F.size("_hashes") + 1e-6) / threshold)).cast("int")  # the largest class with an item that fits
    seen = seen.select("text_key", reach.alias("_reach"), F.explode("_hashes").alias("h"))
    named = small(signatures(table, perms))
    hits = seen.join(named, (seen["h"] == named["h"]) & (seen["_reach"] >= named["size_class"]))
    pairs = cut_lineage(hits.select("text_key", "item_no").distinct(), "decontaminate-candidates")
    few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS

    # beyond the bound a text with many copies is a skewed key of this join, which adaptive execution can split
    facts = small(table.select("item_no", "item_id", "item_set", "item_size"))
    texts = keyed.join(F.broadcast(pairs) if few else pairs, "text_key").join(facts, "item_no")
    shared = F.size(F.array_intersect("item_set", shingles(F.col("_text"), width)))
    counted = texts.select("text_key", "item_no", "item_id", "item_size", shared.alias("shared"))
    return counted.where(F.col("shared") >= need(F.col("item_size"))).distinct().drop("item_no"), few


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, item_id, item_size, shared, containment), one row per document row and contained item."""
    found, few = find(docs, items, **options)
    rows = docs.select(F.col(doc_id), text_key(F.col(options.get("text", "text"))).alias("text_key"))
    joined = rows.join(F.broadcast(found) if few else found, "text_key")
    return joined.select(doc_id, "item_id", "item_size", "shared", (F.col("shared") / F.col("item_size")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents that contain no item, with their own columns."""
    found, few = find(docs, items, text=text, **options)
    bad = found.select(F.col("text_key").alias("bad_key")).distinct()
    bad = F.broadcast(bad) if few else bad
    return docs.join(bad, text_key(docs[text]) == bad["bad_key"], "left_anti")
