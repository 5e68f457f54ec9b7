"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text is its words in lower case; its k-mers are runs of five words (a shorter text is one
k-mer), labelled with how often they occurred before, so repetitions count. Under each of
``SKETCHES`` hash functions the ``ELL`` least k-mers are taken and put back into text order; their
sequence is one sketch. Two texts share a sketch when they agree on those k-mers and on their
order, which follows edit similarity rather than mere overlap: with similarity 0.8 at least one of
24 sketches of 5 agrees with probability above 0.9999. That does not hold for short texts, whose
sketch is most of the text; texts of up to ``SHORT`` k-mers are joined with all texts they can
reach without sketches.

Equal word sequences are one text from the start. Texts of one sketch are not all paired with each
other: the best connected one (the sum of its sketches' group sizes) leads, and the others are
compared with it. Texts of sketches whose members are then still in several classes stay open, and
open texts are joined exactly: two texts that reach the threshold share one of the few k-mers of
each that are rarest among the open texts (as many as the threshold lets a text lose, and one
more), so only texts of different classes that share such a k-mer are compared.

A comparison aligns the k-mers of both texts within
the band of diagonals that the threshold allows (longest chain of common labelled k-mers, increasing
in both texts) and divides the aligned k-mers by all. Links of at least ``threshold`` are joined
into classes by rounds of star contraction, each written to the shared folder.

Null and empty texts are all copies of one empty text. A null doc_id takes part and never names a
class that has another id. Repeated rows are copies. Very long texts are sketched and aligned
whole. Columns other than doc_id and text are not read, and pass through ``keep_one`` untouched.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import map_batches, text_key, texts_in
from flowlake.session import cut_lineage

K = 5
ELL = 5
SKETCHES = 24
THRESHOLD = 0.8
SHORT = 40
PRINT = 16  # 64-bit numbers of a parity print
ONE = np.uint64(0x9E3779B97F4A7C15)
TWO = np.uint64(0xBF58476D1CE4E5B9)
THREE = np.uint64(0x94D049BB133111EB)
SEEDS = np.array([(i + 1) * 0xD1342543DE82EF95 % 2**64 for i in range(SKETCHES)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * TWO
    x = (x ^ (x >> np.uint64(27))) * THREE
    return x ^ (x >> np.uint64(31))


def word_list(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = {w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in set(words)}
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def kmers(hashes: np.ndarray) -> np.ndarray:
    """Labelled k-mers in text order; all are distinct."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(K, n)
    x = np.zeros(n - width + 1, dtype=np.uint64)
    for i in range(width):
        x = x * ONE + hashes[i : n - width + 1 + i]
    x = mixed(x + np.uint64(width))
    order = np.argsort(x, kind="stable")
    ranked = x[order]
    place = np.arange(len(x))
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    label = np.empty(len(x), dtype=np.uint64)
    label[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return np.where(label > 0, mixed(x + label * ONE), x)


def sketches(x: np.ndarray) -> np.ndarray:
    """One 64-bit value per hash function."""
    if len(x) == 0:
        return SEEDS.astype(np.int64)
    ranks = (x[None, :] ^ SEEDS[:, None]) * TWO >> np.uint64(20)
    if len(x) > ELL:
        least = np.sort(np.argpartition(ranks, ELL - 1, axis=1)[:, :ELL], axis=1)
    else:
        least = np.tile(np.arange(len(x)), (SKETCHES, 1))
    out = SEEDS.copy()
    for k in range(least.shape[1]):
        out = mixed(out * ONE + x[least[:, k]])
    return out.astype(np.int64)


def chain(places: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(places) < 2 or (np.diff(places) > 0).all():
        return len(places)
    tops: list[int] = []
    for p in places.tolist():
        at = bisect_left(tops, p)
        tops[at : at + 1] = [p]
    return len(tops)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Aligned k-mers by all k-mers of two texts; 0 as soon as the threshold is out of reach."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = len(a) + len(b)
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    _, i, j = np.intersect1d(a, b, return_indices=True)
    if len(i) < threshold * (both - len(i)):
        return 0.0
    # an aligned k-mer is shifted by k-mers that only one text has, of which the threshold allows so many
    band = both - 2 * (threshold * both / (1 + threshold))
    near = np.abs(i - j) <= band + 1
    order = np.argsort(i[near])
    aligned = chain(j[near][order])
    return aligned / (both - aligned)


def key_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_near_id`` and ``_near_text``, which name a row up to exact repetition."""
    return docs.withColumns({"_near_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_near_text": text_key(F.col("text"))})


def first_row(doc_id: str = "doc_id", text: str = "_near_text") -> Column:
    """Least row of a group: by id, null ids last, then by text."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))


def sketch(docs: DataFrame) -> DataFrame:
    """(doc_id, _near_text, key, n, sketches) of every row; rows of equal words share a key, ``n`` counts k-mers."""

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [word_list(t) for t in texts_in(batch)]
        keys = pa.array([key_of(w) for w in words], pa.binary())
        found = [kmers(word_hashes(w)) for w in words]
        n, made = pa.array(map(len, found), pa.int32()), pa.array([sketches(x) for x in found], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_near_text"), keys, n, made], ["doc_id", "_near_text", "key", "n", "sketches"])

    kept = identified(docs.select("doc_id", "text")).drop("_near_id")
    return map_batches(kept, use, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, _near_text string, key binary, n int, sketches array<bigint>")


def bodies_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, kmers) of the texts named by ``rows`` (doc_id, text key), k-mers as 32-bit numbers."""
    named = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_near_id"), F.col("text").alias("_near_text"))
    texts = identified(docs.select("doc_id", "text")).select("_near_id", "_near_text", "text")
    texts = texts.join(named, ["_near_id", "_near_text"], "left_semi").dropDuplicates(["_near_id", "_near_text"])

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [word_list(t) for t in texts_in(batch)]
        made = [kmers(word_hashes(w)).astype(np.uint32).tobytes() for w in words]
        return pa.RecordBatch.from_arrays([pa.array([key_of(w) for w in words], pa.binary()), pa.array(made, pa.binary())], ["key", "kmers"])

    return map_batches(texts.select("text"), use, "key binary, kmers binary")


def verified(pairs: DataFrame, bodies: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) pairs whose texts align."""
    joined = pairs.join(bodies.select(F.col("key").alias("a"), F.col("kmers").alias("x")), "a")
    joined = joined.join(bodies.select(F.col("key").alias("b"), F.col("kmers").alias("y")), "b").select("a", "b", "x", "y")

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        same = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            value = similarity(np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32), threshold)
            same.append(value >= threshold - 1e-12)
        return batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))

    return map_batches(joined, use, "a binary, b binary")


def led_pairs(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """Distinct (a, b) pairs of a leader and another member of its sketch; never two of one class."""
    led = members.join(leaders, "sketch").where("root != leader_root")
    return led.select(F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b")).distinct()


def leaders_of(members: DataFrame) -> DataFrame:
    """Of each sketch the best connected member."""
    best = members.groupBy("sketch").agg(F.max(F.struct("degree", "key", "root")).alias("m"))
    return best.select("sketch", F.col("m.key").alias("leader"), F.col("m.root").alias("leader_root"))


def tokens_of(bodies: DataFrame) -> DataFrame:
    """(key, n, token): the different k-mers of every text; ``n`` counts all of its k-mers."""

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [np.frombuffer(x, dtype=np.uint32) for x in batch.column("kmers").to_pylist()]
        unique = [np.unique(x) for x in made]
        sizes = np.array([len(x) for x in unique], dtype=np.int64)
        keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        n = np.repeat(np.array([len(x) for x in made], dtype=np.int32), sizes)
        tokens = np.concatenate([np.zeros(0, dtype=np.uint32), *unique]).astype(np.int64)
        return pa.RecordBatch.from_arrays([keys, pa.array(n), pa.array(tokens)], ["key", "n", "token"])

    return map_batches(bodies.select("key", "kmers"), use, "key binary, n int, token bigint")


def rare_tokens(bodies: DataFrame, threshold: float) -> DataFrame:
    """(key, n, token): of every text its rarest k-mers, of which any text that reaches the threshold has one.

    A partner has ``threshold * n`` k-mers in common at least. In one order of all k-mers, here by
    frequency, all but the last ``ceil(threshold * n) - 1`` of both texts therefore meet. K-mers of
    a single text stand first in the order, but meet nobody and are left out.
    """
    tokens = tokens_of(bodies)
    several = cut_lineage(tokens.groupBy("token").agg(F.count("*").alias("seen")).where("seen > 1"), "near-counts")
    texts = tokens.join(several, "token").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("seen", "token"))).alias("ranked"))
    first = F.size("ranked") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
    kept = texts.withColumn("first", first).where("first > 0")
    return kept.select("key", "n", F.explode(F.expr("slice(ranked, 1, first).token")).alias("token"))


def parity(x: np.ndarray) -> np.ndarray:
    """Bits that tell whether an odd number of k-mers falls on them.

    A k-mer that only one of two texts has turns one bit, so their prints differ in at most as
    many bits as there are such k-mers.
    """
    place = x.astype(np.uint64) * ONE >> np.uint64(64 - (64 * PRINT).bit_length() + 1)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=64 * PRINT) & 1).astype(np.uint8)).view(np.int64)


def prints_of(bodies: DataFrame) -> DataFrame:
    """(key, p0, p1, ...): the parity print of every text."""
    names = [f"p{i}" for i in range(PRINT)]

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [parity(np.unique(np.frombuffer(x, dtype=np.uint32))) for x in batch.column("kmers").to_pylist()]
        table = np.array(made, dtype=np.int64).reshape(-1, PRINT)
        return pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array(np.ascontiguousarray(c)) for c in table.T]], ["key", *names])

    return map_batches(bodies.select("key", "kmers"), use, "key binary, " + ", ".join(f"{p} bigint" for p in names))


def open_pairs(bodies: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Distinct (a, b) pairs of texts of different classes that can reach the threshold.

    The largest class of a k-mer is only compared with the others, so a class of many copies does
    not meet itself. Sizes and parity prints tell most pairs out of reach within the join.
    """
    rare = rare_tokens(bodies, threshold).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    rare = cut_lineage(rare, "near-rare")
    sizes = rare.groupBy("token", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("token").agg(F.max(F.struct("size", "root"))["root"].alias("largest"), F.count("*").alias("classes"))
    marked = rare.join(largest.where("classes > 1").drop("classes"), "token").withColumn("large", F.col("root") == F.col("largest")).drop("largest")
    marked = cut_lineage(marked.join(prints_of(bodies), "key"), "near-marked")
    x, y = (marked.select("token", *[F.col(c).alias(f"{side}_{c}") for c in marked.columns if c != "token"]) for side in "xy")
    both = F.col("x_n") + F.col("y_n")
    apart = sum((F.bit_count(F.col(f"x_p{i}").bitwiseXOR(F.col(f"y_p{i}"))) for i in range(PRINT)), F.lit(0))
    # k-mers in common are threshold / (1 + threshold) of both sizes at least
    fits = (F.least("x_n", "y_n") >= F.greatest("x_n", "y_n") * F.lit(threshold) - F.lit(1e-9)) & (apart <= both * F.lit(1 - 2 * threshold / (1 + threshold)) + F.lit(1e-9))
    met = x.join(y.where("not y_large"), "token").where((F.col("x_root") != F.col("y_root")) & (F.col("x_large") | (F.col("x_key") < F.col("y_key"))) & fits)
    return met.select(F.least("x_key", "y_key").alias("a"), F.greatest("x_key", "y_key").alias("b")).distinct()


def linked_classes(docs: DataFrame, groups: DataFrame, short: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, root) of linked texts; ``groups`` has (sketch, key, row, degree) of shared sketches.

    First one leader is compared with all of its sketch. Then the texts of sketches whose members
    are in several classes and the ``short`` texts (key, row) are joined exactly.
    """
    bodies = cut_lineage(bodies_of(docs, groups.select("row.*").unionByName(short.select("row.*")).distinct()), "near-bodies")
    alone = groups.select("sketch", "key", "degree", F.col("key").alias("root"))
    found = cut_lineage(verified(led_pairs(alone, leaders_of(alone)), bodies, threshold), "near-links")
    roots = cut_lineage(components(found), "near-roots")
    members = groups.select("sketch", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    several = members.groupBy("sketch").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high").select("sketch")
    open_ = members.join(several, "sketch", "left_semi").select("key").unionByName(short.select("key")).distinct()
    left = cut_lineage(bodies.join(open_, "key", "left_semi"), "near-open")
    more = cut_lineage(verified(open_pairs(left, roots, threshold), left, threshold), "near-links")
    if more.isEmpty():
        return roots
    return components(found.unionByName(more))


def components(edges: DataFrame) -> DataFrame:
    """(key, root) of every linked key: the least key of its component, by star contraction."""
    pairs = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars")
    before = None
    while True:
        # large star: every neighbour above u is joined to the least of u's neighbourhood
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its neighbours below are joined to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        pairs = cut_lineage(small.where("u != v").distinct(), "stars")
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(
        pairs.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
    )


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, _near_text, key, copy_of, class_id, class_row): one row per row of ``docs``.

    ``copy_of`` is the least doc_id with the same words, ``class_id`` the least of the class.
    """
    sketched = cut_lineage(sketch(docs), "sketches")
    texts = sketched.groupBy("key").agg(first_row().alias("row"), F.first("n").alias("n"), F.first("sketches").alias("sketches"))
    each = texts.select("key", "row", F.explode("sketches").alias("sketch"))
    sizes = each.groupBy("sketch").agg(F.count("*").alias("size")).where("size > 1")
    shared = each.join(sizes, "sketch")
    degree = shared.groupBy("key").agg(F.sum("size").alias("degree"))
    groups = cut_lineage(shared.join(degree, "key").select("sketch", "key", "row", "degree"), "near-groups")
    # partners of texts up to SHORT included; a text of a single k-mer has only equal partners
    short = texts.where((F.col("n") > 1) & (F.col("n") <= F.lit(SHORT / threshold))).select("key", "row")
    roots = linked_classes(docs, groups, short, threshold)
    named = texts.select("key", "row").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("row").alias("class_row"))
    members = named.join(least, "root").select("key", F.col("row.doc_id").alias("copy_of"), F.col("class_row.doc_id").alias("class_id"), "class_row")
    return sketched.select("doc_id", "_near_text", "key").join(members, "key")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The row of every class that names it (the least doc_id), with its own columns."""
    kept = classes(docs, threshold).select("class_row.*").distinct()
    named = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_near_id"), F.col("text").alias("_near_text"))
    rows = identified(docs).join(named, ["_near_id", "_near_text"], "left_semi")
    return rows.dropDuplicates(["_near_id", "_near_text"]).select(docs.columns)
