"""Alignment of two tokenizers' tokens by fragments of byte ranges.

The bytes of ' ' + text are cut by tokens of A (a byte-level BPE) and by tokens of B (a
SentencePiece model). Wherever tokens of both end, a group closes. A fragment describes the tokens
that end inside one byte range: an open prefix (tokens up to its first common end; where the group
began is unknown), closed groups, and an open suffix (tokens after its last common end). Two
neighbouring fragments make one: the left suffix and the right prefix close a group. Composition
is associative, so fragments may be composed in any tree, and a whole text is the composition of
all of its ranges.

Texts are cut before single spaces between two other characters, where neither tokenizer lets a
token cross (checked when the models are loaded). A text of more than ``SEGMENT`` characters
becomes segments of about that size, dealt to tasks of their own; the tokens of a segment are split
by ranges of ``SEGMENT`` bytes, whose borders lie anywhere inside words, into fragments, and these
are composed ``FAN_IN`` at a time by Spark groupings. Shorter texts are one range. Inside a task
the pieces between cuts (words, mostly) are tokenised once and remembered.

Null and empty texts, and texts whose joined A or B bytes differ from ' ' + text, have no tokens:
zeros, no groups and no links. Strings of special tokens are plain text. Each row is aligned by
itself, so repeated ids and texts are fine; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from flowlake.llm.common import ROWS_AT_ONCE, broadcast_value
from flowlake.session import cut_lineage

A_MODEL = "/opt/tokenizers/byte_bpe_50k.json"
B_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEGMENT = 1 << 15
FAN_IN = 16
MOST_KEPT = 500_000  # pieces remembered by a task
KEPT = 8  # ids of a piece on average, at most
PAIR_BITS = 31  # of the B id in a pair
HEAD_PAIRS = 1 << 19
MARK = "▁"
CUT = re.compile(r"(?<=\S) (?=\S)")

INTS, LONGS = ArrayType(IntegerType()), ArrayType(LongType())
FRAGMENT = StructType(
    [StructField(name, kind) for name, kind in (
        ("doc", LongType()), ("seq", LongType()), ("cut", BooleanType()), ("a1", INTS), ("b1", INTS), ("body", StringType()), ("a2", INTS), ("b2", INTS),
        ("n_a", LongType()), ("n_b", LongType()), ("n_groups", LongType()), ("pairs", LONGS), ("times", INTS), ("same", BooleanType()),
    )]
)
NAMES = FRAGMENT.names
CLOSED = StructType(
    [StructField(name, kind) for name, kind in (("n_a", LongType()), ("n_b", LongType()), ("n_groups", LongType()), ("groups", StringType()), ("pairs", LONGS), ("times", INTS))]
)
NONE = np.zeros(0, np.int32)


def byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


def group_text(a_ids, b_ids) -> str:
    return ",".join(map(str, a_ids)) + "|" + ",".join(map(str, b_ids))


@dataclass
class Fragment:
    """Tokens that end in one byte range. Without a common end (``cut`` false) all of them are in a1 and b1."""

    cut: bool
    a1: np.ndarray
    b1: np.ndarray
    body: str  # closed groups between the first and the last common end, joined by ;
    a2: np.ndarray
    b2: np.ndarray
    n_a: int
    n_b: int
    n_groups: int  # in body
    pairs: np.ndarray  # distinct (A id << PAIR_BITS | B id) of tokens that end together, ascending
    times: np.ndarray
    same: bool = True

    @staticmethod
    def of(a_ids, a_ends, b_ids, b_ends, same: bool = True) -> Fragment:
        """Fragment of tokens with their ends, counted from anywhere."""
        places = np.searchsorted(b_ends, a_ends)
        at_a = np.flatnonzero(np.append(b_ends, -1)[places] == a_ends)
        at_b = places[at_a]
        if not len(at_a):
            return Fragment(False, a_ids, b_ids, "", NONE, NONE, len(a_ids), len(b_ids), 0, np.zeros(0, np.int64), NONE, same)
        pairs, times = np.unique(a_ids[at_a].astype(np.int64) << PAIR_BITS | b_ids[at_b], return_counts=True)
        i, j, k, m = at_a[0] + 1, at_b[0] + 1, at_a[-1] + 1, at_b[-1] + 1
        body = groups_text(a_ids[i:k], at_a[1:] - i, b_ids[j:m], at_b[1:] - j)
        return Fragment(True, a_ids[:i], b_ids[:j], body, a_ids[k:], b_ids[m:], len(a_ids), len(b_ids), len(at_a) - 1, pairs, times.astype(np.int32), same)

    def then(self, right: Fragment) -> Fragment:
        """This fragment and the one of the next byte range as one."""
        join = np.concatenate
        n_a, n_b, same = self.n_a + right.n_a, self.n_b + right.n_b, self.same and right.same
        pairs, at = np.unique(join([self.pairs, right.pairs]), return_inverse=True)
        times = np.bincount(at, join([self.times, right.times]), len(pairs)).astype(np.int32)
        if not self.cut:
            return Fragment(right.cut, join([self.a1, right.a1]), join([self.b1, right.b1]), right.body, right.a2, right.b2, n_a, n_b, right.n_groups, pairs, times, same)
        if not right.cut:
            return Fragment(True, self.a1, self.b1, self.body, join([self.a2, right.a1]), join([self.b2, right.b1]), n_a, n_b, self.n_groups, pairs, times, same)
        middle = group_text([*self.a2, *right.a1], [*self.b2, *right.b1])
        body = ";".join([part for part in (self.body, middle, right.body) if part])
        return Fragment(True, self.a1, self.b1, body, right.a2, right.b2, n_a, n_b, self.n_groups + right.n_groups + 1, pairs, times, same)

    def groups(self) -> str:
        """All groups of a text whose ranges this fragment covers."""
        first = group_text(self.a1, self.b1) if self.cut else ""
        return ";".join([part for part in (first, self.body) if part])


NOTHING = Fragment(False, NONE, NONE, "", NONE, NONE, 0, 0, 0, np.zeros(0, np.int64), NONE)


# texts of ids and the mark that follows them: of each id the one with a comma, of A with |, of B with ;
_texts: list[np.ndarray] = [np.zeros(0, dtype=object)]


def groups_text(a_ids, a_last, b_ids, b_last) -> str:
    """Text of closed groups; ``a_last`` and ``b_last`` are the places of each group's last tokens."""
    if not len(a_last):
        return ""
    most = max(int(a_ids.max()), int(b_ids.max()))
    if 3 * most >= len(_texts[0]):
        _texts[0] = np.array([f"{i}{mark}" for i in range(2 * most + 1) for mark in ",|;"], dtype=object)
    a_sizes, b_sizes = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    a_cells, b_cells = a_ids * 3, b_ids * 3
    a_cells[a_last] += 1
    b_cells[b_last] += 2
    cells = np.empty(len(a_ids) + len(b_ids), dtype=np.int32)
    cells[np.arange(len(a_ids)) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)] = a_cells
    cells[np.arange(len(b_ids)) + np.repeat(np.cumsum(a_sizes), b_sizes)] = b_cells
    return "".join(_texts[0][cells].tolist())[:-1]


def bare(piece: str) -> bool:
    return piece != "" and not piece[0].isspace() and not piece[-1].isspace()


class Both:
    """Both tokenizers over pieces of text, and the ids and token sizes of pieces seen before."""

    def __init__(self, a_model: str, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_model)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        special = {t["content"] for t in json.loads(a_model).get("added_tokens", [])}
        entries = sorted(self.a.get_vocab().items(), key=lambda e: e[1])
        self.a_bytes = [b""] * (entries[-1][1] + 1)
        for entry, i in entries:
            self.a_bytes[i] = entry.encode() if entry in special else bytes(letters[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.same = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int32), np.zeros(0, np.int32)]  # of A and of B, piece after piece
        self.ends = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def numbers(self, text: str, fresh: list[str]) -> list[int]:
        """Numbers of a text's pieces; pieces not seen before get the next ones and are added to ``fresh``.

        A piece is known by itself, or by a space and itself where white space stands at its ends.
        """
        keys = text.split(" ") if self.cuts else [" " + text]
        found = list(map(self.known.get, keys))
        missing = [i for i, x in enumerate(found) if x is None] if None in found else []
        if self.cuts and not all([bare(keys[i]) for i in missing]):
            keys = [p if bare(p) else " " + p for p in CUT.split(text)]
            found = list(map(self.known.get, keys))
            missing = [i for i, x in enumerate(found) if x is None]
        for i in missing:
            if keys[i] not in self.known:
                self.known[keys[i]] = len(self.known)
                fresh.append(keys[i])
            found[i] = self.known[keys[i]]
        return found

    def a_of(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(A's ids of all pieces, number of ids of each), each piece taken with a space before it.

        Pieces without white space at their ends are encoded many at a time, as no token crosses from one to the next.
        """
        plain = [k for k in keys if k[0] != " "]
        joined = ["".join([" " + k for k in plain[i : i + 100]]) for i in range(0, len(plain), 100)]
        ids = np.concatenate([np.zeros(0, np.int32), *[np.array(e.ids, np.int32) for e in self.a.encode_batch_fast(joined, add_special_tokens=False)]])
        ends = np.cumsum(self.a_sizes[ids])
        borders = np.cumsum([1 + len(k.encode("utf-8", "surrogatepass")) for k in plain])
        at = np.searchsorted(ends, borders) + 1
        if len(plain) and (at[-1] != len(ends) or not (ends[at - 1] == borders).all()):
            raise ValueError("a token of A crosses a cut")
        if len(plain) == len(keys):
            return ids, np.diff(at, prepend=0)
        parts = iter(np.split(ids, at[:-1]) if plain else [])
        others = iter(self.a.encode_batch_fast([k for k in keys if k[0] == " "], add_special_tokens=False))
        each = [np.array(next(others).ids, np.int32) if k[0] == " " else next(parts) for k in keys]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def learn(self, keys: list[str]) -> None:
        """Remembers the ids of both, and whether both give back the bytes, of pieces taken with a space before them."""
        pieces = [k[1:] if k[0] == " " else k for k in keys]
        found = self.b.encode(pieces, num_threads=1)
        sides = self.a_of(keys), (np.array([i for x in found for i in x], np.int32), np.array([len(x) for x in found], np.int64))
        want = [(" " + p).encode("utf-8", "surrogatepass") for p in pieces]
        same = np.ones(len(pieces), bool)
        for side, ((ids, counts), texts) in enumerate(zip(sides, (self.a_bytes, self.b_bytes), strict=True)):
            parts, ends = [texts[i] for i in ids.tolist()], np.cumsum(counts)
            spelled = [b"".join(parts[i:j]) for i, j in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
            same &= np.array([x == w for x, w in zip(spelled, want, strict=True)], bool)
            self.ids[side] = np.concatenate([self.ids[side], ids])
            self.ends[side] = np.concatenate([self.ends[side], self.ends[side][-1] + ends])
        self.same = np.concatenate([self.same, same])

    def tokens(self, texts: list[str]) -> Iterator[tuple]:
        """(A ids, A ends, B ids, B ends, bytes agree) of every text, taken with a space before it."""
        if len(self.known) > MOST_KEPT or len(self.ids[0]) > MOST_KEPT * KEPT:
            self.forget()
        fresh: list[str] = []
        cut = [self.numbers(t, fresh) for t in texts]
        if fresh:
            self.learn(fresh)
        lengths = np.array([len(numbers) for numbers in cut], np.int64)
        at = np.fromiter(chain.from_iterable(cut), np.int64, int(lengths.sum()))
        same = np.logical_and.reduceat(self.same[at], np.cumsum(lengths) - lengths) if len(cut) else []
        sides = []
        for ids, ends, sizes in zip(self.ids, self.ends, (self.a_sizes, self.b_sizes), strict=True):
            counts = ends[at + 1] - ends[at]
            after = np.cumsum(counts)
            taken = ids[np.arange(after[-1] if len(after) else 0) + np.repeat(ends[at] - (after - counts), counts)]
            borders = np.append(0, after)[np.append(0, np.cumsum(lengths))]
            sides.append((taken, np.append(0, np.cumsum(sizes[taken])), borders))
        (a, a_at, a_of), (b, b_at, b_of) = sides
        for i in range(len(cut)):
            x, y = slice(a_of[i], a_of[i + 1]), slice(b_of[i], b_of[i + 1])
            yield a[x], a_at[1:][x] - a_at[a_of[i]], b[y], b_at[1:][y] - b_at[b_of[i]], bool(same[i])


def segments_of(text: str, size: int) -> list[tuple[int, str]]:
    """(first byte in ' ' + text, segment without its leading space) at the first cut beyond each ``size`` characters."""
    out, start, at = [], 0, 0
    while True:
        found = CUT.search(text, start + size) if len(text) - start > size else None
        part = text[start : found.start()] if found else text[start:]
        out.append((at, part))
        if not found:
            return out
        at += 1 + len(part.encode("utf-8", "surrogatepass"))
        start = found.end()


def by_range(tokens: tuple, start: int, size: int) -> Iterator[tuple[int, Fragment]]:
    """(place, fragment) of a segment's tokens for every byte range; two segments never share a place.

    A cut follows the one before it by ``size`` characters at least, so at most one segment starts inside
    a range; its tokens come after those of the segment before.
    """
    a, a_ends, b, b_ends, same = tokens
    a_range, b_range = (start + a_ends - 1) // size, (start + b_ends - 1) // size
    for number in np.union1d(a_range, b_range).tolist():
        i, k = np.searchsorted(a_range, [number, number + 1])
        j, m = np.searchsorted(b_range, [number, number + 1])
        yield 2 * number + (number == start // size), Fragment.of(a[i:k], a_ends[i:k], b[j:m], b_ends[j:m], same)


def batch_of(rows: list[tuple[int, int, Fragment]]) -> pa.RecordBatch:
    columns = [[r[0] for r in rows], [r[1] for r in rows], *[[getattr(r[2], n) for r in rows] for n in NAMES[2:]]]
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(columns, FRAGMENT.fields, strict=True)], NAMES)


class Loader:
    """Both tokenizers, loaded once by a task from broadcast model files."""

    def __init__(self, spark: SparkSession, a_model: str, b_model: str):
        with open(a_model, encoding="utf-8") as a_file, open(b_model, "rb") as b_file:
            self.files = broadcast_value(spark, (a_file.read(), b_file.read()))
        self.both: Both | None = None

    def get(self) -> Both:
        self.both = self.both or Both(*self.files.value)
        return self.both


def closed(docs: pa.Array, found: list[Fragment], use: Callable[[str], str], name: str = "doc_id") -> pa.RecordBatch:
    """Rows of texts that these fragments cover as a whole."""
    kept = [f if f.same else NOTHING for f in found]
    columns = [
        docs, pa.array([f.n_a for f in kept], pa.int64()), pa.array([f.n_b for f in kept], pa.int64()), pa.array([f.n_groups + f.cut for f in kept], pa.int64()),
        pa.array([use(f.groups()) for f in kept], pa.string()), pa.array([f.pairs for f in kept], pa.list_(pa.int64())), pa.array([f.times for f in kept], pa.list_(pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(columns, [name, *CLOSED.names])


def short_texts(docs: DataFrame, loader: Loader, use: Callable[[str], str]) -> DataFrame:
    """Groups and links of each row of ``docs`` (doc_id, text), its text being a single range."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                texts = part.column("text").to_pylist()
                found = loader.get().tokens([t for t in texts if t])
                yield closed(part.column("doc_id"), [Fragment.of(*next(found)) if t else NOTHING for t in texts], use)

    return docs.mapInArrow(run, StructType([docs.schema["doc_id"], *CLOSED.fields]))


def fragment_of(row: dict) -> Fragment:
    ids = {n: np.array(row[n], np.int32) for n in ("a1", "b1", "a2", "b2", "times")}
    return Fragment(**{n: row[n] for n in NAMES[2:]} | ids | {"pairs": np.array(row["pairs"], np.int64)})


def segments(docs: DataFrame, size: int, loader: Loader) -> DataFrame:
    """(doc, doc_id, start, text): the segments of long texts, as a stored table; ``doc`` numbers the rows."""

    def use(batches):
        for batch in batches:
            for row, text in enumerate(batch.column("text").to_pylist()):
                parts = segments_of(text, size) if loader.get().cuts else [(0, text)]
                same = [batch.column(c).slice(row, 1).take(pa.array([0] * len(parts))) for c in ("doc", "doc_id")]
                yield pa.RecordBatch.from_arrays([*same, pa.array([p[0] for p in parts], pa.int64()), pa.array([p[1] for p in parts], pa.string())], ["doc", "doc_id", "start", "text"])

    schema = StructType([FRAGMENT.fields[0], docs.schema["doc_id"], StructField("start", LongType()), StructField("text", StringType())])
    return cut_lineage(docs.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text").mapInArrow(use, schema), "alignment-segments")


def range_fragments(parts: DataFrame, size: int, loader: Loader) -> DataFrame:
    """Fragments by byte range of segments; each is a group of its own, so a task holds one at a time."""

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = loader.get().tokens(batch.column("text").to_pylist())
            for doc, start, tokens in zip(batch.column("doc").to_pylist(), batch.column("start").to_pylist(), found, strict=True):
                yield batch_of([(doc, place, fragment) for place, fragment in by_range(tokens, start, size)])

    use.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return parts.select("doc", "start", "text").groupBy("doc", "start").applyInArrow(use, FRAGMENT)


def long_texts(parts: DataFrame, use: Callable[[str], str], fan_in: int = FAN_IN) -> DataFrame:
    """(doc, groups and links) of each doc: neighbouring fragments are composed ``fan_in`` at a time until it has one."""

    def whole(rows: list[dict]) -> Fragment:
        return reduce(Fragment.then, [fragment_of(r) for r in sorted(rows, key=lambda r: r["seq"])])

    def level(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield batch_of([(key[0].as_py(), key[1].as_py(), whole([r for batch in batches for r in batch.select(NAMES).to_pylist()]))])

    def last_level(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = whole([r for batch in batches for r in batch.select(NAMES).to_pylist()])
        yield closed(pa.array([key[0].as_py()], pa.int64()), [found], use, "doc")

    for f in (level, last_level):  # Spark looks the annotations up
        f.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    parts = cut_lineage(parts, "alignment-ranges")
    most = parts.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    while most >= fan_in:
        parts = parts.withColumn("up", F.expr(f"seq div {fan_in}")).groupBy("doc", "up").applyInArrow(level, FRAGMENT)
        most //= fan_in
    return parts.groupBy("doc").applyInArrow(last_level, StructType([FRAGMENT.fields[0], *CLOSED.fields]))


def align(
    docs: DataFrame, size: int = SEGMENT, fan_in: int = FAN_IN, use: Callable[[str], str] = str, a_model: str = A_MODEL, b_model: str = B_MODEL
) -> DataFrame:
    """(doc, doc_id, n_a, n_b, n_groups, groups, pairs, times) of every row of ``docs`` (doc_id, text), as a stored table.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in ids of A and B, or what ``use`` makes of that text; ``pairs`` are the
    distinct linked ids (A id << PAIR_BITS | B id) and ``times`` how often the text has them. ``doc`` numbers the rows.
    """
    loader, length = Loader(docs.sparkSession, a_model, b_model), F.coalesce(F.char_length("text"), F.lit(0))
    chosen = docs.select("doc_id", "text")
    short = short_texts(chosen.where(length <= size), loader, use)
    parts = segments(chosen.where(length > size), size, loader)
    long = long_texts(range_fragments(parts, size, loader), use, fan_in).join(parts.where("start = 0").select("doc", "doc_id"), "doc").drop("doc")
    return cut_lineage(short.unionByName(long).select(F.monotonically_increasing_id().alias("doc"), "*"), "alignment")


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n, best): how many links of all texts hold a pair; whether no pair of its B id has more."""

    def add(batches):
        for batch in batches:
            pairs, at = np.unique(batch.column("pairs").flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            times = np.bincount(at, batch.column("times").flatten().to_numpy(zero_copy_only=False), len(pairs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "n"])

    counts = aligned.select("pairs", "times").mapInArrow(add, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.withColumn("a_id", F.shiftright("pair", PAIR_BITS).cast("int")).withColumn("b_id", F.col("pair").bitwiseAND(2**PAIR_BITS - 1).cast("int"))
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))
    return counts.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def link_sums(aligned: DataFrame, counts: DataFrame, head: int = HEAD_PAIRS) -> DataFrame:
    """``aligned`` with n_links, n_best and count_sum in place of pairs and times.

    Pairs that hold at least one in ``head`` of all links are at most ``head`` in number and are looked up in
    a broadcast table; the others, each of few links, are joined.
    """
    spark = aligned.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = counts.where(F.col("n") * head >= total)
    rows = common.select("pair", "n", "best").toPandas().sort_values("pair")
    shared = broadcast_value(spark, (rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(bool)))
    schema = "doc bigint, n_links bigint, n_best bigint, count_sum bigint, pairs array<bigint>, times array<int>"

    def use(batches):
        for batch in batches:
            pairs, n, best = shared.value
            column, times = batch.column("pairs"), batch.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            wanted, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            at = np.minimum(np.searchsorted(pairs, wanted), max(0, len(pairs) - 1))
            known = pairs[at] == wanted if len(pairs) else np.zeros(len(wanted), bool)
            counted, bests = np.where(known, n[at] if len(n) else 0, 0), np.where(known, best[at] if len(n) else False, False)
            sums = [np.zeros(batch.num_rows, np.int64) for _ in range(3)]
            for total, x in zip(sums, (times, times * bests, times * counted), strict=True):
                np.add.at(total, doc, x)
            rest = np.concatenate([[0], np.cumsum(np.bincount(doc[~known], minlength=batch.num_rows))]).astype(np.int32)
            left = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~known], t)) for x, t in ((wanted, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *map(pa.array, sums), *left], ["doc", "n_links", "n_best", "count_sum", "pairs", "times"])

    summed = aligned.select("doc", "pairs", "times").mapInArrow(use, schema)
    rare = summed.where(F.size("pairs") > 0).select("doc", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("doc", F.col("p.pairs").alias("pair"), "p.times")
    added = rare.join(counts.select("pair", "n", "best"), "pair").select(
        "doc", F.lit(0).cast("long").alias("n_links"), (F.col("times") * F.col("best").cast("long")).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
    )
    sums = summed.drop("pairs", "times").unionByName(added).groupBy("doc").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    return aligned.drop("pairs", "times").join(sums, "doc").drop("doc")
