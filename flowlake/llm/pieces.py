"""Subword pieces: vocabulary, batched lattices, Viterbi encoding and exact decoding.

A text is cut at spaces and line breaks into words that no vocabulary piece crosses; a word keeps
its spaces, written as the vocabulary's space mark. Distinct words of equal length form one
matrix of code points. Substring hashes of all words are probed in the sorted piece keys, and the
best score of every prefix advances for all words of the matrix together; vectorised maxima store
the length of the last piece, from which the pieces are read back. Ties go to the shorter last
piece. A character in no piece is spelled in byte pieces.

Encoding puts one space before a non-empty text, as the vocabulary expects; decoding takes it off.
Decoding an encoded text gives the text back exactly, the space mark itself included (spelled in
bytes). Null texts have null pieces, empty texts none. Texts are encoded whole; repeated rows are
encoded row by row; other columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from flowlake.llm.common import broadcast_value, map_batches, plus

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(f" +[^ \n{MARK}]*|\n|{MARK}|[^ \n{MARK}]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
TOP_BITS = 20
CELLS = 1 << 17  # code points of one matrix
CACHED = 400_000  # distinct words kept by a task


@dataclass(frozen=True)
class Vocabulary:
    """Pieces of a SentencePiece model. ``byte_ids[b]`` is the piece of byte b."""

    pieces: list[str]
    scores: np.ndarray
    byte_ids: np.ndarray
    texts: list[bytes]  # what each piece decodes to
    keys: np.ndarray  # sorted hashes of the ordinary pieces
    key_ids: np.ndarray  # their piece ids
    longest: int
    likely: np.ndarray  # by the top bits of a hash: whether any key has them

    @property
    def byte_score(self) -> float:
        """Below every ordinary piece, so bytes only serve where no piece fits."""
        return float(self.scores.min()) * 4.0 - 1.0


def hash_of(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(BASE) + ord(c) + 1) & (2**64 - 1)
    return h


def vocabulary(pieces: list[str], scores: list[float], byte_ids: list[int], special: set[int]) -> Vocabulary:
    """Vocabulary of pieces; ids in ``special`` or ``byte_ids`` are no ordinary pieces."""
    other = special | set(byte_ids)
    ordinary = [i for i in range(len(pieces)) if i not in other and pieces[i]]
    usual = set(ordinary)
    for i in ordinary:
        if MARK in pieces[i].lstrip(MARK) or "\n" in pieces[i]:
            raise ValueError(f"piece {pieces[i]!r} crosses a word")
    # pieces of marks alone carry a placeholder score in public models; rank them last
    values = np.array(scores, dtype=np.float64)
    sane = values[ordinary][values[ordinary] > -1e8]
    values[values <= -1e8] = sane.min() if len(sane) else 0.0
    values[[i for i in range(len(pieces)) if i not in usual]] = 0.0
    keys = np.array([hash_of(pieces[i]) for i in ordinary], dtype=np.uint64)
    order = np.argsort(keys)
    if len(np.unique(keys)) != len(keys):
        raise ValueError("two pieces share a hash or a text")
    texts = [p.replace(MARK, " ").encode() if i in usual else b"" for i, p in enumerate(pieces)]
    for b, i in enumerate(byte_ids):
        texts[i] = bytes([b])
    likely = np.zeros(1 << TOP_BITS, dtype=bool)
    likely[(keys >> np.uint64(64 - TOP_BITS)).astype(np.int64)] = True
    longest = max(len(pieces[i]) for i in ordinary)
    return Vocabulary(pieces, values, np.array(byte_ids), texts, keys[order], np.array(ordinary)[order], longest, likely)


def load(model: str = MODEL) -> Vocabulary:
    """Vocabulary of a model file, read on the driver."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    size = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(size)]
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
    return vocabulary(pieces, [sp.get_score(i) for i in range(size)], byte_ids, special)


class Lattice:
    """All pieces that occur in words of one length: ``ids[l - 1][:, s]`` is the piece at s of l characters, or -1."""

    def __init__(self, vocab: Vocabulary, words: list[str]):
        self.width, self.length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(self.width, self.length)
        prefix = np.zeros((self.width, self.length + 1), dtype=np.uint64)
        for i in range(self.length):
            prefix[:, i + 1] = prefix[:, i] * BASE + codes[:, i] + np.uint64(1)
        self.ids, power = [], np.uint64(1)
        with np.errstate(over="ignore"):
            for size in range(1, min(vocab.longest, self.length) + 1):
                power = power * BASE
                hashes = prefix[:, size:] - prefix[:, : self.length + 1 - size] * power
                self.ids.append(np.full(hashes.shape, -1, dtype=np.int32))
                maybe = np.nonzero(vocab.likely[(hashes >> np.uint64(64 - TOP_BITS)).astype(np.int64)])
                wanted = hashes[maybe]
                at = np.minimum(np.searchsorted(vocab.keys, wanted), len(vocab.keys) - 1)
                self.ids[-1][maybe] = np.where(vocab.keys[at] == wanted, vocab.key_ids[at], -1)
        self.codes = codes


def by_length(words: list[str], cells: int = CELLS):
    """(positions, words) groups of equal length, cut to a bounded number of characters."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for length, places in groups.items():
        step = max(1, cells // max(length, 1))
        for k in range(0, len(places), step):
            part = places[k : k + step]
            yield part, [words[i] for i in part]


def viterbi(vocab: Vocabulary, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
    """Length and id of the last piece of the best segmentation of the first e characters, for every e."""
    width, length = lattice.width, lattice.length
    best = np.full((width, length + 1), -np.inf)
    best[:, 0] = 0.0
    back = np.ones((width, length + 1), dtype=np.int16)
    last, rows = np.full((width, length + 1), -1, dtype=np.int32), np.arange(width)
    padded = np.append(vocab.scores, -np.inf)
    scores = [padded[ids] for ids in lattice.ids]
    n_bytes = 1 + (lattice.codes >= 0x80).astype(int) + (lattice.codes >= 0x800) + (lattice.codes >= 0x10000)
    scores[0] = np.where(lattice.ids[0] < 0, vocab.byte_score * n_bytes, scores[0])
    for end in range(1, length + 1):
        steps = min(len(scores), end)
        ways = np.stack([best[:, end - s] + scores[s - 1][:, end - s] for s in range(1, steps + 1)])
        pick = np.argmax(ways, axis=0)
        back[:, end] = pick + 1
        best[:, end] = ways[pick, rows]
        last[:, end] = np.stack([lattice.ids[s - 1][:, end - s] for s in range(1, steps + 1)])[pick, rows]
    return back, last


def read_back(back: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words in a row, number of ids of each word), all words stepping back together."""
    width, length = back.shape[0], back.shape[1] - 1
    ids = np.full((width, length), -1, dtype=np.int32)
    rows, end, column = np.arange(width), np.full(width, length), length
    while len(rows):
        column -= 1
        ids[rows, column] = last[rows, end]
        end = end - back[rows, end]
        rows, end = rows[end > 0], end[end > 0]
    used = ids >= 0
    return ids[used], used.sum(axis=1)


def encode_words(vocab: Vocabulary, words: list[str]) -> list[bytes]:
    """Piece ids of each word (spaces written as marks), as the bytes of 32-bit numbers."""
    out = [b""] * len(words)
    for places, group in by_length(words):
        back, last = viterbi(vocab, Lattice(vocab, group))
        spelled = (last[:, 1:] < 0).any(axis=1)
        ids, sizes = read_back(back[~spelled], last[~spelled])
        data, ends = ids.tobytes(), (np.cumsum(sizes) * 4).tolist()
        whole = [p for p, slow in zip(places, spelled.tolist(), strict=True) if not slow]
        for place, begin, end in zip(whole, [0, *ends], ends, strict=False):
            out[place] = data[begin:end]
        for k in np.flatnonzero(spelled).tolist():  # some prefix ends in a character without a piece
            found, end = [], len(group[k])
            while end > 0:
                if last[k, end] >= 0:
                    found.append(int(last[k, end]))
                else:
                    found.extend(vocab.byte_ids[b].item() for b in reversed(group[k][end - 1].encode("utf-8", "surrogatepass")))
                end -= int(back[k, end])
            out[places[k]] = np.array(found[::-1], dtype=np.int32).tobytes()
    return out


class Encoder:
    """Encodes texts through a bounded table of words already seen."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.mark = vocab.byte_ids[list(MARK.encode())].astype(np.int32).tobytes()
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        cut = [None if t is None else WORD.findall(" " + t) if t else [] for t in texts]
        if len(self.known) > CACHED:
            self.known = {}
        known = self.known
        new = list({w for words in cut if words for w in words if w not in known})
        for word, ids in zip(new, encode_words(self.vocab, [w.replace(" ", MARK) for w in new]), strict=True):
            known[word] = self.mark if word == MARK else ids
        return [None if words is None else np.frombuffer(b"".join([known[w] for w in words]), dtype=np.int32) for words in cut]


def decode(vocab: Vocabulary, ids: list[int]) -> str:
    texts = vocab.texts
    text = b"".join([texts[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode_column(df: DataFrame, text: str = "text", model: str = MODEL, check: bool = False) -> DataFrame:
    """``df`` with ``piece_ids`` (and ``round_trip`` if ``check``), replacing columns of these names."""
    added = ["piece_ids", *["round_trip"] * check]
    kept = df.select([c for c in df.columns if c not in added])
    shared = broadcast_value(df.sparkSession, load(model))
    state: dict[str, Encoder] = {}

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = state.setdefault("encoder", Encoder(shared.value))
        texts = batch.column(text).to_pylist()
        ids = encoder.encode(texts)
        arrays = [*batch.columns, pa.array(ids, pa.list_(pa.int32()))]
        if check:
            arrays.append(pa.array([None if i is None else decode(shared.value, i.tolist()) == t for i, t in zip(ids, texts, strict=True)]))
        return pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *added])

    kinds = {"piece_ids": ArrayType(IntegerType()), "round_trip": BooleanType()}
    return map_batches(kept, use, plus(kept, **{name: kinds[name] for name in added}))


def decode_column(df: DataFrame, ids: str = "piece_ids", text: str = "text", model: str = MODEL) -> DataFrame:
    """``df`` with the decoded texts of ``ids`` in ``text``; null ids give null."""
    kept = df.select([c for c in df.columns if c != text])
    shared = broadcast_value(df.sparkSession, load(model))

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if i is None else decode(shared.value, i) for i in batch.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return map_batches(kept, use, plus(kept, **{text: StringType()}))


def pieces_of(spark: SparkSession, docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_pieces, round_trip, piece_ids) of every document."""
    from pyspark.sql import functions as F

    done = encode_column(docs.select("doc_id", "text"), "text", model, check=True)
    return done.select("doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"), "round_trip", "piece_ids")
