"""Language model scores by online logistic context mixing over bits.

A text (ASCII letters in lower case) is a sequence of tokens: words `[^\\x20\\x09-\\x0D]+`, then one
end. A token is sent as bits: the commonest tokens have a Huffman code, all others follow an
escape code and are then spelled in bytes, eight bits each, with a closing zero byte.

Every bit is predicted several times, each time from counts of ones and zeros in a table hashed by
a context and the bit's place in the code: for codes, nothing, the token before, the two tokens
before; for spelling, the last one to four bytes. Predictions are mixed in the logistic domain by
weights that a gate selects (how often the two longest contexts were seen) and that learn online,
bit block by bit block; the mix is refined by an adaptive table of what really followed. The bits'
costs add up to the text's log probability and bits per byte. A spelled token that was counted in
training also has its own share of the spelled mass (absolute discounting).

Learning counts tokens, then the bits of every learning document in the tables. Gates learn from
documents that the tables did not count yet, so they see how far counts are to be trusted; then
those are counted too. They are dealt to gate sets by the hash of their text, so the model depends
neither on files nor on partitions. Counts are added up in Spark. Tokens without a code share one
context, as contexts of their own, tried on held-out texts, predicted worse. What is broadcast is bounded: ``HEAD`` tokens, and tables whose slots follow the number of learned tokens
within ``SLOT_BITS``; the token counts, which grow with the corpus, stay in a Spark table.

Null and empty texts consist of the end token. Very long texts are scored whole, in pieces that
keep their context; equal texts share one score; without a learning document every token is
spelled by untrained tables. Other columns are not read.
"""

from __future__ import annotations

import heapq
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import ROWS_AT_ONCE, broadcast_value, map_batches
from flowlake.session import cut_lineage

HEAD = 1 << 16
SLOT_BITS = 20, 22  # least and most
SPELL_BITS = 18
TOKENS_PER_SLOT_BITS = 7  # a table has about one slot for so many (as a power of two) learned tokens
TOKENS_PER_BUCKET = 1 << 22  # learned tokens for one set of gates
BLOCK = 1 << 15  # counts per shuffled row
CHUNK = 1 << 14  # bits predicted at once
COUNTED_AT_ONCE = 4096  # texts
END = b""
MIX = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
STEPS = 33  # refinement buckets
LEARNED_AT_ONCE = 1 << 9  # symbols of one online step
HEAD_LEAST = 8  # times that a token with a code of its own was seen


def tokens_of(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def token_array(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in a row, number of words of each text), without the ends."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten().cast(pa.binary())
    offsets = np.asarray(split.offsets) - split.offsets[0].as_py()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))  # white space at the sides leaves empty words
    before = np.concatenate([[0], np.cumsum(full)])
    return flat.filter(pa.array(full)), np.diff(before[offsets])


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first bit, number of bits, node of each bit, bit) of the code of every symbol."""
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    n, parent, side = len(weights), {}, {}
    top = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], side[i], parent[j], side[j] = top, 0, top, 1
        heapq.heappush(heap, (a + b, top))
        top += 1
    first, size, nodes, bits = [], [], array("I"), array("B")
    for i in range(n):
        path, at = [], i
        while at in parent:
            path.append((parent[at], side[at]))
            at = parent[at]
        first.append(len(nodes))
        size.append(len(path))
        nodes.extend([p for p, _ in reversed(path)])
        bits.extend([s for _, s in reversed(path)])
    return np.array(first, np.int32), np.array(size, np.int32), np.array(nodes, dtype=np.uint32), np.array(bits, dtype=np.uint8)


def byte_code() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    nodes = [(1 << k) | (b >> (8 - k)) for b in range(256) for k in range(8)]
    bits = [b >> (7 - k) & 1 for b in range(256) for k in range(8)]
    return np.arange(0, 2048, 8, dtype=np.int32), np.full(256, 8, np.int32), np.array(nodes, dtype=np.uint32), np.array(bits, dtype=np.uint8)


def bits_of(code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the symbol, node, bit) of every bit."""
    first, size, nodes, bits = code
    sizes = size[symbols]
    of = np.repeat(np.arange(len(symbols), dtype=np.int32), sizes)
    at = np.arange(len(of), dtype=np.int32) + np.take(first[symbols] - (np.cumsum(sizes, dtype=np.int32) - sizes), of)
    return of, nodes[at], bits[at]


def slots(contexts: list[np.ndarray], of: np.ndarray, nodes: np.ndarray, width: int, first: int = 0) -> list[np.ndarray]:
    """Slot of each bit in each table from order ``first`` on; a context is one uint32 per symbol."""
    spread = nodes * MIX[0]
    out = []
    for order, context in enumerate(contexts, first):
        h = np.take((context * MIX[1] + np.uint32(order)) * MIX[2], of)
        h ^= spread
        h ^= h >> np.uint32(15)
        h *= MIX[1]
        h >>= np.uint32(32 - width)
        out.append(h.astype(np.int64))
    return out


def token_contexts(ids: np.ndarray, end: int) -> list[np.ndarray]:
    """Contexts of token ids; before a text stands an end, and nothing is seen through an end."""
    ids = ids.astype(np.uint32) + np.uint32(1)
    stop = np.uint32(end + 1)
    one = np.concatenate([np.array([stop]), ids[:-1]])
    two = np.where(one == stop, np.uint32(0), np.concatenate([np.zeros(1, np.uint32), one[:-1]]))
    return [np.zeros(len(ids), np.uint32), one, (one * MIX[2] ^ two * MIX[0]) + np.uint32(7)]


def spelling(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(bytes, start of each token, contexts) of spelled tokens; a zero byte inside one is sent as 1."""
    data = np.frombuffer(b"\0".join([t.replace(b"\0", b"\1") for t in tokens]) + b"\0", dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in tokens])])[:-1]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    contexts, sofar = [], np.zeros(len(data), np.uint32)
    for k in range(1, 5):
        back = np.concatenate([np.zeros(k, np.uint32), data[:-k].astype(np.uint32) + np.uint32(1)])[: len(data)]
        sofar = sofar * MIX[0] + np.where(place >= k, back, np.uint32(0))
        contexts.append(sofar.astype(np.uint32))
    return data, starts, contexts


def slots_by_node(nodes: int, width: int) -> np.ndarray | None:
    """Slot of every node in the context 0; none for codes whose first context is a real one."""
    zero = np.zeros(1, np.uint32)
    return slots([zero], np.zeros(nodes, np.int32), np.arange(nodes, dtype=np.uint32), width)[0] if nodes else None


class Tables:
    """Counts of zeros and ones: one row per table, slot by slot a pair (zeros, ones).

    Blocks of small counts travel as 16 bits.
    """

    def __init__(self, orders: int, width: int, nodes: int = 0):
        self.width, self.counts, self.by_node = width, np.zeros((orders, 2 << width), dtype=np.int32), slots_by_node(nodes, width)

    def add(self, contexts, of, nodes, bits) -> None:
        known = [] if self.by_node is None else [self.by_node[nodes]]
        for row, at in zip(self.counts, [*known, *slots(contexts[len(known) :], of, nodes, self.width, len(known))], strict=True):
            at <<= 1
            at |= bits
            np.add.at(row, at, np.int32(1))

    def rows(self, kind: str):
        """Blocks of counts as rows (kind, order, block, counts); blocks without a count are left out."""
        for order, row in enumerate(self.counts):
            for block in range(0, len(row), BLOCK):
                if row[block : block + BLOCK].any():
                    part = row[block : block + BLOCK]
                    yield (kind, order, block, part.astype(np.uint16).tobytes() if part.max() < 1 << 16 else part.tobytes())


class Predictor:
    """Mixed predictions from tables; gate weights and refinement learn online."""

    def __init__(self, counts: np.ndarray, width: int, nodes: int = 0):
        zeros, ones = counts[:, 0::2].astype(np.float32), counts[:, 1::2].astype(np.float32)
        self.width, self.orders = width, len(counts)
        # how often a slot was seen, as 0 to 3, stands in the last two bits of its prediction: one look-up for both
        self.stretched = np.log((ones + np.float32(0.2)) / (zeros + np.float32(0.2)))
        packed = self.stretched.view(np.uint32)
        packed &= np.uint32(0xFFFFFFFC)
        packed |= np.digitize(zeros + ones, [0.5, 2.5, 15.5]).astype(np.uint32)
        self.refined_p = np.zeros(16 * STEPS, dtype=np.float32)
        slot = slots_by_node(nodes, width)
        self.first = None if slot is None else self.stretched[0][slot]  # predictions of the first order, node by node
        self.forget()

    def forget(self) -> None:
        """Gates and refinement as before the first step."""
        self.weights = np.full((self.orders, 16), 1.0 / self.orders, dtype=np.float32)
        self.curve = np.full((self.orders, 16), 0.5)
        self.refined = np.zeros((2, 16 * STEPS))

    def mixed(self, contexts, of, nodes):
        """(stretched inputs, gate, mix, refinement bucket) of every bit."""
        if self.first is None:
            inputs = [np.take(row, a) for row, a in zip(self.stretched, slots(contexts, of, nodes, self.width), strict=True)]
        else:
            at = slots(contexts[1:], of, nodes, self.width, first=1)
            inputs = [np.take(self.first, nodes), *[np.take(row, a) for row, a in zip(self.stretched[1:], at, strict=True)]]
        seen = [x.view(np.uint32) & np.uint32(3) for x in inputs[-2:]]
        gate = (seen[1] * np.uint32(4) + seen[0]).astype(np.int64)
        total = inputs[0] * np.take(self.weights[0], gate)
        for row, x in zip(self.weights[1:], inputs[1:], strict=True):
            total += x * np.take(row, gate)
        np.clip(total, -11.0, 11.0, out=total)
        bucket = np.rint((total + np.float32(11.0)) * np.float32((STEPS - 1) / 22.0)).astype(np.int64)
        bucket += gate * STEPS
        return inputs, gate, total, bucket

    def learn(self, contexts, of, nodes, bits) -> None:
        """One online step of gates and refinement on a block of bits."""
        inputs, gate, total, bucket = self.mixed(contexts, of, nodes)
        for value in (0, 1):
            self.refined[value] += np.bincount(bucket[bits == value], minlength=16 * STEPS)
        p = 1.0 / (1.0 + np.exp(-total))
        many = np.maximum(np.bincount(gate, minlength=16), 32)
        for k, x in enumerate(inputs):
            slope = np.bincount(gate, (bits - p) * x, minlength=16) / many
            self.curve[k] += 0.05 * (np.bincount(gate, p * (1 - p) * x * x, minlength=16) / many - self.curve[k])
            self.weights[k] += (0.1 * slope / (self.orders * np.maximum(self.curve[k], 0.02))).astype(np.float32)

    def costs(self, contexts, of, nodes, bits, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol; ``starts`` are the symbols' first bits."""
        _, _, total, bucket = self.mixed(contexts, of, nodes)
        p = np.float32(0.5) / (np.float32(1.0) + np.exp(-total)) + np.float32(0.5) * np.take(self.refined_p, bucket)
        p = np.where(bits == 1, p, np.float32(1.0) - p)
        return np.log10(np.multiply.reduceat(p.astype(np.float64), starts))

    def settle(self, weights: np.ndarray | None, refined: np.ndarray) -> None:
        if weights is not None:
            self.weights = weights.astype(np.float32)
        centre = np.tile(np.linspace(-11.0, 11.0, STEPS), 16)
        prior = 1.0 / (1.0 + np.exp(-centre))
        self.refined_p = ((refined[1] + 4.0 * prior) / (refined.sum(axis=0) + 4.0)).astype(np.float32)


class Codec:
    """Head tokens and their codes; the last symbol is the escape."""

    def __init__(self, head: list[bytes], weights: list[int]):
        self.ids = {t: i for i, t in enumerate(head)}
        self.escape = len(head)
        self.code = huffman(weights)
        self.nodes = 2 * len(weights)  # of the code
        self.bytes = byte_code()

    def ids_of(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(different words, which of them each word without a code is, ids of all tokens with an end after each text, number of tokens of each text)."""
        words, lengths = token_array(texts)
        coded = words.dictionary_encode()
        table = np.fromiter(map(self.ids.get, coded.dictionary.to_numpy(zero_copy_only=False), repeat(self.escape)), np.int64, len(coded.dictionary))
        which = np.asarray(coded.indices)
        ids = table[which]
        return coded.dictionary, which[ids == self.escape], np.insert(ids, np.cumsum(lengths), self.ids[END]), lengths + 1

    def blocks(self, ids: np.ndarray, step: int = CHUNK // 8):
        """(part, contexts, of, nodes, bits) of token ids, a bounded number of bits at a time."""
        contexts = token_contexts(ids, self.ids[END])
        for a in range(0, len(ids), step):
            part = slice(a, min(a + step, len(ids)))
            of, nodes, bits = bits_of(self.code, ids[part])
            yield part, [c[part] for c in contexts], of, nodes, bits

    def spelled_blocks(self, tokens: list[bytes], step: int = CHUNK // 8):
        """(tokens of the block, their starts, contexts, of, nodes, bits), a bounded number of bits at a time."""
        at = 0
        while at < len(tokens):
            end, room = at, step
            while end < len(tokens) and (end == at or room >= len(tokens[end]) + 1):
                room -= len(tokens[end]) + 1
                end += 1
            data, starts, contexts = spelling(tokens[at:end])
            yield (slice(at, end), starts, contexts, *bits_of(self.bytes, data.astype(np.int64)))
            at = end


COUNT_ROWS = "kind string, part int, block int, counts binary"


def arrow_rows(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def summed(counted: DataFrame, orders: int, width: int) -> np.ndarray:
    """Counts of all tasks, added up block by block; at most orders x 2 ** (width + 3) bytes reach the driver."""

    def add(key, batches):
        total = None
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                part = np.frombuffer(data, dtype=np.uint16 if len(data) == 2 * BLOCK else np.int32)
                total = part.astype(np.int64) if total is None else total + part
        low = np.minimum(total, 2**31 - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[1].as_py()], pa.int32()), pa.array([key[2].as_py()], pa.int32()), pa.array([low.tobytes()], pa.binary())], ["part", "block", "counts"]
        )

    from collections.abc import Iterator

    add.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    out = np.zeros((orders, 2 << width), dtype=np.int32)
    for order, at, data in counted.groupBy("kind", "part", "block").applyInArrow(add, "part int, block int, counts binary").collect():
        out[order, at : at + BLOCK] = np.frombuffer(data, dtype=np.int32)
    return out


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, n) over all texts."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, COUNTED_AT_ONCE):
                texts = batch.column("text").slice(start, COUNTED_AT_ONCE)
                counted = token_array(texts)[0].value_counts()
                tokens, n = counted.field("values"), counted.field("counts")
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([tokens, pa.array([END], pa.binary())]), pa.concat_arrays([n, pa.array([len(texts)], pa.int64())])], ["token", "n"])

    return docs.select("text").mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def learn_gates(rows: DataFrame, feed, counts: np.ndarray, width: int, buckets: int, nodes: int) -> tuple[np.ndarray | None, np.ndarray]:
    """(gate weights, refinement counts) learned from the different values of ``rows``' only column.

    Values are dealt to buckets by their hash and sorted, and every bucket is one online pass with its own gates,
    ``ROWS_AT_ONCE`` values after another; weights are averaged by the bits that a bucket saw, refinement counts
    added up. So neither files nor partitions matter, and equal values, however many, count once.
    """
    shared = broadcast_value(rows.sparkSession, counts)
    kind, orders = rows.schema.fields[0].dataType.simpleString(), len(counts)
    value = rows.select(F.col(rows.columns[0]).alias("value")).dropDuplicates()
    keyed = value.select("value", F.xxhash64("value").alias("key")).withColumn("bucket", F.pmod("key", F.lit(buckets)))
    names, types = ["what", "a", "b", "x"], [pa.string(), pa.int32(), pa.int32(), pa.float64()]

    def run(batches):
        own, seen, at, held = None, 0, None, []

        def learned(values: pa.Array) -> int:
            bits = 0
            for block in feed(values):
                own.learn(*block)
                bits += len(block[-1])
            return bits

        def result() -> pa.RecordBatch:
            rows = [("w", g, k, float(own.weights[k, g]) * seen) for g in range(16) for k in range(orders)]
            rows += [("r", v, i, float(own.refined[v, i])) for v in (0, 1) for i in range(16 * STEPS)]
            return arrow_rows([*rows, ("n", 0, 0, float(seen))], names, types)

        def cut(part: list, least: int):
            """Whole groups of rows from the front, and what is left."""
            values = pa.concat_arrays(part)
            last = len(values) - len(values) % ROWS_AT_ONCE if least else len(values)
            return [values.slice(i, min(ROWS_AT_ONCE, last - i)) for i in range(0, last, ROWS_AT_ONCE)], [values.slice(last)]

        for batch in batches:
            numbers = batch.column("bucket").to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for i, k in zip(borders, borders[1:], strict=False):
                if k > i and numbers[i] != at:
                    if held:
                        seen += sum(map(learned, cut(held, 0)[0]))
                        yield result()
                    own = own or Predictor(shared.value, width, nodes)
                    own.forget()
                    seen, at, held = 0, numbers[i], []
                held.append(batch.column("value").slice(i, k - i))
                groups, held = cut(held, ROWS_AT_ONCE)
                seen += sum(map(learned, groups))
        if held:
            seen += sum(map(learned, cut(held, 0)[0]))
            yield result()

    dealt = keyed.repartition(buckets, "bucket").sortWithinPartitions("bucket", "key", "value")
    sums = dealt.select(F.col("value").cast(kind), "bucket").mapInArrow(run, "what string, a int, b int, x double").groupBy("what", "a", "b").agg(F.sum("x"))
    found = {(r[0], r[1], r[2]): r[3] for r in sums.collect()}
    seen = found.get(("n", 0, 0), 0.0)
    refined = np.array([[found.get(("r", v, i), 0.0) for i in range(16 * STEPS)] for v in (0, 1)])
    weights = np.array([[found.get(("w", g, k), 0.0) for g in range(16)] for k in range(orders)]) / seen if seen else None
    return weights, refined


def fit(docs: DataFrame, gate_if: Column, head_size: int = HEAD) -> dict:
    """Model of all rows of ``docs`` (text); rows of ``gate_if`` teach the gates, the others the tables."""
    spark = docs.sparkSession
    counts = cut_lineage(count_tokens(docs), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counts.where(F.col("n") >= HEAD_LEAST).orderBy(F.desc("n"), "token").limit(head_size).collect()
    head = {bytes(r[0]): r[1] for r in top}
    if END not in head:
        head[END] = next((r[0] for r in counts.where(F.col("token") == END).select("n").collect()), 0)
    # tokens without a code: how many, how many different, and the discount that singletons and pairs suggest
    rare = counts.where((F.col("n") < HEAD_LEAST) & (F.col("token") != END))
    once, twice = rare.agg(F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("n") == 2).cast("long")), F.lit(0))).first()
    tail, tail_kinds = max(1, total - sum(head.values())), distinct - sum(n > 0 for n in head.values())
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    codec = Codec(list(head), [*[max(1, n) for n in head.values()], tail])
    coder = broadcast_value(spark, codec)

    width = min(SLOT_BITS[1], max(SLOT_BITS[0], int(total).bit_length() - TOKENS_PER_SLOT_BITS))

    def count_codes(batches):
        tables = Tables(3, width, coder.value.nodes)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                *_, ids, _ = coder.value.ids_of(batch.column("text").slice(start, ROWS_AT_ONCE))
                for _, contexts, of, nodes, bits in coder.value.blocks(ids):
                    tables.add(contexts, of, nodes, bits)
        for row in tables.rows("code"):
            yield arrow_rows([row], ["kind", "part", "block", "counts"], [pa.string(), pa.int32(), pa.int32(), pa.binary()])

    def gate_codes(texts: pa.Array):
        *_, ids, _ = coder.value.ids_of(texts)
        for _, *block in coder.value.blocks(ids, LEARNED_AT_ONCE):
            yield block

    def tail_tokens(tokens: pa.Array) -> list[bytes]:
        return [t for t in tokens.to_pylist() if t not in coder.value.ids]

    def count_spelling(batches):
        tables = Tables(4, SPELL_BITS)
        for batch in batches:
            for _, _, contexts, of, nodes, bits in coder.value.spelled_blocks(tail_tokens(batch.column("token"))):
                tables.add(contexts, of, nodes, bits)
        for row in tables.rows("spell"):
            yield arrow_rows([row], ["kind", "part", "block", "counts"], [pa.string(), pa.int32(), pa.int32(), pa.binary()])

    def gate_spelling(tokens: pa.Array):
        for _, _, *block in coder.value.spelled_blocks(tail_tokens(tokens), LEARNED_AT_ONCE):
            yield block

    def learned_of(rows: DataFrame, count, feed, orders: int, bits: int, nodes: int = 0) -> Predictor:
        """Gates learned from the held rows with tables of the others, then put before tables of all rows."""
        taught, others_ = rows.where("held").drop("held"), rows.where("not held").drop("held")
        others = summed(others_.mapInArrow(count, COUNT_ROWS), orders, bits)
        gates = learn_gates(taught, feed, others, bits, 1 + total // TOKENS_PER_BUCKET, nodes)
        rest = summed(taught.mapInArrow(count, COUNT_ROWS), orders, bits)
        for row, more in zip(others, rest, strict=True):  # one table at a time, to spare the driver's memory
            row[:] = np.minimum(row.astype(np.int64) + more, 2**31 - 1)
        predictor = Predictor(others, bits, nodes)
        predictor.settle(*gates)
        return predictor

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(gate_if, F.lit(False)).alias("held"))
    code_predictor = learned_of(texts, count_codes, gate_codes, 3, width, codec.nodes)
    tokens = counts.select("token", (F.pmod(F.crc32("token"), F.lit(8)) == 0).alias("held"))
    spell_predictor = learned_of(tokens, count_spelling, gate_spelling, 4, SPELL_BITS)
    own = {"tail": tail, "discount": discount, "spelled": max(1e-6, min(1.0, discount * tail_kinds / tail))}
    return {"counts": counts, "total": total, "distinct": distinct, "codec": codec, "head": head, "own": own, "code": code_predictor, "spell": spell_predictor, "width": width}


def spelled_costs(codec: Codec, spell: Predictor, own: dict, tokens: list[bytes], counted: np.ndarray) -> np.ndarray:
    """log10 probability of tokens among those without a code, ``counted`` times seen in training."""
    out = np.empty(len(tokens))
    for part, starts, contexts, of, nodes, bits in codec.spelled_blocks(tokens):
        each = spell.costs(contexts, of, nodes, bits, np.arange(len(contexts[0])) * 8)
        out[part] = np.add.reduceat(each, starts)
    out += np.log10(own["spelled"])
    share = np.maximum(counted - own["discount"], 0.0) / own["tail"]
    return np.where(counted > 0, np.log10(share + 10.0 ** np.maximum(out, -300.0)), out)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score, bits_per_byte) of every row of ``docs``.

    Codes are scored where the text is; tokens without a code, once per text, are joined with
    their training counts and with what it costs to spell them.
    """
    spark = docs.sparkSession
    total, distinct = model["total"], model["distinct"]
    below = float(np.log10(total + distinct + 1))
    known = np.array([np.log10(n + 1) - below for n in model["head"].values()] + [0.0])
    shared = broadcast_value(spark, (model["codec"], model["code"], model["spell"], known, model["own"], np.array([n > 0 for n in model["head"].values()] + [False])))
    body = F.coalesce("text", F.lit(""))
    keys = [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")]
    keyed = docs.select(*keys, body.alias("text"))
    whole = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64()), ("n_bytes", pa.int64())])

    def use(batch: pa.RecordBatch):
        codec, code, _, known, _, seen = shared.value
        words, which, ids, lengths = codec.ids_of(batch.column("text"))
        costs = np.empty(len(ids))
        for part, contexts, of, nodes, bits in codec.blocks(ids):
            sizes = codec.code[1][ids[part]]
            costs[part] = code.costs(contexts, of, nodes, bits, np.cumsum(sizes) - sizes)
        starts = np.cumsum(lengths) - lengths
        k1, k2 = batch.column("k1").to_numpy(zero_copy_only=False), batch.column("k2").to_numpy(zero_copy_only=False)
        # a token that no text holds, another one for every text, stands for the rest of the text
        marks = [b" " + k.to_bytes(8, "big", signed=True) for k in k1.tolist()]
        sums = [
            lengths, np.add.reduceat(seen[ids].astype(np.int64), starts), np.add.reduceat(known[ids], starts), np.add.reduceat(costs, starts),
            np.asarray(pc.binary_length(batch.column("text"))).astype(np.int64),
        ]
        texts_part = pa.StructArray.from_arrays([pa.array(x) for x in sums], fields=list(whole))
        names = ["k1", "k2", "token", "times", "whole"]
        yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(marks, pa.binary()), pa.array(np.ones(len(k1), np.int32)), texts_part], names)
        of_text, kinds = np.searchsorted(starts, np.flatnonzero(ids == codec.escape), side="right") - 1, max(1, len(words))
        each, times = np.unique(of_text * kinds + which, return_counts=True)
        at, tokens = each // kinds, words.take(pa.array(each % kinds))
        yield pa.RecordBatch.from_arrays([pa.array(k1[at]), pa.array(k2[at]), tokens, pa.array(times.astype(np.int32)), pa.nulls(len(at), whole)], names)

    flat = map_batches(keyed, use, "k1 bigint, k2 bigint, token binary, times int, whole struct<n_tokens:bigint,n_known:bigint,base:double,model:double,n_bytes:bigint>")

    def priced(batches):
        codec, _, spell, _, own, _ = shared.value
        for batch in batches:
            rare = batch.filter(pa.array([t not in codec.ids for t in batch.column("token").to_numpy(zero_copy_only=False)], pa.bool_()))
            cost = spelled_costs(codec, spell, own, rare.column("token").to_pylist(), np.array(rare.column("n"), dtype=np.float64)) if len(rare) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*rare.columns, pa.array(cost)], ["token", "c", "cost"])

    # every counted token without a code is spelled once, before the join; unseen ones, which remain, after it
    prices = cut_lineage(model["counts"].select("token", "n").mapInArrow(priced, "token binary, c bigint, cost double"), "token-costs")
    rare, of_whole = F.col("whole").isNull(), lambda c: F.coalesce(F.col(f"whole.{c}"), F.lit(0))
    joined = flat.join(prices, "token", "left").select(
        "k1", "k2", F.when(rare & F.col("c").isNull(), F.col("token")).alias("unseen"), F.when(rare, F.col("times")).otherwise(0).alias("times"),
        of_whole("n_tokens").alias("n_tokens"), (of_whole("n_known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        (of_whole("base") + F.when(rare, F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 1.0) - below)).otherwise(0.0)).alias("base"),
        (of_whole("model") + F.coalesce(F.col("times") * F.col("cost"), F.lit(0.0))).alias("model"),
        of_whole("n_bytes").alias("n_bytes"), (~rare).cast("long").alias("copies"),
    )
    names = ["n_tokens", "n_known", "base", "model", "n_bytes", "copies"]
    merged = joined.groupBy("k1", "k2", "unseen").agg(*[F.sum(c).alias(c) for c in (*names, "times")])

    def spelled(batches):
        codec, _, spell, _, own, _ = shared.value
        for batch in batches:
            at = np.flatnonzero(np.array(batch.column("unseen").is_valid()))
            cost = np.array(batch.column("model"))
            if len(at):
                coded = batch.column("unseen").take(pa.array(at)).dictionary_encode()
                each = spelled_costs(codec, spell, own, coded.dictionary.to_pylist(), np.zeros(len(coded.dictionary)))
                cost[at] += np.array(batch.column("times"))[at] * each[np.array(coded.indices)]
            columns = [pa.array(cost) if n == "model" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *columns], ["k1", "k2", *names])

    costed = merged.mapInArrow(spelled, "k1 bigint, k2 bigint, n_tokens bigint, n_known bigint, base double, model double, n_bytes bigint, copies bigint")
    sums = costed.groupBy("k1", "k2").agg(*[F.sum(c).alias(c) for c in costed.columns[2:]])
    each = sums.select(
        "k1", "k2",
        *[F.expr(f"{c} div copies").alias(c) for c in ("n_tokens", "n_known")],
        (F.col("base") / F.col("copies")).alias("base_score"),
        (F.col("model") / F.col("copies")).alias("score"),
        F.when(F.col("n_bytes") > 0, -F.col("model") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
    return docs.select("doc_id", *keys).join(each, ["k1", "k2"]).drop("k1", "k2")
