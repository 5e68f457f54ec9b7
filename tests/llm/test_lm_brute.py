"""The language model against scalar loops: counting, learning of gates, mixing and spelling."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowlake.llm import lm

M = [int(m) for m in lm.MIX]
MASK = 2**32 - 1


def slot(context, order, node, width):
    h = ((context * M[1] + order) * M[2] & MASK) ^ (node * M[0] & MASK)
    h ^= h >> 15
    return (h * M[1] & MASK) >> (32 - width)


def symbols(codec, tokens):
    """(symbol, contexts) of token ids; ``tokens`` may hold several texts, each with its end."""
    ids = [codec.ids.get(t, codec.escape) for t in tokens]
    stop, out = codec.ids[lm.END] + 1, []
    for i, x in enumerate(ids):
        one = ids[i - 1] + 1 if i else stop
        two = 0 if one == stop or i < 1 else (ids[i - 2] + 1 if i > 1 else stop)
        out.append((x, [0, one, ((one * M[2] & MASK) ^ (two * M[0] & MASK)) + 7 & MASK]))
    return out


def letters(token):
    """(byte, contexts) of a spelled token."""
    data, out = [1 if b == 0 else b for b in token] + [0], []
    for i, b in enumerate(data):
        sofar, contexts = 0, []
        for k in range(1, 5):
            sofar = (sofar * M[0] + (data[i - k] + 1 if i >= k else 0)) & MASK
            contexts.append(sofar)
        out.append((b, contexts))
    return out


def bits(code, symbol):
    first, size, nodes, ones = code
    return [(int(nodes[i]), int(ones[i])) for i in range(first[symbol], first[symbol] + size[symbol])]


class Mixer:
    def __init__(self, orders, width):
        self.orders, self.width, self.counts = orders, width, [defaultdict(lambda: [0, 0]) for _ in range(orders)]
        self.w = [[1 / orders] * 16 for _ in range(orders)]
        self.curve = [[0.5] * 16 for _ in range(orders)]
        self.seen = [[0.0] * (16 * lm.STEPS) for _ in (0, 1)]

    def count(self, contexts, node, bit):
        for k, c in enumerate(contexts):
            self.counts[k][slot(c, k, node, self.width)][bit] += 1

    def look(self, contexts, node):
        found = [self.counts[k].get(slot(c, k, node, self.width), [0, 0]) for k, c in enumerate(contexts)]
        x = [math.log((o + 0.2) / (z + 0.2)) for z, o in found]
        trust = [sum(z + o > edge for edge in (0.5, 2.5, 15.5)) for z, o in found]
        gate = trust[-1] * 4 + trust[-2]
        total = max(-11.0, min(11.0, sum(self.w[k][gate] * x[k] for k in range(self.orders))))
        return x, gate, total, gate * lm.STEPS + round((total + 11) * (lm.STEPS - 1) / 22)

    def learn(self, block):
        """One step on the (contexts, node, bit) of a block."""
        slope, curve, many = [[0.0] * 16 for _ in self.w], [[0.0] * 16 for _ in self.w], Counter()
        for contexts, node, bit in block:
            x, gate, total, bucket = self.look(contexts, node)
            p = 1 / (1 + math.exp(-total))
            many[gate] += 1
            self.seen[bit][bucket] += 1
            for k in range(self.orders):
                slope[k][gate] += (bit - p) * x[k]
                curve[k][gate] += p * (1 - p) * x[k] ** 2
        for g in range(16):
            n = max(many[g], 32)
            for k in range(self.orders):
                self.curve[k][g] += 0.05 * (curve[k][g] / n - self.curve[k][g])
                self.w[k][g] += 0.1 * slope[k][g] / n / (self.orders * max(self.curve[k][g], 0.02))

    def cost(self, contexts, node, bit):
        _, _, total, bucket = self.look(contexts, node)
        centre = -11 + bucket % lm.STEPS * 22 / (lm.STEPS - 1)
        zeros, ones = self.seen[0][bucket], self.seen[1][bucket]
        p = 0.5 / (1 + math.exp(-total)) + 0.5 * (ones + 4 / (1 + math.exp(-centre))) / (zeros + ones + 4)
        return math.log10(p if bit else 1 - p)


def flat(code, seq):
    return [[(contexts, node, bit) for node, bit in bits(code, s)] for s, contexts in seq]


def learn_in_order(mixer, code, groups):
    """``groups``: symbol sequences; each is cut into blocks of LEARNED_AT_ONCE symbols."""
    for seq in groups:
        each = flat(code, seq)
        for i in range(0, len(each), lm.LEARNED_AT_ONCE):
            mixer.learn([b for s in each[i : i + lm.LEARNED_AT_ONCE] for b in s])


@pytest.mark.parametrize("layout", [1, 5])
def test_mixed_scores_are_those_of_scalar_loops(spark, layout):
    r = random.Random(4)
    words = ["the", "of", "and", "model", "data", "Data,", "naïve", "x"] + [f"w{i}" for i in range(30)]
    texts = [" ".join(r.choices(words, weights=[9] * 8 + [1] * 30, k=r.randint(1, 25))) for _ in range(70)] + ["", None, "the of and", "the of and"]
    docs = spark.createDataFrame([(i, t, i % 4 == 0) for i, t in enumerate(texts)], "doc_id int, text string, gate boolean").repartition(layout)
    model = lm.fit(docs, F.col("gate"))
    codec, own = model["codec"], model["own"]
    learned = Counter(t for x in texts for t in lm.tokens_of(x))
    assert set(codec.ids) == {t for t, n in learned.items() if n >= lm.HEAD_LEAST or t == lm.END}

    code, spell = Mixer(3, model["width"]), Mixer(4, lm.SPELL_BITS)
    hashed = spark.createDataFrame([(x or "",) for x in texts], "t string").select("t", F.xxhash64("t").alias("k")).collect()
    key = {row["t"]: row["k"] for row in hashed}
    held = sorted({texts[i] or "" for i in range(len(texts)) if i % 4 == 0}, key=lambda t: (key[t], t))

    def count_texts(chosen):
        for i in chosen:
            for s in flat(codec.code, symbols(codec, lm.tokens_of(texts[i]))):
                for b in s:
                    code.count(*b)

    count_texts(i for i in range(len(texts)) if i % 4)
    learn_in_order(code, codec.code, [symbols(codec, [t for x in held for t in lm.tokens_of(x)])])
    count_texts(range(0, len(texts), 4))

    tokens = sorted(t for t in learned if t not in codec.ids)
    every = spark.createDataFrame([(bytearray(t),) for t in learned], "t binary").select("t", F.xxhash64("t").alias("k"), (F.crc32("t") % 8 == 0).alias("held")).collect()
    taught = [bytes(row["t"]) for row in sorted(every, key=lambda row: (row["k"], bytes(row["t"]))) if row["held"] and bytes(row["t"]) not in codec.ids]
    spelled = {t: [b for s in flat(codec.bytes, letters(t)) for b in s] for t in tokens}
    for t in tokens:
        if t not in taught:
            for b in spelled[t]:
                spell.count(*b)
    if taught:  # blocks of LEARNED_AT_ONCE bytes, whole tokens
        block, size = [], 0
        for t in taught:
            if block and size + len(t) + 1 > lm.LEARNED_AT_ONCE:
                spell.learn(block)
                block, size = [], 0
            block, size = block + spelled[t], size + len(t) + 1
        spell.learn(block)
        for t in taught:
            for b in spelled[t]:
                spell.count(*b)

    probes = texts + ["unseen wörds the of", "model w1 w2 zzz"]
    got = {row["doc_id"]: row["score"] for row in lm.score(spark.createDataFrame(list(enumerate(probes)), "doc_id int, text string"), model).collect()}
    for i, x in enumerate(probes):
        want, stream = 0.0, lm.tokens_of(x)
        for t, s in zip(stream, flat(codec.code, symbols(codec, stream)), strict=True):
            want += sum(code.cost(*b) for b in s)
            if t not in codec.ids:
                out = math.log10(own["spelled"]) + sum(spell.cost(*b) for s2 in flat(codec.bytes, letters(t)) for b in s2)
                share = max(learned[t] - own["discount"], 0.0) / own["tail"] if learned[t] else 0.0
                want += math.log10(share + 10**out)
        assert got[i] == pytest.approx(want, rel=1e-3, abs=1e-3), x


def test_scores_do_not_depend_on_files_or_partitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = []
    for layout in (docs, docs.repartition(7)):
        model = lm.fit(layout, F.col("doc_id") % 7 == 5)
        found.append(lm.score(layout, model).toPandas().set_index("doc_id")["score"].sort_index())
    assert (found[0] - found[1]).abs().max() < 1e-6
