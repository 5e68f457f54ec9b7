"""Token alignment against a plain walk over both token lists."""

import random
from collections import Counter

import pytest

from flowlake.llm import crosstok

SCHEMA = "doc_id string, text string, n_a string"


def plain(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(crosstok.A_MODEL)
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=crosstok.B_MODEL)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    rows, links = [], Counter()
    for text in texts:
        a = a_model.encode(" " + text, add_special_tokens=False) if text else None
        b = b_model.encode(text) if text else []
        a_parts = [bytes(letter[c] for c in t) for t in a.tokens] if text else []
        b_parts = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
            rows.append((0, 0, [], []))
            continue
        groups, pairs, i, j, x, y = [], [], 0, 0, 0, 0
        left, right = [], []
        while i < len(a_parts) or j < len(b_parts):
            if x <= y and i < len(a_parts):
                left.append(a.ids[i])
                x, i = x + len(a_parts[i]), i + 1
            else:
                right.append(b[j])
                y, j = y + len(b_parts[j]), j + 1
            if x == y:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                pairs.append((left[-1], right[-1]))
                left, right = [], []
        links.update(pairs)
        rows.append((len(a.ids), len(b), groups, pairs))
    most = {}
    for (_, b), n in links.items():
        most[b] = max(most.get(b, 0), n)
    return [(n_a, n_b, len(g), len(p), sum(links[x] == most[x[1]] for x in p), sum(links[x] for x in p), ";".join(g)) for n_a, n_b, g, p in rows]


def some_texts():
    r = random.Random(11)
    words = "the of model models' don't naïve über 日本語 🙂🙂 x1y2 3,141 http://a.b/c?d=e \n \t\t     　 <s> <|endoftext|> \x00 \x1f Señor… über-".split(" ")
    letters = " \t\nabcdefghij'.,é—日🙂0123  \x1f"
    made = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(120)]
    made += ["".join(r.choice(letters) for _ in range(r.randint(0, 300))) for _ in range(120)]
    return [*made, *made[:9], None, "", " ", "  ", "a", "▁ mark", "a" * 700, "日本" * 400, " " * 300, "\n" * 50, " lead", "trail ", "a  b c"]


@pytest.mark.parametrize(("size", "fan_in", "head"), [(1 << 15, 16, 1 << 19), (40, 3, 50), (7, 2, 1)])
def test_any_ranges_and_trees_give_the_plain_groups(spark, size, fan_in, head):
    texts = some_texts()
    docs = spark.createDataFrame([(f"d{i}", t, "not read") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    aligned = crosstok.align(docs, size, fan_in)
    found = crosstok.link_sums(aligned, crosstok.link_counts(aligned), head)
    names = "n_a n_b n_groups n_links n_best count_sum groups".split()
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in found.collect()}
    assert got == {f"d{i}": row for i, row in enumerate(plain(texts))}


def test_fragments_compose_in_any_order():
    r, both = random.Random(5), crosstok.Both(open(crosstok.A_MODEL).read(), open(crosstok.B_MODEL, "rb").read())
    for text in some_texts():
        if not text:
            continue
        tokens = next(both.tokens([text]))
        whole = crosstok.Fragment.of(*tokens)
        for size in (1, 3, 10):
            parts = [f for _, f in crosstok.by_range(tokens, 0, size)]
            while len(parts) > 1:
                i = r.randrange(len(parts) - 1)
                parts[i : i + 2] = [parts[i].then(parts[i + 1])]
            one = parts[0]
            assert (one.groups(), one.n_a, one.n_b, one.n_groups, one.pairs.tolist(), one.times.tolist()) == (
                whole.groups(), whole.n_a, whole.n_b, whole.n_groups, whole.pairs.tolist(), whole.times.tolist(),
            )


def test_empty_table(spark):
    aligned = crosstok.align(spark.createDataFrame([], SCHEMA))
    assert crosstok.link_sums(aligned, crosstok.link_counts(aligned)).count() == 0
