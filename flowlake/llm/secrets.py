"""Secret scan with one minimal automaton for all rules.

Rules are written in a small regular language (classes, groups, ``|``, ``?``, ``*``, ``+``,
``{n,}``). Thompson construction gives an automaton for "some text, then a rule read backwards";
subset construction and partition refinement turn it into one minimal transition array over byte
classes. One backward pass over the bytes of a text then marks every byte at which any rule may
have a match that begins there. Rule by rule, marked starts are taken from left to right, the rule's own
forward automaton gives the longest end, and starts inside the last match are passed over: that
is leftmost, longest, non-overlapping search, which for these rules equals greedy matching.

A forward run stops where it meets an earlier run of its rule in the same state, so the work is linear in
the text, whatever it holds.

Spans are in code points, the end exclusive. Null texts count as empty and have no spans; very
long texts are scanned whole; repeated rows are scanned row by row; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import broadcast_value, map_batches, texts_in


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    fold: bool = False  # ASCII letters of keywords match in either case
    value_at_least: int = 0  # length of what follows the separator
    base: bool = False
    tail: str = ""  # may follow the pattern and then belongs to the match


#: What follows the first line of a key: anything up to its last line, or, where that is missing, the
#: lines of base64. Lines may also be parted by blanks or by a written-out line break.
KEY_BODY = (
    r"""(([\x00-\x2C\x2E-\xFF]|-[\x00-\x2C\x2E-\xFF])*-----END\x20[A-Z\x20]*PRIVATE\x20KEY-----"""
    r"""|([\x20\x09\x0D\x0A]*(Proc-Type|DEK-Info):[\x20-\xFF]*[\x0D\x0A]+)*"""
    r"""(([\x20\x09\x0D\x0A]|\\n|\\r)*[A-Za-z0-9+/=]{16,})+(([\x20\x09]*(\x0D|\x0A|\\n|\\r))+[A-Za-z0-9+/=]+)?)?"""
)

#: Kinds in the order in which they are listed; the first three are the base rules.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("key_block", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", tail=KEY_BODY),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


def parse(pattern: str, fold: bool = False):
    """Tree of a pattern: ("set", bytes) | ("cat", parts) | ("or", parts) | ("rep", part, least, endless)."""
    at = 0

    def one_char() -> int:
        nonlocal at
        if pattern[at] == "\\":
            if pattern[at + 1] == "x":
                at += 4
                return int(pattern[at - 2 : at], 16)
            at += 2
            return ord(pattern[at - 1])
        at += 1
        return ord(pattern[at - 1])

    def either(chars: set[int]) -> frozenset[int]:
        return frozenset(chars | {ord(chr(c).swapcase()) for c in chars if chr(c).isalpha()} if fold else chars)

    def atom():
        nonlocal at
        if pattern[at] == "(":
            at += 1
            inside = choice()
            at += 1
            return inside
        if pattern[at] == "[":
            at += 1
            chars: set[int] = set()
            while pattern[at] != "]":
                low = one_char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    chars |= set(range(low, one_char() + 1))
                else:
                    chars.add(low)
            at += 1
            return ("set", either(chars))
        return ("set", either({one_char()}))

    def piece():
        nonlocal at
        node = atom()
        while at < len(pattern) and pattern[at] in "?*+{":
            mark = pattern[at]
            if mark == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at + 1 : end].partition(",")
                at = end + 1
                node = ("rep", node, int(low), (int(high) if high else None) if comma else int(low))
            else:
                at += 1
                node = ("rep", node, int(mark == "+"), 1 if mark == "?" else None)
        return node

    def sequence():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(piece())
        return ("cat", parts)

    def choice():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    tree = choice()
    if at != len(pattern):
        raise ValueError(f"pattern {pattern!r} is not understood at {at}")
    return tree


class Nfa:
    """Thompson automaton; ``skips`` are moves without a byte."""

    def __init__(self):
        self.skips: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.skips.append([])
        self.moves.append([])
        return len(self.skips) - 1

    def add(self, tree, start: int, backwards: bool) -> int:
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((tree[1], end))
            return end
        if kind == "cat":
            for part in reversed(tree[1]) if backwards else tree[1]:
                start = self.add(part, start, backwards)
            return start
        end = self.state()
        if kind == "or":
            for part in tree[1]:
                self.skips[self.add(part, start, backwards)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.add(part, start, backwards)
        if most is None:
            loop = self.state()
            self.skips[start].append(loop)
            self.skips[self.add(part, loop, backwards)].append(loop)
            self.skips[loop].append(end)
        else:
            for _ in range(most - least):
                self.skips[start].append(end)
                start = self.add(part, start, backwards)
            self.skips[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for nxt in self.skips[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


def byte_classes(nfa: Nfa) -> tuple[np.ndarray, list[int]]:
    """Class of each byte, and one byte of each class."""
    sets = sorted({s for row in nfa.moves for s, _ in row}, key=sorted)
    marks: dict[tuple, int] = {}
    of = np.zeros(256, dtype=np.int64)
    for b in range(256):
        of[b] = marks.setdefault(tuple(b in s for s in sets), len(marks))
    return of, [int(np.argmax(of == c)) for c in range(len(marks))]


def subsets(nfa: Nfa, starts: list[int], ends: dict[int, int], restart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subset construction: (transitions by class, set of ended rules as bits, class of bytes)."""
    of, examples = byte_classes(nfa)
    first = nfa.closure(starts)
    ids, todo, table = {first: 0}, [first], []
    while todo:
        here = todo.pop(0)
        row = []
        for b in examples:
            to = {t for s in here for chars, t in nfa.moves[s] if b in chars}
            there = nfa.closure(to | set(starts) if restart else to)
            if there not in ids:
                ids[there] = len(ids)
                todo.append(there)
            row.append(ids[there])
        table.append(row)
    accept = np.array([sum({1 << ends[s] for s in group if s in ends}) for group in ids], dtype=np.int64)
    return np.array(table, dtype=np.int64), accept, of


def minimise(table: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Partition refinement; state 0 stays state 0."""
    part = np.unique(accept, return_inverse=True)[1].reshape(-1)
    while True:
        keys = np.column_stack([part, part[table]])
        refined = np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1)
        if refined.max() == part.max():
            break
        part = refined
    _, example = np.unique(part, return_index=True)
    order = np.argsort(part[0] != np.arange(len(example)), kind="stable")  # part of state 0 first
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    return rank[part[table[example[order]]]], accept[example[order]]


class Automaton:
    """Transitions over bytes as a flat list: next = flat[state + byte], states in steps of 256."""

    def __init__(self, trees: list, backwards: bool, restart: bool):
        nfa = Nfa()
        starts, ends = [], {}
        for k, tree in enumerate(trees):
            starts.append(nfa.state())
            ends[nfa.add(tree, starts[-1], backwards)] = k
        table, accept = minimise(*(made := subsets(nfa, starts, ends, restart))[:2])
        full = table[:, made[2]]
        # accepting states get the highest numbers, so one comparison finds them; state 0 never accepts
        order = np.argsort(accept != 0, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        self.flat: list[int] = (rank[full[order]] * 256).reshape(-1).tolist()
        self.accept: list[int] = accept[order].tolist()
        self.first_accept = int((accept == 0).sum()) * 256
        self.start = int(rank[0]) * 256
        dead = [s for s in range(len(order)) if self.accept[s] == 0 and all(t == s * 256 for t in self.flat[s * 256 : s * 256 + 256])]
        self.dead = dead[0] * 256 if dead and not restart else -1


def relaxed(tree):
    """The tree with inner ``{n,}`` as ``+``: its starts include all true ones.

    Counting several overlapping classes at once would multiply states; the forward automaton
    counts exactly. A rule that is one counted class keeps its count, or every letter would be
    a start.
    """
    kind = tree[0]
    if kind == "cat" and len(tree[1]) > 1:
        return ("cat", [("rep", t[1], 1, None) if t[0] == "rep" and t[2] > 1 and t[3] is None else relaxed(t) for t in tree[1]])
    return ("or", [relaxed(t) for t in tree[1]]) if kind == "or" else tree


class Scanner:
    steps = 0  # bytes read by the forward automata

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        trees = [parse(r.pattern, r.fold) for r in rules]
        self.rules = rules
        self.marks = Automaton([relaxed(t) for t in trees], backwards=True, restart=True)
        # a tail may be empty, so it moves ends, never starts
        self.ends = [Automaton([parse(r.pattern + r.tail, r.fold)], backwards=False, restart=False) for r in rules]

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """(position, rules as bits) of every byte where a match begins, from the last to the first."""
        flat, limit, state, found = self.marks.flat, self.marks.first_accept, self.marks.start, []
        at = len(data)
        for b in reversed(data):
            at -= 1
            state = flat[state + b]
            if state >= limit:
                found.append((at, self.marks.accept[state >> 8]))
        return found

    def longest(self, rule: int, data: bytes, start: int, known: dict[int, int]) -> int:
        """End of the longest match at ``start``, or ``start`` itself.

        ``known`` remembers, every 16 bytes, the states in which earlier runs of this rule passed a position, and
        how they ended. Runs that meet in a state go on alike, so no stretch is read more than once per state.
        """
        auto = self.ends[rule]
        flat, limit, dead, state, end, at, passed = auto.flat, auto.first_accept, auto.dead, auto.start, start, start, []
        while at < len(data):
            for b in data[at : (at | 15) + 1]:
                state = flat[state + b]
                at += 1
                if state >= limit:
                    end = at
                elif state == dead:
                    break
            else:
                here = at << 24 | state >> 8
                if here in known:
                    end = known[here] or end
                    break
                passed.append(here)
                continue
            break
        self.steps += at - start
        for here in passed:
            known[here] = end if end > here >> 24 else 0
        return end

    def keeps(self, rule: Rule, match: bytes) -> bool:
        if not rule.value_at_least:
            return True
        cut = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
        value = match[cut:].lstrip(b" ")
        return len(value[value[:1] in (b'"', b"'") :]) >= rule.value_at_least

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in code points, by start, then rule."""
        data = text.encode("utf-8", "surrogatepass")
        last, found = [0] * len(self.rules), []
        known: list[dict[int, int]] = [{} for _ in self.rules]
        for at, bits in reversed(self.starts(data)):
            for k in range(len(self.rules)):
                if bits >> k & 1 and at >= last[k] and (end := self.longest(k, data, at, known[k])) > at:
                    last[k] = end
                    if self.keeps(self.rules[k], data[at:end]):
                        found.append((at, k, end))
        if found and len(data) != len(text):
            lead = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
            before = np.concatenate([[0], np.cumsum(lead)])
            found = [(int(before[a]), k, int(before[b])) for a, k, b in found]
        return sorted(found)


def listing(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns and ``found``: array of (kind, start, end)."""
    shared = broadcast_value(df.sparkSession, Scanner(rules))
    kept = df.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != "_text")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = shared.value
        rows = [
            [{"kind": scanner.rules[k].kind, "start": a, "end": b} for a, k, b in scanner.spans(t)] for t in texts_in(batch, "_text")
        ]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(rows, kind)], [*keep, "found"])

    return map_batches(kept, use, f"{fields}, found array<struct<kind:string,start:bigint,`end`:bigint>>")


def digest(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Counts of the base kinds, sha256 of the base listing and the listing of all spans."""
    base = [r.kind for r in RULES if r.base]
    found = scan(df, text, keep)

    def joined(col):
        return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        *keep,
        *map(count, base),
        F.sha2(joined(F.filter("found", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every span of any kind replaced by ``mark``; overlapping spans become one."""
    shared = broadcast_value(df.sparkSession, Scanner(rules))

    def use(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in batch.column(text).to_pylist():
            parts, at = [], 0
            for a, _, b in shared.value.spans(t or ""):
                if a >= at:
                    parts += [t[at:a], mark]
                at = max(at, b)
            out.append("".join([*parts, t[at:]]) if parts else t)
        place = batch.schema.get_field_index(text)
        return batch.set_column(place, text, pa.array(out, pa.string()))

    return map_batches(df, use, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))
