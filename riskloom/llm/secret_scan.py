"""Secret scans with one deterministic automaton for all rules.

The rules are put together as one nondeterministic automaton, made deterministic by subset
construction, minimised by splitting classes of states until none differs, and laid out as one
transition array. Texts are then read once, byte by byte, for all rules together: numpy advances
thousands of stretches of text a step. A stretch ends at a *reset*, a pair of bytes after which the
automaton is in its start state whatever came before, so stretches are independent of each other.

In the few stretches where a rule is accepted, automata built alike give the bounds: one of the
rules read backwards marks, in one pass from the right, every byte at which a match of a rule
starts; from the leftmost mark the rule's own automaton, which is tied to the start, goes on to the
last byte that it accepts, and the next match is looked for after that. Matches that are too short
are dropped then. No pattern library takes part. Rules must be such that the longest match from a
start is the greedy one, as it is for all here.

A null text is empty and has no spans; a very long one is read like any other, in time linear in its
length. Spans that start together come in the order of the rules. Repeated rows get a row each, an
empty table gives none. Other columns are carried along unless they have the name of a result.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import chunks

ALNUM = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


@dataclass(frozen=True)
class Rule:
    """parts: ("word", literals in either case), ("exact", literal), ("repeat", times, bytes) for so many or more,
    or ("one" | "maybe" | "some" | "any", bytes).

    least: bytes a match must have; with `tail`, counted from the first byte of its last part.
    """

    kind: str
    parts: tuple
    least: int
    tail: bool = False


#: Fixed rules. The first three are the base ones; order decides between spans that start together.
RULES = (
    Rule(
        "assign",
        (
            ("word", (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")),
            ("maybe", b"\"'"), ("any", b" "), ("one", b":="), ("any", b" "), ("maybe", b"\"'"), ("some", ALNUM + b"+/_.=-"),
        ),
        8,
        tail=True,
    ),
    Rule("access", (("exact", b"AKIA"), ("some", ALNUM[:26] + ALNUM[52:])), 16),
    Rule("hex", (("repeat", 32, b"0123456789abcdef"),), 32),
    Rule("github", (("exact", b"gh"), ("one", b"pousr"), ("exact", b"_"), ("some", ALNUM)), 40),
    Rule("jwt", (("exact", b"eyJ"), ("some", ALNUM + b"_-"), ("one", b"."), ("some", ALNUM + b"_-")), 24),
    Rule("pem", (("exact", b"-----BEGIN "), ("any", ALNUM[:26] + b" "), ("exact", b"PRIVATE KEY-----")), 1),
)
BASE_KINDS = ("assign", "access", "hex")
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@dataclass
class Automaton:
    """step[state * classes + byte_class[byte]] is the next state times classes."""

    byte_class: np.ndarray
    step: np.ndarray
    accepts: np.ndarray  # by state: a bit for each rule
    resets: np.ndarray  # by two byte classes: whether they always lead to the start state, 0
    classes: int


def nondeterministic(rules) -> tuple[list[tuple[int, frozenset, int, int]], dict[int, int], int]:
    """Edges (from, bytes, to, rule) from start state 0, into which none leads; rule by final state; count of states."""
    edges: list[tuple[int, frozenset, int, int]] = []
    finals: dict[int, int] = {}
    count = 1

    def chain(froms: set[int], sets, rule: int) -> set[int]:
        nonlocal count
        for s in sets:
            edges.extend((f, frozenset(s), count, rule) for f in froms)
            froms, count = {count}, count + 1
        return froms

    for r, rule in enumerate(rules):
        at = {0}
        for what, *arg in rule.parts:
            if what == "word":
                at = set().union(*(chain(at, [bytes([c]).lower() + bytes([c]).upper() for c in w], r) for w in arg[0]))
            elif what == "exact":
                at = chain(at, [bytes([c]) for c in arg[0]], r)
            elif what == "repeat":
                at = chain(at, [arg[1]] * arg[0], r)
                edges.extend((f, frozenset(arg[1]), f, r) for f in at)
            else:
                after = chain(at, [arg[0]], r)
                if what in ("some", "any"):
                    edges.extend((f, frozenset(arg[0]), f, r) for f in after)
                at = after | at if what in ("maybe", "any") else after
        finals |= dict.fromkeys(at, r)
    return edges, finals, count


ANY_BYTE = frozenset(range(256))


def compiled(rules=RULES) -> Automaton:
    """Reads forwards; accepts a rule where a match of it ends, wherever that began."""
    edges, finals, _ = nondeterministic(rules)
    return deterministic([(0, ANY_BYTE, 0), *((u, s, v) for u, s, v, _ in edges)], finals)


def compiled_backwards(rules=RULES) -> Automaton:
    """Reads backwards; accepts a rule where a match of it starts, wherever that ends."""
    edges, finals, count = nondeterministic(rules)
    turned = [(0, ANY_BYTE, 0)]
    for u, s, v, r in edges:
        to = u or count + r
        turned += [(v, s, to), (0, s, to)] if v in finals else [(v, s, to)]
    return deterministic(turned, {count + r: r for r in range(len(rules))})


def compiled_tied(rule: Rule) -> Automaton:
    """Reads one rule from a start on; accepts where it may end."""
    edges, finals, _ = nondeterministic([rule])
    return deterministic([(u, s, v) for u, s, v, _ in edges], finals)


def deterministic(edges: list[tuple[int, frozenset, int]], finals: dict[int, int]) -> Automaton:
    """Subset construction and minimisation, from start state 0."""
    out: dict[int, list[tuple[frozenset, int]]] = {}
    for u, s, v in edges:
        out.setdefault(u, []).append((s, v))
    # bytes that no edge tells apart are one class
    signs: dict[tuple, int] = {}
    every = sorted({s for _, s, _ in edges}, key=sorted)
    byte_class = np.array([signs.setdefault(tuple(b in s for s in every), len(signs)) for b in range(256)], np.uint8)
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(signs))]
    by_byte = {u: [frozenset(to for s, to in own if b in s) for b in sample] for u, own in out.items()}
    # subset construction
    names, todo, rows = {frozenset([0]): 0}, [frozenset([0])], []
    while todo:
        state = todo.pop(0)
        row = []
        for c in range(len(sample)):
            to = frozenset().union(*(by_byte[s][c] for s in state if s in by_byte))
            if to not in names:
                names[to] = len(names)
                todo.append(to)
            row.append(names[to])
        rows.append(row)
    step = np.array(rows)
    accepts = np.array([sum({1 << finals[s] for s in state if s in finals}) for state in names])
    # minimisation: states are alike while they accept alike and lead to alike states
    alike, count = np.unique(accepts, return_inverse=True)[1], 0
    while len(np.unique(alike)) > count:
        count = len(np.unique(alike))
        alike = np.unique(np.column_stack([alike, alike[step]]), axis=0, return_inverse=True)[1].ravel()
    order = np.full(count, -1)
    for s in range(len(step)):  # classes in order of first state, so that the start stays 0
        if order[alike[s]] < 0:
            order[alike[s]] = order.max() + 1
    alike = order[alike]
    first = np.array([np.flatnonzero(alike == c)[0] for c in range(count)])
    step, accepts = alike[step[first]], accepts[first]
    resets = np.stack([np.all(step[step[:, c]] == 0, axis=0) for c in range(len(sample))])
    return Automaton(byte_class, (step * len(sample)).astype(np.int32).ravel(), accepts.astype(np.int32), resets, len(sample))


def stretches(a: Automaton, classes: np.ndarray, offs: np.ndarray, least: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches that cover the text: cut at text ends, and at resets about every `least` bytes."""
    data = classes
    at = np.flatnonzero(a.resets[data[:-1], data[1:]]) + 2
    at = at[np.flatnonzero(np.diff(at // least, prepend=-1))]
    cuts = np.unique(np.concatenate([at, offs, [0, len(data)]]))
    return cuts[:-1], cuts[1:]


def flagged(a: Automaton, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each stretch, the rules (bits) that the automaton accepts in it."""
    order = np.argsort(start - end, kind="stable")  # longest first, so that those still going are a prefix
    begin, size = start[order], (end - start)[order]
    met = np.zeros(len(begin), np.int32)
    state = np.zeros(len(begin), np.int32)
    alive = len(begin)
    accepts = np.repeat(a.accepts, a.classes)
    for t in range(int(size[0]) if alive else 0):
        while alive and size[alive - 1] <= t:
            alive -= 1
        s = a.step[state[:alive] + classes[begin[:alive] + t]]
        state[:alive] = s
        met[:alive] |= accepts[s]
    out = np.zeros(len(begin), np.int32)
    out[order] = met
    return out


def begun(a: Automaton, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, place, rules as bits) by stretch and place: where matches start, from one pass backwards over all stretches."""
    order = np.argsort(start - end, kind="stable")
    last, size = end[order] - 1, (end - start)[order]
    state = np.zeros(len(last), np.int32)
    accepts = np.repeat(a.accepts, a.classes)
    alive = len(last)
    held = [(np.zeros(0, np.int64),) * 3]
    for t in range(int(size[0]) if alive else 0):
        while alive and size[alive - 1] <= t:
            alive -= 1
        at = last[:alive] - t
        s = a.step[state[:alive] + a.byte_class[data[at]]]
        state[:alive] = s
        hit = np.flatnonzero(accepts[s])
        if len(hit):
            held.append((order[hit], at[hit], accepts[s[hit]]))
    which, place, met = (np.concatenate(x) for x in zip(*held, strict=True))
    by = np.lexsort((place, which))
    return which[by], place[by], met[by]


class Reach:
    """One rule's own automaton, laid out for stepping byte by byte."""

    def __init__(self, rule: Rule):
        a = compiled_tied(rule)
        self.rule, self.byte_class = rule, a.byte_class.tobytes()
        self.step, self.accepts = a.step.tolist(), np.repeat(a.accepts, a.classes).tolist()
        stuck = (a.step.reshape(-1, a.classes) == np.arange(len(a.accepts))[:, None] * a.classes).all(axis=1) & (a.accepts == 0)
        self.dead = int(np.flatnonzero(stuck)[0]) * a.classes

    def matches(self, piece: bytes, starts: list[int]) -> Iterator[tuple[int, int]]:
        """Leftmost matches that don't overlap, those that are too short dropped."""
        classes, done = piece.translate(self.byte_class), 0
        for s in starts:
            if s < done:
                continue
            state, first = 0, None
            for p in range(s, len(classes)):
                state = self.step[state + classes[p]]
                if state == self.dead:
                    break
                if self.accepts[state]:
                    first, done = p if first is None else first, p + 1
            if done - (first if self.rule.tail else s) >= self.rule.least:
                yield s, done


@dataclass
class Scanner:
    """All automata of a set of rules."""

    rules: tuple
    ends: Automaton
    starts: Automaton
    reach: list[Reach]


def scanner(rules=RULES) -> Scanner:
    return Scanner(tuple(rules), compiled(rules), compiled_backwards(rules), [Reach(r) for r in rules])


def scan(a: Scanner, texts: pa.Array) -> Iterator[list[list[tuple[str, int, int]]]]:
    """For each run of texts, the spans (kind, start, end) of each text, by start, then rule."""
    for _, data, offs in chunks(texts):
        spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offs) - 1)]
        classes = a.ends.byte_class[data]
        start, end = stretches(a.ends, classes, offs)
        some = np.flatnonzero(flagged(a.ends, classes, start, end))
        start, end = start[some], end[some]
        owner = np.searchsorted(offs, start, "right") - 1
        which, place, met = begun(a.starts, data, start, end)
        heads = np.searchsorted(which, np.arange(len(some) + 1))
        for i, d in enumerate(owner):
            piece, base = data[start[i] : end[i]].tobytes(), int(start[i] - offs[d])
            own, bits = place[heads[i] : heads[i + 1]] - start[i], met[heads[i] : heads[i + 1]]
            for r, reach in enumerate(a.reach):
                at = own[(bits >> r & 1) > 0].tolist()
                spans[d] += [(base + s, r, base + e) for s, e in reach.matches(piece, at)]
        out = []
        for d, own in enumerate(spans):
            if own:
                code = np.concatenate([[0], np.cumsum((data[offs[d] : offs[d + 1]] & 0xC0) != 0x80)])
                own = [(a.rules[r].kind, int(code[s]), int(code[e])) for s, r, e in sorted(own)]
            out.append(own)
        yield out


def automaton(spark: SparkSession):
    """The compiled rules, broadcast: a few thousand states, whatever the data."""
    return spark.sparkContext.broadcast(scanner())


def secret_spans(docs: DataFrame, others: list[str] | None = None) -> DataFrame:
    """docs' columns `others` (default: all but text), and secrets: array of kind, start, end."""
    shared = automaton(docs.sparkSession)
    keep = [c for c in (docs.columns if others is None else others) if c not in ("text", "secrets")]
    schema = T.StructType([docs.schema[c] for c in keep]).add("secrets", T.ArrayType(SPAN))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in d] for part in scan(shared.value, b.column("text")) for d in part]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(rows, kind)], [*keep, "secrets"])

    return docs.select(*keep, "text").mapInArrow(run, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every secret in text replaced by [kind]; of spans that overlap, the first names the whole."""
    shared = automaton(docs.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column("text")
            found = [d for part in scan(shared.value, texts) for d in part]
            if any(found):
                new = texts.to_pylist()
                for i, own in enumerate(found):
                    if not own:
                        continue
                    text, out, at = new[i], [], 0
                    for k, s, e in own:
                        if s >= at:
                            out += [text[at:s], f"[{k}]"]
                        at = max(at, e)
                    new[i] = "".join(out) + text[at:]
                b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, texts.type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans, from secret_spans()."""
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("secrets")).alias("spans"))
