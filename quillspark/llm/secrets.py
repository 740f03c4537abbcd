"""Secret scans by one combined deterministic automaton.

A rule is a prefix pattern and a run: ``prefix run+`` where the run (one byte class) must be so
long. The prefixes are parsed into one position automaton; subset construction over all rules
together gives a deterministic automaton that starts no new match of a rule inside an open one
(leftmost, non-overlapping, greedy) and is then minimised by partition refinement. It counts the
run of a rule without prefix up to its least length, as such runs are everywhere; a run behind a
prefix is rare, and its length is checked where it ends (counting all runs inside the automaton
multiplies to half a million states). Bytes that no rule tells apart share a class. The scan is
one pass over a text's bytes through one transition array, whatever the number of rules; only
states inside a counted run leave the inner loop.

A narrow map: no shuffle, memory bounded by one block of texts.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import blocks, documents, retext


class Rule(NamedTuple):
    """``kind`` names the spans; ``run`` holds the run's bytes; ``whole`` counts the prefix into ``least``."""

    kind: str
    prefix: str
    run: str
    least: int
    fold: bool = False
    whole: bool = False


ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
UPPER_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

#: The base rules, in the order of the kinds.
BASE = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", ALNUM + "+/_.=-", 12, fold=True),
    Rule("access", "AKIA", UPPER_DIGITS, 18, whole=True),
    Rule("hex", "", "0123456789abcdef", 16),
)
#: Further public token formats; their spans join the base ones.
MORE = (
    Rule("forge", "gh[pousr]_", ALNUM, 40, whole=True),
    Rule("slack", "xox[abprs]-", ALNUM + "-", 20, whole=True),
    Rule("stripe", "sk_live_", ALNUM, 24, whole=True),
    Rule("google", "AIza", ALNUM + "_-", 39, whole=True),
    Rule("pem", "-----BEGIN ([A-Z]+ )*PRIVATE KEY----", "-", 1),
)
RULES = BASE + MORE


# --- prefix patterns to a position automaton -------------------------------------------------


class _Nfa:
    """Thompson automaton of one prefix: byte edges and empty edges between numbered states."""

    def __init__(self, pattern: str, fold: bool):
        self.text, self.at, self.fold = pattern, 0, fold
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []
        self.start, self.end = self._choice()
        if self.at != len(pattern):
            raise ValueError(f"cannot read {pattern!r} at {self.at}")

    def _state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def _choice(self):
        start, end = self._state(), self._state()
        while True:
            a, b = self._sequence()
            self.empty[start].append(a)
            self.empty[b].append(end)
            if self.at < len(self.text) and self.text[self.at] == "|":
                self.at += 1
                continue
            return start, end

    def _sequence(self):
        start = end = self._state()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            a, b = self._atom()
            sign = self.text[self.at] if self.at < len(self.text) else ""
            if sign and sign in "?*+":
                self.at += 1
                first, last = self._state(), self._state()
                self.empty[first].append(a)
                self.empty[b].append(last)
                if sign in "?*":
                    self.empty[first].append(last)
                if sign in "*+":
                    self.empty[b].append(a)
                a, b = first, last
            self.empty[end].append(a)
            end = b
        return start, end

    def _atom(self):
        char = self.text[self.at]
        if char == "(":
            self.at += 1
            inner = self._choice()
            self.at += 1
            return inner
        if char == "[":
            close = self.text.index("]", self.at + 1)
            body, chars, i = self.text[self.at + 1 : close], set(), 0
            while i < len(body):
                if i + 2 < len(body) and body[i + 1] == "-":
                    chars |= {chr(c) for c in range(ord(body[i]), ord(body[i + 2]) + 1)}
                    i += 3
                else:
                    chars.add(body[i])
                    i += 1
            self.at = close + 1
        else:
            chars = {char}
            self.at += 1
        if self.fold:
            chars |= {c.upper() for c in chars} | {c.lower() for c in chars}
        a, b = self._state(), self._state()
        self.edges[a].append((frozenset(ord(c) for c in chars), b))
        return a, b

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


class _Scanner:
    """One rule's deterministic steps. A state is a set of prefix states, or the run's length so far."""

    def __init__(self, rule: Rule):
        self.rule = rule
        self.nfa = _Nfa(rule.prefix, rule.fold)
        self.first = self.nfa.closure([self.nfa.start])
        self.run = frozenset(ord(c) for c in rule.run)
        self.least = 1 if rule.prefix else rule.least

    def step(self, state, byte: int):
        if isinstance(state, int):
            if byte in self.run:
                return min(state + 1, self.least)
            state = self.first
        if self.nfa.end in state and byte in self.run:
            return 1
        moved = [t for s in state for chars, t in self.nfa.edges[s] if byte in chars]
        return self.nfa.closure(moved) | self.first


class Automaton(NamedTuple):
    """``moves[state + class]`` is the next state; states are multiples of ``width``. Those from ``hot``
    on are inside some rule's run, and ``full[state // width]`` names those rules."""

    classes: bytes
    width: int
    moves: list[int]
    hot: int
    full: list[tuple[int, ...]]
    least: tuple[int, ...]


@lru_cache
def compiled(rules: tuple[Rule, ...] = RULES) -> Automaton:
    scanners = [_Scanner(rule) for rule in rules]
    # Bytes that no prefix and no run tells apart.
    sets = [s.run for s in scanners] + [chars for s in scanners for edges in s.nfa.edges for chars, _ in edges]
    kinds: dict[tuple, int] = {}
    classes = bytearray(256)
    sample: list[int] = []
    for byte in range(256):
        signature = tuple(byte in x for x in sets)
        if signature not in kinds:
            kinds[signature] = len(kinds)
            sample.append(byte)
        classes[byte] = kinds[signature]
    # Subset construction over all rules together.
    first = tuple(s.first for s in scanners)
    number = {first: 0}
    todo, table = [first], []
    cache: dict = {}
    for state in todo:
        row = []
        for byte in sample:
            parts = []
            for k, part in enumerate(state):
                at = (k, part, byte)
                if at not in cache:
                    cache[at] = scanners[k].step(part, byte)
                parts.append(cache[at])
            nxt = tuple(parts)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            row.append(number[nxt])
        table.append(row)
    full = [tuple(k for k, part in enumerate(state) if isinstance(part, int) and part >= scanners[k].least) for state in todo]
    # Minimisation: refine by the full rules, then by the classes of the successors.
    names: dict = {}
    block = [names.setdefault(x, len(names)) for x in full]
    while True:
        names = {}
        finer = [names.setdefault((block[i], *(block[j] for j in row)), len(names)) for i, row in enumerate(table)]
        done = len(names) == len(set(block))
        block = finer
        if done:
            break
    count = max(block) + 1
    one = [0] * count
    for i, b in enumerate(block):
        one[b] = i
    # Number plain states first, so that one comparison tells hot ones; the start state is 0.
    order = sorted(range(count), key=lambda b: (bool(full[one[b]]), b != block[0], b))
    new = {b: i for i, b in enumerate(order)}
    width = len(sample)
    moves = [new[block[j]] * width for b in order for j in table[one[b]]]
    hot = sum(not full[one[b]] for b in order) * width
    return Automaton(bytes(classes), width, moves, hot, [full[one[b]] for b in order], tuple(s.least for s in scanners))


# --- scanning ---------------------------------------------------------------------------------


@lru_cache
def _backward(rule: Rule):
    """The prefix reversed as steps, for the start of a match from the place of its run."""
    nfa = _Nfa(rule.prefix, rule.fold)
    back: list[list[tuple[frozenset, int]]] = [[] for _ in nfa.edges]
    empty: list[list[int]] = [[] for _ in nfa.edges]
    for s, edges in enumerate(nfa.edges):
        for chars, t in edges:
            back[t].append((chars, s))
        for t in nfa.empty[s]:
            empty[t].append(s)

    def closure(states):
        seen, todo = set(states), list(states)
        while todo:
            for nxt in empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen

    return back, closure, nfa.start, nfa.end


def _match_start(raw: bytes, run: int, rule: Rule, after: int) -> int:
    """Leftmost start from ``after`` on of a prefix that ends where the run starts."""
    if not rule.prefix:
        return run
    back, closure, start, end = _backward(rule)
    states, found, at = closure([end]), run, run
    while states and at >= after:
        if start in states:
            found = at
        if at == 0:
            break
        at -= 1
        byte = raw[at]
        states = closure([t for s in states for chars, t in back[s] if byte in chars])
    return found


def scan(raw: bytes, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """Spans ``(start, rule, end)`` in bytes, by start and then rule."""
    machine = compiled(rules)
    moves, width, hot, full = machine.moves, machine.width, machine.hot, machine.full
    spans: list[tuple[int, int, int]] = []
    opened: dict[int, tuple[int, int]] = {}  # rule: start of the match, start of its run
    ended = [0] * len(rules)

    def close(k: int, end: int) -> None:
        start, run = opened.pop(k)
        ended[k] = end
        if end - (start if rules[k].whole else run) >= rules[k].least:
            spans.append((start, k, end))

    state = 0
    for at, kind in enumerate(raw.translate(machine.classes)):
        state = moves[state + kind]
        if state >= hot or opened:
            now = full[state // width]
            for k in [k for k in opened if k not in now]:
                close(k, at)
            for k in now:
                if k not in opened:
                    run = at + 1 - machine.least[k]
                    opened[k] = (_match_start(raw, run, rules[k], ended[k]), run)
    for k in list(opened):
        close(k, len(raw))
    return sorted(spans)


def text_spans(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """As ``scan``, in code points."""
    if not text:
        return []
    raw = text.encode()
    found = scan(raw, rules)
    if not found or len(raw) == len(text):
        return found
    points = {0: 0}
    before = total = 0
    for edge in sorted({x for a, _, b in found for x in (a, b)}):
        total += len(raw[before:edge].decode())
        points[edge] = total
        before = edge
    return [(points[a], k, points[b]) for a, k, b in found]


def _named(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def _scan_rows(batches):
    base = len(BASE)
    for batch in blocks(batches):
        found = [text_spans(x) for x in batch.column("text").to_pylist()]
        counts = [pa.array([sum(k == n for _, k, _ in x) for x in found], pa.int64()) for n in range(base)]
        digests = [hashlib.sha256(_named([y for y in x if y[1] < base], RULES).encode()).hexdigest() for x in found]
        names = [_named(x, RULES) for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(digests), pa.array(names)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)`` with counts of the base kinds and all spans.

    Null and empty texts have no spans. Repeated rows give repeated rows. Extra columns are ignored;
    an empty table gives an empty result. Spans are ``kind:start:end`` in code points, by start and
    then in the order of the rules.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(_scan_rows, schema)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))


def masked(text: str | None, rules: tuple[Rule, ...] = RULES) -> str | None:
    """``text`` with every span replaced by ``[KIND]``; overlapping spans become one, named by the first."""
    spans = text_spans(text, rules)
    if not spans:
        return text
    out, done = [], 0
    open_start, open_kind, open_end = spans[0]
    for start, kind, end in [*spans[1:], (len(text) + 1, 0, 0)]:
        if start < open_end:
            open_end = max(open_end, end)
            continue
        out += [text[done:open_start], f"[{rules[open_kind].kind.upper()}]"]
        done, (open_start, open_kind, open_end) = open_end, (start, kind, end)
    return "".join(out) + text[done:]


def _mask_rows(batches):
    for batch in blocks(batches):
        yield retext(batch, [masked(x) for x in batch.column("text").to_pylist()])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by its kind in brackets; ``n_chars`` follows. No row goes."""
    return docs.mapInArrow(_mask_rows, docs.schema)
