"""Secret scanning with one combined deterministic automaton.

Every rule's regex becomes an automaton for its leftmost, non-overlapping matches. Their product
is built by subset construction over byte classes, minimised, and stored as one flat transition
array. A text's bytes are read once, whatever the number of rules; a negative entry in the array
marks the bytes at which some rule's match has just ended. Where the match began is found by
running the reversed rule back from its end, which happens only for real matches.
"""

from __future__ import annotations

import hashlib
import re._constants as sre
import re._parser as sre_parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import limit_batches

_ALL = (1 << 256) - 1
#: Bytes walked between looks for an ended match.
_STRETCH = 2048


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a bytes regex, and the shortest capture (or match) that counts."""

    kind: str
    pattern: bytes
    min_group: int = 0  # least length of the part after the last assignment sign and quote
    ignore_case: bool = False


#: The rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule("assign", rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, True),
    Rule("access", rb"AKIA[A-Z0-9]{16,}"),
    Rule("hex", rb"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("pem", rb"-----BEGIN [A-Z ]{0,16}PRIVATE KEY-----"),
)
#: How an assignment's value is set off from its keyword (used once per match, for its length).
_VALUE_CHARS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


class _Nfa:
    """States with byte-mask moves and empty moves, from a parsed regex."""

    def __init__(self, rule: Rule, backwards: bool):
        self.moves: list[list[tuple[int, int]]] = []
        self.empty: list[list[int]] = []
        self.fold, self.backwards = rule.ignore_case, backwards
        self.start, self.accept = self._new(), self._new()
        self._items(list(sre_parser.parse(rule.pattern)), self.start, self.accept)
        self._closed: dict[int, frozenset[int]] = {}

    def _new(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def _items(self, items, a: int, b: int) -> None:
        for item in reversed(items) if self.backwards else items:
            nxt = self._new()
            self._one(item, a, nxt)
            a = nxt
        self.empty[a].append(b)

    def _one(self, item, a: int, b: int) -> None:
        op, arg = item
        if op in (sre.LITERAL, sre.IN, sre.NOT_LITERAL, sre.ANY):
            self.moves[a].append((self._mask(op, arg), b))
        elif op is sre.SUBPATTERN:
            self._items(list(arg[3]), a, b)
        elif op is sre.BRANCH:
            for branch in arg[1]:
                self._items(list(branch), a, b)
        elif op is sre.MAX_REPEAT:
            least, most, body = arg
            for _ in range(least):
                nxt = self._new()
                self._items(list(body), a, nxt)
                a = nxt
            if most is sre.MAXREPEAT:
                loop = self._new()
                self.empty[a].append(loop)
                self._items(list(body), loop, loop)
                a = loop
            else:
                for _ in range(most - least):
                    self.empty[a].append(b)
                    nxt = self._new()
                    self._items(list(body), a, nxt)
                    a = nxt
            self.empty[a].append(b)
        else:
            raise ValueError(f"a rule uses what the automaton cannot express: {op}")

    def _mask(self, op, arg) -> int:
        if op is sre.ANY:
            return _ALL & ~(1 << 10)
        if op is sre.LITERAL:
            mask = 1 << arg
        elif op is sre.NOT_LITERAL:
            return _ALL & ~(1 << arg)
        else:
            mask, negated = 0, False
            for kind, value in arg:
                if kind is sre.NEGATE:
                    negated = True
                elif kind is sre.LITERAL:
                    mask |= 1 << value
                elif kind is sre.RANGE:
                    mask |= sum(1 << c for c in range(value[0], value[1] + 1))
                else:
                    raise ValueError(f"a rule uses what the automaton cannot express: {kind}")
            mask = _ALL & ~mask if negated else mask
        if self.fold:
            for c in range(65, 91):
                if mask >> c & 1 or mask >> (c + 32) & 1:
                    mask |= 1 << c | 1 << (c + 32)
        return mask

    def closure(self, states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    def move(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({b for s in states for mask, b in self.moves[s] if mask >> byte & 1})


class _Leftmost:
    """One rule's automaton: attempts in order of their start; ended() when a match is complete."""

    def __init__(self, rule: Rule):
        self.nfa = _Nfa(rule, False)
        self.first = self.nfa.closure({self.nfa.start})
        self.known: dict[tuple, tuple] = {}
        self.kind = rule.kind
        self._compare()

    def _compare(self) -> None:
        """Which attempts make a later one needless: they outlive it and match no later.

        The greatest relation on attempts in which the older moves wherever the younger does.
        """
        masks = {m for state in self.nfa.moves for m, _ in state}
        sample = list({tuple(m >> b & 1 for m in masks): b for b in range(256)}.values())
        todo, to = [self.first], {}
        for one in todo:
            to[one] = [self.nfa.move(one, b) for b in sample]
            todo += [x for x in dict.fromkeys(to[one]) if x and x not in todo]
        done = lambda x: self.nfa.accept in x
        self.covers = {(a, b) for a in todo for b in todo if done(a) or not done(b)}
        while bad := {(a, b) for a, b in self.covers if any(y and (not x or (x, y) not in self.covers) for x, y in zip(to[a], to[b], strict=True))}:
            self.covers -= bad

    initial: tuple = (False, ())

    def step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        """The next state, and whether a match ended just before this byte."""
        if (state, byte) not in self.known:
            self.known[state, byte] = self._step(state, byte)
        return self.known[state, byte]

    def _step(self, state: tuple, byte: int) -> tuple[tuple, bool]:
        accepted, attempts = state
        ended = False
        if accepted:
            went = self.nfa.move(attempts[0], byte)
            if went:
                if self.nfa.accept not in went:
                    raise ValueError(f"rule {self.kind}: a complete match may be left for an incomplete one")
                return (True, (went,)), False
            attempts, ended = (), True
        out: list[frozenset[int]] = []
        for one in [*attempts, self.first]:
            left = self.nfa.move(one, byte)
            if left and not any((older, left) in self.covers for older in out):
                if self.nfa.accept in left:
                    if out:
                        raise ValueError(f"rule {self.kind}: a later start may match before an earlier one")
                    return (True, (left,)), ended
                out.append(left)
        return (False, tuple(out)), ended


class Automaton:
    """The combined automaton; scan() gives (kind number, start, end) in bytes."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        parts = [_Leftmost(r) for r in rules]
        masks = {m for p in parts for state in p.nfa.moves for m, _ in state}
        kinds: dict[tuple, int] = {}
        classes = bytes(kinds.setdefault(tuple(m >> b & 1 for m in masks), len(kinds)) for b in range(256))
        sample = [classes.index(k) for k in range(len(kinds))]
        index = {tuple(p.initial for p in parts): 0}
        todo, to, out = [next(iter(index))], [], []
        for state in todo:
            row, events = [], []
            for byte in sample:
                went = [p.step(s, byte) for p, s in zip(parts, state, strict=True)]
                target = tuple(x for x, _ in went)
                if target not in index:
                    index[target] = len(todo)
                    todo.append(target)
                row.append(index[target])
                events.append(sum(1 << k for k, (_, e) in enumerate(went) if e))
            to.append(row)
            out.append(events)
        at_end = np.array([sum(1 << k for k, s in enumerate(state) if s[0]) for state in todo])
        self.full_states = len(todo)
        self.classes = classes
        self._minimise(np.array(to), np.array(out), at_end)
        self._reverse = [_Nfa(r, True) for r in rules]

    def _minimise(self, to: np.ndarray, out: np.ndarray, at_end: np.ndarray) -> None:
        """Partition refinement on outputs, then on the blocks that each class leads to."""
        block = np.unique(np.column_stack([out, at_end]), axis=0, return_inverse=True)[1].reshape(-1)
        while True:
            finer = np.unique(np.column_stack([block, block[to]]), axis=0, return_inverse=True)[1].reshape(-1)
            if finer.max() == block.max():
                break
            block = finer
        n, width = int(block.max()) + 1, to.shape[1]
        first = np.array([np.flatnonzero(block == k)[0] for k in range(n)])
        table, events = block[to[first]] * width, out[first]
        marked = np.argwhere(events)
        self.events = [(0, 0)]
        flat = table.copy()
        for s, c in marked:
            flat[s, c] = -len(self.events)
            self.events.append((int(events[s, c]), int(table[s, c])))
        self.states, self.width, self.start = n, width, int(block[0]) * width
        self.table = flat.reshape(-1).astype(np.int32)
        self.at_end = at_end[first].astype(np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_row_list", "_flat")}

    def _begin(self, k: int, data: bytes, end: int, least: int) -> int:
        """Where the match of rule k that ends at end begins, not before least."""
        nfa = self._reverse[k]
        states, at, found = nfa.closure({nfa.start}), end, end
        while at > least and states:
            at -= 1
            states = nfa.move(states, data[at])
            if nfa.accept in states:
                found = at
        return found

    def _rows(self) -> list[list]:
        """The table as rows that hold the next rows; an entry that ends a match leads to a trap.

        A row's last item is its place in the table. The trap leads to itself, so a stretch of
        bytes is walked without a test at each byte and looked into only if it ended there.
        """
        rows: list[list] = [[] for _ in range(self.states)]
        trap: list = []
        trap.extend([trap] * self.width + [-1])
        flat = self.table.tolist()
        for k, row in enumerate(rows):
            at = k * self.width
            row.extend([rows[x // self.width] if x >= 0 else trap for x in flat[at : at + self.width]])
            row.append(at)
        self._flat = flat
        return rows

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        if not hasattr(self, "_row_list"):
            self._row_list = self._rows()
        row, width = self._row_list[self.start // self.width], self.width
        ends: list[tuple[int, int]] = []
        coded = data.translate(self.classes)
        for at in range(0, len(coded), _STRETCH):
            before = row
            stretch = coded[at : at + _STRETCH]
            for c in stretch:
                row = row[c]
            if row[-1] < 0:
                s = before[-1]
                for i, c in enumerate(stretch, at):
                    s = self._flat[s + c]
                    if s < 0:
                        bits, s = self.events[-s]
                        ends.append((i, bits))
                row = self._row_list[s // width]
        if bits := int(self.at_end[row[-1] // width]):
            ends.append((len(data), bits))
        found, last = [], [0] * len(self.rules)
        for end, bits in ends:
            for k, rule in enumerate(self.rules):
                if bits >> k & 1:
                    start = self._begin(k, data, end, last[k])
                    last[k] = end
                    if not rule.min_group or _value_length(data, start, end) >= rule.min_group:
                        found.append((k, start, end))
        return found


def _value_length(data: bytes, start: int, end: int) -> int:
    """Length of an assignment's value: what follows the sign, spaces and an optional quote."""
    at = start
    while data[at] not in b":=":
        at += 1
    at += 1
    while data[at] == 32:
        at += 1
    if data[at] in b"\"'":
        at += 1
    return end - at


def compile_rules(rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> Automaton:
    return Automaton(tuple(rules))


def find_spans(automaton: Automaton, text: str | None) -> list[tuple[int, int, int]]:
    """(rule number, start, end) in code points, by start and then by rule."""
    data = (text or "").encode("utf-8", "replace")
    found = automaton.scan(data)
    if found and len(data) != len(text):
        at = lambda b: len(data[:b].decode("utf-8"))
        found = [(k, at(a), at(b)) for k, a, b in found]
    return sorted(found, key=lambda x: (x[1], x[0]))


def scan_secrets(docs: DataFrame, automaton: Automaton | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All spans of every whole text: (doc_id, spans array<struct<kind,start,end>>).

    One row per input row, also for null and empty texts (no spans) and repeated rows. Positions
    are code points, the end exclusive. No shuffle; a task holds one batch of rows.
    """
    automaton = automaton or compile_rules()
    limit_batches(docs.sparkSession)
    kinds = [r.kind for r in automaton.rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[{"kind": kinds[k], "start": a, "end": b} for k, a, b in find_spans(automaton, t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind_type)], names=["doc_id", "spans"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def secret_report(docs: DataFrame, automaton: Automaton | None = None) -> DataFrame:
    """Counts per base kind, a digest of the base spans and all spans as text, per document."""
    base = [r.kind for r in BASE_RULES]
    shown = lambda col: F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs, automaton).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(shown(F.filter("spans", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, automaton: Automaton | None = None, mark: str = "[secret]") -> DataFrame:
    """doc_id and the whole text with every found span replaced by a mark (null stays null)."""
    automaton = automaton or compile_rules()
    limit_batches(docs.sparkSession)

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, at = [], 0
        for _, a, b in find_spans(automaton, text):
            if b > at:
                out += [text[at : max(a, at)], mark] if a >= at else []
                at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([clean(t) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, text string")


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
