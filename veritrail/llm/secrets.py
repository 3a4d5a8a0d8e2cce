"""Secret scans: one minimal automaton over all rules, one pass over the bytes of a text.

Rule regexes (ASCII literals, classes, groups, alternation, bounded or unbounded repeats) become one NFA. Subset
construction with a restart at every byte and Moore minimisation turn it into a transition array over byte classes; the
scan runs it once per text and stops only at bytes where some rule ends. There the start is found by the rule's reversed
automaton and the longest end by its anchored one. Matches of one rule do not overlap; the match that can end first
comes first and takes its leftmost start. Every rule here has matches of one parse, so that is the leftmost one.

A null text counts as empty, and an empty text has no spans. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.llm.shared import in_small_batches


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, and how many characters the last group (or all of it) needs for a match to count."""

    kind: str
    regex: str
    least: int = 1


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
#: The first three are the base rules; the counted repeat keeps the many short runs of hex letters from ever ending a match.
BASE_RULES = (
    Rule("assign", rf"""(?:{_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE_RULES,
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("vcs", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 39),
)


class _Nfa:
    """Thompson automaton; edges carry a bit mask of bytes."""

    def __init__(self):
        self.edges: list[list[tuple[int, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, tree, start: int) -> int:
        """Append a parsed regex behind start; the state where it ends."""
        for op, arg in tree:
            start = self._node(op, arg, start)
        return start

    def _node(self, op, arg, start: int) -> int:
        if op in (sre.LITERAL, sre.IN):
            end = self.state()
            self.edges[start].append((_mask(op, arg), end))
            return end
        if op is sre.SUBPATTERN:
            return self.add(arg[-1], start)
        if op is sre.BRANCH:
            end = self.state()
            for tree in arg[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(tree, first)].append(end)
            return end
        if op is sre.MAX_REPEAT:
            low, high, tree = arg
            for _ in range(low):
                start = self.add(tree, start)
            if high is sre.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.empty[start] += [loop, end]
                self.empty[self.add(tree, loop)] += [loop, end]
                return end
            ends = [start]
            for _ in range(high - low):
                ends.append(self.add(tree, ends[-1]))
            end = self.state()
            for s in ends:
                self.empty[s].append(end)
            return end
        raise ValueError(f"rules may not use {op}")

    def reversed(self) -> _Nfa:
        back = _Nfa()
        for _ in self.edges:
            back.state()
        for s, out in enumerate(self.edges):
            for mask, t in out:
                back.edges[t].append((mask, s))
            for t in self.empty[s]:
                back.empty[t].append(s)
        return back

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _mask(op, arg) -> int:
    if op is sre.LITERAL:
        if arg > 127:
            raise ValueError("rules are ASCII only")
        return 1 << arg
    mask = 0
    for kind, x in arg:
        if kind is sre.LITERAL:
            mask |= _mask(kind, x)
        elif kind is sre.RANGE and x[1] < 128:
            mask |= sum(1 << b for b in range(x[0], x[1] + 1))
        else:
            raise ValueError(f"rules may not use {kind} in a class")
    return mask


def _byte_classes(nfa: _Nfa) -> tuple[bytes, list[int]]:
    """Class of each byte, and one byte of each class."""
    masks = sorted({m for out in nfa.edges for m, _ in out})
    of = {}
    classes = bytes(of.setdefault(tuple(m >> b & 1 for m in masks), len(of)) for b in range(256))
    return classes, [classes.index(c) for c in range(len(of))]


def _determinise(nfa: _Nfa, starts: list[int], ends: list[int], samples: list[int], restart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction: transitions[state, class] and, per state, the bit set of ends[] reached. State 0 is the start."""
    first = nfa.closure(starts)
    ids, order, rows = {first: 0}, [first], []
    steps = [[nfa.closure([t for m, t in out if m >> b & 1]) for b in samples] for out in nfa.edges]
    for states in order:  # grows
        row = []
        for c in range(len(samples)):
            to = frozenset().union(*(steps[s][c] for s in states), first if restart else ())
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    return np.array(rows), np.array([sum(1 << k for k, e in enumerate(ends) if e in states) for states in order])


def _minimise(moves: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's partition refinement; then the start is state 0 and accepting states come last."""
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[moves]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    one = np.zeros(block.max() + 1, int)
    one[block] = np.arange(len(block))
    order = sorted(range(len(one)), key=lambda k: (accepts[one[k]] != 0, k != block[0]))
    place = np.argsort(order)
    return place[block[moves[one[order]]]], accepts[one[order]]


class Automaton:
    """All rules, compiled. Its size depends on the rules alone."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.kinds = [r.kind for r in rules]
        self.least = [r.least for r in rules]
        self.regexes = [r.regex for r in rules]
        nfa, starts, ends = _Nfa(), [], []
        for r in rules:
            starts.append(nfa.state())
            ends.append(nfa.add(sre_parser.parse(r.regex), starts[-1]))
        self.classes, samples = _byte_classes(nfa)
        self.width = len(samples)
        flat = lambda moves: (moves * self.width).reshape(-1).tolist()
        moves, accepts = _minimise(*_determinise(nfa, starts, ends, samples, True))
        if accepts[0]:
            raise ValueError("a rule matches the empty text")
        self.states = len(accepts)
        self.moves, self.accepts = flat(moves), accepts.tolist()
        self.accepting = int((accepts == 0).sum()) * self.width
        back, self.own, self.forward, self.backward = nfa.reversed(), [], [], []
        for s, e in zip(starts, ends, strict=True):
            for to, graph, a, b, restart in ((self.own, nfa, s, e, True), (self.forward, nfa, s, e, False), (self.backward, back, e, s, False)):
                m, x = _minimise(*_determinise(graph, [a], [b], samples, restart))
                to.append((flat(m), x.tolist()))

    def ends(self, codes: bytes) -> list[tuple[int, int]]:
        """(end, rules that end there) in one pass."""
        moves, width, accepting, state, found = self.moves, self.width, self.accepting, 0, []
        for i, c in enumerate(codes):
            state = moves[state + c]
            if state >= accepting:
                found.append((i + 1, self.accepts[state // width]))
        return found

    def _last_accept(self, automaton, codes) -> int:
        """Codes read when the anchored automaton accepted last; -1 if never."""
        moves, accepts = automaton
        state, best = 0, -1
        seen = set()
        for i, c in enumerate(codes):
            state = moves[state + c]
            if accepts[state // self.width]:
                best = i + 1
            elif state not in seen:
                if all(moves[state + k] == state for k in range(self.width)):  # dead
                    break
                seen.add(state)
        return best

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind as listed; byte offsets."""
        codes = data.translate(self.classes)
        taken = [0] * len(self.kinds)  # where the last match of each rule ended
        fresh: list[tuple[int, int] | None] = [None] * len(self.kinds)
        out = []
        for end, rules in self.ends(codes):
            for r in range(len(self.kinds)):
                if not rules >> r & 1 or end <= taken[r]:
                    continue
                if fresh[r]:  # after a match the search starts anew at its end; each byte is read once more at most
                    at, state = fresh[r]
                    moves, accepts = self.own[r]
                    while at < end and not accepts[state // self.width]:
                        state = moves[state + codes[at]]
                        at += 1
                    fresh[r] = (at, state)
                    if not accepts[state // self.width]:
                        continue
                start = end - self._last_accept(self.backward[r], _back(codes, taken[r], end))
                stop = start + self._last_accept(self.forward[r], memoryview(codes)[start:])
                taken[r] = stop
                fresh[r] = (stop, 0)
                whole = re.fullmatch(self.regexes[r], data[start:stop].decode())
                if len(whole[whole.re.groups]) >= self.least[r]:
                    out.append((start, r, stop))
        return [(self.kinds[r], start, stop) for start, r, stop in sorted(out)]

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points."""
        data = (text or "").encode()
        found = self.spans(data)
        if not found or len(data) == len(text):
            return found
        at = {0: 0}
        last = 0
        for offset in sorted({x for _, s, e in found for x in (s, e)}):
            at[offset] = at[last] + len(data[last:offset].decode())
            last = offset
        return [(k, at[s], at[e]) for k, s, e in found]


def _back(codes: bytes, low: int, end: int) -> Iterator[int]:
    return (codes[i] for i in range(end - 1, low - 1, -1))


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<kind, start, end>> of a text column."""
    compiled = Automaton(rules)

    @F.arrow_udf(SPAN)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in compiled.scan(t.as_py())] for t in texts], _SPAN_ARROW)

    return scan(text)


def scan_secrets(docs: DataFrame, text: str = "text", out: str = "secret_spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with one more column of spans; a column of that name is replaced, all others and all rows stay."""
    return in_small_batches(docs).withColumn(out, secret_spans(F.col(text), rules))


def redact_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mask: str = "[secret]") -> DataFrame:
    """docs with every span of a text replaced by the mask, overlapping spans by one; texts without spans stay as they are."""
    compiled = Automaton(rules)

    @F.arrow_udf(T.StringType())
    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([masked(t.as_py(), compiled, mask) for t in texts], pa.string())

    return in_small_batches(docs).withColumn(text, redact(F.col(text)))


def masked(text: str | None, compiled: Automaton, mask: str) -> str | None:
    parts, last = [], 0
    for _, start, end in compiled.scan(text):
        if start >= last:
            parts += [text[last:start], mask]
        last = max(last, end)
    return "".join([*parts, text[last:]]) if parts else text


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
