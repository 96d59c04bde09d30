"""Secret scans by one deterministic automaton for all rules.

The rules' regular expressions become one nondeterministic automaton that may start at every byte;
subset construction and minimisation turn it into transition arrays over byte classes. A text is
scanned once, byte by byte. When a rule accepts, its match goes on as long as it still accepts; then
the automaton drops that rule's other threads, as matches of a rule don't overlap, and a small reversed
automaton of the rule finds the leftmost start. Rules are such that of two overlapping matches the
one that starts first also accepts first.

Null texts count as empty; spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from functools import cache
from itertools import count
from operator import length_hint

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean


@dataclass(frozen=True)
class Rule:
    """A match counts if ``group`` has ``least`` characters; one that fails still uses up its text."""

    kind: str
    regex: str
    least: int = 0
    group: int = 0
    any_case: bool = False


# The base rules and their order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("pem", r"-----BEGIN\x20([A-Z]+\x20)*PRIVATE\x20KEY-----"),
)


class _Parser:
    """Regular expressions of literals, classes, groups, ``|``, ``? * +`` and ``{m}``, ``{m,}``, ``{m,n}``."""

    def __init__(self, regex: str, any_case: bool):
        self.text, self.at, self.any_case = regex, 0, any_case

    def parse(self):
        tree = self.either()
        if self.at < len(self.text):
            raise ValueError(f"unreadable at {self.at}: {self.text}")
        return tree

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self):
        options = [self.chain()]
        while self.peek() == "|":
            self.take()
            options.append(self.chain())
        return options[0] if len(options) == 1 else ("or", options)

    def chain(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            one = self.atom()
            while self.peek() in ("?", "*", "+", "{") and self.peek():
                one = self.repeat(one)
            parts.append(one)
        return ("seq", parts)

    def repeat(self, one):
        c = self.take()
        if c == "?":
            return ("or", [one, ("seq", [])])
        if c == "*":
            return ("star", one)
        if c == "+":
            return ("seq", [one, ("star", one)])
        body = self.text[self.at : self.text.index("}", self.at)]
        self.at += len(body) + 1
        low, comma, high = body.partition(",")
        rest = [("star", one)] if comma and not high else [("or", [one, ("seq", [])])] * (int(high or low) - int(low))
        return ("seq", [one] * int(low) + rest)

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def cased(self, found: set[int]):
        if self.any_case:
            found |= {ord(x) for b in found if chr(b).isalpha() for x in (chr(b).lower(), chr(b).upper())}
        return ("set", frozenset(found))

    def atom(self):
        c = self.take()
        if c == "(":
            tree = self.either()
            self.take()
            return tree
        if c == "[":
            found: set[int] = set()
            while (c := self.take()) != "]":
                low = self.escaped() if c == "\\" else ord(c)
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.take()
                    c = self.take()
                    found |= set(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
                else:
                    found.add(low)
            return self.cased(found)
        return self.cased({self.escaped() if c == "\\" else ord(c)})


def _turned(tree):
    kind, body = tree
    if kind == "seq":
        return (kind, [_turned(x) for x in reversed(body)])
    if kind == "or":
        return (kind, [_turned(x) for x in body])
    return (kind, _turned(body)) if kind == "star" else tree


class _Nfa:
    def __init__(self):
        self.free: list[list[int]] = []  # steps that need no byte
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.step.append(None)
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        kind, body = tree
        if kind == "set":
            end = self.state()
            self.step[start] = (body, end)
            return end
        if kind == "seq":
            for x in body:
                inner = self.state()
                self.free[start].append(inner)
                start = self.add(x, inner)
            return start
        end = self.state()
        for x in body if kind == "or" else [body]:
            inner = self.state()
            self.free[start].append(inner)
            last = self.add(x, inner)
            self.free[last].append(start if kind == "star" else end)
        if kind == "star":
            self.free[start].append(end)
        return end

    def closed(self, states) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Automaton:
    """Minimal transition arrays of several rules.

    ``to[s][c]``: the state after a byte of class c; ``accepts[s]``: the rules that accept there;
    ``dropped[s][r]``: the state that is left of s when rule r starts afresh. State 0 is the first.
    """

    def __init__(self, trees: list, anywhere: bool):
        nfa = _Nfa()
        starts = [nfa.state() for _ in trees]
        ends = [nfa.add(tree, s) for tree, s in zip(trees, starts, strict=True)]
        bounds = [*starts[1:], len(nfa.free)] if len(trees) == 1 else None
        owner = self._owners(nfa, starts, bounds)
        sets = {x[0] for x in nfa.step if x}
        marks = [tuple(b in s for s in sets) for b in range(256)]
        numbers = {m: k for k, m in enumerate(dict.fromkeys(marks))}
        self.class_of = bytes(numbers[m] for m in marks)
        byte_of = {numbers[m]: b for b, m in enumerate(marks)}
        first = nfa.closed(starts)
        ids, todo, raw_to, raw_drop = {first: 0}, deque([first]), [], []

        def named(found: frozenset[int]) -> int:
            if found not in ids:
                ids[found] = len(ids)
                todo.append(found)
            return ids[found]

        while todo:
            own = todo.popleft()
            steps = [nfa.step[x] for x in own if nfa.step[x]]
            row = []
            for c in range(len(numbers)):
                b = byte_of[c]
                hit = {end for allowed, end in steps if b in allowed}
                row.append(named(nfa.closed(hit | set(starts)) if anywhere else nfa.closed(hit)))
            raw_to.append(row)
            raw_drop.append({r: named(frozenset(x for x in own if owner[x] != r) | first) for r in range(len(trees)) if anywhere and ends[r] in own})
        accepts = [frozenset(r for r, e in enumerate(ends) if e in own) for own in ids]
        part = self._minimised(raw_to, raw_drop, accepts)
        keep: dict[int, int] = {}
        for s, p in enumerate(part):
            keep.setdefault(p, s)
        self.to = [[part[t] for t in raw_to[s]] for s in keep.values()]
        self.dropped = [{r: part[t] for r, t in raw_drop[s].items()} for s in keep.values()]
        self.accepts = [accepts[s] for s in keep.values()]
        self.dead = next((s for s, row in enumerate(self.to) if set(row) == {s} and not self.accepts[s]), -1)

    @staticmethod
    def _owners(nfa: _Nfa, starts: list[int], bounds) -> list[int]:
        owner = [0] * len(nfa.free)
        for r, s in enumerate(starts):
            todo = [s]
            seen = {s}
            while todo:
                x = todo.pop()
                owner[x] = r
                for y in [*nfa.free[x], *([nfa.step[x][1]] if nfa.step[x] else [])]:
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        return owner

    @staticmethod
    def _minimised(to, drop, accepts) -> list[int]:
        """Numbers of equivalence classes; state 0 gets 0."""
        part = [0] * len(to)
        key: list = [(a, tuple(sorted(d))) for a, d in zip(accepts, drop, strict=True)]
        while True:
            numbers: dict = {}
            new = [numbers.setdefault(k, len(numbers)) for k in key]
            if len(numbers) == len(set(part)) and new == part:
                return part
            part = new
            key = [(part[s], tuple(part[t] for t in to[s]), tuple(sorted((r, part[t]) for r, t in drop[s].items()))) for s in range(len(to))]


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [_Parser(r.regex, r.any_case).parse() for r in rules]
        self.all = Automaton(trees, True)
        self.back = [Automaton([_turned(t)], False) for t in trees]
        self.whole = [re.compile(r.regex.encode(), re.IGNORECASE * r.any_case) for r in rules]
        # A state as the list of the states that follow; an accepting one is empty, so that it stops the loop.
        self.rows: list[list] = [[] for _ in self.all.to]
        for s, row in enumerate(self.rows):
            if not self.all.accepts[s]:
                row.extend(self.rows[t] for t in self.all.to[s])
        self.stops = {id(row): s for s, row in enumerate(self.rows) if self.all.accepts[s]}

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all matches that count, in bytes."""
        out: list[tuple[int, int, int]] = []
        last = [0] * len(self.rules)
        classes = data.translate(self.all.class_of)
        n, at, state = len(classes), 0, 0
        while at < n:
            row, left = self.rows[state], iter(classes)
            left.__setstate__(at)
            try:
                for c in left:
                    row = row[c]
                state, at = self.stops.get(id(row), -1), n
                if state < 0:
                    break
            except IndexError:
                state, at = self.stops[id(row)], n - length_hint(left) - 1
            state, at = self._follow(data, classes, state, at, last, out)
        return sorted(out)

    def _follow(self, data, classes, state, at, last, out) -> tuple[int, int]:
        """From an accepting state before byte ``at`` to one where no rule accepts."""
        to, accepts = self.all.to, self.all.accepts
        n = len(classes)
        while accepts[state]:
            after = to[state][classes[at]] if at < n else -1
            over = [r for r in accepts[state] if after < 0 or r not in accepts[after]]
            for r in over:
                self._found(data, r, at, last, out)
            if after < 0:
                return state, at
            for r in over:
                state = self.all.dropped[state].get(r, state)
            state, at = to[state][classes[at]], at + 1
        return state, at

    def _found(self, data, r, end, last, out) -> None:
        back, s, start = self.back[r], 0, -1
        for k in range(end - 1, last[r] - 1, -1):
            s = back.to[s][back.class_of[data[k]]]
            if back.accepts[s]:
                start = k
            elif s == back.dead:
                break
        if start < 0:
            return
        last[r] = end
        rule = self.rules[r]
        group = self.whole[r].fullmatch(data, start, end).group(rule.group) if rule.least else b""
        if len(group) >= rule.least:
            out.append((start, r, end))


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def spans_of(data: bytes, rules: tuple[Rule, ...]) -> list[tuple[int, int, int]]:
    """(start, rule, end) in code points."""
    found = scanner(rules).matches(data)
    if found and not data.isascii():
        places = sorted({x for s, _, e in found for x in (s, e)})
        chars, before, done = {}, 0, 0
        for p in places:
            done += len(data[before:p].decode())
            chars[p], before = done, p
        found = [(chars[s], r, chars[e]) for s, r, e in found]
    return found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Rows (doc_id, found array<struct<kind, start, end>>), by start, then by the rules' order."""
    kinds = [r.kind for r in rules]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def search(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = [[{"kind": kinds[r], "start": s, "end": e} for s, r, e in spans_of(t, rules)] if t else [] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        lean(search), "doc_id long, found array<struct<kind:string, start:long, end:long>>"
    )


def digests(scanned: DataFrame) -> DataFrame:
    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("found", lambda x: x["kind"].isin(kinds))

    def of(kind):
        return F.filter("found", lambda x: x["kind"] == kind)

    def said(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    return scanned.select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("found")).alias("spans"),
    )
