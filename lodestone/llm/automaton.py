"""A deterministic automaton for many regular expressions: subset construction, minimisation, transition arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEAD = 0


class _Nfa:
    """Byte-level automaton with empty moves, built from one expression at a time."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def closure(self, states) -> frozenset[int]:
        seen = set(states)
        todo = list(seen)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


_SETS = {"d": "0123456789", "w": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_", "s": " \t\n\r\x0b\x0c"}
_CONTROLS = {"n": "\n", "t": "\t", "r": "\r"}


class _Parser:
    """Literals, classes, groups, alternation and the quantifiers ``? * + {m} {m,} {m,n}`` over single bytes.

    Counts above ``most`` become ``{most,}``: what then matches is a superset.
    """

    def __init__(self, nfa: _Nfa, pattern: str, any_case: bool, most: int | None = None) -> None:
        self.nfa, self.text, self.at, self.any_case, self.most = nfa, pattern, 0, any_case, most

    def peek(self) -> str:
        return self.text[self.at:self.at + 1]

    def take(self) -> str:
        if self.at >= len(self.text):
            raise ValueError(f"pattern ends too early: {self.text}")
        self.at += 1
        return self.text[self.at - 1]

    def cased(self, members: set[int]) -> frozenset[int]:
        if self.any_case:
            members = members | {ord(f(chr(b))) for b in members if b < 128 and chr(b).isalpha() for f in (str.lower, str.upper)}
        return frozenset(members)

    def escape(self) -> set[int]:
        c = self.take()
        if c == "x":
            return {int(self.take() + self.take(), 16)}
        return {ord(m) for m in _SETS.get(c, _CONTROLS.get(c, c))}

    def char_class(self) -> set[int]:
        negated = self.peek() == "^"
        if negated:
            self.take()
        members: set[int] = set()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.take()
            low = self.escape() if c == "\\" else {ord(c)}
            if self.peek() == "-" and self.text[self.at + 1:self.at + 2] != "]" and len(low) == 1:
                self.take()
                c = self.take()
                high = self.escape() if c == "\\" else {ord(c)}
                low = set(range(min(low), max(high) + 1))
            members |= low
        self.take()
        return set(range(256)) - members if negated else members

    def alternatives(self) -> tuple[int, int]:
        start, end = self.nfa.state(), self.nfa.state()
        while True:
            s, e = self.sequence()
            self.nfa.empty[start].append(s)
            self.nfa.empty[e].append(end)
            if self.peek() != "|":
                return start, end
            self.take()

    def sequence(self) -> tuple[int, int]:
        start = end = self.nfa.state()
        while self.peek() not in ("", "|", ")"):
            s, e = self.repeated()
            self.nfa.empty[end].append(s)
            end = e
        return start, end

    def atom(self) -> tuple[int, int]:
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            found = self.alternatives()
            if self.take() != ")":
                raise ValueError(f"group not closed: {self.text}")
            return found
        if c in "*+?{)^$":
            raise ValueError(f"{c!r} is not supported here: {self.text}")
        members = self.char_class() if c == "[" else self.escape() if c == "\\" else set(range(256)) - {10} if c == "." else {ord(c)}
        if max(members) > 255:
            raise ValueError(f"only single bytes are supported: {self.text}")
        start, end = self.nfa.state(), self.nfa.state()
        self.nfa.moves[start].append((self.cased(members), end))
        return start, end

    def repeated(self) -> tuple[int, int]:
        begin = self.at
        start, end = self.atom()
        while self.peek() in ("?", "*", "+", "{") and self.peek():
            c = self.take()
            if c == "{":
                body = self.text[self.at:self.text.index("}", self.at)]
                self.at += len(body) + 1
                low, _, high = body.partition(",")
                least, most = int(low), int(low) if "," not in body else int(high) if high else None
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            if self.most is not None and max(least, most or 0) > self.most:
                least, most = min(least, self.most), None
            after = self.at
            pieces = []
            for _ in range(max(least, most or 0, 1) if most is not None else max(least, 1)):
                self.at = begin
                pieces.append(self.atom())
            self.at = after
            if self.peek() in ("?", "*", "+", "{") and self.peek():
                raise ValueError(f"quantifiers cannot be stacked: {self.text}")
            start, end = self.nfa.state(), self.nfa.state()
            here = start
            for i, (s, e) in enumerate(pieces):
                if i >= least:
                    self.nfa.empty[here].append(end)
                self.nfa.empty[here].append(s)
                here = e
            self.nfa.empty[here].append(end)
            if most is None:
                self.nfa.empty[pieces[-1][1]].append(pieces[-1][0])
        return start, end


@dataclass(frozen=True)
class Expression:
    """``pattern`` over bytes; ``never_after`` holds bytes that cannot stand before a match.

    A run of one class, such as ``[0-9a-f]+``, names its class there: its leftmost match never starts inside the run.
    """
    pattern: str
    any_case: bool = False
    never_after: str = ""


@dataclass(frozen=True)
class Automaton:
    """``step[state, byte]``; state 0 is dead.  ``accepts`` and ``reaches`` are bit sets of expressions.

    ``opening[previous byte]`` is the state before the first byte of a possible match.
    """
    step: np.ndarray
    accepts: np.ndarray
    reaches: np.ndarray
    opening: np.ndarray


def _minimise(step: np.ndarray, accepts: np.ndarray) -> np.ndarray:
    """Class number of each state: split by what is accepted, then by the classes reached, until stable."""
    _, classes = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([classes, classes[step]]), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == classes.max():
            return finer
        classes = finer


def _renumbered(step: np.ndarray, accepts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The smallest automaton with the same answers, and the new number of each state; state 0 stays."""
    classes = _minimise(step, accepts)
    order = np.where(classes == classes[0], 0, np.where(classes < classes[0], classes + 1, classes))
    n = int(order.max()) + 1
    small, final = np.zeros((n, step.shape[1]), np.int64), np.zeros(n, np.int64)
    small[order], final[order] = order[step], accepts
    return small, final, order


def compile_expressions(expressions: list[Expression]) -> Automaton:
    """One automaton that follows all expressions at once from a common start."""
    if len(expressions) > 62:
        raise ValueError("more than 62 expressions do not fit one bit set")
    nfa, starts, ends = _Nfa(), [], {}
    for number, e in enumerate(expressions):
        parser = _Parser(nfa, e.pattern, e.any_case)
        start, end = parser.alternatives()
        if parser.at != len(e.pattern):
            raise ValueError(f"unexpected {parser.peek()!r}: {e.pattern}")
        starts.append(start)
        ends[end] = number

    numbers: dict[frozenset[int], int] = {frozenset(): DEAD}
    todo: list[frozenset[int]] = []

    def number_of(states: frozenset[int]) -> int:
        if states not in numbers:
            numbers[states] = len(numbers)
            todo.append(states)
        return numbers[states]

    blocked = [frozenset(e.never_after.encode()) for e in expressions]
    opening = np.array([number_of(nfa.closure(s for s, no in zip(starts, blocked, strict=True) if b not in no)) for b in range(256)], np.int64)
    rows: dict[int, np.ndarray] = {DEAD: np.zeros(256, np.int64)}
    accepts: dict[int, int] = {DEAD: 0}
    while todo:
        states = todo.pop()
        targets: list[set[int]] = [set() for _ in range(256)]
        for s in states:
            for members, to in nfa.moves[s]:
                for b in members:
                    targets[b].add(to)
        cache: dict[frozenset[int], int] = {}
        row = np.zeros(256, np.int64)
        for b, t in enumerate(targets):
            if t:
                key = frozenset(t)
                if key not in cache:
                    cache[key] = number_of(nfa.closure(key))
                row[b] = cache[key]
        rows[numbers[states]] = row
        accepts[numbers[states]] = sum(1 << ends[s] for s in states if s in ends)
    step = np.stack([rows[i] for i in range(len(numbers))])
    taken = np.array([accepts[i] for i in range(len(numbers))], np.int64)
    small, final, order = _renumbered(step, taken)
    reaches = final.copy()
    while True:
        wider = reaches | np.bitwise_or.reduce(reaches[small], axis=1)
        if (wider == reaches).all():
            return Automaton(small.astype(np.int32), final, reaches, order[opening].astype(np.int32))
        reaches = wider


@dataclass(frozen=True)
class StartAutomaton:
    """Reads bytes from right to left and never dies: ``accepts[state]`` has the expressions with a match that starts here.

    ``kind[byte]`` is a column of ``step``; the last column stands for the border of a text and leads to state 0.
    """
    kind: np.ndarray
    step: np.ndarray
    accepts: np.ndarray

    @property
    def border(self) -> int:
        return self.step.shape[1] - 1


def compile_starts(expressions: list[Expression], most: int) -> StartAutomaton:
    """One automaton for the reversed expressions, each of which may begin at any byte; counts above ``most`` are cut to it.

    Cut counts keep the subsets few; a reported start then is a necessary condition for a match.
    """
    nfa, starts, ends = _Nfa(), {}, []
    for number, e in enumerate(expressions):
        start, end = _Parser(nfa, e.pattern, e.any_case, most).alternatives()
        starts[start] = number
        ends.append(end)
    back = _Nfa()
    for _ in nfa.empty:
        back.state()
    for s, (empty, moves) in enumerate(zip(nfa.empty, nfa.moves, strict=True)):
        for to in empty:
            back.empty[to].append(s)
        for members, to in moves:
            back.moves[to].append((members, s))

    # bytes that all moves treat alike share a column
    sets = sorted({members for moves in nfa.moves for members, _ in moves}, key=sorted)
    columns: dict[tuple[bool, ...], int] = {}
    kind = np.array([columns.setdefault(tuple(b in m for m in sets), len(columns)) for b in range(256)], np.uint8)
    example = [int(np.flatnonzero(kind == c)[0]) for c in range(len(columns))]

    fresh = back.closure(ends)
    numbers, todo, rows, accepts = {fresh: 0}, [fresh], {}, {}
    while todo:
        states = todo.pop()
        row = [0] * (len(columns) + 1)
        for c, b in enumerate(example):
            after = fresh | back.closure({to for s in states for members, to in back.moves[s] if b in members})
            if after not in numbers:
                numbers[after] = len(numbers)
                todo.append(after)
            row[c] = numbers[after]
        rows[numbers[states]] = row
        accepts[numbers[states]] = sum(1 << starts[s] for s in states if s in starts)
    small, final, _ = _renumbered(np.array([rows[i] for i in range(len(numbers))]), np.array([accepts[i] for i in range(len(numbers))], np.int64))
    return StartAutomaton(kind, small.astype(np.int32), final)
