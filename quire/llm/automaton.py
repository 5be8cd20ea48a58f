"""Regular expressions over bytes as minimal deterministic automata.

A pattern becomes a nondeterministic automaton, several are put side by side, subset construction makes one deterministic
automaton of them, and partition refinement makes that minimal.  What is left is arrays: a class for each byte, the next
state for each state and class, and for each state a bit for every pattern that a match of which may end there.

Patterns have literals, ``\\`` escapes (``\\xHH`` too), classes with ranges and ``^``, groups, ``|``, ``?``, ``*``, ``+`` and ``{n}``, ``{n,}``.
A match is the longest one at the leftmost start.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

Tree = tuple


class Pattern:
    """A pattern as a tree of ("set", bytes), ("then", trees), ("either", trees) and ("many", tree, least, unbounded)."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0
        self.tree = self.either()
        if self.at != len(text):
            raise ValueError(f"cannot read {text!r} from {self.at} on")

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def either(self) -> Tree:
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("either", options)

    def sequence(self) -> Tree:
        out = []
        while self.peek() and self.peek() not in "|)":
            out.append(self.repeated(self.single()))
        return ("then", out)

    def repeated(self, tree: Tree) -> Tree:
        while (sign := self.peek()) and sign in "?*+{":
            self.take()
            if sign == "?":
                tree = ("either", [tree, ("then", [])])
            elif sign == "{":
                stop = self.text.index("}", self.at)
                least, comma, _ = self.text[self.at : stop].partition(",")
                tree, self.at = ("many", tree, int(least), bool(comma)), stop + 1
            else:
                tree = ("many", tree, int(sign == "+"), True)
        return tree

    def single(self) -> Tree:
        c = self.take()
        if c == "(":
            tree = self.either()
            self.take()
            return tree
        if c == "[":
            return ("set", self.chosen())
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return ("set", frozenset([self.escaped() if c == "\\" else ord(c)]))

    def escaped(self) -> int:
        c = self.take()
        if c != "x":
            return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))
        self.at += 2
        return int(self.text[self.at - 2 : self.at], 16)

    def chosen(self) -> frozenset[int]:
        out, without = set(), self.peek() == "^"
        if without:
            self.take()
        while self.peek() != "]":
            low = high = self.escaped() if (c := self.take()) == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.escaped() if (c := self.take()) == "\\" else ord(c)
            out.update(range(low, high + 1))
        self.take()
        return frozenset(range(256)) - out if without else frozenset(out)


def either_case(tree: Tree) -> Tree:
    """The tree with each ASCII letter in both cases."""
    kind, inner, *rest = tree
    if kind == "set":
        return (kind, inner | {b ^ 32 for b in inner if 65 <= b & ~32 <= 90})
    return (kind, either_case(inner) if kind == "many" else [either_case(t) for t in inner], *rest)


def backwards(tree: Tree) -> Tree:
    """A tree of the same matches, read from their end."""
    kind, inner, *rest = tree
    if kind == "set":
        return tree
    return (kind, backwards(inner), *rest) if kind == "many" else (kind, [backwards(t) for t in (inner[::-1] if kind == "then" else inner)])


def shortest(tree: Tree) -> int:
    """Bytes of the shortest match."""
    kind, inner, *rest = tree
    if kind == "set":
        return 1
    if kind == "many":
        return rest[0] * shortest(inner)
    return (sum if kind == "then" else min)(shortest(t) for t in inner) if inner else 0


@dataclass
class Steps:
    """A nondeterministic automaton: for each state the states it is at once, too, and the bytes that lead to another."""

    free: list[list[int]] = field(default_factory=list)
    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, tree: Tree, start: int) -> int:
        """The state in which a match of the tree from ``start`` on ends."""
        kind, inner, *rest = tree
        if kind == "set":
            stop = self.state()
            self.moves[start].append((inner, stop))
            return stop
        if kind == "then":
            for t in inner:
                start = self.add(t, start)
            return start
        if kind == "either":
            stop = self.state()
            for t in inner:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(t, begin)].append(stop)
            return stop
        least, unbounded = rest
        for _ in range(least):
            start = self.add(inner, start)
        if unbounded:
            loop, stop = self.state(), self.state()
            self.free[start].append(loop)
            self.free[loop].append(stop)
            self.free[self.add(inner, loop)].append(loop)
            return stop
        return start

    def closed(self, states: set[int]) -> frozenset[int]:
        seen, left = set(states), list(states)
        while left:
            for s in self.free[left.pop()]:
                if s not in seen:
                    seen.add(s)
                    left.append(s)
        return frozenset(seen)


@dataclass
class Automaton:
    """classes: one of each byte; table: next states, a row a state; ends: bits of the patterns that end in a state; state 0 is the first.

    Without a prefix, a state from which no match can come is -1 in ``table``.
    """

    classes: np.ndarray
    table: np.ndarray
    ends: np.ndarray

    def ending(self, data: bytes, start: int, stop: int) -> int:
        """End of the longest match from ``start`` on, before ``stop`` or at it; -1 if there is none."""
        table, ends, state, last = self.rows, self.final, 0, start if self.final[0] else -1
        for at in range(start, stop):
            state = table[state][data[at]]
            if state < 0:
                break
            if ends[state]:
                last = at + 1
        return last

    def marks(self, data: bytes, start: int, stop: int) -> list[int]:
        """Positions, from the last to the first, before which a match of this backward automaton ends."""
        table, ends, state, out = self.rows, self.final, 0, []
        for at in range(stop - 1, start - 1, -1):
            state = table[state][data[at]]
            if ends[state]:
                out.append(at)
        return out

    def __post_init__(self) -> None:
        self.rows = self.table[:, self.classes].tolist() if len(self.table) < 500 else None
        self.final = self.ends.tolist()


def compiled(trees: list[Tree], anywhere: bool) -> Automaton:
    """The minimal automaton of all trees; ``anywhere``: a match may begin at any byte."""
    steps = Steps()
    begin = steps.state()
    bits: dict[int, int] = {}
    for k, tree in enumerate(trees):
        start = steps.state()
        steps.free[begin].append(start)
        bits[steps.add(tree, start)] = 1 << k
    sets = sorted({s for moves in steps.moves for s, _ in moves}, key=sorted)
    member = np.array([[b in s for s in sets] for b in range(256)]).reshape(256, -1)
    _, picked, classes = np.unique(member, axis=0, return_index=True, return_inverse=True)
    classes = classes.reshape(-1).astype(np.uint8)
    useful = lambda states: frozenset(s for s in steps.closed(states) if steps.moves[s] or s in bits)
    first = useful({begin})
    after = [[useful({t for allowed, t in moves if byte in allowed}) for byte in picked.tolist()] for moves in steps.moves]
    known, order, table = {first: 0}, [first], []
    for states in order:
        row = []
        for c in range(len(picked)):
            reached = frozenset().union(*(after[s][c] for s in states), first if anywhere else ())
            if not reached:
                row.append(-1)
                continue
            if reached not in known:
                known[reached] = len(order)
                order.append(reached)
            row.append(known[reached])
        table.append(row)
    ends = np.array([sum({bits[s] for s in states if s in bits}) for states in order], np.int64)
    return minimal(classes, np.array(table, np.int32), ends)


def minimal(classes: np.ndarray, table: np.ndarray, ends: np.ndarray) -> Automaton:
    """Equivalent states as one: split by what ends in them, then by the groups they lead to, until no group splits."""
    group = np.unique(ends, return_inverse=True)[1].reshape(-1)
    while True:
        after = np.where(table < 0, -1, group[table])
        _, now = np.unique(np.column_stack([group, after]), axis=0, return_inverse=True)
        if now.max() == group.max():
            break
        group = now.reshape(-1)
    _, shown = np.unique(group, return_index=True)
    rank = np.empty(len(shown), np.int32)
    rank[np.argsort(shown)] = np.arange(len(shown), dtype=np.int32)  # the first state stays the first
    shown = np.sort(shown)
    small = table[shown]
    return Automaton(classes, np.where(small < 0, -1, rank[group[small]]).astype(np.int32), ends[shown])
