"""Regular expressions as one deterministic automaton over bytes.

Subset construction over the rules' joint nondeterministic automaton, then
minimisation; the result is a flat transition array that a scan steps through
once for all rules. Expressions: literals, `\\xHH` and other escapes, classes,
groups, `|`, `?`, `*`, `+`, `{m}`, `{m,}` and `{m,n}`, over ASCII.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

MANY = -1


class Syntax:
    """A recursive reader of an expression; each method returns a tree of tuples."""

    def __init__(self, text: str, ignore_case: bool):
        self.text, self.at, self.ignore_case = text, 0, ignore_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def next(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def letter(self) -> int:
        c = self.next()
        if c == "\\":
            c = self.next()
            if c == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            return ord({"t": "\t", "n": "\n", "r": "\r"}.get(c, c))
        return ord(c)

    def cased(self, bytes_: set[int]) -> tuple:
        if self.ignore_case:
            bytes_ = bytes_ | {b ^ 0x20 for b in bytes_ if 0x41 <= b & 0xDF <= 0x5A}
        return ("set", frozenset(bytes_))

    def choice(self) -> tuple:
        parts = [self.row()]
        while self.peek() == "|":
            self.next()
            parts.append(self.row())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def row(self) -> tuple:
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("row", parts)

    def repeated(self) -> tuple:
        tree = self.single()
        while self.peek() and self.peek() in "?*+{":
            c = self.next()
            if c == "{":
                end = self.text.index("}", self.at)
                low, comma, high = self.text[self.at : end].partition(",")
                self.at = end + 1
                least, most = int(low), (int(high) if high else MANY) if comma else int(low)
            else:
                least, most = {"?": (0, 1), "*": (0, MANY), "+": (1, MANY)}[c]
            tree = ("times", tree, least, most)
        return tree

    def single(self) -> tuple:
        if self.peek() == "(":
            self.next()
            if self.text.startswith("?:", self.at):
                self.at += 2
            tree = self.choice()
            self.next()
            return tree
        if self.peek() == "[":
            self.next()
            found: set[int] = set()
            while self.peek() != "]":
                low = high = self.letter()
                if self.peek() == "-" and self.text[self.at + 1] != "]":
                    self.next()
                    high = self.letter()
                found |= set(range(low, high + 1))
            self.next()
            return self.cased(found)
        return self.cased({self.letter()})


@dataclass
class Positions:
    """A nondeterministic automaton: steps on sets of bytes and free steps."""

    steps: list[list[tuple[frozenset, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def new(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def build(self, tree: tuple, begin: int, backwards: bool) -> int:
        """Adds the tree from `begin` on; returns where it ends."""
        kind = tree[0]
        if kind == "set":
            end = self.new()
            self.steps[begin].append((tree[1], end))
            return end
        if kind == "row":
            for part in reversed(tree[1]) if backwards else tree[1]:
                begin = self.build(part, begin, backwards)
            return begin
        if kind == "or":
            end = self.new()
            for part in tree[1]:
                own = self.new()
                self.free[begin].append(own)
                self.free[self.build(part, own, backwards)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            begin = self.build(part, begin, backwards)
        if most == MANY:
            loop = self.new()
            self.free[begin].append(loop)
            self.free[self.build(part, loop, backwards)].append(loop)
            end = self.new()
            self.free[loop].append(end)
            return end
        end = self.new()
        self.free[begin].append(end)
        for _ in range(most - least):
            begin = self.build(part, begin, backwards)
            self.free[begin].append(end)
        return end


@dataclass
class Automaton:
    """A minimal deterministic automaton.

    `classes` maps a byte to its class; `moves[state * width + class]` is the
    next state times width; `accepts[state]` has a bit for each rule that ends
    there. States that accept are numbered from `floor` on (times width).
    State 0 begins; `dead` is the state that leads nowhere, if there is one.
    """

    classes: bytes
    width: int
    moves: list[int]
    accepts: list[int]
    floor: int
    dead: int


def compile_rules(rules: list[tuple[str, bool]], search: bool, backwards: bool = False) -> Automaton:
    """Rules are (expression, ignore case). search: a match may begin anywhere, else only where the scan does."""
    net = Positions()
    start = net.new()
    ends: dict[int, int] = {}
    for bit, (text, ignore_case) in enumerate(rules):
        begin = net.new()
        net.free[start].append(begin)
        ends[net.build(Syntax(text, ignore_case).choice(), begin, backwards)] = bit
    # bytes that no rule tells apart are one class
    sets = {s for steps in net.steps for s, _ in steps}
    signature = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {sig: i for i, sig in enumerate(dict.fromkeys(signature))}
    classes = bytes(kinds[sig] for sig in signature)
    samples = [signature.index(sig) for sig in kinds]

    def closed(states: set[int]) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for q in net.free[todo.pop()]:
                if q not in seen:
                    seen.add(q)
                    todo.append(q)
        return frozenset(q for q in seen if net.steps[q] or q in ends)

    first = closed({start})
    number, order, moves = {first: 0}, [first], []
    for states in order:
        row = []
        for b in samples:
            target = {q for p in states for s, q in net.steps[p] if b in s}
            target = closed(target | {start} if search else target)
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        moves.append(row)
    accepts = np.array([sum({1 << ends[q] for q in states if q in ends}) for states in order], object)

    # Moore's refinement: states stay together as long as all their moves do
    table = np.array(moves)
    block = np.unique(accepts.astype(str), return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == block.max():
            break
        block = finer
    firsts = np.unique(block, return_index=True)[1]
    ranked = sorted(firsts.tolist(), key=lambda q: (accepts[q] != 0, q))  # the start is 0: rules match no empty text
    new = {int(block[q]): i for i, q in enumerate(ranked)}
    width = len(samples)
    flat = [new[int(block[t])] * width for q in ranked for t in moves[q]]
    accept = [int(accepts[q]) for q in ranked]
    dead = next((i * width for i in range(len(ranked)) if not accept[i] and all(t == i * width for t in flat[i * width : (i + 1) * width])), -1)
    return Automaton(classes, width, flat, accept, width * sum(not a for a in accept), dead)
