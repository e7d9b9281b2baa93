"""One deterministic automaton for many rules, from their regular expressions.

The expressions are read by Python's own parser, turned into a non-deterministic automaton
over bytes, made deterministic by subset construction and minimised by partition refinement.
What is left are two arrays: the class of each byte, and the next state of each state and class.
"""

from __future__ import annotations

import re._parser as syntax
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Input class that no byte has; it leads to the start from everywhere and parts the texts of a stream.
BREAK = 256
#: More states than this are refused rather than sent to every task (16-bit states, 8 MB at 64 classes).
MOST_STATES = 1 << 16


@dataclass(frozen=True)
class Automaton:
    """``step[state * width + kind[byte]]`` is the next state times ``width``; state 0 is the start.

    ``accepts[state]`` has bit k if a match of rule k ends there. ``dead`` is the state that
    nothing leaves, or -1; an automaton that searches has none.
    """

    kind: np.ndarray
    step: np.ndarray
    width: int
    accepts: np.ndarray
    dead: int


class _Graph:
    """States of a non-deterministic automaton: edges on sets of bytes, and empty edges."""

    def __init__(self) -> None:
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def add(self, items, start: int, backwards: bool) -> int:
        """Append parsed ``items`` behind ``start``; the state after them."""
        for op, value in reversed(list(items)) if backwards else items:
            start = self._add_one(str(op), value, start, backwards)
        return start

    def _add_one(self, op: str, value, start: int, backwards: bool) -> int:
        if op == "SUBPATTERN":
            return self.add(value[3], start, backwards)
        if op == "BRANCH":
            end = self.state()
            for part in value[1]:
                head = self.state()
                self.free[start].append(head)
                self.free[self.add(part, head, backwards)].append(end)
            return end
        if op == "MAX_REPEAT":
            low, high, part = value
            for _ in range(low):
                start = self.add(part, start, backwards)
            if high is syntax.MAXREPEAT:
                head = self.state()
                self.free[start].append(head)
                self.free[self.add(part, head, backwards)].append(head)
                return head
            end = self.state()
            for _ in range(high - low):
                self.free[start].append(end)
                start = self.add(part, start, backwards)
            self.free[start].append(end)
            return end
        end = self.state()
        self.edges[start].append((_bytes(op, value), end))
        return end

    def closure(self, states) -> frozenset[int]:
        seen, queue = set(states), list(states)
        while queue:
            for s in self.free[queue.pop()]:
                if s not in seen:
                    seen.add(s)
                    queue.append(s)
        return frozenset(seen)


def _bytes(op: str, value) -> frozenset[int]:
    if op == "LITERAL":
        return frozenset([value])
    if op == "NOT_LITERAL":
        return frozenset(range(256)) - {value}
    if op == "IN":
        found: set[int] = set()
        negated = False
        for kind, part in value:
            if str(kind) == "NEGATE":
                negated = True
            else:
                found |= frozenset(range(part[0], part[1] + 1)) if str(kind) == "RANGE" else _bytes(str(kind), part)
        return frozenset(range(256)) - found if negated else frozenset(found)
    raise ValueError(f"rules may not use {op}")


def compile_rules(patterns: list[str], search: bool = True, backwards: bool = False) -> Automaton:
    """The minimal automaton of ``patterns`` (byte expressions, at most 63).

    ``search``: matches may begin anywhere, so one pass finds where those of every rule end.
    ``backwards``: for texts read from their end.
    """
    graph = _Graph()
    starts, ends = [], {}
    for k, pattern in enumerate(patterns):
        start = graph.state()
        starts.append(start)
        end = graph.add(syntax.parse(pattern.encode()), start, backwards)
        ends[end] = ends.get(end, 0) | 1 << k
    sets = {s for edges in graph.edges for s, _ in edges}
    # Bytes that no edge tells apart share a class.
    groups: dict[tuple, int] = {}
    ordered = sorted(sets, key=sorted)
    kind = np.array([groups.setdefault(tuple(b in s for s in ordered), len(groups)) for b in range(256)] + [0])
    kind[BREAK] = len(groups)
    sample = {c: int(np.flatnonzero(kind == c)[0]) for c in range(len(groups))}

    first = graph.closure(starts)
    known, rows, queue = {first: 0}, [], [first]
    for current in queue:
        row = []
        for c in range(len(groups)):
            goal = {t for s in current for on, t in graph.edges[s] if sample[c] in on}
            goal = graph.closure(goal | set(starts) if search else goal)
            if goal not in known:
                if len(known) >= MOST_STATES:
                    raise ValueError(f"the rules need more than {MOST_STATES} states")
                known[goal] = len(known)
                queue.append(goal)
            row.append(known[goal])
        rows.append([*row, 0])
    marks = np.array([sum({ends[s] for s in states if s in ends}) for states in known], np.int64)
    return _minimal(np.array(rows), marks, kind)


def _minimal(step: np.ndarray, accepts: np.ndarray, kind: np.ndarray) -> Automaton:
    """Join states that no input tells apart: refine the classes of equal marks until stable."""
    _, part = np.unique(accepts, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)
        if finer.max() == part.max():
            break
        part = finer.ravel()
    # The start's class becomes state 0.
    part = np.where(part == part[0], 0, np.where(part == 0, part[0], part))
    _, chosen = np.unique(part, return_index=True)
    width = step.shape[1]
    table = part[step[chosen]]
    loops = (table[:, :-1] == np.arange(len(chosen))[:, None]).all(axis=1) & (accepts[chosen] == 0)
    dead = np.flatnonzero(loops & (np.arange(len(chosen)) > 0))
    return Automaton(kind.astype(np.int16), (table * width).astype(np.int64).ravel(), width, accepts[chosen], int(dead[0]) if len(dead) else -1)


#: Bytes of a lane, how far before its own part a lane starts to read, and bytes taken at once.
LANE, RUN_UP, BLOCK = 512, 32, 1 << 22


def _advance(machine: Automaton, data: np.ndarray, rows: np.ndarray, state: int) -> np.ndarray:
    """State (times width) after each byte of one block; ``rows`` are bounds of texts within it."""
    texts = np.zeros(len(data), np.int32)
    inner = rows[(rows > 0) & (rows < len(data))]
    np.add.at(texts, inner, 1)
    place = np.arange(len(data)) + np.cumsum(texts)  # one break before each new text
    lanes = -(-(len(data) + len(inner)) // LANE)
    stream = np.full(RUN_UP + lanes * LANE, machine.kind[BREAK], np.int16)
    stream[RUN_UP + place] = machine.kind[data]
    columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(stream, RUN_UP + LANE)[::LANE].T)
    states = np.zeros(lanes, np.int64)
    for j in range(RUN_UP):
        states = machine.step[states + columns[j]]
    own = columns[RUN_UP:]
    seen = np.empty((LANE, lanes), np.int32)
    began = states
    for j in range(LANE):
        states = machine.step[states + own[j]]
        seen[j] = states
    while True:
        due = np.concatenate([[state], seen[-1, :-1]])
        wrong = np.flatnonzero(due != began)
        if not len(wrong):
            return seen.T.ravel()[place]
        began, states = due, due[wrong]
        again = np.ascontiguousarray(own[:, wrong])
        for j in range(LANE):
            states = machine.step[states + again[j]]
            seen[j, wrong] = states


def scan(machine: Automaton, data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of the states after each byte of a stream of texts, ``rows`` being their bounds; one pass.

    A block is cut into lanes that advance together, one byte of each at a time. A lane
    starts some bytes early from the start state, which nearly always gives the right state
    at its first own byte. Where the lane before ends in another, the lane is read again
    from that one, until all lanes agree: the states are those of a pass from left to right.
    """
    state = 0
    for at in range(0, len(data), BLOCK):
        end = min(at + BLOCK, len(data))
        low, high = np.searchsorted(rows, [at, end])
        if low < len(rows) and rows[low] == at:
            state = 0
        states = _advance(machine, data[at:end], rows[low:high] - at, state)
        state = int(states[-1])
        yield at, states // machine.width


def walk(machine: Automaton, data: np.ndarray | bytes, rule: int) -> list[int]:
    """How many bytes each match of ``rule`` takes that begins at the first byte."""
    state, found, bit = 0, [], 1 << rule
    for n, byte in enumerate(data, 1):
        state = int(machine.step[state * machine.width + int(machine.kind[byte])]) // machine.width
        if state == machine.dead:
            break
        if machine.accepts[state] & bit:
            found.append(n)
    return found
