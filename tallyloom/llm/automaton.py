"""Regular expressions over bytes as minimal deterministic automata in flat transition arrays.

The syntax is what secret rules need: literals, ``\\xHH`` and punctuation escapes, ``[classes]``,
``( | )`` groups and the quantifiers ``? * + {n} {n,} {n,m}``; ASCII only.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Never part of UTF-8, so it can stand between texts: every state falls back to the start on it.
SEPARATOR = 0xFF


class Rule(NamedTuple):
    """A kind of secret: head, then as many bytes of tail as follow (tail: a class, or empty).

    The search automaton needs the head alone, which keeps it small. min_tail: the least bytes from
    the head's last byte on; shorter matches still use up their bytes, but are dropped."""

    kind: str
    head: str
    tail: str = ""
    ignore_case: bool = False
    min_tail: int = 1

    @property
    def pattern(self) -> str:
        return self.head + (f"{self.tail}*" if self.tail else "")


def parse(pattern: str, ignore_case: bool = False) -> tuple:
    """Syntax tree: ("set", bytes), ("cat", parts), ("alt", parts) or ("rep", part, least, most or None)."""
    at = 0

    def peek() -> str:
        return pattern[at : at + 1]

    def take() -> str:
        nonlocal at
        at += 1
        return pattern[at - 1]

    def escaped() -> int:
        nonlocal at
        if take() == "x":
            at += 2
            return int(pattern[at - 2 : at], 16)
        return ord(pattern[at - 1])

    def folded(found: set[int]) -> tuple:
        if ignore_case:
            found |= {b ^ 32 for b in found if 65 <= b & ~32 <= 90}
        return ("set", frozenset(found))

    def char_class() -> tuple:
        found: set[int] = set()
        while peek() != "]":
            low = escaped() if (c := take()) == "\\" else ord(c)
            high = low
            if peek() == "-" and pattern[at + 1] != "]":
                take()
                high = escaped() if (c := take()) == "\\" else ord(c)
            found |= set(range(low, high + 1))
        take()
        return folded(found)

    def bounds() -> tuple[int, int | None]:
        c = take()
        if c in "?*+":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        text = ""
        while peek() != "}":
            text += take()
        take()
        low, comma, high = text.partition(",")
        return int(low), int(high) if high else (None if comma else int(low))

    def part() -> tuple:
        c = take()
        if c == "(":
            node = choice()
            take()
        elif c == "[":
            node = char_class()
        else:
            node = folded({escaped() if c == "\\" else ord(c)})
        while peek() and peek() in "?*+{":
            node = ("rep", node, *bounds())
        return node

    def choice() -> tuple:
        options = [[]]
        while peek() and peek() != ")":
            if peek() == "|":
                take()
                options.append([])
            else:
                options[-1].append(part())
        return ("alt", tuple(("cat", tuple(x)) for x in options))

    return choice()


def reverse(node: tuple) -> tuple:
    """The tree of the reversed words."""
    if node[0] == "cat":
        return ("cat", tuple(reverse(x) for x in reversed(node[1])))
    if node[0] == "alt":
        return ("alt", tuple(reverse(x) for x in node[1]))
    return ("rep", reverse(node[1]), *node[2:]) if node[0] == "rep" else node


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.byte: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.byte.append(None)
        return len(self.free) - 1

    def add(self, node: tuple, start: int) -> int:
        """Put the tree behind start; the state in which it has matched."""
        if node[0] == "set":
            end = self.state()
            step = self.state()
            self.free[start].append(step)
            self.byte[step] = (node[1], end)
            return end
        if node[0] == "cat":
            for x in node[1]:
                start = self.add(x, start)
            return start
        end = self.state()
        if node[0] == "alt":
            for x in node[1]:
                own = self.state()
                self.free[start].append(own)
                self.free[self.add(x, own)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            start = loop
        for _ in range((high or low) - low):
            self.free[start].append(end)
            start = self.add(inner, start)
        self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(x for x in seen if self.byte[x] or not self.free[x])


class Automaton(NamedTuple):
    """step[state + classes[byte]] is the next state; states are multiples of width, 0 is the start.

    Accepting states are those from first_accepting on; accepts[state // width] has a bit for each tree.
    dead: the state without a way on, or -1.
    """

    classes: bytes
    width: int
    step: np.ndarray
    accepts: list[int]
    first_accepting: int
    dead: int


def determinise(trees: list[tuple], search: bool) -> Automaton:
    """Subset construction and minimisation. search: a match of each tree may begin at every byte."""
    nfa, ends = _Nfa(), {}
    start = nfa.state()
    for k, tree in enumerate(trees):
        own = nfa.state()
        nfa.free[start].append(own)
        ends[nfa.add(tree, own)] = k
    first = nfa.closure([start])
    sets = sorted({x[0] for x in nfa.byte if x}, key=sorted)
    alike: dict[tuple, list[int]] = {}  # bytes that no rule tells apart
    for b in range(256):
        alike.setdefault((b == SEPARATOR, *(b in x for x in sets)), []).append(b)
    ids, rows, order = {first: 0}, [], [first]
    for states in order:
        row = [0] * 256
        for own in alike.values():
            to = {nfa.byte[s][1] for s in states if nfa.byte[s] and own[0] in nfa.byte[s][0]}
            to = nfa.closure(to | {start} if search else to) if own[0] != SEPARATOR else first if search else frozenset()
            if to not in ids:
                ids[to] = len(order)
                order.append(to)
            for b in own:
                row[b] = ids[to]
        rows.append(row)
    step = np.array(rows)
    marks = np.array([sum(1 << k for e, k in ends.items() if e in s) for s in order])
    group = np.unique(marks, return_inverse=True)[1]
    while True:  # Moore: split until states of a group go to the same groups
        finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    kept = np.unique(group, return_index=True)[1]
    first_of = sorted(range(len(kept)), key=lambda g: (marks[kept[g]] > 0, g != group[0], g))
    place = np.empty(len(kept), np.int64)
    place[first_of] = np.arange(len(kept))
    table = place[group[step[kept[first_of]]]]
    columns, classes = np.unique(table, axis=1, return_inverse=True)
    width, accepts = columns.shape[1], [int(marks[kept[g]]) for g in first_of]
    dead = [i for i in range(len(columns)) if not accepts[i] and (columns[i] == i).all()]
    return Automaton(bytes(classes.ravel().tolist()), width, np.ascontiguousarray(columns.ravel() * width, dtype=np.int32), accepts, width * next((i for i, x in enumerate(accepts) if x), len(accepts)), dead[0] * width if dead else -1)


class Scanner:
    """All rules at once: one search automaton over every byte, then exact spans where it accepts.

    Spans are leftmost, longest and non-overlapping for each rule by itself. A rule must be such that
    of two matches the one that begins first is also complete first, as holds for a fixed head
    followed by a run of characters.
    """

    LANE = 2048

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        trees = [parse(r.head, r.ignore_case) for r in rules]
        self.rules = rules
        self.search = determinise(trees, True)
        self.forward = [determinise([parse(r.pattern, r.ignore_case)], False) for r in rules]
        self.backward = [determinise([reverse(t)], False) for t in trees]

    def states(self, data: bytes) -> np.ndarray:
        """The search automaton's state after each byte.

        The bytes are laid out in lanes that advance together from the start state; then each lane
        whose true first state is another is corrected up to where both runs meet."""
        a, lane = self.search, self.LANE
        lanes = -(-len(data) // lane)
        flat = np.frombuffer((data + bytes([SEPARATOR]) * (lanes * lane - len(data))).translate(a.classes), np.uint8)
        cols = np.ascontiguousarray(flat.reshape(lanes, lane).T).astype(np.int32)
        out, now = np.empty((lane, lanes), np.int32), np.zeros(lanes, np.int32)
        for t in range(lane):
            np.add(cols[t], now, out=cols[t])
            now = out[t]
            np.take(a.step, cols[t], out=now, mode="clip")
        step = a.step
        for i in range(1, lanes):
            s, t = int(out[lane - 1, i - 1]), 0
            if s:
                own = flat[i * lane : (i + 1) * lane]
                while t < lane and (s := int(step[s + int(own[t])])) != out[t, i]:
                    out[t, i] = s
                    t += 1
        return out.T.reshape(-1)[: len(data)]

    @staticmethod
    def _longest(a: Automaton, data: bytes, positions: range) -> int:
        """Bytes of the longest match along positions, or 0."""
        s, longest, step, classes = 0, 0, a.step, a.classes
        for n, at in enumerate(positions, 1):
            s = int(step[s + classes[data[at]]])
            if s == a.dead:
                break
            if s >= a.first_accepting:
                longest = n
        return longest

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule number, end), sorted, in bytes."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        data = bytes([SEPARATOR]).join(texts)
        if not data:
            return found
        begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
        state = self.states(data)
        hits = np.flatnonzero(state >= self.search.first_accepting)
        owner = np.searchsorted(begins, hits, side="right") - 1
        done: dict[int, int] = {}
        doc = -1
        for at, i, s in zip(hits.tolist(), owner.tolist(), (state[hits] // self.search.width).tolist(), strict=True):
            if i != doc:
                doc, done = i, {}
            marks = self.search.accepts[s]
            for k, rule in enumerate(self.rules):
                low = max(done.get(k, 0), int(begins[i]))
                if not marks >> k & 1 or at < low:
                    continue
                if size := self._longest(self.backward[k], data, range(at, low - 1, -1)):
                    start = at + 1 - size
                    end = start + self._longest(self.forward[k], data, range(start, int(begins[i]) + len(texts[i])))
                    done[k] = end
                    if end - at >= rule.min_tail:
                        found[i].append((start - int(begins[i]), k, end - int(begins[i])))
        for spans in found:
            spans.sort()
        return found
