"""Regular expressions to one minimal transition table for many rules.

The dialect: literals, escapes (\\. \\xHH \\-), classes, groups, ``|``, ``? * + {n} {n,} {n,m}`` and ``(?i:...)``, over bytes.
A rule's matches are the leftmost, longest, non-overlapping ones. Every state that accepts may lead only to states that
accept or to none (``compile_rules`` checks it), so that one pass over the bytes never has to look at a byte twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Nfa:
    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    start: int = 0
    accept: int = 0

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def step(self, states, byte: int) -> frozenset[int]:
        return self.closure({t for s in states for on, t in self.moves[s] if byte in on})

    def backwards(self) -> Nfa:
        out = Nfa([[] for _ in self.moves], [[] for _ in self.free], self.accept, self.start)
        for s, moves in enumerate(self.moves):
            for on, t in moves:
                out.moves[t].append((on, s))
            for t in self.free[s]:
                out.free[t].append(s)
        return out


class _Parser:
    """Thompson's construction by recursive descent; each part is a pair of states."""

    def __init__(self, pattern: str):
        self.text, self.at, self.nfa, self.fold = pattern, 0, Nfa(), False

    def parse(self) -> Nfa:
        self.nfa.start, self.nfa.accept = self.choice()
        if self.at != len(self.text):
            raise ValueError(f"unexpected {self.text[self.at :]!r} in {self.text!r}")
        return self.nfa

    def more(self, stops: str = "") -> bool:
        return self.at < len(self.text) and self.text[self.at] not in stops

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def choice(self) -> tuple[int, int]:
        parts = [self.sequence()]
        while self.more() and self.text[self.at] == "|":
            self.at += 1
            parts.append(self.sequence())
        if len(parts) == 1:
            return parts[0]
        a, b = self.nfa.state(), self.nfa.state()
        for s, t in parts:
            self.nfa.free[a].append(s)
            self.nfa.free[t].append(b)
        return a, b

    def sequence(self) -> tuple[int, int]:
        first = last = self.nfa.state()
        while self.more("|)"):
            s, t = self.repeated()
            self.nfa.free[last].append(s)
            last = t
        return first, last

    def repeated(self) -> tuple[int, int]:
        begin = self.at
        part = self.atom()
        end = self.at
        if not self.more() or self.text[self.at] not in "?*+{":
            return part
        sign = self.take()
        if sign == "{":
            low, comma, high = self.text[self.at : (close := self.text.index("}", self.at))].partition(",")
            self.at = close + 1
            least, most = int(low), (int(high) if high else None) if comma else int(low)
        else:
            least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
        after = self.at

        def copy() -> tuple[int, int]:
            self.at = begin
            out = self.atom()
            if self.at != end:
                raise ValueError(self.text)
            return out

        parts = [part] + [copy() for _ in range(max(least, most or 0, 1) - 1 + (most is None and least > 1))]
        self.at = after
        first = last = self.nfa.state()
        exit_ = self.nfa.state()
        for k, (s, t) in enumerate(parts):
            if k >= least:
                self.nfa.free[last].append(exit_)
            self.nfa.free[last].append(s)
            last = t
        if most is None:
            self.nfa.free[last].append(parts[-1][0])
        self.nfa.free[last].append(exit_)
        return first, exit_

    def atom(self) -> tuple[int, int]:
        c = self.take()
        if c == "(":
            fold = self.fold
            if self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            out = self.choice()
            if not self.more() or self.take() != ")":
                raise ValueError(f"no closing bracket in {self.text!r}")
            self.fold = fold
            return out
        on = self.bracket() if c == "[" else {self.escape()} if c == "\\" else {ord(c)}
        if self.fold:
            on |= {ord(chr(b).swapcase()) for b in on if chr(b).isascii() and chr(b).isalpha()}
        s, t = self.nfa.state(), self.nfa.state()
        self.nfa.moves[s].append((frozenset(on), t))
        return s, t

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def bracket(self) -> set[int]:
        items, negated = set(), False
        if self.text[self.at] == "^":
            negated, self.at = True, self.at + 1
        while (c := self.take()) != "]":
            low = self.escape() if c == "\\" else ord(c)
            if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                c = self.take()
                items |= set(range(low, (self.escape() if c == "\\" else ord(c)) + 1))
            else:
                items.add(low)
        return set(range(128)) - items if negated else items


@dataclass
class Searcher:
    """All rules in one table. ``table[state * width + class]`` is the next state times width, or, where rules end before
    this byte, minus 1 minus an index into ``events`` (the rules' bit mask and the next state times width)."""

    classes: bytes
    width: int
    table: list[int]
    events: list[tuple[int, int]]
    at_end: dict[int, int]
    backwards: list[Nfa]
    states: int

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, mask of the rules whose match ends there), in one pass over the bytes."""
        state, table, out = 0, self.table, []
        for at, c in enumerate(data.translate(self.classes)):
            state = table[state + c]
            if state < 0:
                mask, state = self.events[-1 - state]
                out.append((at, mask))
        if state in self.at_end:
            out.append((len(data), self.at_end[state]))
        return out

    def start(self, data: bytes, rule: int, end: int, least: int) -> int:
        """The leftmost start, not before least, of the match of a rule that ends at end."""
        nfa, found = self.backwards[rule], end
        states, at = nfa.closure({nfa.start}), end
        while states and at > least:
            at -= 1
            states = nfa.step(states, data[at])
            if nfa.accept in states:
                found = at
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule, start, end) of every match, by end and rule."""
        last, out = [0] * len(self.backwards), []
        for end, mask in self.ends(data):
            for rule in range(len(last)):
                if mask >> rule & 1:
                    out.append((rule, self.start(data, rule, end, last[rule]), end))
                    last[rule] = end
        return out


def _byte_classes(nfas: list[Nfa]) -> tuple[bytes, list[int]]:
    sets = sorted({on for n in nfas for moves in n.moves for on, _ in moves}, key=sorted)
    seen: dict[tuple, int] = {}
    classes = bytes(seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256))
    return classes, [classes.index(k) for k in range(len(seen))]


def _rule_step(nfa: Nfa, state, byte: int):
    """One rule's searcher: threads in the order in which they began, and whether the first of them has matched.

    Returns the next state and whether a match ended before this byte (it is then searched for from this byte on)."""
    groups, matched = state
    seen: set[int] = set()
    after = []
    for g in groups:
        if new := nfa.step(g, byte) - seen:
            after.append(frozenset(new))
            seen |= new
    if matched:
        if not after:
            return _rule_step(nfa, ((), False), byte)[0], True
        if nfa.accept not in after[0]:
            raise ValueError("a rule may not go on from a match to text that is no match")
        return (tuple(after[:1]), True), False
    if new := nfa.step(nfa.closure({nfa.start}), byte) - seen:
        after.append(frozenset(new))
    for k, g in enumerate(after):
        if nfa.accept in g:
            if k:
                raise ValueError("a rule's match may not begin inside another that is still open")
            return (tuple(after[:1]), True), False
    return (tuple(after), False), False


def compile_rules(patterns: list[str]) -> Searcher:
    """Subset construction over the product of all rules' searchers, then minimisation by refining partitions."""
    nfas = [_Parser(p).parse() for p in patterns]
    classes, samples = _byte_classes(nfas)
    steps: list[dict] = [{} for _ in nfas]

    def step(k: int, state, c: int):
        if (state, c) not in steps[k]:
            steps[k][state, c] = _rule_step(nfas[k], state, samples[c])
        return steps[k][state, c]

    root = tuple(((), False) for _ in nfas)
    number, todo, rows, outs = {root: 0}, [root], [], []
    for state in todo:  # grows
        row, out = [], []
        for c in range(len(samples)):
            parts = [step(k, s, c) for k, s in enumerate(state)]
            after = tuple(p[0] for p in parts)
            if after not in number:
                number[after] = len(todo)
                todo.append(after)
            row.append(number[after])
            out.append(sum(1 << k for k, p in enumerate(parts) if p[1]))
        rows.append(row)
        outs.append(out)
    final = np.array([[sum(1 << k for k, s in enumerate(state) if s[1])] for state in todo])
    next_, out = np.array(rows), np.array(outs)
    block = np.unique(np.hstack([final, out]), axis=0, return_inverse=True)[1].reshape(-1)
    while True:
        finer = np.unique(np.hstack([block[:, None], block[next_]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = np.concatenate([[block[0]], np.setdiff1d(np.arange(block.max() + 1), block[0])])
    rename = np.empty(len(order), np.int64)
    rename[order] = np.arange(len(order))
    block = rename[block]
    first = np.unique(block, return_index=True)[1]
    width = len(samples)
    events: dict[tuple[int, int], int] = {}
    flat = []
    for s in first:
        for c in range(width):
            to, mask = int(block[next_[s, c]]) * width, int(out[s, c])
            flat.append(-1 - events.setdefault((mask, to), len(events)) if mask else to)
    at_end = {int(block[s]) * width: int(final[s, 0]) for s in first if final[s, 0]}
    return Searcher(classes, width, flat, list(events), at_end, [n.backwards() for n in nfas], len(first))
