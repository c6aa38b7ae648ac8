"""One byte automaton for many patterns: subset construction, then minimisation.

Patterns are byte regexes without anchors, look-around, back-references or lazy
repeats. For each pattern the automaton follows leftmost-longest,
non-overlapping matching, as if it were searched alone; one transition per byte
serves all of them. Two properties are required and checked, which every rule
that ends in an open run has: a match, once it is long enough, stays one while
it goes on, and no earlier start is still undecided when a match is.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from re import _constants as op
from re import _parser as parser

#: A repeat is unrolled; this bounds the states one rule can ask for.
MAX_REPEAT = 256


class _Nfa:
    """Thompson construction; ``steps[s]`` holds (bytes, target), ``free[s]`` empty moves."""

    def __init__(self) -> None:
        self.steps: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, items, start: int) -> int:
        """Appends parsed items behind ``start``; gives the state behind them."""
        for kind, value in items:
            if kind is op.LITERAL or kind is op.NOT_LITERAL or kind is op.IN or kind is op.ANY:
                end = self.state()
                self.steps[start].append((_bytes_of(kind, value), end))
                start = end
            elif kind is op.SUBPATTERN:
                start = self.add(value[3], start)
            elif kind is op.BRANCH:
                end = self.state()
                for branch in value[1]:
                    self.free[self.add(branch, start)].append(end)
                start = end
            elif kind is op.MAX_REPEAT:
                least, most, body = value
                if least > MAX_REPEAT or most is not op.MAXREPEAT and most > MAX_REPEAT:
                    raise ValueError(f"a repeat of over {MAX_REPEAT}")
                for _ in range(least):
                    start = self.add(body, start)
                if most is op.MAXREPEAT:
                    loop = self.state()
                    self.free[start].append(loop)
                    self.free[self.add(body, loop)].append(loop)
                    start = loop
                else:
                    end = self.state()
                    self.free[start].append(end)
                    for _ in range(most - least):
                        start = self.add(body, start)
                        self.free[start].append(end)
                    start = end
            else:
                raise ValueError(f"{kind} can't be compiled to a byte automaton")
        return start

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def step(self, states: frozenset[int], byte: int) -> frozenset[int]:
        return self.closure({t for s in states for on, t in self.steps[s] if byte in on})


def _bytes_of(kind, value) -> frozenset[int]:
    if kind is op.ANY:
        return frozenset(range(256)) - {10}
    if kind is op.LITERAL:
        return frozenset({value})
    if kind is op.NOT_LITERAL:
        return frozenset(range(256)) - {value}
    found: set[int] = set()
    negate = False
    for k, v in value:
        if k is op.NEGATE:
            negate = True
        elif k is op.LITERAL:
            found.add(v)
        elif k is op.RANGE:
            found.update(range(v[0], v[1] + 1))
        else:
            raise ValueError(f"{k} in a set")
    return frozenset(range(256)) - found if negate else frozenset(found)


def any_case(letters: str) -> str:
    """The pattern with each ASCII letter outside of sets taken in either case."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else c for c in letters)


def _reversed(items) -> list:
    out = []
    for kind, value in reversed(list(items)):
        if kind is op.SUBPATTERN:
            value = (*value[:3], _reversed(value[3]))
        elif kind is op.BRANCH:
            value = (value[0], [_reversed(b) for b in value[1]])
        elif kind is op.MAX_REPEAT:
            value = (value[0], value[1], _reversed(value[2]))
        out.append((kind, value))
    return out


def _compile(items) -> tuple[_Nfa, frozenset[int], int]:
    nfa = _Nfa()
    first = nfa.state()
    last = nfa.add(items, first)
    return nfa, nfa.closure({first}), last


class Anchored:
    """A deterministic automaton for one pattern from a fixed position; -1 is no way on."""

    def __init__(self, items) -> None:
        nfa, start, last = _compile(items)
        numbers, self.rows, self.accepts, todo = {start: 0}, [], [], [start]
        for states in todo:
            row = []
            for byte in range(256):
                after = nfa.step(states, byte)
                if after and after not in numbers:
                    numbers[after] = len(numbers)
                    todo.append(after)
                row.append(numbers[after] if after else -1)
            self.rows.append(row)
            self.accepts.append(last in states)

    def longest(self, data: bytes, at: int, end: int, by: int = 1) -> int:
        """How many bytes the longest match from ``at`` on has, going ``by``; -1 for none."""
        state, best, n = 0, 0 if self.accepts[0] else -1, 0
        while at != end:
            state = self.rows[state][data[at]]
            if state < 0:
                break
            n, at = n + 1, at + by
            if self.accepts[state]:
                best = n
        return best


def forward(pattern: str) -> Anchored:
    return Anchored(parser.parse(pattern.encode()))


def backward(pattern: str) -> Anchored:
    return Anchored(_reversed(parser.parse(pattern.encode())))


def _search_steps(pattern: str):
    """A deterministic searcher for one pattern: start state, step function, matched test.

    A state is the tuple of live threads by age, oldest first, and whether the
    oldest has matched. When a matched thread ends, the search begins anew at
    that byte.
    """
    nfa, start, last = _compile(parser.parse(pattern.encode()))
    if last in start:
        raise ValueError(f"{pattern!r} matches nothing")

    def step(state, byte):
        threads, matched = state
        moved = []
        seen: frozenset[int] = frozenset()
        for thread in threads if matched else (*threads, start):
            after = nfa.step(thread, byte) - seen
            if after:
                seen |= after
                moved.append(after)
        if matched:
            if moved and last in moved[0]:
                return tuple(moved[:1]), True
            if moved:
                raise ValueError(f"{pattern!r}: a match must stay one while it goes on")
            return step(((), False), byte)
        for age, thread in enumerate(moved):
            if last in thread:
                if age:
                    raise ValueError(f"{pattern!r}: an earlier start is undecided at a match")
                return (thread,), True
        return tuple(moved), False

    return ((), False), step


class Automaton:
    """``table[s]`` maps a byte to the next state; states from ``hot`` on are inside a match.

    ``inside[s - hot]`` lists the numbers of the patterns that match up to here.
    State ``start`` begins a text.
    """

    def __init__(self, patterns: Sequence[str]) -> None:
        searchers = [_search_steps(p) for p in patterns]
        groups = _byte_groups(patterns)
        first = tuple(s for s, _ in searchers)
        numbers, rows, todo = {first: 0}, [], [first]
        memo: list[dict] = [{} for _ in patterns]
        for state in todo:
            row = []
            for group in groups:
                after = []
                for k, part in enumerate(state):
                    if (part, group[0]) not in memo[k]:
                        memo[k][part, group[0]] = searchers[k][1](part, group[0])
                    after.append(memo[k][part, group[0]])
                after = tuple(after)
                if after not in numbers:
                    numbers[after] = len(numbers)
                    todo.append(after)
                row.append(numbers[after])
            rows.append(row)
        outputs = [tuple(k for k, part in enumerate(state) if part[1]) for state in todo]
        self._minimise(rows, outputs, groups)

    def _minimise(self, rows: list[list[int]], outputs: list[tuple], groups: list[list[int]]) -> None:
        """Refines the partition by outputs until states of a class move alike (Moore)."""
        kinds: dict = {}
        classes = [kinds.setdefault(o, len(kinds)) for o in outputs]
        while True:
            kinds = {}
            refined = [
                kinds.setdefault((c, *[classes[t] for t in row]), len(kinds))
                for c, row in zip(classes, rows, strict=True)
            ]
            if len(set(refined)) == len(set(classes)):
                break
            classes = refined
        members = dict(zip(reversed(classes), range(len(classes) - 1, -1, -1), strict=True))
        order = sorted(members, key=lambda c: (bool(outputs[members[c]]), members[c]))
        number = {c: i for i, c in enumerate(order)}
        self.start = number[classes[0]]
        self.hot = sum(not outputs[members[c]] for c in order)
        self.inside = [outputs[members[c]] for c in order[self.hot :]]
        self.table = []
        for c in order:
            full = [0] * 256
            for group, target in zip(groups, rows[members[c]], strict=True):
                for byte in group:
                    full[byte] = number[classes[target]]
            self.table.append(full)

    def ends(self, data: bytes) -> dict[int, list[int]]:
        """For each pattern the end positions of its matches, from one pass over the bytes."""
        table, hot, inside = self.table, self.hot, self.inside
        found = defaultdict(list)
        row, open_at = table[self.start], -1
        # A match grows by one byte while its state lasts: its end moves along.
        for at, byte in enumerate(data):
            state = row[byte]
            row = table[state]
            if state >= hot:
                for k in inside[state - hot]:
                    ends = found[k]
                    if ends and ends[-1] == at and open_at == at - 1:
                        ends[-1] = at + 1
                    else:
                        ends.append(at + 1)
                open_at = at
        return found


def _byte_groups(patterns: Sequence[str]) -> list[list[int]]:
    """Bytes that no pattern tells apart, as groups."""
    sets: set[frozenset[int]] = set()
    for pattern in patterns:
        nfa = _compile(parser.parse(pattern.encode()))[0]
        sets.update(on for steps in nfa.steps for on, _ in steps)
    ordered = sorted(sets, key=sorted)
    groups = defaultdict(list)
    for byte in range(256):
        groups[tuple(byte in s for s in ordered)].append(byte)
    return list(groups.values())
