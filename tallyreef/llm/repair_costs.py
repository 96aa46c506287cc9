"""Least edits that bring a sequence of marked rows into a grammar, by a weighted automaton.

The edit automaton is nondeterministic: a row may be kept, given another role or deleted,
and rows may be inserted. It is made deterministic as rows ask for it: after any rows, the
least cost of each grammar state, less the least of them, is a state of the deterministic
automaton, and a table remembers what each such state and symbol lead to. A scan of the
table gives the cost. A second table goes backward: from the states that lie on a cheapest
way after a row, over the arcs that the costs make tight, to those before it, with the
order of what can follow them; so the way whose letters come first is read off forward.

Costs of a state that another state can always do as well as are dropped, which keeps the
number of vectors finite: ``_gaps`` has the least number by which one state can trail
another for any rows to come.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence
from io import StringIO
from itertools import product

INFINITE = float("inf")
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Stands for the new initial of an edit that gives none.
NONE = "-"
#: Gaps beyond this stand for none.
MOST_GAP = 64

Vector = tuple[float, ...]


class Grammar:
    """A deterministic grammar of initials and what edits cost.

    ``arcs`` leads from a state and an initial to a state; ``new`` are the initials that
    a row can be given or inserted with. A symbol is a pair (initial, extra), extra being
    what a row costs that stays; extra None is a row that has to go.
    """

    def __init__(self, arcs: dict[tuple[int, str], int], final: frozenset[int], new: tuple[str, ...], rerole: int, delete: int, insert: int, start: int = 0):
        self.arcs, self.final, self.new, self.start = arcs, final, new, start
        self.rerole, self.delete, self.insert = rerole, delete, insert
        self.states = range(1 + max([start, *final, *(p for p, _ in arcs), *arcs.values()]))
        far = [[0 if p == q else INFINITE for q in self.states] for p in self.states]
        for p, initial in product(self.states, new):
            if (p, initial) in arcs and arcs[p, initial] != p:
                far[p][arcs[p, initial]] = insert
        for k, p, q in product(self.states, repeat=3):
            far[p][q] = min(far[p][q], far[p][k] + far[k][q])
        #: Cost of inserts alone from state to state.
        self.far = far

    def moves(self, state: int, symbol: tuple[str, int | None]) -> list[tuple[str, str, int, float]]:
        """Edit, new initial (or NONE), next state and cost of every way over a row."""
        initial, extra = symbol
        found = [(DELETE, NONE, state, self.delete)]
        if extra is not None:
            if (state, initial) in self.arcs:
                found.append((KEEP, NONE, self.arcs[state, initial], extra))
            found += [(REROLE, x, self.arcs[state, x], self.rerole + extra) for x in self.new if (state, x) in self.arcs]
        return found


class Repairer:
    """Costs and edits of sequences of symbols; tables grow with the vectors that are met."""

    def __init__(self, grammar: Grammar, symbols: list[tuple[str, int | None]]):
        self.grammar, self.symbols = grammar, symbols
        self.gaps = self._gaps(symbols)
        self.vectors: list[Vector] = []
        self.numbers: dict[Vector, int] = {}
        #: (vector, symbol) to (vector, cost).
        self.forward: dict[tuple[int, tuple], tuple[int, int]] = {}
        #: (vector, symbol, traced) to (traced, choices); choices lead from a state to (edits, next state).
        self.backward: dict[tuple[int, tuple, int], tuple[int, dict]] = {}
        self.traced: list[tuple[tuple[int, int], ...]] = []
        self.traced_numbers: dict[tuple, int] = {}
        self.first, self.first_cost = self._number([self.grammar.far[grammar.start][q] for q in grammar.states])

    def _gaps(self, symbols: list) -> list[list[float]]:
        """For states p, q: the least g so that from p any rows to come cost at most g more than from q."""
        g = self.grammar
        ends = [min((g.far[p][f] for f in g.final), default=INFINITE) for p in g.states]
        steps = []
        for symbol in symbols:
            step = [[INFINITE] * len(g.states) for _ in g.states]
            for p, k in product(g.states, repeat=2):
                for _, _, q, cost in g.moves(k, symbol):
                    step[p][q] = min(step[p][q], g.far[p][k] + cost)
            steps.append(step)
        gaps = [[0.0 if ends[q] == INFINITE else max(0.0, ends[p] - ends[q]) for q in g.states] for p in g.states]
        changed = True
        while changed:
            changed = False
            for p, q in product(g.states, repeat=2):
                needed = max((min(s[p][a] - s[q][b] + gaps[a][b] if s[p][a] < INFINITE else INFINITE for a in g.states) for s in steps for b in g.states if s[q][b] < INFINITE), default=0.0)
                if needed > gaps[p][q]:
                    gaps[p][q] = needed if needed <= MOST_GAP else INFINITE
                    changed = True
        return gaps

    def _number(self, costs: list[float]) -> tuple[int, int]:
        """The vector's number and what was taken off it; states that trail another for good are dropped."""
        costs = [INFINITE if any(costs[p] + self.gaps[p][q] < costs[q] for p in self.grammar.states) else costs[q] for q in self.grammar.states]
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], int(least)

    def step(self, vector: int, symbol: tuple) -> tuple[int, int]:
        key = (vector, symbol)
        if key not in self.forward:
            g, before = self.grammar, self.vectors[vector]
            after = [INFINITE] * len(g.states)
            for p in g.states:
                for _, _, q, cost in g.moves(p, symbol):
                    after[q] = min(after[q], before[p] + cost)
            self.forward[key] = self._number([min(after[p] + g.far[p][q] for p in g.states) for q in g.states])
        return self.forward[key]

    def _trace_number(self, ranks: dict[int, int]) -> int:
        """A set of states on cheapest ways, each with the rank of what follows it."""
        key = tuple(sorted(ranks.items()))
        if key not in self.traced_numbers:
            self.traced_numbers[key] = len(self.traced)
            self.traced.append(key)
        return self.traced_numbers[key]

    def _placed(self, costs: Vector, ways: dict[int, tuple]) -> tuple[int, dict]:
        """Number of the states that have a way or reach one by tight inserts, and their edits.

        ways: state to (key, edits, initials, next state); keys order ways by their letters.
        """
        g = self.grammar
        # An insert costs, so what it leads to costs more and is placed before.
        for p in sorted(g.states, key=lambda p: -costs[p]):
            for x in g.new:
                q = g.arcs.get((p, x))
                if costs[p] < INFINITE and q in ways and q != p and costs[p] + g.insert == costs[q]:
                    key, edits, initials, then = ways[q]
                    way = ((INSERT, *key), INSERT + edits, x + initials, then)
                    ways[p] = min(ways[p], way) if p in ways else way
        order = {key: i for i, key in enumerate(sorted({w[0] for w in ways.values()}))}
        return self._trace_number({p: order[w[0]] for p, w in ways.items()}), {p: w[1:] for p, w in ways.items()}

    def _end(self, vector: int) -> tuple[int, dict, int]:
        costs = self.vectors[vector]
        best = min(costs[f] for f in self.grammar.final)
        number, choices = self._placed(costs, {f: (("",), "", "", f) for f in self.grammar.final if costs[f] == best})
        return number, choices, int(best)

    def _back(self, vector: int, symbol: tuple, traced: int) -> tuple[int, dict]:
        key = (vector, symbol, traced)
        if key not in self.backward:
            g, costs = self.grammar, self.vectors[vector]
            after, shift = self.step(vector, symbol)
            ranks, ways = dict(self.traced[traced]), {}
            for p in g.states:
                for edit, initial, q, cost in g.moves(p, symbol):
                    if q in ranks and costs[p] + cost - shift == self.vectors[after][q]:
                        way = ((edit, ranks[q]), edit, initial, q)
                        ways[p] = min(ways[p], way) if p in ways else way
            self.backward[key] = self._placed(costs, ways)
        return self.backward[key]

    def repair(self, codes: Sequence[int]) -> tuple[int, str, str]:
        """Cost of rows given by places in the symbols, letters of the cheapest edits that come first in ASCII, and each edit's new initial (NONE where it gives none)."""
        vectors, total = array("L", [self.first]), self.first_cost
        for code in codes:
            number, cost = self.step(vectors[-1], self.symbols[code])
            vectors.append(number)
            total += cost
        number, end, rest = self._end(vectors[-1])
        # traced[i] holds after the last i rows.
        traced = array("L", [number])
        for i in range(len(codes) - 1, -1, -1):
            traced.append(self._back(vectors[i], self.symbols[codes[i]], traced[-1])[0])
        state, letters, initials = self.grammar.start, StringIO(), StringIO()
        for i, code in enumerate(codes):
            edits, new, state = self._back(vectors[i], self.symbols[code], traced[len(codes) - 1 - i])[1][state]
            letters.write(edits)
            initials.write(new)
        letters.write(end[state][0])
        initials.write(end[state][1])
        return total + rest, letters.getvalue(), initials.getvalue()
