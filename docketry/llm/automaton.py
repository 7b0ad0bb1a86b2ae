"""Regexes to one minimal deterministic automaton, and its scan over many bytes at once.

Rules are parsed with the standard library's regex parser (which only reads the rule; no text is matched by it), joined
into one non-deterministic automaton that may begin at every byte, made deterministic by subset construction over byte
classes, and minimised by partition refinement. The same rules read backwards make an automaton for the reversed bytes,
and one rule that begins at the first byte only makes an anchored one, which reads the end of a match.

The scan cuts a byte array into lanes and steps all lanes together through the transition array; a lane that begins in
the middle of a rule is run again from the state its left neighbour ended in, until it meets its first run. So every
byte's state is exactly that of one pass from left to right.
"""

from __future__ import annotations

import re

import numpy as np

#: A byte that no UTF-8 text has; it leads back to the start from every state.
GAP = 0xFF
LANE = 1024
#: Up to so many lanes are run again byte by byte instead of together.
FEW = 32


class Nfa:
    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def build(self, tree, begin: int, fold: bool, backwards: bool = False) -> int:
        """Adds the parsed regex, or its reversal, after state `begin`; the state where it ends."""
        for op, arg in reversed([*tree]) if backwards else tree:
            name = str(op)
            if name in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
                end = self.state()
                self.moves[begin].append((_bytes(name, arg, fold), end))
                begin = end
            elif name == "SUBPATTERN":
                begin = self.build(arg[3], begin, fold or bool(arg[1] & re.IGNORECASE), backwards)
            elif name == "BRANCH":
                end = self.state()
                for branch in arg[1]:
                    start = self.state()
                    self.empty[begin].append(start)
                    self.empty[self.build(branch, start, fold, backwards)].append(end)
                begin = end
            elif name in ("MAX_REPEAT", "POSSESSIVE_REPEAT"):
                least, most, inner = arg
                for _ in range(least):
                    begin = self.build(inner, begin, fold, backwards)
                if str(most) == "MAXREPEAT":
                    loop = self.state()
                    self.empty[begin].append(loop)
                    self.empty[self.build(inner, loop, fold, backwards)].append(loop)
                    begin = loop
                else:
                    end = self.state()
                    for _ in range(most - least):
                        self.empty[begin].append(end)
                        begin = self.build(inner, begin, fold, backwards)
                    self.empty[begin].append(end)
                    begin = end
            else:
                raise ValueError(f"a rule uses {name}, which the automaton doesn't have")
        return begin


def _bytes(name: str, arg, fold: bool) -> frozenset[int]:
    if name == "ANY":
        return frozenset(range(256)) - {10, GAP}
    found: set[int] = set()
    negated = name == "NOT_LITERAL"
    for op, x in arg if name == "IN" else [("LITERAL", arg)]:
        if str(op) == "NEGATE":
            negated = True
        elif str(op) == "RANGE":
            found |= {*range(x[0], x[1] + 1)}
        elif str(op) == "LITERAL":
            found.add(x)
        else:
            raise ValueError(f"a rule's class uses {op}")
    if found and max(found) > 127:
        raise ValueError("rules are ASCII")
    if fold:
        found |= {b ^ 32 for b in found if chr(b).isalpha()}
    return frozenset(range(256)) - found - {GAP} if negated else frozenset(found)


class Automaton:
    """The rules' minimal automaton: classes of bytes, transitions by state and class, and the set of rules that end in each state (a bit each).

    backwards: of the rules' reversals; anchored: matches begin at the first byte only, and a state that leads nowhere is dead."""

    def __init__(self, rules: list[str], backwards: bool = False, anchored: bool = False):
        nfa, start = Nfa(), 0
        nfa.state()
        ends = []
        for rule in rules:
            begin = nfa.state()
            nfa.empty[start].append(begin)
            ends.append(nfa.build(re._parser.parse(rule), begin, False, backwards))
        self._classes({m[0] for moves in nfa.moves for m in moves})
        samples = [int(np.flatnonzero(self.classes == c)[0]) for c in range(self.n_classes)]
        reach: list[frozenset[int]] = []
        for s in range(len(nfa.moves)):
            todo, seen = [s], {s}
            while todo:
                for x in nfa.empty[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            reach.append(frozenset(seen))
        # by class, where each state leads
        leads: list[dict[int, frozenset[int]]] = [{} for _ in samples]
        for s, moves in enumerate(nfa.moves):
            for by, to in moves:
                for c, b in enumerate(samples):
                    if b in by:
                        leads[c][s] = leads[c].get(s, frozenset()) | reach[to]
        first = reach[start]
        again = frozenset() if anchored else first  # a new match may begin at every byte
        number, todo, table = {first: 0}, [first], []
        for here in todo:
            row = []
            for lead in leads:
                there = again.union(*(lead[s] for s in here if s in lead))
                if there not in number:
                    number[there] = len(number)
                    todo.append(there)
                row.append(number[there])
            table.append(row)
        accepts = [sum(1 << k for k, e in enumerate(ends) if e in s) for s in number]
        self._minimise(np.array(table), np.array(accepts))
        dead = (self.table == np.arange(len(self.table))[:, None]).all(1) & (self.accepts == 0)
        self.dead = int(np.flatnonzero(dead)[0]) if dead.any() else -1

    def _classes(self, sets: set[frozenset[int]]) -> None:
        """Bytes that no rule tells apart share a class."""
        key = {b: tuple(b in s for s in sorted(sets, key=sorted)) for b in range(256)}
        number = {k: i for i, k in enumerate(dict.fromkeys(key.values()))}
        self.classes = np.array([number[key[b]] for b in range(256)], np.uint8)
        self.n_classes = len(number)

    def _minimise(self, table: np.ndarray, accepts: np.ndarray) -> None:
        """Splits blocks of states until all of a block go to the same blocks; accepting states come last."""
        block = np.unique(accepts, return_inverse=True)[1]
        while True:
            new = np.unique(np.column_stack((block, block[table])), axis=0, return_inverse=True)[1].ravel()
            if new.max() == block.max():
                break
            block = new
        n = int(block.max()) + 1
        member = np.zeros(n, np.int64)
        member[block] = np.arange(len(block))
        order = np.argsort(accepts[member] > 0, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        self.table = rank[block[table[member[order]]]]
        self.accepts = accepts[member[order]]
        self.first_accepting = int((self.accepts == 0).sum())
        self.start = int(rank[block[0]])
        self.flat = (self.table * self.n_classes).ravel()

    def longest(self, buf: np.ndarray, at: int, stop: int) -> int:
        """Where the longest match that begins at `at` ends; -1 if none does. Runs of bytes that lead a state to itself are passed at once."""
        state, end, table, classes = self.start, -1, self.table, self.classes
        while at < stop and state != self.dead:
            to = int(table[state, classes[buf[at]]])
            at += 1
            if to == state:
                ahead = 64
                while at < stop:
                    run = table[state, classes[buf[at : min(at + ahead, stop)]]] == state
                    if not run.all():
                        at += int(run.argmin())
                        break
                    at += len(run)
                    ahead *= 2
            state = to
            if self.accepts[state]:
                end = at
        return end

    def scan(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions after which rules end, rising, and the rules that end there."""
        lanes = max(1, -(-len(buf) // LANE))
        classes = np.full(lanes * LANE, self.classes[GAP], np.uint8)
        classes[: len(buf)] = self.classes[buf]
        steps = np.ascontiguousarray(classes.reshape(lanes, LANE).T)
        k, limit = self.n_classes, self.first_accepting * self.n_classes
        state = np.full(lanes, self.start * k, np.int64)
        at: list[np.ndarray] = []
        by: list[np.ndarray] = []
        index = np.empty(lanes, np.int64)
        for i in range(LANE):
            np.add(state, steps[i], out=index)
            np.take(self.flat, index, out=state, mode="wrap")
            if state.max() >= limit:
                hit = np.flatnonzero(state >= limit)
                at.append(hit * LANE + i)
                by.append(state[hit])
        ended = state
        rerun = np.flatnonzero(ended[:-1] != self.start * k) + 1
        came = np.full(lanes, self.start * k, np.int64)
        while len(rerun) > FEW:  # lanes whose left neighbour ends in another state than the one they began in
            rerun = rerun[ended[rerun - 1] != came[rerun]]
            old, new, lane = came[rerun].copy(), ended[rerun - 1].copy(), rerun
            came[rerun] = ended[rerun - 1]
            changed = np.zeros(0, np.int64)
            for i in range(LANE):
                if not len(lane):
                    break
                step = steps[i, lane]
                old, new = self.flat[old + step], self.flat[new + step]
                hit = new >= limit
                if hit.any():
                    at.append(lane[hit] * LANE + i)
                    by.append(new[hit])
                apart = old != new
                old, new, lane = old[apart], new[apart], lane[apart]
            else:
                ended[lane] = new
                changed = lane
            rerun = changed[changed + 1 < lanes] + 1
        # a state that goes on over many lanes is followed one lane after the other
        flat = self.flat.tolist() if len(rerun) else []
        for lane in rerun.tolist():
            while lane < lanes and ended[lane - 1] != came[lane]:
                old, new = int(came[lane]), int(ended[lane - 1])
                came[lane] = new
                here: list[int] = []
                states: list[int] = []
                for i, step in enumerate(steps[:, lane].tolist()):
                    old, new = flat[old + step], flat[new + step]
                    if new >= limit:
                        here.append(lane * LANE + i)
                        states.append(new)
                    if old == new:
                        break
                else:
                    ended[lane] = new
                at.append(np.array(here, np.int64))
                by.append(np.array(states, np.int64))
                lane += 1
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, rules = np.concatenate(at), self.accepts[np.concatenate(by) // k]
        order = np.argsort(where, kind="stable")
        return where[order] + 1, rules[order]
