"""Probabilistic automata from example strings: states of a prefix tree merge while their futures are statistically compatible."""

from __future__ import annotations

import math

#: Classes of symbols and how many characters each has; any other character is a class of its own.
CLASSES = {"9": "0123456789", "x": "abcdef", "l": "ghijklmnopqrstuvwxyz", "X": "ABCDEF", "L": "GHIJKLMNOPQRSTUVWXYZ"}
_CLASS = {c: k for k, cs in CLASSES.items() for c in cs}


def folded(s: str) -> str:
    """A string whose letters are all capitals is of the format of its small letters."""
    return s.lower() if s.isupper() else s


class Automaton:
    """States hold how many strings end there and how many go on by each class of symbols, where to, and by which characters.

    A format is read by classes, so that random characters are one path, and each state keeps the characters themselves, so that a
    fixed prefix is known by its letters. States of one depth merge first, from the top; what is left are as many states as the
    lengths and class patterns of the examples tell apart. Then states of different depths merge, which makes loops, and there only
    on evidence: both must have been passed by `evidence` strings at least, or a few examples would fold into one state.
    """

    def __init__(self, strings: list[str], alpha: float = 0.05, evidence: int = 12):
        self.ends, self.counts, self.to, self.chars = [0], [{}], [{}], [{}]
        for s in map(folded, strings):
            q = 0
            for c in s:
                k = _CLASS.get(c, c)
                if k not in self.to[q]:
                    self.to[q][k] = len(self.to)
                    self.ends.append(0), self.counts.append({}), self.to.append({}), self.chars.append({})
                self.counts[q][k] = self.counts[q].get(k, 0) + 1
                self.chars[q][c] = self.chars[q].get(c, 0) + 1
                q = self.to[q][k]
            self.ends[q] += 1
        self.root = list(range(len(self.to)))
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.evidence = evidence
        self._merge_depths()
        self._merge_across()
        self.kept = self._reached()
        self._compile()

    def _find(self, q: int) -> int:
        while self.root[q] != q:
            self.root[q] = self.root[self.root[q]]
            q = self.root[q]
        return q

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.counts[q].values())

    def _alike(self, a: int, b: int) -> bool:
        """Hoeffding's bound on every class's share and on the share that ends, for the two states and all pairs that follow both."""
        todo, seen = [(a, b)], set()
        while todo:
            a, b = (self._find(q) for q in todo.pop())
            if a == b or (a, b) in seen:
                continue
            seen.add((a, b))
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            far = self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > far:
                return False
            for k in self.counts[a].keys() | self.counts[b].keys():
                if abs(self.counts[a].get(k, 0) / n - self.counts[b].get(k, 0) / m) > far:
                    return False
                if k in self.to[a] and k in self.to[b]:
                    todo.append((self.to[a][k], self.to[b][k]))
        return True

    def _unite(self, a: int, b: int) -> None:
        """Makes one state of two, and of each two that they lead to by the same class."""
        todo = [(a, b)]
        while todo:
            a, b = (self._find(q) for q in todo.pop())
            if a == b:
                continue
            self.root[b] = a
            self.ends[a] += self.ends[b]
            for mine, other in ((self.counts[a], self.counts[b]), (self.chars[a], self.chars[b])):
                for k, n in other.items():
                    mine[k] = mine.get(k, 0) + n
            for k, q in self.to[b].items():
                if k in self.to[a]:
                    todo.append((self.to[a][k], q))
                else:
                    self.to[a][k] = q

    def _next(self, states: list[int]) -> list[int]:
        return list(dict.fromkeys(self._find(q) for s in states for _, q in sorted(self.to[s].items())))

    def _merge_depths(self) -> None:
        layer = [0]
        while layer:
            kept: list[int] = []
            for b in sorted(self._next(layer), key=lambda q: -self._total(q)):
                if self._find(b) == b:
                    a = next((a for a in kept if self._alike(a, b)), None)
                    if a is None:
                        kept.append(b)
                    else:
                        self._unite(a, b)
            layer = kept

    def _merge_across(self) -> None:
        red, layer = [], [0]
        seen = {0}
        while layer:
            for b in layer:
                if self._find(b) != b:
                    continue
                known = self._total(b) >= self.evidence
                a = next((a for a in map(self._find, red) if known and self._total(a) >= self.evidence and self._alike(a, b)), None)
                if a is None:
                    red.append(b)
                else:
                    self._unite(a, b)
            layer = [q for q in self._next([self._find(q) for q in layer]) if q not in seen]
            seen |= set(layer)

    def _reached(self) -> list[int]:
        out, layer = [self._find(0)], [self._find(0)]
        while layer:
            layer = [q for q in self._next(layer) if q not in out]
            out += layer
        return out

    def _compile(self) -> None:
        """For each state: a character's log probability and next state, those of an unseen class, and that of the end. A class never
        seen in a state counts as half an example among all classes and leaves the state as it is."""
        known = max(2, len({k for q in self.kept for k in self.counts[q]}))
        self.steps: dict[int, dict[str, tuple[float, int]]] = {}
        self.unseen: dict[int, float] = {}
        self.end: dict[int, float] = {}
        for q in self.kept:
            n = self._total(q) + 0.5 * (known + 1)
            self.steps[q] = {}
            for k, m in self.counts[q].items():
                for c in CLASSES.get(k, k):
                    share = (self.chars[q].get(c, 0) + 1) / (m + len(CLASSES.get(k, k)))
                    self.steps[q][c] = (math.log((m + 0.5) / n * share), self._find(self.to[q][k]))
            self.unseen[q] = math.log(0.5 / n)
            self.end[q] = math.log((self.ends[q] + 0.5) / n)

    def score(self, s: str) -> float:
        """Natural log of the string's probability."""
        q, total = self.kept[0], 0.0
        for c in folded(s):
            step = self.steps[q].get(c)
            if step is None:
                total += self.unseen[q] - math.log(len(CLASSES.get(_CLASS.get(c, c), c)))
            else:
                total += step[0]
                q = step[1]
        return total + self.end[q]
