"""Earley parsing of texts by a grammar, and trees of the parses."""

from __future__ import annotations

import heapq
import itertools
import sys
from dataclasses import dataclass

from ..model import Node, document, qualify
from .front import Grammar, Term

#: Texts up to so many characters have their trees remembered, so many of them: columns of short texts repeat.
REMEMBERED = (200, 2000)
NAMESPACE = "http://invisiblexml.org/NS"
sys.setrecursionlimit(max(sys.getrecursionlimit(), 200_000))  # parses nest as deep as lists are long


@dataclass
class Failure(ValueError):
    """Where no parse goes on: 1-based position, line and column."""

    source: str
    at: int

    def __post_init__(self) -> None:
        self.line = self.source.count("\n", 0, self.at) + 1
        self.column = self.at - (self.source.rfind("\n", 0, self.at) + 1) + 1
        self.excerpt = self.source.split("\n")[self.line - 1]
        self.info = f"ixml:{self.line}:{self.column}: syntax error\n{self.excerpt}\n{' ' * (self.column - 1)}^"
        super().__init__(self.info)


class Machine:
    """A grammar made ready; one can parse any number of texts."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        self.alternatives: list[tuple[str, tuple[Term, ...]]] = []
        self.of: dict[str, list[int]] = {}
        self.seen: dict[tuple[str, bool], Node] = {}
        for name, rule in grammar.rules.items():
            self.of[name] = []
            for a in rule.alternatives:
                self.of[name].append(len(self.alternatives))
                self.alternatives.append((name, a))
        self.first, self.empty = self._starts()
        terms = [t for _, a in self.alternatives for t in a]
        self.letters = {c for t in terms if t.kind == "text" for c in t.value}
        self.sets = [t.value for t in terms if t.kind == "set"]
        self.looks_ahead = any(t.kind == "not" for t in terms)
        self.legible: dict[str, bool] = {}
        #: Rules that repeat one set, which match a span in one way.
        self.runs = {name: r.alternatives[0][0] for name, r in grammar.rules.items() if len(r.alternatives) == 2 and len(r.alternatives[0]) == 1 and r.alternatives[0][0].kind == "set" and r.alternatives[1] == (Term("rule", name, "-"), r.alternatives[0][0])}
        self.ready: dict[tuple[str, str], list[int]] = {}

    def _starts(self) -> tuple[list[list[Term]], list[bool]]:
        """For each alternative the terminals that it can begin with, and whether it can match nothing, by repeating until nothing changes."""
        none = {name: False for name in self.of}
        heads: list[dict[int, Term]] = [{} for _ in self.alternatives]
        empty = [False] * len(self.alternatives)
        changed = True
        while changed:
            changed = False
            for k, (name, terms) in enumerate(self.alternatives):
                before = len(heads[k]), empty[k]
                for t in terms:
                    if t.kind == "rule":
                        for a in self.of[t.value]:
                            heads[k] |= heads[a]
                        if not none[t.value]:
                            break
                    elif t.kind not in ("insert", "not") and not (t.kind == "text" and not t.value):
                        heads[k][id(t)] = t
                        break
                else:
                    empty[k] = none[name] = True
                changed |= before != (len(heads[k]), empty[k])
        return [list(h.values()) for h in heads], empty

    def begun(self, name: str, char: str) -> list[int]:
        """The alternatives of a rule that can match nothing or begin with a character."""
        key = (name, char)
        if key not in self.ready:
            if len(self.ready) > 50_000:
                self.ready.clear()
            fits = lambda t: bool(char) and (t.value[0] == char if t.kind == "text" else char in t.value)
            self.ready[key] = [a for a in self.of[name] if self.empty[a] or any(map(fits, self.first[a]))]
        return self.ready[key]

    def readable(self, text: str) -> str | None:
        """A text without the characters that no terminal reads, which go in any case: where it parses, nothing else has to. None if there are none such, or terminals look ahead."""
        rest = None if self.looks_ahead else "".join(c for c in text if self._reads(c))
        return rest if rest != text else None

    def _reads(self, char: str) -> bool:
        if char not in self.legible:
            if len(self.legible) > 50_000:
                self.legible.clear()
            self.legible[char] = char in self.letters or any(char in s for s in self.sets)
        return self.legible[char]

    @staticmethod
    def _ends(t: Term, text: str, i: int) -> int:
        """Where a terminal that begins at ``i`` ends, or -1."""
        if t.kind == "text":
            return i + len(t.value) if text.startswith(t.value, i) else -1
        if t.kind == "set":
            return i + 1 if i < len(text) and text[i] in t.value else -1
        if t.kind == "insert":
            return i
        v = t.value
        hit = text.startswith(v, i) if isinstance(v, str) else i < len(text) and text[i] in v
        return -1 if hit else i

    def recognise(self, text: str) -> dict[str, dict[int, set[int]]]:
        """For each rule and end, the starts of its matches; Failure if the text isn't one of the grammar's."""
        n = len(text)
        sets: list[dict] = [{} for _ in range(n + 1)]
        waiting: list[dict[str, list]] = [{} for _ in range(n + 1)]
        done: dict[str, dict[int, set[int]]] = {name: {} for name in self.of}
        starts = [(a, 0, 0) for a in self.begun(self.grammar.start, text[:1])]
        sets[0] = dict.fromkeys(starts)
        far = 0
        for i in range(n + 1):
            todo = list(sets[i])
            here, wait = sets[i], waiting[i]
            if todo:
                far = i
            predicted: set[str] = set()
            if i == 0:
                predicted.add(self.grammar.start)
            empty: set[str] = set()
            while todo:
                a, dot, origin = todo.pop()
                name, terms = self.alternatives[a]
                if dot == len(terms):
                    found = done[name].setdefault(i, set())
                    if origin in found:
                        continue
                    found.add(origin)
                    if origin == i:
                        empty.add(name)
                    for b, d, o in waiting[origin].get(name, ()):
                        item = (b, d + 1, o)
                        if item not in here:
                            here[item] = None
                            todo.append(item)
                    continue
                t = terms[dot]
                if t.kind == "rule":
                    wait.setdefault(t.value, []).append((a, dot, origin))
                    if t.value not in predicted:
                        predicted.add(t.value)
                        for b in self.begun(t.value, text[i : i + 1]):
                            item = (b, 0, i)
                            if item not in here:
                                here[item] = None
                                todo.append(item)
                    if t.value in empty:
                        item = (a, dot + 1, origin)
                        if item not in here:
                            here[item] = None
                            todo.append(item)
                    continue
                end = self._ends(t, text, i)
                if end == i:
                    item = (a, dot + 1, origin)
                    if item not in here:
                        here[item] = None
                        todo.append(item)
                elif end > i:
                    sets[end][(a, dot + 1, origin)] = None
            sets[i] = {}
        if 0 not in done[self.grammar.start].get(n, ()):
            raise Failure(text, far)
        return done

    def parse(self, text: str, every: bool = False) -> Node:
        """The document of a text: the first parse, or with costs a cheapest one.

        Of an ambiguous text the root says so in an attribute; with ``every`` all parses stand under AMBIGUOUS, which has an
        attribute ``cut`` if a rule has over 1000 ways over a span and the others were left out.
        """
        key = (text, every)
        found = self.seen.pop(key, None) or _Builder(self, text, every).document()
        if len(text) <= REMEMBERED[0]:
            self.seen[key] = found
            if len(self.seen) > REMEMBERED[1]:
                del self.seen[next(iter(self.seen))]
            return _copy(found)
        return found


class _Builder:
    def __init__(self, machine: Machine, text: str, every: bool):
        self.m, self.text, self.every = machine, text, every
        self.done = machine.recognise(text)
        self.memo: dict = {}
        self.open: set = set()
        self.costly = machine.grammar.costly
        self.ambiguous = self.cut = False
        self.limit = 1000 if every else 2
        self.depths: dict = {}
        self.lowest = 1 << 30

    def begins(self, t: Term, dot: int, i: int, j: int) -> list[int]:
        """Where the ``dot``-th term of an alternative that begins at i can begin to end at j, from the right."""
        if t.kind == "rule":
            starts = self.done[t.value].get(j, ())
            return [i] if dot == 1 and i in starts else [] if dot == 1 else sorted((s for s in starts if s >= i), reverse=True)
        if t.kind in ("insert", "not"):
            return [j] if self.m._ends(t, self.text, j) == j else []
        s = j - (len(t.value) if t.kind == "text" else 1)
        return [s] if s >= i and self.m._ends(t, self.text, s) == j else []

    def splits(self, a: int, dot: int, i: int, j: int) -> tuple[int, list[list[tuple[Term, int, int]]]]:
        """The least cost at which the first ``dot`` terms of an alternative span i to j, and the ways of that cost, from the right.

        Without costs all ways cost 0. Only ways of equal cost are ever left out.
        """
        if not dot:
            return (0, [[]]) if i == j else (1 << 30, [])
        key = (a, dot, i, j)
        if key in self.memo:
            return self.memo[key]
        outer, self.lowest = self.lowest, 1 << 30
        t = self.m.alternatives[a][1][dot - 1]
        best, out = 1 << 30, []
        for s in self.begins(t, dot, i, j):
            c, before = self.splits(a, dot - 1, i, s)
            if before and t.kind == "rule" and self.costly:
                c += self.cost(t.value, s, j)[0]
            if not before or c > best or c >= 1 << 30:
                continue
            if c < best:
                best, out = c, []
            out += [[*rest, (t, s, j)] for rest in before[: self.limit + 1 - len(out)]]
            if len(out) > self.limit and not self.costly:
                break
        self.keep(key, (best, out))
        self.lowest = min(outer, self.lowest)
        return best, out

    def keep(self, key: tuple, value: tuple) -> None:
        """Remembers a result, unless it was found within a span that is still open and left out there."""
        if self.lowest >= len(self.depths):
            self.memo[key] = value

    def cheapest(self, name: str, i: int, j: int) -> tuple[int, list]:
        """The least cost of a rule's alternatives over a span, without its own, and the ways of that cost."""
        best, out = 1 << 30, []
        for a in self.m.of[name]:
            c, ways = self.splits(a, len(self.m.alternatives[a][1]), i, j)
            if c < best:
                best, out = c, []
            if c == best:
                out = out + ways
        self.cut |= len(out) > self.limit
        return best, out[: self.limit]

    def cost(self, name: str, i: int, j: int) -> tuple[int, list]:
        """The least cost of a rule's parses over a span, and its ways of that cost."""
        key = ("cost", name, i, j)
        if key in self.memo:
            return self.memo[key]
        if key in self.depths:
            self.lowest = min(self.lowest, self.depths[key])
            return 1 << 30, []
        outer, self.lowest = self.lowest, 1 << 30
        self.depths[key] = len(self.depths)
        best, kept = self.cheapest(name, i, j)
        del self.depths[key]
        found = best + self.m.grammar.rules[name].cost, kept
        self.keep(key, found)
        if self.lowest >= len(self.depths):  # what was left out was this span itself
            self.lowest = 1 << 30
        self.lowest = min(outer, self.lowest)
        return found

    def children(self, name: str, i: int, j: int) -> list[list[Node]]:
        """Contents of a rule over a span: one list, or with ``every`` one for each parse. A span inside itself is left out."""
        if name in self.m.runs:
            return [[Node("text", value=self.text[i:j])]] if self.m.runs[name].mark != "-" else [[]]
        key = (name, i, j)
        if key in self.open:
            return []
        self.open.add(key)
        ways = self.cost(name, i, j)[1] if self.costly else self.cheapest(name, i, j)[1]
        if len(ways) > 1:
            self.ambiguous = True
        out: list[list[Node]] = []
        for way in ways:
            partial: list[list[Node]] = [[]]
            for t, s, e in way:
                more = self.term(t, s, e)
                partial = [[*x, *(_copy(n) for n in y)] if self.every else [*x, *y] for x in partial for y in more]
            out += partial
            if out and not self.every:
                break
        self.open.discard(key)
        return out

    def term(self, t: Term, s: int, e: int) -> list[list[Node]]:
        if t.kind == "insert":
            return [[Node("text", value=t.value)]]
        if t.kind != "rule":
            return [[Node("text", value=self.text[s:e])]] if s < e and t.mark != "-" else [[]]
        rule = self.m.grammar.rules[t.value]
        mark = t.mark or rule.mark
        inner = self.children(t.value, s, e)
        if rule.mark == "*" and len(inner) > 1:
            inner = [[n for x in inner for n in x]]
        if mark == "-":
            return inner
        name = t.alias or rule.alias or rule.name
        if mark == "@":
            return [[Node("attribute", name, value="".join(_flat(n) for n in x))] for x in inner]
        return [[_element(name, x)] for x in inner]

    def document(self) -> Node:
        g = self.m.grammar
        rule = g.rules[g.start]
        bodies = self.term(Term("rule", g.start), 0, len(self.text))
        if self.every and len(bodies) > 1:
            root = Node("element", "AMBIGUOUS")
            if self.cut:
                root.add(Node("attribute", "cut", value="1000"))
            for b in bodies:
                for n in b:
                    root.add(n)
            tops = [root]
        else:
            tops = bodies[0] if bodies else [Node("element", rule.name)]
        if self.ambiguous and tops and tops[0].kind == "element":
            tops[0].attrs.insert(0, Node("attribute", "state", value="ambiguous", parent=tops[0]))
            tops[0].attrs.insert(1, Node("namespace", "ixml", value=NAMESPACE, parent=tops[0]))
        doc = document(*_merged(tops))
        qualify(doc)
        return doc


def _copy(n: Node) -> Node:
    c = Node(n.kind, n.name, n.prefix, n.value, n.ns_uri)
    for x in [*n.attrs, *n.children]:
        c.add(_copy(x))
    return c


def _flat(n: Node) -> str:
    return n.value or "" if n.kind in ("text", "attribute") else "".join(_flat(x) for x in [*n.attrs, *n.children])


def _merged(nodes: list[Node]) -> list[Node]:
    out: list[Node] = []
    for n in nodes:
        if n.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Node("text", value=(out[-1].value or "") + (n.value or ""))
        else:
            out.append(n)
    return out


def _element(name: str, nodes: list[Node]) -> Node:
    e = Node("element", name)
    for n in nodes:
        if n.kind == "attribute" and e.attr(n.name or "") is None:
            e.add(n)
    for n in _merged([n for n in nodes if n.kind != "attribute"]):
        e.add(n)
    return e


def failure_document(f: Failure) -> Node:
    """The document that stands for a text that doesn't parse."""
    root = Node("element", "ixml")
    root.add(Node("attribute", "state", "ixml", "failed"))
    root.add(Node("namespace", "ixml", value=NAMESPACE))
    for name, value in (("info", f.info), ("line", f.line), ("column", f.column), ("pos", f.at + 1)):
        root.add(Node("element", name)).add(Node("text", value=str(value)))
    doc = document(root)
    qualify(doc)
    return doc


def kept_characters(machine: Machine, text: str) -> list[int] | None:
    """The places of the characters of a text that is left when the fewest are taken out for it to parse; None if nothing helps.

    Items are found in the order of the characters taken out within them, cheapest first, so each is final when it is first
    met. A character can go in front of any that is read, inside a literal too, and at the end.
    """
    n = len(text)
    alternatives, of, start = machine.alternatives, machine.of, machine.grammar.start
    cost: dict[tuple, int] = {}
    back: dict[tuple, tuple] = {}
    waiting: dict[tuple[str, int], list[tuple]] = {}
    ended: dict[tuple[str, int], list[tuple]] = {}
    done: set[tuple] = set()
    heap: list[tuple[int, int, tuple]] = []
    order = itertools.count()

    def put(item: tuple, c: int, how: tuple) -> None:
        if c < cost.get(item, 1 << 30):
            cost[item], back[item] = c, how
            heapq.heappush(heap, (c, next(order), item))

    for a in of[start]:
        put((a, 0, 0, 0, 0), 0, ())
    while heap:
        c, _, item = heapq.heappop(heap)
        if item in done:
            continue
        done.add(item)
        a, dot, inside, origin, end = item  # inside: characters of a literal that are read already
        name, terms = alternatives[a]
        if dot == len(terms):
            if name == start and origin == 0:
                if end == n:
                    return sorted(_read(item, back))
                put((a, dot, inside, origin, end + 1), c + 1, (item,))
            ended.setdefault((name, origin), []).append(item)
            for w in waiting.get((name, origin), ()):
                put((w[0], w[1] + 1, 0, w[3], end), cost[w] + c, (w, item))
            continue
        t = terms[dot]
        if t.kind == "rule":
            key = (t.value, end)
            if key not in waiting:
                for b in of[t.value]:
                    put((b, 0, 0, end, end), 0, ())
            waiting.setdefault(key, []).append(item)
            for d in ended.get(key, ()):
                put((a, dot + 1, 0, origin, d[4]), c + cost[d], (item, d))
            continue
        if t.kind in ("insert", "not"):
            if machine._ends(t, text, end) == end:
                put((a, dot + 1, 0, origin, end), c, (item,))
            continue
        if t.kind == "text" and inside == len(t.value):
            put((a, dot + 1, 0, origin, end), c, (item,))
        elif end < n:
            if t.kind == "set" and text[end] in t.value:
                put((a, dot + 1, 0, origin, end + 1), c, (item, end))
            elif t.kind == "text" and text[end] == t.value[inside]:
                put((a, dot, inside + 1, origin, end + 1), c, (item, end))
            put((a, dot, inside, origin, end + 1), c + 1, (item,))
    return None


def _read(item: tuple, back: dict[tuple, tuple]) -> list[int]:
    """The places that an item has read, along the way it was found."""
    out, stack = [], [item]
    while stack:
        for step in back[stack.pop()]:
            if isinstance(step, int):
                out.append(step)
            else:
                stack.append(step)
    return out
