"""Invisible XML grammars: text to rules."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

from ..sources.brace import ParseError

_NAME = re.compile(r"[A-Za-z_·À-￿][\w·]*(?:[.\-]+[\w·]+)*-?")
_MARKS = "^@-*"


@dataclass(frozen=True)
class Set:
    """Characters in ranges or Unicode categories, or all others."""

    ranges: tuple[tuple[str, str], ...] = ()
    categories: tuple[str, ...] = ()
    negated: bool = False
    #: What is known of characters already.
    known: dict[str, bool] = field(default_factory=dict, compare=False, repr=False)

    def __contains__(self, c: str) -> bool:
        if c not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            self.known[c] = self._has(c)
        return self.known[c]

    def _has(self, c: str) -> bool:
        hit = any(a <= c <= b for a, b in self.ranges)
        if not hit and self.categories:
            k = unicodedata.category(c)
            hit = any(k == x or (len(x) == 1 and k[0] == x) or (x == "LC" and k in ("Lu", "Ll", "Lt")) for x in self.categories)
        return hit != self.negated


@dataclass(frozen=True)
class Term:
    """kind: rule, text, set, insert or not (a text or set that must not come next)."""

    kind: str
    value: object
    mark: str = ""
    alias: str | None = None


@dataclass
class Rule:
    name: str
    mark: str
    alias: str | None
    alternatives: list[tuple[Term, ...]] = field(default_factory=list)
    cost: int = 0
    helper: bool = False


@dataclass
class Grammar:
    rules: dict[str, Rule]
    start: str

    @property
    def costly(self) -> bool:
        return any(r.cost for r in self.rules.values())


class _Reader:
    def __init__(self, source: str):
        self.s, self.i = source.removeprefix("﻿"), 0
        self.rules: dict[str, Rule] = {}
        self.first: str | None = None
        self.helpers = 0

    def fail(self, message: str) -> ParseError:
        return ParseError(message, self.s, self.i)

    def space(self) -> None:
        while self.i < len(self.s):
            if self.s[self.i].isspace():
                self.i += 1
            elif self.s[self.i] == "{":
                depth = 0
                while self.i < len(self.s):
                    depth += (self.s[self.i] == "{") - (self.s[self.i] == "}")
                    self.i += 1
                    if not depth:
                        break
                else:
                    raise self.fail("comment is not closed")
            else:
                return

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def eat(self, text: str) -> bool:
        if self.peek(len(text)) == text:
            self.i += len(text)
            self.space()
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            raise self.fail(f"expected {text!r}")

    def name(self) -> str:
        m = _NAME.match(self.s, self.i)
        if not m:
            raise self.fail("expected a name")
        self.i = m.end()
        self.space()
        return m[0]

    def mark(self) -> str:
        m = self.peek() if self.peek() and self.peek() in _MARKS else ""
        if m:
            self.i += 1
            self.space()
        return m

    def string(self) -> str:
        q = self.peek()
        out = []
        self.i += 1
        while True:
            c = self.peek()
            if not c or c == "\n":
                raise self.fail("string is not closed")
            if c == q:
                if self.peek(2) != q * 2:
                    break
                self.i += 1
            out.append(c)
            self.i += 1
        self.i += 1
        self.space()
        return "".join(out)

    def encoded(self) -> str:
        m = re.compile(r"#([0-9a-fA-F]+)").match(self.s, self.i)
        if not m:
            raise self.fail("expected hexadecimal digits")
        self.i = m.end()
        self.space()
        return chr(int(m[1], 16))

    def char_or_string(self) -> str:
        return self.encoded() if self.peek() == "#" else self.string()

    def charset(self) -> Set:
        negated = self.eat("~")
        self.need("[")
        ranges, categories = [], []
        while not self.eat("]"):
            c = self.peek()
            if c and c in "\"'#":
                a = self.char_or_string()
                if self.eat("-"):
                    b = self.char_or_string()
                    if len(a) != 1 or len(b) != 1 or a > b:
                        raise self.fail("invalid range")
                    ranges.append((a, b))
                else:
                    ranges += [(x, x) for x in a]
            elif m := re.compile(r"LC|[A-Z][a-z]?").match(self.s, self.i):
                categories.append(m[0])
                self.i = m.end()
                self.space()
            else:
                raise self.fail("invalid character set")
            if not (self.eat(";") or self.eat("|") or self.eat(",")) and self.peek() != "]":
                raise self.fail("expected ;, | or ]")
        return Set(tuple(ranges), tuple(categories), negated)

    def helper(self, alternatives: list[tuple[Term, ...]]) -> Term:
        self.helpers += 1
        name = f"|{self.helpers}"
        self.rules[name] = Rule(name, "-", None, alternatives, helper=True)
        return Term("rule", name, "-")

    def alternatives(self) -> list[tuple[Term, ...]]:
        out = [self.sequence()]
        while self.eat("|") or self.eat(";"):
            out.append(self.sequence())
        return out

    def sequence(self) -> tuple[Term, ...]:
        out: list[Term] = []
        while self.peek() and self.peek() not in "|;.)":
            out.append(self.repeated())
            if not self.eat(","):
                break
        return tuple(out)

    def repeated(self) -> Term:
        """Repetitions become left-recursive helper rules."""
        t = self.factor()
        if self.eat("?"):
            return self.helper([(), (t,)])
        op = next((o for o in ("++", "**", "+", "*") if self.eat(o)), None)
        if op is None:
            return t
        sep = (self.factor(),) if len(op) == 2 else ()
        many = self.helper([])
        self.rules[many.value].alternatives = [(t,), (many, *sep, t)]
        return many if op[0] == "+" else self.helper([(), (many,)])

    def factor(self) -> Term:
        if self.eat("("):
            alternatives = self.alternatives()
            self.need(")")
            return self.helper(alternatives)
        if self.eat("!"):
            c = self.peek()
            return Term("not", self.charset() if c in "[~" else self.char_or_string())
        if self.eat("+"):
            return Term("insert", self.char_or_string())
        mark = self.mark()
        c = self.peek()
        if c and c in "\"'#":
            return Term("text", self.char_or_string(), mark)
        if c and c in "[~":
            return Term("set", self.charset(), mark)
        name = self.name()
        alias = self.name() if self.eat(">") else None
        return Term("rule", name, mark, alias)

    def rule(self) -> None:
        mark = self.mark()
        name = self.name()
        alias = self.name() if self.eat(">") else None
        cost = 0
        if self.eat("="):
            while self.eat("<"):
                cost += 1
        elif not self.eat(":"):
            raise self.fail("expected = or :")
        rule = self.rules.get(name)
        if rule is not None:
            raise self.fail(f"rule {name} is given twice")
        self.rules[name] = Rule(name, mark, alias, [], cost)
        self.first = self.first or name
        self.rules[name].alternatives = self.alternatives()
        self.need(".")

    def grammar(self) -> Grammar:
        self.space()
        if re.compile(r"ixml\s+version").match(self.s, self.i):
            self.i = self.s.index(".", self.s.index('"', self.s.index('"', self.i) + 1)) + 1
            self.space()
        while self.i < len(self.s):
            self.rule()
        if self.first is None:
            raise self.fail("a grammar needs a rule")
        for r in list(self.rules.values()):
            for a in r.alternatives:
                for t in a:
                    if t.kind == "rule" and t.value not in self.rules:
                        raise ParseError(f"rule {t.value} is not given", self.s, 0)
        return Grammar(self.rules, self.first)


def parse(source: str) -> Grammar:
    return _Reader(source).grammar()
