"""Brace syntax: lexer and parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from ..functions.trimming import trim
from ..model import Node, char_of, document, qualify

_SPACE = re.compile(r"[ \r\n]+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.#-]*")
_BARE = re.compile(r"[^\s(){}'\"\t]+")
_ENTITY = re.compile(r"&(#?[A-Za-z0-9_.-]+)(;?)")
_HEX = re.compile(r"#?[0-9a-f]+\Z")


class ParseError(ValueError):
    """What is wrong, and where: message, line and column from 1, with the line and a caret below."""

    def __init__(self, message: str, source: str, at: int):
        at = min(at, len(source))
        self.message = message
        self.line = source.count("\n", 0, at) + 1
        start = source.rfind("\n", 0, at) + 1
        self.column = at - start + 1
        end = source.find("\n", at)
        self.excerpt = source[start : end if end >= 0 else len(source)]
        super().__init__(f"{self.line}:{self.column}: {message}\n{self.excerpt}\n{' ' * (self.column - 1)}^")


@dataclass(frozen=True, slots=True)
class Token:
    kind: str
    text: str
    at: int


class Lexer:
    """Tokens of a text, white space and comments among them."""

    def __init__(self, source: str):
        self.s = source
        self.i = 0

    def fail(self, message: str, at: int | None = None) -> ParseError:
        return ParseError(message, self.s, self.i if at is None else at)

    def _take(self, kind: str, end: int) -> Token:
        t = Token(kind, self.s[self.i : end], self.i)
        self.i = end
        return t

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def space(self) -> Iterator[Token]:
        """White space and comments here, if any."""
        while True:
            if m := _SPACE.match(self.s, self.i):
                yield self._take("whitespace", m.end())
            elif self.peek() == "\t":
                raise self.fail("unexpected tab character")
            elif self.peek(2) in ("//", "/*"):
                yield from self._comments()
            else:
                return

    def _comments(self) -> Iterator[Token]:
        n = 0
        while self.s[self.i + n : self.i + n + 1] == "/":
            n += 1
        if self.s[self.i + n : self.i + n + 1] != "*":
            end = self.s.find("\n", self.i)
            yield self._take("comment", len(self.s) if end < 0 else end + 1)
            return
        close = re.compile(r"\*" + "/" * n)
        kind, start = "comment", self.i + n + 1
        while True:
            m = close.search(self.s, start)
            if not m:
                raise self.fail("comment is not closed")
            if self.s[m.end() : m.end() + 1] == "/":
                raise self.fail("comment is closed with too many slashes", m.start())
            more = self.s[m.end() : m.end() + 1] == "*"
            yield self._take(kind, m.end())
            if not more:
                return
            kind, start = "comment_continuation", self.i + 1

    def quote(self, kind: str) -> Token:
        q = self.peek()
        n = len(self.s) - self.i - len(self.s[self.i :].lstrip(q)) if self.peek(3) == q * 3 else 1 + (self.peek(2) == q * 2)
        if n == 2:
            return self._take(kind, self.i + 2)
        end = self.s.find(q * n, self.i + n)
        if end < 0:
            raise self.fail("quote is not closed")
        if self.s[end + n : end + n + 1] == q:
            raise self.fail("quote closed with too many quotes", end)
        return self._take(kind, end + n)

    def entity(self, kind: str) -> Token:
        m = _ENTITY.match(self.s, self.i)
        if not m or (not m[2] and not _HEX.match(m[1])):
            raise self.fail("entity is not closed")
        return self._take(kind, m.end())

    def value(self, what: str) -> Iterator[Token]:
        """A value after an equals sign; ``what``: element or attr."""
        c = self.peek()
        if c and c in "'\"":
            yield self.quote(f"{what}_value_quote")
        elif c == "&":
            yield self.entity(f"{what}_value_entity")
        elif c == "(":
            yield self._take("cpar_left", self.i + 1)
            yield from self.space()
            while self.peek() != ")":
                c = self.peek()
                if c and c in "'\"":
                    yield self.quote(f"{what}_value_compound_quote")
                elif c == "&":
                    yield self.entity(f"{what}_value_compound_entity")
                else:
                    raise self.fail("compound may hold only quotes and entities" if c else "compound is not closed")
                yield from self.space()
            yield self._take("cpar_right", self.i + 1)
        else:
            if c in ("", "=", "&") or self.peek(2) in ("//", "/*") or not (m := _BARE.match(self.s, self.i)):
                raise self.fail("expected a value")
            yield self._take(f"{what}_value_text", m.end())

    def _name(self, ns_kind: str, kind) -> Iterator[Token]:
        """A name with or without prefix; ``kind`` is asked when the end of the name is known."""
        m = _NAME.match(self.s, self.i)
        if not m:
            raise self.fail("invalid name")
        if self.s[m.end() : m.end() + 1] == ":":
            yield self._take(ns_kind, m.end())
            yield self._take("ns_colon", self.i + 1)
            m = _NAME.match(self.s, self.i)
            if not m:
                raise self.fail("expected a name after the colon")
        yield self._take(kind(m.end()), m.end())

    def attributes(self) -> Iterator[Token]:
        yield self._take("apar_left", self.i + 1)
        yield from self.space()
        while self.peek() != ")":
            if not self.peek():
                raise self.fail("attributes are not closed")
            m = _NAME.match(self.s, self.i)
            if m and m[0] == "xmlns":
                yield self._take("ns_declaration", m.end())
                if self.peek() == ":":
                    yield self._take("ns_colon", self.i + 1)
                    m = _NAME.match(self.s, self.i)
                    if not m:
                        raise self.fail("expected a name after the colon")
                    yield self._take("attr_ns", m.end())
            else:
                yield from self._name("attr_ns", lambda end: "attr_key")
            yield from self.space()
            if self.peek() == "=":
                yield self._take("equals", self.i + 1)
                yield from self.space()
                yield from self.value("attr")
                yield from self.space()
        yield self._take("apar_right", self.i + 1)

    def _kind(self, end: int) -> str:
        return "element_key" if self.s[end:].lstrip(" \r\n")[:1] == "=" else "element_name"

    def __iter__(self) -> Iterator[Token]:
        depth: list[int] = []
        while True:
            yield from self.space()
            c = self.peek()
            if not c:
                if depth:
                    raise self.fail("brace is not closed", depth[-1])
                return
            if c == "}":
                if not depth:
                    raise self.fail("unexpected closing brace")
                depth.pop()
                yield self._take("brace_right", self.i + 1)
            elif c in "'\"":
                yield self.quote("quote")
            elif c == "&":
                yield self.entity("entity")
            elif c == "!" or c == "?":
                m = _NAME.match(self.s, self.i + 1)
                if not m or (c == "!" and m[0] != "DOCTYPE"):
                    raise self.fail("invalid name")
                yield self._take("element_key", m.end())
                yield from self.space()
                if self.peek() == "=":
                    yield self._take("equals", self.i + 1)
                    yield from self.space()
                    yield from self.value("element")
            elif _NAME.match(self.s, self.i):
                yield from self._name("element_ns", self._kind)
                yield from self.space()
                if self.peek() == "(":
                    yield from self.attributes()
                    yield from self.space()
                if self.peek() == "=":
                    yield self._take("equals", self.i + 1)
                    yield from self.space()
                    yield from self.value("element")
                elif self.peek() == "{":
                    depth.append(self.i)
                    yield self._take("brace_left", self.i + 1)
            else:
                raise self.fail("unexpected character")


def unquote(quote: str, column: int = 1, no_trim: bool = False) -> str:
    """The content of a quote with its quote characters."""
    q = quote[0]
    n = len(quote) - len(quote.lstrip(q))
    if n == len(quote):
        return ""
    inner = quote[n : len(quote) - n]
    return inner if no_trim else trim(inner)


def uncomment(comment: str) -> str:
    """The content of a comment with its slashes."""
    if comment.startswith("*"):
        inner = comment[1 : comment.rindex("*")]
    elif comment.lstrip("/").startswith("*"):
        inner = comment.lstrip("/")[1 : comment.lstrip("/").rindex("*")]
    else:
        return comment.lstrip("/").strip(" \r\n\t")
    if "\n" not in inner:
        return inner.strip(" \t\r")
    return trim(inner[1:] if inner[:1] == " " else inner, comment=True)


def tokenize(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, line, column) of all tokens, lines and columns from 1."""
    out, line, start, seen = [], 1, 0, 0
    for t in Lexer(source):
        new = source.count("\n", seen, t.at)
        if new:
            line, start = line + new, source.rfind("\n", 0, t.at) + 1
        seen = t.at
        out.append((t.kind, t.text, line, t.at - start + 1))
    return out


def contents(source: str) -> list[tuple[str, str]]:
    """(kind, decoded text) of the quotes, values, entities and comments of a text."""
    out = []
    for t in Lexer(source):
        if t.kind.startswith("comment"):
            out.append(("comment", uncomment(t.text)))
        elif "quote" in t.kind:
            out.append(("quote", unquote(t.text)))
        elif "entity" in t.kind:
            out.append(("entity", t.text.strip("&;")))
        elif t.kind.endswith("value_text"):
            out.append(("value", t.text))
    return out


def parse(source: str, merge: bool = True) -> Node:
    """The tree of a text. ``merge``: adjacent text and character entities become one text node."""
    source = source.removeprefix("﻿")
    doc = document()
    stack = [doc]
    target: Node = doc  # what a value goes to
    last: Node | None = None
    prefix: str | None = None
    attribute: Node | None = None
    for t in Lexer(source):
        k = t.kind
        if k in ("whitespace", "equals", "cpar_left", "cpar_right", "apar_left", "ns_colon"):
            continue
        if k in ("element_ns", "attr_ns"):
            if attribute is not None and attribute.kind == "namespace" and not attribute.name:
                attribute.name = t.text
            else:
                prefix = t.text
        elif k in ("element_name", "element_key"):
            if t.text[0] in "!?":
                last = stack[-1].add(Node("doctype" if t.text[0] == "!" else "pi", t.text[1:]))
            else:
                last = stack[-1].add(Node("element", t.text, prefix))
            prefix, attribute, target = None, None, last
        elif k == "ns_declaration":
            attribute = target = last.add(Node("namespace", ""))
        elif k == "attr_key":
            if last.attr(f"{prefix}:{t.text}" if prefix else t.text):
                raise ParseError("attribute is given twice", source, t.at)
            attribute = target = last.add(Node("attribute", t.text, prefix))
            prefix = None
        elif k == "apar_right":
            attribute, target = None, last
        elif k == "brace_left":
            stack.append(last)
        elif k == "brace_right":
            stack.pop()
        elif k.startswith("comment"):
            body = uncomment(t.text)
            if k == "comment_continuation":
                stack[-1].children[-1].value += "\n" + body
            else:
                stack[-1].add(Node("comment", value=body))
        else:
            inside = stack[-1] if k in ("quote", "entity") else target
            if "entity" in k:
                name = t.text[1:].rstrip(";")
                c = char_of(name) if name[0] == "#" and merge else None
                _append(inside, c, merge, name)
            else:
                _append(inside, unquote(t.text) if "quote" in k else t.text, merge)
    qualify(doc)
    return doc


def _append(to: Node, value: str | None, merge: bool, entity: str | None = None) -> None:
    if to.kind in ("namespace", "doctype", "pi") or (to.kind == "attribute" and value is not None and not to.children):
        to.value = (to.value or "") + (value if value is not None else f"&{entity};")
    elif value is None:
        if to.kind == "attribute" and to.value is not None:
            to.add(Node("text", value=to.value))
            to.value = None
        to.add(Node("entity", entity))
    elif merge and to.children and to.children[-1].kind == "text":
        to.children[-1].value += value
    elif value or to.kind == "element":
        to.add(Node("text", value=value))
