"""JSON as a tree, without losing number forms, key order or repeated keys."""

from __future__ import annotations

import re

from ..model import Node, document, qualify
from .brace import ParseError

_WS = re.compile(r"[ \t\r\n]*")
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_NUMBER_END = " \n,}]"
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.-]*(?::[A-Za-z_][A-Za-z0-9_.-]*)?\Z")
_STRING = re.compile(r'[^"\\\x00-\x1f]*')
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_INDEX = re.compile(r"\[[0-9]+\]\Z")


def looks_like_scalar(text: str) -> bool:
    """Whether a string would read as a number, true, false or null without its quotes."""
    return text in ("true", "false", "null") or NUMBER.fullmatch(text) is not None


class _Reader:
    def __init__(self, source: str):
        self.s, self.i = source, 0

    def fail(self, message: str) -> ParseError:
        return ParseError(message, self.s, self.i)

    def space(self) -> str:
        self.i = _WS.match(self.s, self.i).end()
        return self.s[self.i : self.i + 1]

    def string(self) -> str:
        """Escapes of code units are decoded one by one."""
        self.i += 1
        out = []
        while True:
            m = _STRING.match(self.s, self.i)
            out.append(m[0])
            self.i = m.end()
            c = self.s[self.i : self.i + 1]
            if c == '"':
                self.i += 1
                return "".join(out)
            if c != "\\":
                raise self.fail("json string is not closed" if not c else "control character in json string")
            e = self.s[self.i + 1 : self.i + 2]
            if e == "u" and re.fullmatch(r"[0-9A-Fa-f]{4}", h := self.s[self.i + 2 : self.i + 6]):
                c = chr(int(h, 16))
                out.append("�" if "\ud800" <= c <= "\udfff" else c)
                self.i += 6
            elif e in _ESCAPES and e:
                out.append(_ESCAPES[e])
                self.i += 2
            else:
                raise self.fail("invalid escape in json string")

    def scalar(self) -> tuple[str, bool]:
        """A scalar's text, and whether it was a string."""
        c = self.s[self.i : self.i + 1]
        if c == '"':
            return self.string(), True
        for word in ("true", "false", "null"):
            if self.s.startswith(word, self.i):
                self.i += len(word)
                return word, False
        if m := NUMBER.match(self.s, self.i):
            if m.end() < len(self.s) and self.s[m.end()] not in _NUMBER_END:
                self.i = m.end()
                raise self.fail("json number is followed by something else")
            self.i = m.end()
            return m[0], False
        raise self.fail("expected a json value")


def _named(key: str) -> Node:
    """The element of a key."""
    key = _INDEX.sub("", key) if key else key
    if not key:
        return Node("element", "_")
    if not NAME.match(key):
        node = Node("element", "_")
        node.add(Node("attribute", "_", value=key))
        return node
    prefix, _, name = key.rpartition(":")
    return Node("element", name, prefix or None)


def _set(node: Node, value: str, was_string: bool) -> None:
    if was_string and looks_like_scalar(value):
        node.add(Node("attribute", "S"))
    if value or was_string:
        node.add(Node("text", value=value))


def _member(owner: Node, key: str, r: _Reader, top: Node) -> Node | None:
    """Reads the value of a key into ``owner``; an element that is to be filled if the value is an object or array."""
    c = r.space()
    if c in "{[" and c:
        return owner.add(_named(key))
    value, was_string = r.scalar()
    if (mark := _INDEX.sub("", key)) in ("|", "//", "_//", "&"):
        key = mark
    if key == "_" and was_string and NAME.match(value):
        prefix, _, owner.name = value.rpartition(":")
        owner.prefix = prefix or None
    elif key == "|":
        owner.add(Node("text", value=value))
    elif key == "//":
        owner.add(Node("comment", value=value))
    elif key == "_//":
        # before the owner until that has a name or content; behind it, the last one comes first
        at = top.children.index(owner) if owner in top.children else len(top.children)
        fresh = owner.qname == "_" and not owner.children and not owner.attrs
        top.children.insert(at if fresh else at + 1, Node("comment", value=value, parent=top))
    elif key == "&" and value[:1] == "&":
        owner.add(Node("entity", value[1:].rstrip(";")))
    elif key == "!DOCTYPE":
        at = top.children.index(owner) if owner in top.children else len(top.children)
        node = Node("doctype", "DOCTYPE", value=value, parent=top)
        top.children.insert(at, node)
    elif key == "_xmlns" or key.startswith("_xmlns:"):
        owner.add(Node("namespace", key[7:], value=value))
    elif len(key) > 1 and key[0] == "_" and NAME.match(key[1:]):
        prefix, _, name = key[1:].rpartition(":")
        owner.add(Node("attribute", name, prefix or None, value=None if value == "null" and not was_string else value))
    else:
        _set(owner.add(_named(key)), value, was_string)
    return None


def fill(r: _Reader, doc: Node, stack: list[tuple[Node, str]], opening: Node | None, opened: list[Node] | None = None) -> None:
    """Reads what is in the containers of ``stack``, innermost last, after entering ``opening`` if there is one, until the outermost ends.

    With ``opened`` the text may end before that, behind a member; containers that are entered are added to it.
    """
    first = opened is not None and r.space() != ","  # behind an opening bracket
    while True:
        if opening is not None:
            kind = r.space()
            r.i += 1
            if kind == "[":
                opening.add(Node("attribute", "A"))
            stack.append((opening, "]" if kind == "[" else "}"))
            if opened is not None:
                opened.append(opening)
            opening, first = None, True
        node, close = stack[-1]
        c = r.space()
        if not c and opened is not None:
            return
        if c == close:
            r.i += 1
            stack.pop()
            if not stack:
                return
            first = False
            continue
        if not first:
            if c != ",":
                raise r.fail("expected a comma or the end of the json container")
            r.i += 1
            c = r.space()
        first = False
        if close == "]":
            if c in ("{", "["):
                opening = node.add(Node("element", "_"))
            else:
                _set(node.add(Node("element", "_")), *r.scalar())
            continue
        if c != '"':
            raise r.fail("expected a json key")
        key = r.string()
        if r.space() != ":":
            raise r.fail("expected a colon")
        r.i += 1
        opening = _member(node, key, r, doc)


def parse(source: str, root: str | None = None) -> Node:
    """The tree of a JSON text. ``root`` names the element of an anonymous top-level value. Any depth."""
    r = _Reader(source.removeprefix("﻿"))
    doc = document()
    top = doc.add(Node("element", root or "_"))
    c = r.space()
    if c not in ("{", "["):
        _set(top, *r.scalar())
    else:
        fill(r, doc, [], top)
    if r.space():
        raise r.fail("something follows the json value")
    qualify(doc)
    return doc
