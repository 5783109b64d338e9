"""Trees as brace syntax, compact or indented."""

from __future__ import annotations

import re

from ..model import Node
from ..sources.brace import unquote

_BARE = re.compile(r"(?!&|=|//|/\*)[^\s(){}'\"\x00-\x1f]+\Z")


def longest(text: str, char: str) -> int:
    return max(map(len, re.findall(f"{re.escape(char)}+", text)), default=0)


def quoted(text: str, prefer_double: bool = False) -> str:
    """The text in as few quote characters as it takes; a quote at an end is kept away by a newline."""
    if not text:
        return '""' if prefer_double else "''"
    one, two = longest(text, "'"), longest(text, '"')
    double = (two < one) if not prefer_double else not one < two
    if one == two == 0:
        double = prefer_double
    q, n = ('"', two + 1) if double else ("'", one + 1)
    if q in (text[0], text[-1]) and (other := '"' if q == "'" else "'") not in (text[0], text[-1]):
        q, n = other, longest(text, other) + 1  # no newline is needed then
    n = 3 if n == 2 else n
    if text[0] == q or text[-1] == q:
        return f"{q * n}\n{text}\n{q * n}"
    return f"{q * n}{text}{q * n}"


def bare(text: str) -> bool:
    return _BARE.match(text) is not None


def _needs_parts(text: str, compact: bool, newlines: bool, tabs: bool) -> bool:
    """Whether a quote can't hold the text as it is."""
    if "\r" in text or tabs and "\t" in text or (compact or newlines) and "\n" in text:
        return True
    head, tail = text[: len(text) - len(text.lstrip(" \t\n"))], text[len(text.rstrip(" \t\n")) :]
    return ("\n" in head and head.strip("\n") != "") or ("\n" in tail and tail.strip("\n") != "")


def _kept_newlines(text: str, prefer_double: bool) -> str:
    """With a newline more at an end that has one: a quote loses the first and the last. One that keeps its quotes away has these already."""
    if "\n" not in (text[:1], text[-1:]) or quoted(text, prefer_double).strip("'\"")[:1] == "\n" != text[:1] or text[0] in "'\"" or text[-1] in "'\"":
        return text
    if not text.strip("\n"):
        return text + "\n"
    return "\n" * (text[0] == "\n") + text + "\n" * (text[-1] == "\n")


def parts(text: str, compact: bool = False, newlines: bool = False, tabs: bool = False, non_ascii: bool = False, prefer_double: bool = False) -> list[str]:
    """Quotes and character entities that together are the text."""
    if not _needs_parts(text, compact, newlines, tabs) and not (non_ascii and not text.isascii()):
        q = quoted(_kept_newlines(text, prefer_double), prefer_double)
        if not (compact and "\n" in q) and unquote(q) == text:
            return [q]
    cut = "\r" + ("\t" if tabs else "")
    body = text
    pattern = f"[{cut}\n]"
    if non_ascii:
        pattern = f"(?:{pattern}|[^\x00-\x7f])"
    out: list[str] = []
    at = 0
    for m in re.finditer(pattern, body):
        out += _pieces(body[at : m.start()], compact, prefer_double)
        out.append(f"&#{ord(m[0])};")
        at = m.end()
    return out + _pieces(body[at:], compact, prefer_double) or ["''"]


def _pieces(text: str, compact: bool, prefer_double: bool) -> list[str]:
    """One quote, or in compact form such as need no newline: quote characters at the ends stand apart as entities."""
    if not text:
        return []
    if "\n" not in (q := quoted(text, prefer_double)) or not compact:
        return [q]
    head, tail = text[: len(text) - len(text.lstrip("'"))], text[len(text.rstrip("'")) :] if text.strip("'") else ""
    middle = text[len(head) : len(text) - len(tail)]
    return [*["&#39;"] * len(head), *([quoted(middle, prefer_double)] if middle else []), *["&#39;"] * len(tail)]


def quote_compact(text: str) -> str:
    """The shortest form of a value on one line."""
    if bare(text):
        return quoted(text)
    p = parts(text, compact=True)
    return p[0] if len(p) == 1 else f"({''.join(p)})"


def comment_slashes(text: str) -> int:
    """Slashes that a comment with this text needs."""
    return max((len(m) for m in re.findall(r"(?<=\*)/+", text)), default=0) + 1


class Printer:
    def __init__(self, indent: int = 4, compact: bool = False, newlines: bool = False, non_ascii: bool = False, tabs: bool = False, prefer_double: bool = False):
        self.step = indent
        self.compact = compact
        self.options = {"compact": compact, "newlines": newlines, "tabs": tabs, "non_ascii": non_ascii, "prefer_double": prefer_double}

    def _items(self, nodes: list[Node]) -> list[str]:
        out: list[str] = []
        for n in nodes:
            out += [f"&{n.name};"] if n.kind == "entity" else parts(n.value or "", **self.options)
        return out

    def value(self, nodes: list[Node], column: int) -> str:
        """What follows an equals sign: text and entity nodes."""
        if len(nodes) == 1 and nodes[0].kind in ("text", "cdata") and bare(v := nodes[0].value or "") and not (self.options["non_ascii"] and not v.isascii()):
            return v
        items = self._items(nodes) or ["''"]
        if len(items) == 1:
            return self._lines(items[0], column)
        if self.compact:
            return f"({''.join(items)})"
        pad = "\n" + " " * (column + 2)
        return "( " + pad.join(self._rows(items, column + 2)) + " )"

    def _rows(self, items: list[str], column: int) -> list[str]:
        """Entities stay on the line of the quote before, unless both are long."""
        return [self._lines(x, column) for x in items]

    def _lines(self, quote: str, column: int) -> str:
        """A quote of several lines, the later ones under the first one's content."""
        if "\n" not in quote or quote[0] not in "'\"":
            return quote
        n = len(quote) - len(quote.lstrip(quote[0]))
        lines = quote.split("\n")
        alone = not lines[0].strip(quote[0])  # nothing beside the opening quotes: all stands below them
        pad = " " * (column if alone else column + n)
        return "\n".join([lines[0], *[pad + x if x else "" for x in lines[1:]]])

    def _attr(self, a: Node, width: int, column: int) -> str:
        name = ("xmlns" + (f":{a.name}" if a.name else "")) if a.kind == "namespace" else a.qname
        if a.value is None and not a.children:
            return name
        nodes = a.children or [Node("text", value=a.value)]
        if self.compact:
            return f"{name}={self.value(nodes, 0)}"
        return f"{name.ljust(width)} = {self.value(nodes, column + max(width, len(name)) + 3)}"

    def attributes(self, node: Node, column: int) -> str:
        if not node.attrs:
            return ""
        if self.compact:
            out = []
            for a in node.attrs:
                text = self._attr(a, 0, 0)
                out.append(text if not out or out[-1][-1] in "'\")" or re.search("=&[^;]+;\\Z", out[-1]) else " " + text)
            return f"({''.join(out)})"
        names = [("xmlns" + (f":{a.name}" if a.name else "")) if a.kind == "namespace" else a.qname for a in node.attrs if a.value is not None or a.children]
        width = max(map(len, names), default=0)
        return "(" + ("\n" + " " * (column + 1)).join(self._attr(a, width, column + 1) for a in node.attrs) + ")"

    @staticmethod
    def is_value(n: Node) -> bool:
        """An element that prints as key = value."""
        return n.kind == "element" and bool(n.children) and all(c.kind in ("text", "entity", "cdata") for c in n.children)

    def comment(self, n: Node, column: int) -> str:
        v = n.value or ""
        if self.compact or "\n" in v:
            s = "/" * comment_slashes(v)
            if self.compact:
                return "".join((s + "*" if i == 0 else "*") + f"{self._apart(line)}*{s}" for i, line in enumerate(v.split("\n")))
            pad = "\n" + " " * (column + len(s) + 2)
            return f"{s}* " + pad.join(v.split("\n")) + f" *{s}"
        return f"// {v}" if v else "//"

    @staticmethod
    def _apart(line: str) -> str:
        """A line of a compact comment, behind a space where it would be taken for the comment's own marks."""
        return f" {line}" if line[:1] in ("*", "/") and line else line

    def _special(self, n: Node) -> str:
        mark = "!" if n.kind == "doctype" else "?"
        sep = "=" if self.compact else " = "
        shown = (n.value or "").replace("\n", " ") if self.compact and n.kind == "doctype" else n.value
        value = [Node("text", value=shown)] if shown else []
        head = f"{mark}{n.name or 'DOCTYPE'}"
        return head + (sep + self.value(value, len(head) + 3) if value else "")

    def pretty(self, doc: Node) -> str:
        out: list[str] = []
        stack: list[tuple] = [("nodes", doc.children, 0)]
        while stack:
            what, x, column = stack.pop()
            if what == "text":
                out.append(x)
                continue
            pad = " " * column
            todo: list[tuple] = []
            i = 0
            while i < len(x):
                n = x[i]
                width = 0
                run = i
                while run < len(x) and self.is_value(x[run]) and not x[run].attrs:
                    width = max(width, len(x[run].qname))
                    run += 1
                if run > i:
                    for n in x[i:run]:
                        todo.append(("text", f"{pad}{n.qname.ljust(width)} = {self.value(n.children, column + width + 3)}\n", 0))
                    i = run
                    continue
                if n.kind in ("text", "cdata", "entity"):
                    items = self._items([n])
                    todo += [("text", pad + self._lines(q, column) + "\n", 0) for q in items]
                elif n.kind == "comment":
                    todo.append(("text", f"{pad}{self.comment(n, column)}\n", 0))
                elif n.kind in ("doctype", "pi"):
                    todo.append(("text", f"{pad}{self._special(n)}\n", 0))
                elif n.kind == "element":
                    head = pad + n.qname + self.attributes(n, column + len(n.qname))
                    if self.is_value(n):
                        last = len(head.rsplit("\n", 1)[-1])
                        todo.append(("text", f"{head} = {self.value(n.children, last + 3)}\n", 0))
                    elif not n.children:
                        todo.append(("text", head + "\n", 0))
                    else:
                        todo.append(("text", head + (f"\n{pad}{{\n" if n.attrs else " {\n"), 0))
                        todo.append(("nodes", n.children, column + self.step))
                        todo.append(("text", f"{pad}}}\n", 0))
                i += 1
            stack += reversed(todo)
        return "".join(out)

    def one_line(self, doc: Node) -> str:
        out: list[str] = []

        def put(token: str) -> None:
            """Appends a token, behind a space where the two would run together."""
            if out and token:
                a, b = out[-1][-1], token[0]
                closed = a in "'\"(){}" or out[-1][0] == "&" or out[-1].startswith(("//", "/*"))  # else a name or value may go on
                if (not closed and b not in "(){}=") or (a in "'\"" and b == a):
                    out.append(" ")
            out.append(token)

        stack: list[Node | str] = list(reversed(doc.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.kind in ("text", "cdata", "entity"):
                for q in self._items([n]):
                    put(q)
            elif n.kind == "comment":
                put(self.comment(n, 0))
            elif n.kind in ("doctype", "pi"):
                put(self._special(n))
            elif n.kind == "element":
                put(n.qname)
                attrs = self.attributes(n, 0)
                if attrs:
                    out.append(attrs)
                if self.is_value(n):
                    out.append("=")
                    out.append(self.value(n.children, 0))
                elif n.children:
                    out.append("{")
                    stack.append("}")
                    stack.extend(reversed(n.children))
        return "".join(out)

    def render(self, doc: Node) -> str:
        return self.one_line(doc) if self.compact else self.pretty(doc)
