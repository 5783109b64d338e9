"""Documents as trees and trees as rows.

A tree lives only inside one Arrow batch of a parser or a renderer; everything between works on rows of NODES, one for each
node, with pre and post numbers: a is an ancestor of d if a.pre < d.pre and a.post > d.post.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

NODES = "doc_id bigint, pre int, post int, parent int, level int, ord int, kind string, prefix string, name string, ns_uri string, value string, path string"
FIELDS = tuple(x.split()[0] for x in NODES.split(", "))
#: Kinds that have children.
CONTAINERS = ("document", "element", "attribute")


@dataclass(slots=True, eq=False)
class Node:
    kind: str
    name: str | None = None
    prefix: str | None = None
    value: str | None = None
    ns_uri: str | None = None
    attrs: list[Node] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None

    def add(self, child: Node) -> Node:
        child.parent = self
        (self.attrs if child.kind in ("attribute", "namespace") else self.children).append(child)
        return child

    @property
    def qname(self) -> str:
        return f"{self.prefix}:{self.name}" if self.prefix else self.name or ""

    def attr(self, qname: str) -> Node | None:
        return next((a for a in self.attrs if a.qname == qname), None)

    def walk(self) -> Iterator[Node]:
        """This node and all below in document order, without attributes."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def text(self) -> str:
        """The string value: all text below; an attribute's or a leaf's own."""
        if self.kind in ("text", "cdata", "comment", "pi", "namespace", "doctype"):
            return self.value or ""
        if self.kind == "entity":
            return char_of(self.name) or ""
        if self.kind == "attribute" and not self.children:
            return self.value or ""
        return "".join(n.text() for n in self.walk() if n is not self and n.kind in ("text", "cdata", "entity"))


def document(*children: Node) -> Node:
    doc = Node("document")
    for c in children:
        doc.add(c)
    return doc


def element(qname: str, *children: Node, **attrs: str) -> Node:
    prefix, _, name = qname.rpartition(":")
    node = Node("element", name, prefix or None)
    for k, v in attrs.items():
        node.add(Node("attribute", k, value=v))
    for c in children:
        node.add(c)
    return node


def text(value: str) -> Node:
    return Node("text", value=value)


def char_of(entity: str | None) -> str | None:
    """The character of #10, #x0a or of a predefined or HTML name; None if there is none."""
    from html.entities import html5

    if not entity:
        return None
    try:
        if entity[:2] in ("#x", "#X"):
            return chr(int(entity[2:], 16))
        if entity[0] == "#":
            return chr(int(entity[1:]))
    except (ValueError, OverflowError):
        return None
    return html5.get(entity + ";")


def qualify(doc: Node, scope: dict[str, str] | None = None) -> None:
    """Fills ns_uri from the declarations in scope; ``scope``: those around the document."""
    stack = [(doc, {"xml": "http://www.w3.org/XML/1998/namespace"} | (scope or {}))]
    while stack:
        node, scope = stack.pop()
        own = {a.name or "": a.value or "" for a in node.attrs if a.kind == "namespace"}
        scope = scope | own if own else scope
        if node.kind == "element":
            node.ns_uri = scope.get(node.prefix or "") or None
            for a in node.attrs:
                if a.kind == "attribute":
                    a.ns_uri = scope.get(a.prefix) if a.prefix else None
        stack += [(c, scope) for c in node.children if c.kind == "element"]


def shred(doc: Node, doc_id: int | None) -> list[tuple]:
    """Rows of NODES. Top-level nodes have parent -1 and level 0; a namespace's or attribute's rows follow its element's."""
    rows: list[list] = []
    post = 0
    stack: list[tuple[Node, int, int, int, str, int]] = [(c, -1, 0, i, "", -1) for i, c in reversed(list(enumerate(doc.children)))]
    while stack:
        node, parent, level, ord_, base, done = stack.pop()
        if done >= 0:
            rows[done][2] = post
            post += 1
            continue
        pre = len(rows)
        if node.kind == "element":
            path = f"{base}/{node.qname}"
        elif node.kind == "attribute":
            path = f"{base}/@{node.qname}"
        else:
            path = base
        value = None if node.kind == "element" or node.kind == "attribute" and node.children else node.value
        rows.append([doc_id, pre, 0, parent, level, ord_, node.kind, node.prefix, node.name, node.ns_uri, value, path])
        stack.append((node, parent, level, ord_, base, pre))
        below = [*node.attrs, *node.children]
        stack += [(c, pre, level + 1, i, path, -1) for i, c in reversed(list(enumerate(below)))]
    return [tuple(r) for r in rows]


def build(rows: list[dict]) -> Node:
    """The tree of one document's rows, in any order; rows whose parent is missing become top-level."""
    doc = document()
    made: dict[int, Node] = {}
    for r in sorted(rows, key=lambda r: r["pre"]):
        node = Node(r["kind"], r["name"], r["prefix"], r["value"], r.get("ns_uri"))
        made[r["pre"]] = node
        made.get(r["parent"], doc).add(node)
    return doc
