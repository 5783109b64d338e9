"""Trees as JSON; the inverse of the JSON reader."""

from __future__ import annotations

from collections import Counter

from ..model import Node
from ..sources.json_tree import looks_like_scalar

_ESCAPE = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def string(text: str) -> str:
    return '"' + "".join(_ESCAPE.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in text) + '"'


def _leaf(node: Node) -> str | None:
    """The scalar of an element that has only text and no attributes but S and the key."""
    if any(a.kind == "namespace" or a.qname not in ("S", "_") for a in node.attrs) or any(c.kind not in ("text", "cdata") for c in node.children) or not node.children:
        return None
    value = node.text()
    return value if looks_like_scalar(value) and not node.attr("S") else string(value)


def _key(node: Node) -> str:
    own = node.attr("_")
    return own.value or "" if node.name == "_" and own is not None else node.qname


_MARKS = {"text": "|", "cdata": "|", "comment": "//", "entity": "&"}


def _value(node: Node, anonymous: bool, before: tuple[str, ...] = (), after: tuple[str, ...] = ()) -> str:
    """``anonymous``: the element's name isn't printed by what stands around it. ``before``, ``after``: members around its own."""
    named = anonymous and node.qname != "_"
    if not named and not before and not after and (leaf := _leaf(node)) is not None:
        return leaf
    if node.attr("A") is not None:
        return "[" + ",".join(_value(c, True) for c in node.children if c.kind == "element") + "]"
    parts = [*before, *([f'"_":{string(node.qname)}'] if named else [])]
    for a in node.attrs:
        if a.kind == "namespace":
            parts.append(f"{string('_xmlns' + (':' + a.name if a.name else ''))}:{string(a.value or '')}")
        elif a.qname not in ("A", "S", "_") or (a.qname == "_" and node.name != "_"):
            parts.append(f"{string('_' + a.qname)}:{'null' if a.value is None and not a.children else string(a.text())}")
    total = Counter(_key(c) for c in node.children if c.kind == "element")
    marks = Counter(_MARKS[c.kind] for c in node.children if c.kind in _MARKS)
    seen: Counter[str] = Counter()
    used: Counter[str] = Counter()
    for c in node.children:
        if c.kind == "element":
            key = _key(c)
            shown = f"{key}[{seen[key]}]" if total[key] > 1 else "" if c.qname == "_" and c.attr("_") is None else key
            seen[key] += 1
            parts.append(f"{string(shown)}:{_value(c, False)}")
        elif mark := _MARKS.get(c.kind):
            key = f"{mark}[{used[mark]}]" if marks[mark] > 1 else mark
            used[mark] += 1
            v = f"&{c.name};" if c.kind == "entity" else c.value or ""
            parts.append(f'"{key}":{v if mark == "|" and looks_like_scalar(v) else string(v)}')
    parts += after
    return "{" + ",".join(parts) + "}"


def render(doc: Node) -> str:
    """One line. Comments and doctype around the root go into the root's object: those before it first, those behind it at its end, the last one first."""
    roots = [c for c in doc.children if c.kind == "element"]
    if not roots:
        extra = [f'"!DOCTYPE":{string(c.value or "")}' if c.kind == "doctype" else f'"_//":{string(c.value or "")}' for c in doc.children if c.kind in ("doctype", "comment")]
        loose = "".join(c.text() for c in doc.children if c.kind in ("text", "cdata", "entity"))
        return (loose if looks_like_scalar(loose) else string(loose)) if loose else "{" + ",".join(extra) + "}"
    at = doc.children.index(roots[0])
    around = [c for c in (*doc.children[:at], *reversed(doc.children[at:])) if c.kind in ("doctype", "comment")]
    total, number, shown = sum(c.kind == "comment" for c in around), 0, []
    for c in around:
        key = "!DOCTYPE" if c.kind == "doctype" else f"_//[{number}]" if total > 1 else "_//"
        number += c.kind == "comment"
        shown.append(f'"{key}":{string(c.value or "")}')
    first = sum(c.kind in ("doctype", "comment") for c in doc.children[:at])
    before, after = tuple(shown[:first]), tuple(shown[first:])
    if len(roots) == 1:
        return _value(roots[0], True, before, after)
    holder = Node("element", "_")
    for c in roots:
        holder.children.append(c)
    return _value(holder, True, before, after)
