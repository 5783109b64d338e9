"""Trees as XML, HTML, text and path lines."""

from __future__ import annotations

from ..model import Node

DECLARATION = '<?xml version="1.0" encoding="UTF-8"?>\n'
#: Fixed values of the HTML standard: elements without content, and those whose content is raw text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
#: Stands between two hyphens in a comment, where XML allows none.
HYPHEN_MARK = "␐"


def escape(text: str, quote: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return text.replace('"', "&quot;").replace("\n", "&#10;").replace("\t", "&#9;").replace("\r", "&#13;") if quote else text.replace("\r", "&#13;")


def _attrs(node: Node, html: bool) -> str:
    out = []
    for a in node.attrs:
        name = ("xmlns" + (f":{a.name}" if a.name else "")) if a.kind == "namespace" else a.qname
        if html and a.value is None and not a.children:
            out.append(f" {name}")
        else:
            value = "".join(f"&{c.name};" if c.kind == "entity" else escape(c.value or "", True) for c in a.children) if a.children else escape(a.value or "", True)
            out.append(f' {name}="{value}"')
    return "".join(out)


def _markup(doc: Node, html: bool) -> str:
    out: list[str] = []
    stack: list[Node | str] = list(reversed(doc.children))
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.kind == "element":
            tag = n.qname
            if html and tag.lower() in VOID:
                out.append(f"<{tag}{_attrs(n, html)}>")
            elif not n.children and not html:
                out.append(f"<{tag}{_attrs(n, html)}/>")
            else:
                out.append(f"<{tag}{_attrs(n, html)}>")
                stack.append(f"</{tag}>")
                stack.extend(reversed(n.children))
        elif n.kind == "text":
            raw = html and n.parent is not None and (n.parent.name or "").lower() in RAW
            out.append(n.value or "" if raw else escape(n.value or ""))
        elif n.kind == "cdata":
            out.append(n.value or "" if html else f"<![CDATA[{n.value or ''}]]>")
        elif n.kind == "entity":
            out.append(f"&{n.name};")
        elif n.kind == "comment":
            v = n.value or ""
            while "--" in v:
                v = v.replace("--", f"-{HYPHEN_MARK}-")
            out.append(f"<!--{v + HYPHEN_MARK if v.endswith('-') else v}-->")
        elif n.kind == "pi":
            out.append(f"<?{n.name} {n.value or ''}?>")
        elif n.kind == "doctype":
            out.append(f"<!DOCTYPE {n.value or 'html'}>\n")
    return "".join(out)


def xml(doc: Node, declaration: bool = True) -> str:
    return (DECLARATION if declaration else "") + _markup(doc, False)


def html(doc: Node) -> str:
    return _markup(doc, True)


def text(doc: Node) -> str:
    """All text in document order; an entity prints as <ENTITY> and its name."""
    return "".join(n.value or "" if n.kind in ("text", "cdata") else f"<ENTITY>{n.name}" for n in doc.walk() if n.kind in ("text", "cdata", "entity"))


def quote_c(value: str) -> str:
    """C escapes; other control characters as two hexadecimal digits."""
    named = {"\a": "\\a", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\v": "\\v", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}
    return "".join(named.get(c) or (f"\\x{ord(c):02X}" if c < " " or c == "\x7f" else c) for c in value)


def clines(doc: Node) -> str:
    """A line for each leaf: its path and its value; an element's attributes come first."""
    out: list[str] = []
    stack: list[tuple[Node, str]] = [(c, "") for c in reversed(doc.children)]
    while stack:
        n, base = stack.pop()
        if n.kind == "element":
            path = f"{base}/{n.qname}"
            for a in n.attrs:
                name = ("xmlns" + (f":{a.name}" if a.name else "")) if a.kind == "namespace" else a.qname
                out.append(f'{path}/@{name}="{quote_c(a.text())}"\n')
            if not n.children and not n.attrs:
                out.append(f'{path}=""\n')
            stack += [(c, path) for c in reversed(n.children)]
        elif n.kind in ("text", "cdata"):
            out.append(f'{base}="{quote_c(n.value or "")}"\n')
        elif n.kind == "entity":
            out.append(f'{base}="&{n.name};"\n')
        elif n.kind == "comment":
            out.append(f'{base}//="{quote_c(n.value or "")}"\n')
        elif n.kind == "doctype":
            out.append(f'{base}/!DOCTYPE="{quote_c(n.value or "")}"\n')
        elif n.kind == "pi":
            out.append(f'{base}/?{n.name}="{quote_c(n.value or "")}"\n')
    return "".join(out)
