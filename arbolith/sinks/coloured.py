"""Brace syntax in colours: for terminals, HTML and TeX."""

from __future__ import annotations

import html
from collections.abc import Callable

from ..model import Node
from ..sources import brace
from .brace_out import Printer

#: What a token is coloured as.
CLASSES = {
    "comment": "comment", "comment_continuation": "comment", "quote": "quote", "entity": "entity", "element_ns": "namespace", "element_name": "element", "element_key": "key", "ns_declaration": "namespace", "attr_ns": "namespace",
    "attr_key": "attribute", "element_value_text": "value", "element_value_quote": "value", "element_value_entity": "entity", "element_value_compound_quote": "value", "element_value_compound_entity": "entity",
    "attr_value_text": "attribute_value", "attr_value_quote": "attribute_value", "attr_value_entity": "entity", "attr_value_compound_quote": "attribute_value", "attr_value_compound_entity": "entity",
}
THEMES = {
    "dark": {"comment": "2aa1b3", "quote": "26a269", "entity": "c061cb", "namespace": "9a9996", "element": "ff8800", "key": "88b4f7", "attribute": "88b4f7", "value": "26a269", "attribute_value": "5dc9ab"},
    "light": {"comment": "2a8091", "quote": "1b7a4b", "entity": "8a2a95", "namespace": "6e6d6a", "element": "a85400", "key": "1c5fb8", "attribute": "1c5fb8", "value": "1b7a4b", "attribute_value": "23755c"},
    "none": {},
}
_TEX = {"\\": r"\textbackslash{}", "{": r"\{", "}": r"\}", "$": r"\$", "&": r"\&", "#": r"\#", "_": r"\_", "%": r"\%", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", " ": "~", "\n": "\\linebreak\n"}


def nearest_256(colour: str) -> int:
    """The colour of the 256-colour cube that is nearest to rrggbb."""
    steps = (0, 95, 135, 175, 215, 255)
    at = [min(range(6), key=lambda i, v=int(colour[k : k + 2], 16): abs(steps[i] - v)) for k in (0, 2, 4)]
    return 16 + 36 * at[0] + 6 * at[1] + at[2]


def paint(source: str, to: str = "terminal", theme: str = "dark", true_colour: bool = True, prefix: str = "arb") -> str:
    """A text of brace syntax in colours. ``to``: terminal, html, tex or raw; html uses classes that ``style`` defines."""
    colours = THEMES[theme]
    out = []
    for kind, text, _, _ in brace.tokenize(source):
        c = CLASSES.get(kind)
        if to == "html":
            shown = html.escape(text, quote=False)
            out.append(f'<span class="{prefix}-{c}">{shown}</span>' if c else shown)
        elif to == "tex":
            shown = "".join(_TEX.get(x, x) for x in text)
            out.append(f"\\{prefix}{c.title().replace('_', '')}{{{shown}}}" if c else shown)
        elif to == "terminal" and c in colours:
            rgb = colours[c]
            code = ";".join(str(int(rgb[k : k + 2], 16)) for k in (0, 2, 4))
            out.append(f"\x1b[38;2;{code}m{text}\x1b[0m" if true_colour else f"\x1b[38;5;{nearest_256(rgb)}m{text}\x1b[0m")
        else:
            out.append(text)
    return "".join(out)


def style(theme: str = "light", prefix: str = "arb") -> str:
    return "".join(f".{prefix}-{c}{{color:#{rgb}}}\n" for c, rgb in THEMES[theme].items())


def page(body: str, theme: str = "light", prefix: str = "arb", only_style: bool = False, no_style: bool = False, id: str | None = None, cls: str | None = None) -> str:
    """An HTML fragment around painted text."""
    sheet = f"<style>\n{style(theme, prefix)}</style>\n"
    if only_style:
        return sheet
    marks = (f' id="{id}"' if id else "") + f' class="{f"{prefix} {cls}" if cls else prefix}"'
    return ("" if no_style else sheet) + f"<pre{marks}>{body}</pre>\n"


def renderer(to: str = "terminal", theme: str = "dark", **printer) -> Callable[[Node], str]:
    """For ``writers.trees``: trees in colours."""
    show = Printer(**printer).render

    def use(doc: Node) -> str:
        painted = paint(show(doc), to, theme)
        return page(painted, theme) if to == "html" else painted

    return use
