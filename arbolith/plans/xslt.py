"""XSLT 1.0 stylesheets over trees: compiled once on the driver, applied to each document in Arrow batches."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

from ..model import Node, document, qualify
from . import xpath as X
from . import xpath_tree as T

NAMESPACE = "http://www.w3.org/1999/XSL/Transform"


class StylesheetError(ValueError):
    pass


@dataclass
class Template:
    pattern: X.Path | None
    name: str | None
    mode: str | None
    priority: float
    order: int
    body: Node
    precedence: int = 0


@dataclass(frozen=True)
class Expression:
    """A parameter that is an XPath expression, not a string; it is evaluated on each document."""

    source: str


@dataclass
class Stylesheet:
    templates: list[Template] = field(default_factory=list)
    named: dict[str, Template] = field(default_factory=dict)
    globals: list[Node] = field(default_factory=list)
    keys: dict[str, list[tuple[X.Path, object]]] = field(default_factory=dict)
    output: dict[str, str] = field(default_factory=dict)
    strip: list[str] = field(default_factory=list)
    preserve: list[str] = field(default_factory=list)
    sets: dict[str, Node] = field(default_factory=dict)
    decimals: dict[str, dict[str, str]] = field(default_factory=dict)
    #: Prefixes of literal elements, with the prefix and namespace that stand for them in results.
    aliases: dict[str, tuple[str, str]] = field(default_factory=dict)


def _xsl(n: Node) -> str | None:
    """The instruction's name, if the node is one."""
    return n.name if n.kind == "element" and n.ns_uri == NAMESPACE else None


def _get(n: Node, name: str, default: str | None = None) -> str | None:
    a = n.attr(name)
    return a.text() if a is not None else default


def _alternatives(e: object) -> list:
    return [*_alternatives(e.left), *_alternatives(e.right)] if isinstance(e, X.Binary) and e.op == "|" else [e]


def _priority(p: X.Path) -> float:
    if len(p.steps) != 1 or p.absolute or p.steps[0].predicates:
        return 0.5
    t = p.steps[0].test
    return -0.5 if t in ("*", "node()", "text()", "comment()") else -0.25 if t.endswith(":*") else 0.0


def _root_of(doc: Node) -> Node:
    qualify(doc)
    root = next((c for c in doc.children if c.kind == "element"), None)
    if root is None:
        raise StylesheetError("the stylesheet is empty")
    return root


def _modules(root: Node, others: dict[str, Node], within: tuple[str, ...] = ()) -> list[list[Node]]:
    """The declarations of a stylesheet and of those it imports, a list for each, least precedence first; included ones count as its own."""
    mine: list[Node] = []
    imported: list[list[Node]] = []

    def take(r: Node, names: tuple[str, ...]) -> None:
        for n in r.children:
            if _xsl(n) not in ("import", "include"):
                mine.append(n)
                continue
            name = _get(n, "href") or ""
            if name in names or name not in others:
                raise StylesheetError(f"stylesheet {name!r} {'includes itself' if name in names else 'is not given'}")
            inner = _root_of(others[name])
            if _xsl(n) == "include":
                take(inner, (*names, name))
            else:
                imported.extend(_modules(inner, others, (*names, name)))

    take(root, within)
    return [*imported, mine]


def compile(doc: Node, others: dict[str, Node] | None = None) -> Stylesheet:
    """A stylesheet from its tree; what it lacks or holds wrongly is an error here. ``others``: trees of stylesheets that it imports or includes, by name."""
    root = _root_of(doc)
    sheet = Stylesheet()
    if _xsl(root) not in ("stylesheet", "transform"):
        body = Node("element", "template")
        body.children = [root]
        sheet.templates.append(Template(X.Path(True, ()), None, None, 0.5, 0, body))
        return sheet
    declared = [(p, n) for p, module in enumerate(_modules(root, others or {})) for n in module]
    for order, (precedence, n) in enumerate(declared):
        match _xsl(n):
            case "template":
                name, match_ = _get(n, "name"), _get(n, "match")
                for p in _alternatives(X.parse(match_)) if match_ else [None]:
                    own = float(_get(n, "priority") or (_priority(p) if p is not None else 0))
                    t = Template(p, name, _get(n, "mode"), own, order, n, precedence)
                    sheet.templates.append(t)
                    if name:
                        sheet.named[name] = t
            case "variable" | "param":
                sheet.globals = [*(g for g in sheet.globals if _get(g, "name") != _get(n, "name")), n]
            case "decimal-format":
                sheet.decimals[_get(n, "name") or ""] = T.SYMBOLS | {a.name or "": a.text() for a in n.attrs if a.kind == "attribute" and a.name != "name"}
            case "namespace-alias":
                spaces = {a.name: a.value or "" for a in root.attrs if a.kind == "namespace"}
                to = _get(n, "result-prefix") or ""
                sheet.aliases[_get(n, "stylesheet-prefix") or ""] = (to, spaces.get(to, ""))
            case "key":
                for p in _alternatives(X.parse(_get(n, "match") or "")):
                    sheet.keys.setdefault(_get(n, "name") or "", []).append((p, X.parse(_get(n, "use") or "")))
            case "output":
                sheet.output |= {a.name or "": a.text() for a in n.attrs if a.kind == "attribute"}
            case "strip-space":
                sheet.strip += (_get(n, "elements") or "").split()
            case "preserve-space":
                sheet.preserve += (_get(n, "elements") or "").split()
            case "attribute-set":
                sheet.sets[_get(n, "name") or ""] = n
    sheet.templates.sort(key=lambda t: (t.precedence, t.priority, t.order))
    return sheet


class Run:
    """One application of a stylesheet to a tree."""

    def __init__(self, sheet: Stylesheet, doc: Node, params: dict[str, str] | None = None, documents: dict[str, Node] | None = None):
        self.sheet, self.doc = sheet, doc
        self.documents = documents or {}
        self.functions = {"key": self._key, "document": self._document, "system-property": lambda c, n: "1.0" if T.string(n).endswith("version") else "", "function-available": lambda c, n: False, "element-available": lambda c, n: False, "format-number": self._format_number}
        self.running: list[Template] = []
        self.index: dict[str, dict[str, list[Node]]] = {}
        self.base: dict[str, object] = {}
        self.messages: list[str] = []
        self.depth = 0
        for n in doc.walk() if sheet.strip else ():
            if n.kind == "element" and any(x in ("*", n.qname) for x in sheet.strip) and n.qname not in sheet.preserve:
                n.children = [x for x in n.children if x.kind != "text" or (x.value or "").strip(" \t\r\n")]
        for g in sheet.globals:
            name = _get(g, "name") or ""
            if _xsl(g) == "param" and params and name in params:
                given = params[name]
                self.base[name] = T.evaluate(X.parse(given.source), self._context(doc, self.base)) if isinstance(given, Expression) else given
            else:
                self.base[name] = self._variable(g, self._context(doc, self.base))

    def _context(self, node: Node, variables: dict, position: int = 1, size: int = 1) -> T.Context:
        return T.Context(node, position, size, variables, self.functions, node)

    def _document(self, c: T.Context, name: object, *_: object) -> list[Node]:
        key = T.string(name)
        if key not in self.documents:
            raise StylesheetError(f"document({key!r}) isn't given")
        return [self.documents[key]]

    def _format_number(self, c: T.Context, value: object, pattern: object, name: object = "") -> str:
        key = T.string(name)
        if key and key not in self.sheet.decimals:
            raise StylesheetError(f"decimal format {key!r} isn't declared")
        return T.format_number(T.number(value), T.string(pattern), self.sheet.decimals.get(key, T.SYMBOLS))

    def _key(self, c: T.Context, name: object, value: object) -> list[Node]:
        key = T.string(name)
        if key not in self.index:
            table = self.index[key] = {}
            for n in self.doc.walk():
                for p, use in self.sheet.keys.get(key, ()):
                    if self.matches(n, p):
                        v = T.evaluate(use, self._context(n, self.base))
                        for s in [x.text() for x in v] if isinstance(v, list) else [T.string(v)]:
                            same = table.setdefault(s, [])
                            if not same or same[-1] is not n:
                                same.append(n)
        wanted = {x.text() for x in value} if isinstance(value, list) else {T.string(value)}
        if len(wanted) == 1:  # as it stands in the index: distinct, in document order
            return self.index[key].get(*wanted, [])
        return T.ordered([n for w in wanted for n in self.index[key].get(w, [])])

    def matches(self, n: Node, p: object) -> bool:
        """Whether a pattern selects a node: from some ancestor-or-self of its parent."""
        if isinstance(p, X.Path) and p.absolute and not p.steps:
            return n.kind == "document"
        if not isinstance(p, X.Path):
            v = T.evaluate(p, self._context(n, self.base))
            return isinstance(v, list) and any(x is n for x in v)
        return self._back(n, list(p.steps), p.absolute)

    def _back(self, n: Node, steps: list[X.Step], absolute: bool) -> bool:
        if not steps:
            return not absolute or n.kind == "document"
        *rest, s = steps
        if s == X.ANY or s.axis == "descendant-or-self":
            here: Node | None = n
            while here is not None:
                if self._back(here, rest, absolute):
                    return True
                here = here.parent
            return False
        parent = n.parent
        axis = s.axis if s.axis != "descendant" else "child"
        if parent is None or (axis == "attribute") != (n.kind == "attribute") or not T.matches(n, s.test, axis):
            return False
        if s.predicates:
            same = [x for x in T.axis(parent, axis) if T.matches(x, s.test, axis)]
            if not any(x is n for x in T._kept(same, s.predicates, self._context(n, self.base))):
                return False
        if s.axis == "descendant":
            here = parent
            while here is not None:
                if self._back(here, rest, absolute):
                    return True
                here = here.parent
            return False
        return self._back(parent, rest, absolute) if rest or absolute else True

    def apply(self, nodes: list[Node], variables: dict, mode: str | None, given: dict, out: Node) -> None:
        self.depth += 1
        if self.depth > 2000:
            raise StylesheetError("templates recur without end")
        for i, n in enumerate(nodes, 1):
            t = next((t for t in reversed(self.sheet.templates) if t.mode == mode and t.pattern is not None and self.matches(n, t.pattern)), None)
            if t is not None:
                self.template(t, self._context(n, dict(self.base), i, len(nodes)), given, out)
            elif n.kind in ("element", "document"):
                self.apply(n.children, variables, mode, {}, out)
            elif n.kind in ("text", "cdata", "attribute", "entity"):
                self.text(n.text(), out)
        self.depth -= 1

    def template(self, t: Template, c: T.Context, given: dict, out: Node) -> None:
        c = T.Context(c.node, c.position, c.size, dict(self.base), self.functions, c.node)
        body = []
        for n in t.body.children:
            if _xsl(n) == "param":
                name = _get(n, "name") or ""
                c.variables[name] = given[name] if name in given else self._variable(n, c)
            else:
                body.append(n)
        self.running.append(t)
        self.body(body, c, out)
        self.running.pop()

    def imported(self, n: Node, c: T.Context, out: Node) -> None:
        """apply-imports: the current node by the templates of less precedence."""
        now = self.running[-1]
        t = next((t for t in reversed(self.sheet.templates) if t.precedence < now.precedence and t.mode == now.mode and t.pattern is not None and self.matches(n, t.pattern)), None)
        if t is not None:
            self.template(t, c, {}, out)
        elif n.kind in ("element", "document"):
            self.apply(n.children, c.variables, now.mode, {}, out)
        else:
            self.text(n.text(), out)

    def _variable(self, n: Node, c: T.Context) -> object:
        if (select := _get(n, "select")) is not None:
            return T.evaluate(X.parse(select), c)
        if not n.children:
            return ""
        fragment = document()
        self.body(n.children, c, fragment)
        return [fragment]

    @staticmethod
    def text(value: str, out: Node) -> None:
        if not value:
            return
        if out.children and out.children[-1].kind == "text":
            out.children[-1].value += value
        else:
            out.add(Node("text", value=value))

    def avt(self, template: str, c: T.Context) -> str:
        """An attribute value template."""
        return re.sub(r"\{\{|\}\}|\{([^}]*)\}", lambda m: m[0][0] if m[1] is None else T.string(T.evaluate(X.parse(m[1]), c)), template)

    def body(self, nodes: list[Node], c: T.Context, out: Node) -> None:
        c = T.Context(c.node, c.position, c.size, dict(c.variables), c.functions, c.current)
        for n in nodes:
            name = _xsl(n)
            if name in ("variable", "param"):
                c.variables[_get(n, "name") or ""] = self._variable(n, c)
            elif name is not None:
                self.instruction(name, n, c, out)
            elif n.kind in ("text", "cdata"):
                self.text(n.value or "", out)
            elif n.kind == "entity":
                self.text(n.text(), out)
            elif n.kind == "element":
                alias = self.sheet.aliases.get(n.prefix or "")
                made = out.add(Node("element", n.name, (alias[0] or None) if alias else n.prefix))
                if alias and out.prefix != made.prefix:
                    made.add(Node("namespace", alias[0], value=alias[1]))
                for a in n.attrs:
                    if a.kind == "namespace" and a.value != NAMESPACE and a.name not in self.sheet.aliases:
                        made.add(Node("namespace", a.name, value=a.value))
                    elif a.kind == "attribute" and a.prefix != "xsl" and a.ns_uri != NAMESPACE:
                        made.add(Node("attribute", a.name, a.prefix, self.avt(a.text(), c) if a.value is not None or a.children else None))
                    elif a.kind == "attribute" and a.name == "use-attribute-sets":
                        self.attribute_sets(a.text(), c, made)
                self.body(n.children, c, made)

    def attribute_sets(self, names: str, c: T.Context, out: Node) -> None:
        for s in names.split():
            if s in self.sheet.sets:
                self.body(self.sheet.sets[s].children, c, out)

    def sorted(self, n: Node, nodes: list[Node], c: T.Context) -> list[Node]:
        for s in reversed([x for x in n.children if _xsl(x) == "sort"]):
            e = X.parse(_get(s, "select", ".") or ".")
            numeric, down = _get(s, "data-type") == "number", _get(s, "order") == "descending"
            keys = {}
            for i, x in enumerate(nodes, 1):
                v = T.evaluate(e, c.at(x, i, len(nodes)))
                f = T.number(v)
                keys[id(x)] = (f == f, f if f == f else 0) if numeric else T.string(v)
            nodes = sorted(nodes, key=lambda x: keys[id(x)], reverse=down)
        return nodes

    def _given(self, n: Node, c: T.Context) -> dict:
        return {_get(x, "name") or "": self._variable(x, c) for x in n.children if _xsl(x) == "with-param"}

    def instruction(self, name: str, n: Node, c: T.Context, out: Node) -> None:
        match name:
            case "value-of":
                self.text(T.string(T.evaluate(X.parse(_get(n, "select") or "."), c)), out)
            case "text":
                self.text("".join(x.text() for x in n.children), out)
            case "apply-templates":
                found = T.evaluate(X.parse(_get(n, "select") or "node()"), c)
                self.apply(self.sorted(n, found, c), c.variables, _get(n, "mode"), self._given(n, c), out)
            case "call-template":
                t = self.sheet.named.get(_get(n, "name") or "")
                if t is None:
                    raise StylesheetError(f"no template is named {_get(n, 'name')}")
                self.depth += 1
                if self.depth > 2000:
                    raise StylesheetError("templates recur without end")
                self.template(t, c, self._given(n, c), out)
                self.depth -= 1
            case "for-each":
                found = self.sorted(n, T.evaluate(X.parse(_get(n, "select") or ""), c), c)
                body = [x for x in n.children if _xsl(x) != "sort"]
                for i, x in enumerate(found, 1):
                    inner = c.at(x, i, len(found))
                    inner.current = x
                    self.body(body, inner, out)
            case "if":
                if T.boolean(T.evaluate(X.parse(_get(n, "test") or ""), c)):
                    self.body(n.children, c, out)
            case "choose":
                for x in n.children:
                    if _xsl(x) == "otherwise" or _xsl(x) == "when" and T.boolean(T.evaluate(X.parse(_get(x, "test") or ""), c)):
                        self.body(x.children, c, out)
                        break
            case "element":
                prefix, _, local = self.avt(_get(n, "name") or "", c).rpartition(":")
                made = out.add(Node("element", local, prefix or None))
                self.attribute_sets(_get(n, "use-attribute-sets") or "", c, made)
                self.body(n.children, c, made)
            case "attribute":
                prefix, _, local = self.avt(_get(n, "name") or "", c).rpartition(":")
                holder = document()
                self.body(n.children, c, holder)
                out.attrs = [a for a in out.attrs if a.qname != (f"{prefix}:{local}" if prefix else local)]
                out.add(Node("attribute", local, prefix or None, holder.text()))
            case "comment":
                holder = document()
                self.body(n.children, c, holder)
                out.add(Node("comment", value=holder.text()))
            case "processing-instruction":
                holder = document()
                self.body(n.children, c, holder)
                out.add(Node("pi", self.avt(_get(n, "name") or "", c), value=holder.text()))
            case "copy":
                if c.node.kind == "element":
                    made = out.add(Node("element", c.node.name, c.node.prefix))
                    for a in c.node.attrs:
                        if a.kind == "namespace":
                            made.add(Node("namespace", a.name, value=a.value))
                    self.body(n.children, c, made)
                elif c.node.kind == "document":
                    self.body(n.children, c, out)
                else:
                    self.copy(c.node, out)
            case "copy-of":
                v = T.evaluate(X.parse(_get(n, "select") or ""), c)
                if isinstance(v, list):
                    for x in v:
                        self.copy(x, out)
                else:
                    self.text(T.string(v), out)
            case "number":
                if (value := _get(n, "value")) is not None:
                    numbers = [int(T.number(T.evaluate(X.parse(value), c)) + 0.5)]
                else:
                    numbers = self.counted(c.node, _get(n, "level") or "single", _get(n, "count"), _get(n, "from"))
                grouping = self.avt(_get(n, "grouping-separator") or "", c), int(self.avt(_get(n, "grouping-size") or "0", c) or 0)
                self.text(numbered(numbers, self.avt(_get(n, "format") or "1", c), *grouping), out)
            case "message":
                holder = document()
                self.body(n.children, c, holder)
                self.messages.append(holder.text())
                if _get(n, "terminate") == "yes":
                    raise StylesheetError(holder.text())
            case "apply-imports":
                self.imported(c.node, c, out)
            case "fallback" | "sort" | "with-param":
                pass
            case _:
                raise StylesheetError(f"xsl:{name} isn't supported")

    def counted(self, node: Node, level: str, count: str | None, start: str | None) -> list[int]:
        """Places of a node among those that ``count`` selects (by default those of its kind and name), outermost first; nothing above or before a node of ``start`` counts."""

        def selects(n: Node, pattern: str | None) -> bool:
            if pattern is None:
                return n.kind == node.kind and n.qname == node.qname
            return any(self.matches(n, p) for p in _alternatives(X.parse(pattern)))

        if level == "any":
            total = 0
            for n in self.doc.walk():
                total = 0 if start is not None and selects(n, start) else total + selects(n, count)
                if n is node:
                    break
            return [total] if total else []
        found: list[Node] = []
        here: Node | None = node
        while here is not None and here.kind != "document" and not (start is not None and selects(here, start)):
            if selects(here, count):
                found.append(here)
                if level == "single":
                    break
            here = here.parent
        out = []
        for n in reversed(found):
            beside = n.parent.children if n.parent is not None else [n]
            out.append(1 + sum(selects(x, count) for x in itertools.takewhile(lambda x: x is not n, beside)))
        return out

    def copy(self, n: Node, out: Node) -> None:
        if n.kind == "document":
            for x in n.children:
                self.copy(x, out)
        elif n.kind in ("text", "cdata"):
            self.text(n.value or "", out)
        else:
            made = out.add(Node(n.kind, n.name, n.prefix, n.value))
            for x in [*n.attrs, *n.children]:
                self.copy(x, made)

    def result(self) -> Node:
        out = document()
        self.apply([self.doc], dict(self.base), None, {}, out)
        if kind := self.sheet.output.get("doctype-system"):
            top = next((c for c in out.children if c.kind == "element"), None)
            value = "html" if kind == "about:legacy-compat" else f'{top.qname if top else "html"} SYSTEM "{kind}"'
            out.children.insert(0, Node("doctype", "DOCTYPE", value=value, parent=out))
        qualify(out)
        return out


#: Fixed values of Roman numerals.
_ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def _counter(number: int, token: str, separator: str, size: int) -> str:
    """A number as a format's token shows it: 1, 01, a, A, i or I."""
    if token in ("a", "A", "i", "I") and number > 0:
        out = ""
        if token in "iI":
            for n, letters in _ROMAN:
                out += letters * (number // n)
                number %= n
        while token in "aA" and number:
            number, digit = divmod(number - 1, 26)
            out = chr(97 + digit) + out
        return out.upper() if token.isupper() else out
    digits = str(number).rjust(len(token) if token.isdigit() else 1, "0")
    return re.sub(rf"(?<=\d)(?=(?:\d{{{size}}})+$)", lambda m: separator, digits) if separator and size > 0 else digits


def numbered(numbers: list[int], pattern: str, separator: str = "", size: int = 0) -> str:
    """Numbers by a format such as 1.a: what stands between its tokens stands between the numbers, its last token and separator serve for more."""
    tokens = re.findall(r"[^\W_]+", pattern)
    between = re.split(r"[^\W_]+", pattern)
    if not tokens:
        tokens, between = ["1"], [pattern, ""]
    out = between[0]
    for i, n in enumerate(numbers):
        if i:
            out += between[min(i, len(tokens) - 1)] if len(tokens) > 1 else "."
        out += _counter(n, tokens[min(i, len(tokens) - 1)], separator, size)
    return out + between[-1]


def transform(sheet: Stylesheet, doc: Node, params: dict[str, str] | None = None, documents: dict[str, Node] | None = None) -> Node:
    return Run(sheet, doc, params, documents).result()
