"""XML Schema 1.0, a subset: elements, sequences, choices, all, occurrences, attributes, simple types with facets, references."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

import regex

from ..model import Node, qualify
from . import xpath as X
from . import xpath_tree as T

_INT = r"[+-]?[0-9]+"
_YMD = r"-?[0-9]{4,}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])"
_ZONE = r"(Z|[+-][0-9]{2}:[0-9]{2})?"
_HMS = r"([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?"
#: Fixed values of XML Schema: the lexical form of built-in types, and the bounds of whole numbers.
PATTERNS = {
    "boolean": "true|false|0|1", "integer": _INT, "decimal": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)", "double": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|-?INF|NaN",
    "date": _YMD + _ZONE, "time": _HMS + _ZONE, "dateTime": f"{_YMD}T{_HMS}{_ZONE}", "gYear": r"-?[0-9]{4,}" + _ZONE, "NMTOKEN": r"[\w.:\-]+", "NCName": r"[A-Za-z_][\w.\-]*", "Name": r"[A-Za-z_:][\w.:\-]*",
    "ID": r"[A-Za-z_][\w.\-]*", "IDREF": r"[A-Za-z_][\w.\-]*", "language": r"[A-Za-z]{1,8}(-[A-Za-z0-9]{1,8})*", "hexBinary": "([0-9a-fA-F]{2})*", "duration": r"-?P(?=.)([0-9]+Y)?([0-9]+M)?([0-9]+D)?(T(?=.)([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?",
}
PATTERNS["float"] = PATTERNS["double"]
PATTERNS |= {"gMonth": r"--(0[1-9]|1[0-2])" + _ZONE, "gDay": r"---(0[1-9]|[12][0-9]|3[01])" + _ZONE, "gYearMonth": r"-?[0-9]{4,}-(0[1-9]|1[0-2])" + _ZONE, "gMonthDay": r"--(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])" + _ZONE}
PATTERNS |= {"base64Binary": r"([A-Za-z0-9+/] ?)*=? ?=?", "QName": r"([A-Za-z_][\w.\-]*:)?[A-Za-z_][\w.\-]*", "NMTOKENS": r"[\w.:\-]+( [\w.:\-]+)*", "IDREFS": r"[A-Za-z_][\w.\-]*( [A-Za-z_][\w.\-]*)*", "ENTITY": r"[A-Za-z_][\w.\-]*"}
#: Types that take any text.
ANY_TEXT = {"string", "normalizedString", "token", "anyURI", "anyType", "anySimpleType", "anyAtomicType"}
BOUNDS = {
    "byte": (-(2**7), 2**7 - 1), "short": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1), "unsignedByte": (0, 2**8 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedInt": (0, 2**32 - 1),
    "unsignedLong": (0, 2**64 - 1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1),
}


class SchemaError(ValueError):
    pass


@dataclass
class Schema:
    elements: dict[str, Node] = field(default_factory=dict)
    types: dict[str, Node] = field(default_factory=dict)
    groups: dict[str, Node] = field(default_factory=dict)
    attributes: dict[str, Node] = field(default_factory=dict)
    #: For each element the names of those that may stand in its place.
    substitutes: dict[str, set[str]] = field(default_factory=dict)
    target: str | None = None
    qualified: bool = False


def _get(n: Node, name: str) -> str | None:
    a = n.attr(name)
    return a.text() if a is not None else None


def _local(name: str | None) -> str | None:
    return name.rpartition(":")[2] if name else None


def _instance(n: Node, name: str) -> str | None:
    """An attribute of the namespace for instances of schemas."""
    return next((a.text() for a in n.attrs if a.kind == "attribute" and a.name == name and (a.prefix == "xsi" or a.ns_uri == "http://www.w3.org/2001/XMLSchema-instance")), None)


def _parts(n: Node) -> list[Node]:
    return [c for c in n.children if c.kind == "element" and c.name != "annotation"]


def compile(doc: Node) -> Schema:
    root = next((c for c in doc.children if c.kind == "element"), None)
    if root is None or root.name != "schema":
        raise SchemaError("no schema")
    s = Schema()
    for c in _parts(root):
        table = {"element": s.elements, "complexType": s.types, "simpleType": s.types, "group": s.groups, "attributeGroup": s.groups, "attribute": s.attributes}.get(c.name or "")
        if table is not None:
            table[_get(c, "name") or ""] = c
    s.target, s.qualified = _get(root, "targetNamespace"), _get(root, "elementFormDefault") == "qualified"
    heads = {name: _local(_get(e, "substitutionGroup")) for name, e in s.elements.items()}
    for name in heads:
        head = heads[name]
        while head and name not in s.substitutes.setdefault(head, set()):
            s.substitutes[head].add(name)
            head = heads.get(head)
    elsewhere = any(c.name in ("import", "include", "redefine") for c in _parts(root))
    for n in root.walk():
        for a in ("type", "base", "itemType", "memberTypes") if n.kind == "element" else ():
            for name in (_get(n, a) or "").split():
                if not elsewhere and (local := _local(name)) not in s.types and local not in PATTERNS and local not in BOUNDS and local not in ANY_TEXT:
                    raise SchemaError(f"unknown type {name}")
        if n.kind == "element" and n.name == "pattern":
            _pattern(_get(n, "value") or "")
    return s


def _by_local_names(path: str) -> str:
    """The path of a selector or field with elements by their local names, as prefixes are the schema's."""

    def step(m: re.Match) -> str:
        return f"@{m[2]}" if m[1] else f"*[local-name()='{m[2]}']"

    return re.sub(r"(@)?(?:[\w.-]+:)?([A-Za-z_][\w.-]*)", step, path)


def _translated(pattern: str) -> str:
    """A pattern of XML Schema in the syntax of the regex module, whose sets can be subtracted: no anchors, names of characters, classes."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if c == "\\":
            inner = {"i": r"\p{L}_:", "c": r"\p{L}\p{Nd}_.:\-·"}.get(two[1:].lower())
            if inner is None:
                out.append(two)
            else:
                out.append(f"[{'^' if two[1:].isupper() else ''}{inner}]")
            if two[1:] in ("p", "P") and pattern[i + 2 : i + 5] == "{Is":  # blocks
                end = pattern.index("}", i)
                out[-1] += "{In" + pattern[i + 5 : end] + "}"
                i = end + 1
                continue
            i += 2
            continue
        if c == "[":
            if depth and out[-1] == "-":
                out.pop()
                out.append("--")
            out.append("[")
            depth += 1
        elif c == "]":
            out.append(c)
            depth -= 1
        elif depth == 0 and c in "^$":
            out.append("\\" + c)
        elif depth and c in "&|~" and pattern[i + 1 : i + 2] == c:
            out.append("\\" + c)
        else:
            out.append(c)
        i += 1
    return "".join(out)


@functools.lru_cache(maxsize=512)
def _pattern(pattern: str) -> regex.Pattern:
    try:
        return regex.compile(_translated(pattern), regex.V1)
    except (regex.error, ValueError) as e:
        raise SchemaError(f"invalid pattern {pattern}: {e}") from None


def _same(a: str, b: str, variety: str) -> bool:
    if variety == "number":
        try:
            return Decimal(a.strip()) == Decimal(b.strip())
        except InvalidOperation:
            return a.strip() == b.strip()
    return a.split() == b.split() if variety == "list" else a == b


class _Validator:
    def __init__(self, schema: Schema):
        self.s = schema
        self.errors: list[str] = []
        self.tables: dict[str, set[tuple]] = {}
        self.ids: set[str] = set()

    def fail(self, n: Node, message: str) -> None:
        self.errors.append(f"element {n.qname}: {message}")

    # -- simple values

    def builtin(self, name: str, value: str) -> str | None:
        collapsed = " ".join(value.split())
        if name in BOUNDS:
            lo, hi = BOUNDS[name]
            ok = re.fullmatch(_INT, collapsed) and (lo is None or int(collapsed) >= lo) and (hi is None or int(collapsed) <= hi)
        else:
            ok = name not in PATTERNS or re.fullmatch(PATTERNS[name], collapsed)
        if ok and name == "ID":
            if collapsed in self.ids:
                return f"the id '{collapsed}' is there twice"
            self.ids.add(collapsed)
        return None if ok else f"'{value}' is not a valid value of the type xs:{name}"

    def simple(self, name: str | None, inline: Node | None, value: str) -> str | None:
        node = inline or self.s.types.get(_local(name) or "")
        if node is None:
            return self.builtin(_local(name) or "string", value)
        for c in _parts(node):
            if c.name == "restriction":
                inner = next((x for x in _parts(c) if x.name == "simpleType"), None)
                return self.simple(_get(c, "base"), inner, value) or self.facets(c, value)
            if c.name == "union":
                members = [*(_get(c, "memberTypes") or "").split()]
                tries = [self.simple(m, None, value) for m in members] + [self.simple(None, x, value) for x in _parts(c)]
                return None if None in tries else f"'{value}' is not a valid value of the union"
            if c.name == "list":
                for x in value.split():
                    if m := self.simple(_get(c, "itemType"), next(iter(_parts(c)), None), x):
                        return m
                return None
        return None

    def variety(self, name: str | None, inline: Node | None) -> str:
        """list, union, number or text: how values of a simple type are counted and compared."""
        node = inline or self.s.types.get(_local(name) or "")
        if node is None:
            local = _local(name) or "string"
            return "list" if local in ("NMTOKENS", "IDREFS", "ENTITIES") else "number" if local in BOUNDS or local in ("decimal", "integer", "double", "float") else "text"
        for c in _parts(node):
            if c.name == "restriction":
                return self.variety(_get(c, "base"), next((x for x in _parts(c) if x.name == "simpleType"), None))
            if c.name in ("list", "union"):
                return c.name
        return "text"

    def facets(self, node: Node, value: str) -> str | None:
        variety = self.variety(_get(node, "base"), next((x for x in _parts(node) if x.name == "simpleType"), None))
        allowed = [_get(f, "value") for f in _parts(node) if f.name == "enumeration"]
        if allowed and not any(_same(value, a or "", variety) for a in allowed):
            return f"'{value}' is not one of {', '.join(map(str, allowed))}"
        patterns = [_get(f, "value") or "" for f in _parts(node) if f.name == "pattern"]
        if patterns and not any(_pattern(p).fullmatch(value) for p in patterns):
            return f"'{value}' does not match the pattern {patterns[0]}"
        for f in _parts(node):
            bound = _get(f, "value") or ""
            wrong = False
            if f.name in ("length", "minLength", "maxLength"):
                n, m = len(value.split() if variety == "list" else value), int(bound)
                wrong = n != m if f.name == "length" else n < m if f.name == "minLength" else n > m
            elif f.name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
                try:
                    x, y = Decimal(value.strip()), Decimal(bound)
                except InvalidOperation:
                    x, y = value, bound  # dates compare as text
                wrong = {"minInclusive": x < y, "maxInclusive": x > y, "minExclusive": x <= y, "maxExclusive": x >= y}[f.name]
            elif f.name in ("totalDigits", "fractionDigits"):
                digits = value.strip().lstrip("+-")
                wrong = len(digits.partition(".")[2]) > int(bound) if f.name == "fractionDigits" else len(digits.replace(".", "").lstrip("0")) > int(bound)
            if wrong:
                return f"'{value}' breaks {f.name} {bound}"
        return None

    # -- structure

    def identity(self, n: Node, decl: Node) -> None:
        """Keys and what is unique below an element, then references to keys."""
        rules = [c for c in _parts(decl) if c.name in ("key", "unique", "keyref")]
        for rule in sorted(rules, key=lambda r: r.name == "keyref"):
            paths = {k: [_by_local_names(_get(p, "xpath") or ".") for p in _parts(rule) if p.name == k] for k in ("selector", "field")}
            name, refer = _get(rule, "name") or "", _local(_get(rule, "refer")) or ""
            seen: set[tuple] = set()
            for hit in T.evaluate(X.parse(paths["selector"][0]), T.Context(n)):
                found = [T.evaluate(X.parse(f), T.Context(hit)) for f in paths["field"]]
                if not all(found):
                    if rule.name == "key":
                        self.fail(hit, f"a field of the key {name} is missing")
                    continue
                value = tuple(T.string(f) for f in found)
                if rule.name == "keyref" and value not in self.tables.get(refer, ()):
                    self.fail(hit, f"no key {refer} has the value {', '.join(value)}")
                elif rule.name != "keyref" and value in seen:
                    self.fail(hit, f"the value {', '.join(value)} of {name} is there twice")
                seen.add(value)
            if rule.name != "keyref":
                self.tables.setdefault(name, set()).update(seen)

    def space(self, decl: Node) -> str | None:
        """The namespace in which an element is declared."""
        top = any(decl is e for e in self.s.elements.values())
        return self.s.target if top or (_get(decl, "form") or ("qualified" if self.s.qualified else "")) == "qualified" else None

    def element(self, n: Node, decl: Node) -> None:
        if _get(decl, "ref"):
            decl = self.s.elements.get(n.name or "", decl)
        if _get(decl, "abstract") == "true":
            self.fail(n, "the element is abstract")
        if self.s.target and (n.ns_uri or None) != self.space(decl):
            self.fail(n, f"the namespace is {n.ns_uri}, not {self.space(decl)}")
        self.identity(n, decl)
        if (nil := _instance(n, "nil")) is not None:
            if _get(decl, "nillable") != "true":
                self.fail(n, "the element is not nillable")
            elif nil.strip() in ("true", "1"):
                if n.children:
                    self.fail(n, "the element is nil but not empty")
                return
        inline = next((c for c in _parts(decl) if c.name in ("complexType", "simpleType")), None)
        name = _get(decl, "type")
        if (given := _instance(n, "type")) is not None:
            inline, name = None, given.strip()
            if (local := _local(name) or "") not in self.s.types and local not in PATTERNS and local not in BOUNDS and local not in ANY_TEXT:
                self.fail(n, f"unknown type {name}")
                return
        node = inline or self.s.types.get(_local(name) or "")
        if (fixed := _get(decl, "fixed")) is not None and n.text() != fixed:
            self.fail(n, f"the value is fixed to '{fixed}'")
        if node is not None and node.name == "complexType":
            self.complex(n, node)
        elif name or inline:
            if any(c.kind == "element" for c in n.children):
                self.fail(n, "element content is not allowed, the type is simple")
            elif m := self.simple(name, inline, n.text()):
                self.fail(n, m)
            for a in n.attrs:
                if a.kind == "attribute" and a.prefix != "xsi":
                    self.fail(n, f"the attribute {a.qname} is not allowed")

    def complex(self, n: Node, node: Node) -> None:
        particles, attrs, simple, mixed = self.content(node)
        self.attributes(n, attrs)
        own = [c for c in n.children if c.kind == "element"]
        if simple is not None:
            if m := self.simple(_get(simple, "base"), None, n.text()) or self.facets(simple, n.text()):
                self.fail(n, m)
            return
        if not mixed and any(c.kind in ("text", "cdata") and (c.value or "").strip() for c in n.children):
            self.fail(n, "character content is not allowed")
        at = 0
        for p in particles:
            end = self.particle(p, own, at, n)
            if end is None:
                shown = own[at].qname if at < len(own) else "the end"
                self.fail(n, f"{shown} is not expected, {self.expected(p)} is")
                return
            at = end
        if at < len(own):
            self.fail(n, f"{own[at].qname} is not expected")

    def content(self, node: Node) -> tuple[list[Node], list[Node], Node | None, bool]:
        mixed = _get(node, "mixed") == "true"
        particles, attrs, simple = [], [], None
        for c in _parts(node):
            if c.name in ("sequence", "choice", "all", "group"):
                particles.append(c)
            elif c.name in ("attribute", "attributeGroup", "anyAttribute"):
                attrs.append(c)
            elif c.name in ("simpleContent", "complexContent"):
                inner = next(iter(_parts(c)))
                more = self.content(inner)
                base = self.s.types.get(_local(_get(inner, "base")) or "")
                if c.name == "simpleContent":
                    simple = inner
                    if base is not None and base.name == "complexType":
                        _, base_attrs, simple, _ = self.content(base)
                        attrs += base_attrs
                elif inner.name == "extension" and base is not None:
                    p, a, _, m = self.content(base)
                    particles, attrs, mixed = [*p, *particles], [*a, *attrs], mixed or m
                particles += more[0]
                attrs += more[1]
        return particles, attrs, simple, mixed

    def attributes(self, n: Node, decls: list[Node]) -> None:
        known, anything = {}, False
        stack = list(decls)
        while stack:
            d = stack.pop()
            if d.name == "anyAttribute":
                anything = True
            elif d.name == "attributeGroup":
                stack += [c for c in _parts(self.s.groups.get(_local(_get(d, "ref")) or "", d))]
            else:
                real = self.s.attributes.get(_local(_get(d, "ref")) or "", d)
                known[_get(real, "name") or ""] = (d, real)
        for a in n.attrs:
            if a.kind != "attribute" or a.prefix in ("xsi", "xml"):
                continue
            if a.name not in known:
                if not anything:
                    self.fail(n, f"the attribute {a.qname} is not allowed")
                continue
            real = known[a.name][1]
            if m := self.simple(_get(real, "type"), next((c for c in _parts(real) if c.name == "simpleType"), None), a.text()):
                self.fail(n, f"attribute {a.qname}: {m}")
            if (fixed := _get(real, "fixed")) is not None and a.text() != fixed:
                self.fail(n, f"attribute {a.qname} is fixed to '{fixed}'")
        for name, (d, _) in sorted(known.items()):
            if _get(d, "use") == "required" and n.attr(name) is None:
                self.fail(n, f"the attribute {name} is required but missing")

    def wild(self, n: Node, p: Node) -> bool:
        """Whether a wildcard takes an element; one that is declared is checked unless the wildcard skips it."""
        spaces = (_get(p, "namespace") or "##any").split()
        here = n.ns_uri or None
        names = {"##targetNamespace": self.s.target, "##local": None}
        if spaces != ["##any"] and not (here not in (None, self.s.target) if spaces == ["##other"] else here in [names.get(x, x) for x in spaces]):
            return False
        how, decl = _get(p, "processContents"), self.s.elements.get(n.name or "")
        if decl is not None and how != "skip" and here == self.s.target:
            self.element(n, decl)
        elif how == "strict":
            self.fail(n, "the element is not declared")
        return True

    def expected(self, p: Node) -> str:
        if p.name == "element":
            return _local(_get(p, "ref")) or _get(p, "name") or "?"
        return " or ".join(self.expected(c) for c in (_parts(p) if p.name == "choice" else _parts(p)[:1])) or "nothing"

    def particle(self, p: Node, own: list[Node], at: int, n: Node) -> int | None:
        """Where a particle's matches end, taking as many as may be; None if there are too few."""
        least = int(_get(p, "minOccurs") or 1)
        most = _get(p, "maxOccurs") or "1"
        limit = len(own) + least + 1 if most == "unbounded" else int(most)
        count = 0
        while count < limit:
            end = self.once(p, own, at, n)
            if end is None or (end == at and count >= least):
                break
            at, count = end, count + 1
        return at if count >= least else None

    def once(self, p: Node, own: list[Node], at: int, n: Node) -> int | None:
        if p.name == "element":
            name = _local(_get(p, "ref")) or _get(p, "name")
            if at < len(own) and (own[at].name == name or (_get(p, "ref") and own[at].name in self.s.substitutes.get(name or "", ()))):
                self.element(own[at], p)
                return at + 1
            return None
        if p.name == "any":
            return at + 1 if at < len(own) and self.wild(own[at], p) else None
        if p.name == "group":
            inner = _parts(self.s.groups.get(_local(_get(p, "ref")) or "", p))
            return self.particle(inner[0], own, at, n) if inner else at
        if p.name == "sequence":
            for c in _parts(p):
                end = self.particle(c, own, at, n)
                if end is None:
                    return None
                at = end
            return at
        if p.name == "choice":
            empty = None
            for c in _parts(p):
                kept = len(self.errors)
                end = self.particle(c, own, at, n)
                if end is not None and end > at:
                    return end
                del self.errors[kept:]
                empty = at if end == at else empty
            return empty
        todo = _parts(p)  # all
        while todo:
            hit = next((c for c in todo if self.once(c, own, at, n) is not None), None)
            if hit is None:
                break
            todo.remove(hit)
            at += 1
        return at if all(int(_get(c, "minOccurs") or 1) == 0 for c in todo) else None


def validate(schema: Schema, doc: Node) -> list[str]:
    """What is wrong with a document; nothing for a valid one."""
    root = next((c for c in doc.children if c.kind == "element"), None)
    if root is None:
        return ["the document is empty"]
    if schema.target:
        qualify(doc)
    decl = schema.elements.get(root.name or "")
    if decl is None:
        return [f"element {root.qname}: no declaration for the root"]
    v = _Validator(schema)
    v.element(root, decl)
    return v.errors
