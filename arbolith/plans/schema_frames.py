"""Schemas over tables of nodes: simple types become expressions, content models counts and windows, keys aggregates and anti-joins.

For schemas whose documents have bounded depth and whose content is sequences or sets of elements; others are for the one-pass validator (``xsd``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Node
from . import xpath as X
from . import xsd
from .xpath_frames import Frames, select, string_values


class NotRelational(ValueError):
    """A schema that can't be said as columns."""


_DECIMAL = "decimal(38,9)"


def _java(pattern: str) -> str:
    """A pattern of XML Schema for the JVM, where a set is subtracted by an intersection with its complement."""
    return xsd._translated(pattern).replace("--[", "&&[^").replace("·", "\\x{b7}")


class Types:
    """Conditions on string columns, from the simple types of a schema."""

    def __init__(self, schema: xsd.Schema):
        self.schema, self.validator = schema, xsd._Validator(schema)

    def builtin(self, name: str, value: Column) -> Column:
        flat = F.trim(F.regexp_replace(value, r"\s+", " "))
        if name in xsd.BOUNDS:
            low, high = xsd.BOUNDS[name]
            number = flat.try_cast("decimal(38,0)")
            fits = F.regexp_like(flat, F.lit(f"^(?:{xsd._INT})$"))
            for bound, ok in ((low, lambda b: number >= b), (high, lambda b: number <= b)):
                if bound is not None:
                    fits = fits & F.coalesce(ok(F.lit(bound).cast("decimal(38,0)")), F.lit(False))
            return fits
        return F.regexp_like(flat, F.lit(f"^(?:{xsd.PATTERNS[name]})$")) if name in xsd.PATTERNS else F.lit(True)

    def valid(self, name: str | None, inline: Node | None, value: Column) -> Column:
        node = inline or self.schema.types.get(xsd._local(name) or "")
        if node is None:
            return self.builtin(xsd._local(name) or "string", value)
        for c in xsd._parts(node):
            inner = [x for x in xsd._parts(c) if x.name == "simpleType"]
            if c.name == "restriction":
                return self.valid(xsd._get(c, "base"), inner[0] if inner else None, value) & self.facets(c, value)
            if c.name == "union":
                out = F.lit(False)
                for m in (xsd._get(c, "memberTypes") or "").split():
                    out = out | self.valid(m, None, value)
                for x in inner:
                    out = out | self.valid(None, x, value)
                return out
            if c.name == "list":
                return F.forall(self._items(value), lambda x: self.valid(xsd._get(c, "itemType"), inner[0] if inner else None, x))
        return F.lit(True)

    @staticmethod
    def _items(value: Column) -> Column:
        return F.filter(F.split(value, r"\s+"), lambda x: x != "")

    def facets(self, node: Node, value: Column) -> Column:
        inner = next((x for x in xsd._parts(node) if x.name == "simpleType"), None)
        variety = self.validator.variety(xsd._get(node, "base"), inner)
        number, out = F.trim(value).try_cast(_DECIMAL), F.lit(True)
        given = {n: [xsd._get(f, "value") or "" for f in xsd._parts(node) if f.name == n] for n in ("enumeration", "pattern")}
        if allowed := given["enumeration"]:
            if variety == "number":
                out = out & F.coalesce(number.isin(*[F.lit(a).cast(_DECIMAL) for a in allowed]), F.lit(False))
            elif variety == "list":
                out = out & F.array_join(self._items(value), " ").isin([" ".join(a.split()) for a in allowed])
            else:
                out = out & value.isin(allowed)
        if patterns := given["pattern"]:
            out = out & F.regexp_like(value, F.lit("^(?:" + "|".join(f"(?:{_java(p)})" for p in patterns) + ")$"))
        length = F.size(self._items(value)) if variety == "list" else F.char_length(value)
        digits = F.regexp_replace(F.trim(value), "^[+-]", "")
        for f in xsd._parts(node):
            bound = xsd._get(f, "value") or ""
            n = F.lit(bound).try_cast(_DECIMAL)
            plain = n.isNotNull() & number.isNotNull()  # dates compare as text
            test = {
                "length": lambda: length == int(bound), "minLength": lambda: length >= int(bound), "maxLength": lambda: length <= int(bound),
                "minInclusive": lambda: F.when(plain, number >= n).otherwise(value >= bound), "maxInclusive": lambda: F.when(plain, number <= n).otherwise(value <= bound),
                "minExclusive": lambda: F.when(plain, number > n).otherwise(value > bound), "maxExclusive": lambda: F.when(plain, number < n).otherwise(value < bound),
                "fractionDigits": lambda: F.char_length(F.regexp_extract(digits, r"\.(\d*)", 1)) <= int(bound), "totalDigits": lambda: F.char_length(F.regexp_replace(F.regexp_replace(digits, r"\.", ""), "^0+", "")) <= int(bound),
            }.get(f.name or "")
            if test is not None:
                out = out & test()
        return out


@dataclass
class _Model:
    """What a schema says of each path: simple values, children with their least and most numbers and order, attributes."""

    values: dict[str, tuple[str | None, Node | None]] = field(default_factory=dict)
    children: dict[str, list[tuple[str, int, int | None]]] = field(default_factory=dict)
    ordered: set[str] = field(default_factory=set)
    attributes: dict[str, dict[str, bool]] = field(default_factory=dict)


def _model(schema: xsd.Schema, root: str) -> _Model:
    model = _Model()
    validator = xsd._Validator(schema)

    def visit(decl: Node, path: str, open_: tuple[str, ...]) -> None:
        if xsd._get(decl, "ref"):
            decl = schema.elements[xsd._local(xsd._get(decl, "ref")) or ""]
        if schema.substitutes.get(xsd._get(decl, "name") or ""):
            raise NotRelational("elements that stand for others")
        inline = next((c for c in xsd._parts(decl) if c.name in ("complexType", "simpleType")), None)
        name = xsd._get(decl, "type")
        node = inline or schema.types.get(xsd._local(name) or "")
        if node is None or node.name == "simpleType":
            if name or node is not None:
                model.values[path] = name, inline if inline is not None and inline.name == "simpleType" else None
                model.children[path] = []
            return
        if (own := xsd._get(node, "name") or "") and own in open_:
            raise NotRelational("documents of any depth")
        particles, attrs, simple, mixed = validator.content(node)
        if mixed or simple is not None and len(xsd._parts(simple)) > sum(x.name in ("attribute", "attributeGroup") for x in xsd._parts(simple)):
            raise NotRelational("mixed or restricted simple content")
        found = model.attributes.setdefault(path, {})
        for a in attrs:
            if a.name != "attribute" or xsd._get(a, "ref"):
                raise NotRelational("attributes by reference")
            found[xsd._get(a, "name") or ""] = xsd._get(a, "use") == "required"
            model.values[f"{path}/@{xsd._get(a, 'name')}"] = xsd._get(a, "type"), next((x for x in xsd._parts(a) if x.name == "simpleType"), None)
        model.children[path] = []
        if simple is not None:
            model.values[path] = xsd._get(simple, "base"), None
            return
        for p in particles:
            if p.name not in ("sequence", "all") or any(xsd._get(p, k) not in (None, "1") for k in ("minOccurs", "maxOccurs")) or any(e.name != "element" for e in xsd._parts(p)) or model.children[path]:
                raise NotRelational("content that is no sequence or set of elements")
            if p.name == "sequence":
                model.ordered.add(path)
            for e in xsd._parts(p):
                child = xsd._get(e, "name") or xsd._local(xsd._get(e, "ref")) or ""
                if any(child == c for c, _, _ in model.children[path]):
                    raise NotRelational("an element in two places")
                most = xsd._get(e, "maxOccurs") or "1"
                model.children[path].append((child, int(xsd._get(e, "minOccurs") or 1), None if most == "unbounded" else int(most)))
                visit(e, f"{path}/{child}", (*open_, own))

    if root not in schema.elements:
        raise xsd.SchemaError(f"no element {root}")
    visit(schema.elements[root], f"/{root}", ())
    return model


def violations(nodes: DataFrame, schema: xsd.Schema, root: str) -> DataFrame:
    """(doc_id, pre, message) of what is wrong in documents whose top is to be ``root``: values that their types don't let through, elements and attributes that aren't
    declared or are missing, too few or many of a kind, wrong order. Identity constraints are for ``duplicates`` and ``broken``. NotRelational for schemas beyond that.
    """
    model = _model(schema, root)
    types = Types(schema)
    elements, attributes = nodes.filter("kind = 'element'"), nodes.filter("kind = 'attribute' and coalesce(prefix, '') != 'xsi'")
    known = [p for p in model.values if "/@" not in p] + [p for p in model.children]
    out = [elements.filter(~F.col("path").isin(known)).select("doc_id", "pre", F.concat(F.lit("element "), "path", F.lit(" is not expected")).alias("message"))]
    declared = [f"{p}/@{a}" for p, found in model.attributes.items() for a in found]
    out.append(attributes.filter(~F.col("path").isin(declared)).select("doc_id", "pre", F.concat(F.lit("attribute "), "path", F.lit(" is not allowed")).alias("message")))
    # values: attributes hold theirs, elements that of the texts below
    texts = string_values(elements.filter(F.col("path").isin([p for p in model.values if "/@" not in p])), nodes).select("doc_id", "pre", "path", "text")
    held = texts.unionByName(attributes.filter("value is not null").select("doc_id", "pre", "path", F.col("value").alias("text")))
    fine = F.lit(True)
    for path, (name, inline) in model.values.items():
        fine = F.when(F.col("path") == path, types.valid(name, inline, F.col("text"))).otherwise(fine)
    out.append(held.filter(~fine).select("doc_id", "pre", F.concat(F.lit("'"), "text", F.lit("' is not a valid value of "), "path").alias("message")))
    # numbers of children: each that has to be there is asked for, with none counted as 0
    rules = [(p, f"{p}/{c}", low, high) for p, found in model.children.items() for c, low, high in found] + [(p, f"{p}/@{a}", 1, 1) for p, found in model.attributes.items() for a, required in found.items() if required]
    if rules:
        asked = nodes.sparkSession.createDataFrame(rules, "path string, child string, low int, high int")  # one row a rule of the schema
        counts = nodes.filter("kind in ('element', 'attribute')").groupBy("doc_id", F.col("parent").alias("pre"), F.col("path").alias("child")).agg(F.count("*").alias("n"))
        wanted = elements.select("doc_id", "pre", "path").join(F.broadcast(asked), "path")
        seen = wanted.join(counts, ["doc_id", "pre", "child"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        wrong = seen.filter("n < low or n > high")
        out.append(wrong.select("doc_id", "pre", F.concat(F.col("n").cast("string"), F.lit(" of "), "child").alias("message")))
    places = {f"{p}/{c}": i for p in model.ordered for i, (c, _, _) in enumerate(model.children[p])}
    if places:
        place = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])[F.col("path")]
        before = F.max("place").over(Window.partitionBy("doc_id", "parent").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
        moved = elements.withColumn("place", place).withColumn("before", before).filter("place < before")
        out.append(moved.select("doc_id", "pre", F.concat(F.lit("element "), "path", F.lit(" comes too late")).alias("message")))
    tops = elements.filter((F.col("level") == 0) & (F.col("name") != root))
    out.append(tops.select("doc_id", "pre", F.lit(f"the top is not {root}").alias("message")))
    bad = nodes.filter("kind = 'error'").select("doc_id", "pre", F.col("value").alias("message"))
    for more in out:
        bad = bad.unionByName(more)
    return bad


def keys(nodes: DataFrame, selector: str, fields: list[str]) -> DataFrame:
    """(doc_id, pre, k0, k1 ...): the values of an identity constraint's fields at the nodes that ``selector`` gives; a node without one of the fields is left out."""
    frames, rows = Frames(nodes), select(nodes, selector)
    names = []
    for i, f in enumerate(fields):
        e = X.parse(f)
        rows, has = frames.value(e, rows)
        rows = rows.filter(has.as_("bool"))
        rows, value = frames._string(e, rows)
        rows = rows.withColumn(f"k{i}", value)
        names.append(f"k{i}")
    return rows.select("doc_id", "pre", *names)


def duplicates(found: DataFrame, across: bool = False) -> DataFrame:
    """Of ``keys``, those that more than one node has, with ``n``: in a document, or with ``across`` in all."""
    names = [c for c in found.columns if c[0] == "k"]
    return found.groupBy(*([] if across else ["doc_id"]), *names).agg(F.count("*").alias("n")).filter("n > 1")


def broken(refs: DataFrame, found: DataFrame, across: bool = False) -> DataFrame:
    """The rows of ``refs`` (see ``keys``) that no row of ``found`` has the values of: in the same document, or with ``across`` in any, also of another table."""
    names = [*([] if across else ["doc_id"]), *(c for c in refs.columns if c[0] == "k")]
    return refs.join(found.select(*names).distinct(), names, "left_anti")
