"""Whole documents in one pass: a text is parsed once, its tree goes through all steps, and what is asked of it comes out.

A Trees is a table of texts and the steps for each text's tree. Nothing runs until one of its results is used, and each result is
one Arrow stage over the texts, without a shuffle, however many steps there are. Tables of nodes (``nodes``) are there for
what joins or groups nodes of many documents.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..model import Node, char_of, document, qualify
from ..sinks import writers
from ..sources import readers
from ..sources.readers import tree_rows
from . import xpath as X
from . import xpath_tree, xsd, xslt

Change = Callable[[Node], Node | None]
#: Texts that are trees at once, and rows of one batch that comes out.
_ROWS, _BATCH = 256, 20_000
#: Characters of a text, and rows of its result, up to which a worker remembers the result; results remembered, for each of so many queries.
_SHORT, _FEW, _REMEMBERED, _QUERIES = 200, 8, 20_000, 4
#: What a Python worker remembers, by query.
_memory: dict[str, _Memory] = {}
#: Tasks that rows with one text are dealt to.
_SALT = 8


class _Memory(dict):
    """Results of short texts, as columns of texts repeat; the first ones are kept."""

    @staticmethod
    def of(query: str) -> _Memory:
        if query not in _memory:
            while len(_memory) >= _QUERIES:
                del _memory[next(iter(_memory))]
            _memory[query] = _Memory()
        return _memory[query]

    def keep(self, key: tuple, rows: list[tuple]) -> None:
        if len(self) < _REMEMBERED and len(rows) <= _FEW and sum(len(v) for r in rows for v in r if isinstance(v, str)) <= 4 * _SHORT:
            self[key] = rows


# -- changes to one tree


def found(doc: Node, e: object) -> list[Node]:
    """The nodes that a parsed path gives, in document order."""
    out = xpath_tree.evaluate(e, xpath_tree.Context(doc))
    if not isinstance(out, list):
        raise X.XPathError("the expression gives no nodes")
    return xpath_tree.ordered(out)


def copied(n: Node) -> Node:
    out = Node(n.kind, n.name, n.prefix, n.value, n.ns_uri)
    for x in [*n.attrs, *n.children]:
        out.add(copied(x))
    return out


def _everywhere(doc: Node) -> Iterator[Node]:
    """All nodes, attributes and their parts too."""
    stack = [doc]
    while stack:
        n = stack.pop()
        yield n
        stack += reversed([*n.attrs, *n.children])


def _rid(doc: Node, gone: Iterable[Node]) -> None:
    out = {id(n) for n in gone}
    if out:
        for n in {id(g.parent): g.parent for g in gone if g.parent is not None}.values():
            n.attrs = [a for a in n.attrs if id(a) not in out]
            n.children = [c for c in n.children if id(c) not in out]


def _in_attribute(n: Node) -> bool:
    return n.parent is not None and n.parent.kind == "attribute"


def selected(doc: Node, e: object, order: str) -> Node:
    """A document of the nodes found, by themselves; an attribute becomes an element."""
    nodes = [n for n in found(doc, e) if n.kind != "document"]
    _rid(doc, nodes)
    out = document()
    for n in nodes if order == "document" else reversed(nodes):
        if n.kind == "attribute":
            made = Node("element", n.name, n.prefix, ns_uri=n.ns_uri)
            for c in [Node("text", value=n.value)] if n.value is not None and not n.children else n.children:
                made.add(c)
            n = made
        out.add(n)
    return out


def deleted(doc: Node, e: object) -> Node:
    _rid(doc, [n for n in found(doc, e) if n.kind != "document"])
    return doc


def replaced(doc: Node, e: object, value: str) -> Node:
    """``value`` as the content of the first node found."""
    for n in found(doc, e)[:1]:
        n.children = []
        if n.kind == "element":
            n.add(Node("text", value=value))
        elif n.kind != "document":
            n.value = value
    return doc


def without_entity(doc: Node, name: str) -> Node:
    _rid(doc, [n for n in _everywhere(doc) if n.kind == "entity" and n.name == name and not _in_attribute(n)])
    return doc


def merged(doc: Node) -> Node:
    """Adjacent texts as one, and attributes of one text as its value."""
    for n in _everywhere(doc):
        if len(n.children) > 1:
            kept: list[Node] = []
            for c in n.children:
                if c.kind == "text" and kept and kept[-1].kind == "text":
                    kept[-1].value = (kept[-1].value or "") + (c.value or "")
                else:
                    kept.append(c)
            n.children = kept
        for a in n.attrs:
            if a.kind == "attribute" and a.children and all(c.kind == "text" for c in a.children):
                a.value, a.children = "".join(c.value or "" for c in a.children), []
    return doc


def with_text(doc: Node, text_of: Callable[[str], str | None]) -> Node:
    """Texts for the references to entities for which there is one."""
    for n in list(_everywhere(doc)):
        if n.kind == "entity" and (t := text_of(n.name or "")) is not None:
            n.kind, n.name, n.value = "text", None, t
    return merged(doc)


def with_tree(doc: Node, name: str, top: Node) -> Node:
    for n in list(_everywhere(doc)):
        if n.kind == "entity" and n.name == name and not _in_attribute(n):
            new = copied(top)
            new.parent = n.parent
            n.parent.children[next(i for i, c in enumerate(n.parent.children) if c is n)] = new
    return doc


def with_attribute(doc: Node, e: object, name: str, value: str) -> Node:
    for n in found(doc, e):
        if n.kind == "element":
            n.attrs = [a for a in n.attrs if a.kind != "attribute" or a.name != name]
            n.add(Node("attribute", name, value=value))
    return doc


def under(doc: Node, name: str) -> Node:
    root = Node("element", name)
    for c in doc.children:
        root.add(c)
    return document(root)


def more(doc: Node, tops: list[Node]) -> Node:
    for t in tops:
        doc.add(copied(t))
    return doc


# -- what is read off one tree


def leading(n: Node) -> str | None:
    """A node's own value, or the content of the first node in it."""
    return n.value if n.value is not None else n.children[0].value if n.children else None


def numbers(doc: Node) -> dict[int, int]:
    """The number of each node in document order, attributes included, from 0, by identity."""
    out: dict[int, int] = {}
    for n in _everywhere(doc):
        out[id(n)] = len(out) - 1
    return out


def filled(n: Node, parts: list[tuple[str, object]]) -> str:
    """A template for an element: texts, and expressions for ${...}."""
    out = []
    for text, e in parts:
        out.append(text)
        if e == "..":
            out.append(n.qname)
        elif e is not None:
            out.append(xpath_tree.string(xpath_tree.evaluate(e, xpath_tree.Context(n))))
    return "".join(out)


# -- tables


@dataclass(frozen=True)
class Trees:
    """``texts``: (doc_id, raw, type, ...) and ``make``: the tree of a row, whatever its doc_id and ``kept``. A text that has no tree, by a ValueError, is a document of one node of kind error.

    Columns ``kept`` of ``texts`` go on to all results beside doc_id.
    """

    texts: DataFrame
    make: Callable[[dict], Node]
    changes: tuple[Change, ...] = ()
    kept: tuple[str, ...] = ()

    def change(self, f: Change) -> Trees:
        """With one more step, a function from tree to tree; where it gives none, or an empty document, the document is gone."""
        return replace(self, changes=(*self.changes, f))

    def select(self, path: str, order: str = "reverse") -> Trees:
        """New documents of the nodes found, in reverse document order or order="document"."""
        e = X.parse(path)
        return self.change(lambda doc: selected(doc, e, order))

    def delete(self, path: str) -> Trees:
        """Without the nodes found; an invalid path changes nothing."""
        try:
            e = X.parse(path)
        except X.XPathError:
            return self
        return self.change(lambda doc: deleted(doc, e))

    def replace(self, path: str, value: str) -> Trees:
        e = X.parse(path)
        return self.change(lambda doc: replaced(doc, e, value))

    def replace_argument(self, argument: str) -> Trees:
        """``replace`` from XPATH=VALUE, cut at the first equals sign."""
        path, equals, value = argument.partition("=")
        if not equals:
            raise X.XPathError("replace needs XPATH=VALUE")
        return self.replace(path, value)

    def delete_entity(self, name: str) -> Trees:
        return self.change(lambda doc: without_entity(doc, name))

    def replace_entity(self, name: str, text: str) -> Trees:
        return self.change(lambda doc: with_text(doc, lambda n: text if n == name else None))

    def replace_entity_with_tree(self, name: str, content: str | Node, kind: str = "brace") -> Trees:
        top = (readers.parse(content, kind) if isinstance(content, str) else content).children[0]
        return self.change(lambda doc: with_tree(doc, name, top))

    def substitute_entity(self, name: str | None = None) -> Trees:
        """Characters for references: all numeric ones, or those of one name."""
        return self.change(lambda doc: with_text(doc, lambda n: char_of(n) if (n == name if name else n.startswith("#")) else None))

    def add(self, content: str | Node) -> Trees:
        tops = (readers.parse(content, "brace") if isinstance(content, str) else content).children
        return self.change(lambda doc: more(doc, tops))

    def add_root(self, name: str) -> Trees:
        return self.change(lambda doc: under(doc, name))

    def set_attribute(self, path: str, name: str, value: str) -> Trees:
        e = X.parse(path)
        return self.change(lambda doc: with_attribute(doc, e, name, value))

    def transform(self, sheet: str, kind: str = "brace", params: dict | None = None, documents: dict[str, str] | None = None) -> Trees:
        """Through a stylesheet. ``documents``: small texts for document(), import and include, by name; all are parsed on the driver."""
        others = {k: readers.parse(v, sniffed(v), trim=False) for k, v in (documents or {}).items()}
        compiled = xslt.compile(readers.parse(sheet, kind, trim=False), others)
        return self.change(lambda doc: xslt.transform(compiled, doc, params, others))

    def valid(self, schema: str, kind: str = "brace") -> Trees:
        """Only documents that a schema takes."""
        compiled = xsd.compile(readers.parse(schema, kind, trim=False))
        return self.change(lambda doc: None if xsd.validate(compiled, doc) else doc)

    def _maker(self) -> Callable[[dict], Node | None]:
        """The tree of a row after all steps; a function that holds nothing of Spark."""
        make, changes = self.make, self.changes

        def tree(row: dict) -> Node | None:
            try:
                doc = make(row)
            except ValueError as e:
                doc = document(Node("error", value=str(e)))
            for change in changes:
                doc = change(doc)
                if doc is None or not doc.children:
                    return None
            if changes:
                qualify(doc)
            return doc

        return tree

    def each(self, use: Callable[[Node], Iterable[tuple]], fields: str) -> DataFrame:
        """doc_id and ``fields``, as "name type, ..." of string, int, long, double and boolean: rows that ``use`` makes of each tree."""
        names, kinds = zip(*(f.split() for f in fields.split(", ")), strict=True)
        lead = ["doc_id", *self.kept]
        types = [*[to_arrow_type(self.texts.schema[c].dataType) for c in lead], *[{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[k] for k in kinds]]
        schema = ", ".join([*[f"`{c}` {self.texts.schema[c].dataType.simpleString()}" for c in lead], fields])
        tree = self._maker()
        others = [c for c in self.texts.columns if c not in lead and c != "raw"]  # what the tree depends on beside the text
        query = uuid.uuid4().hex

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [*lead, *names])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            memory = _Memory.of(query)
            for b in batches:
                for at in range(0, b.num_rows, _ROWS):
                    for row in b.slice(at, _ROWS).to_pylist():
                        key = (row["raw"], *(row[c] for c in others)) if len(row["raw"]) <= _SHORT else None
                        found = memory.get(key) if key else None
                        if found is None:
                            doc = tree(row)
                            found = list(use(doc)) if doc is not None else []
                            if key:
                                memory.keep(key, found)
                        own = tuple(row[c] for c in lead)
                        out += [(*own, *r) for r in found]
                        if len(out) >= _BATCH:
                            yield batch(out)
                            out = []
            if out:
                yield batch(out)

        return self.texts.mapInArrow(run, schema)

    def nodes(self) -> DataFrame:
        """Rows of NODES."""
        tree = self._maker()
        return tree_rows(self.texts, lambda row: tree(row) or document())

    def render(self, kind: str, **options) -> DataFrame:
        """(doc_id, text) in one of the formats of ``writers.renderer``."""
        show = writers.renderer(kind, **options)
        return self.each(lambda doc: [(show(doc),)], "text string")

    def clines(self) -> DataFrame:
        """(doc_id, line_no, line): a path line for each leaf."""
        show = writers.renderer("clines")
        return self.each(lambda doc: enumerate(show(doc).splitlines()), "line_no int, line string")

    def found(self, path: str) -> DataFrame:
        """(doc_id, pre, value): the string value of each node found, in document order."""
        e = X.parse(path)

        def use(doc: Node) -> Iterator[tuple]:
            place = numbers(doc)
            return ((place[id(n)], n.text()) for n in found(doc, e))

        return self.each(use, "pre int, value string")

    def values(self, path: str) -> DataFrame:
        """(doc_id, value): the string value of each node found."""
        e = X.parse(path)
        return self.each(lambda doc: ((n.text(),) for n in found(doc, e)), "value string")

    def first(self, path: str) -> DataFrame:
        """(doc_id, value): of the first node found its own value, or the content of the first node in it."""
        e = X.parse(path)
        return self.each(lambda doc: ((leading(n),) for n in found(doc, e)[:1]), "value string")

    def evaluate(self, expression: str, kind: str = "string") -> DataFrame:
        """(doc_id, value) of an expression, as a string, double or boolean."""
        e = X.parse(expression)
        as_kind = {"string": xpath_tree.string, "double": xpath_tree.number, "boolean": xpath_tree.boolean}[kind]
        return self.each(lambda doc: [(as_kind(xpath_tree.evaluate(e, xpath_tree.Context(doc))),)], f"value {kind}")

    def foreach(self, path: str, template: str) -> DataFrame:
        """(doc_id, pre, line): the template for each node found, with ${name} for a child's text, ${.} for its own and ${..} for its name; what is no element stands for its parent."""
        e, parts, at = X.parse(path), [], 0
        for m in re.finditer(r"\$\{([^}]*)\}", template):
            parts.append((template[at : m.start()], ".." if m[1] == ".." else X.parse(m[1])))
            at = m.end()
        parts.append((template[at:], None))

        def use(doc: Node) -> Iterator[tuple]:
            place = numbers(doc)
            tops = {id(t): t for n in found(doc, e) if (t := n if n.kind == "element" else n.parent) is not None}
            return ((place[k], filled(t, parts)) for k, t in tops.items())

        return self.each(use, "pre int, line string")

    def validate(self, schema: str, kind: str = "brace") -> DataFrame:
        """(doc_id, valid, message): message has the first thing that is wrong."""
        compiled = xsd.compile(readers.parse(schema, kind, trim=False))

        def use(doc: Node) -> list[tuple]:
            errors = xsd.validate(compiled, doc)
            return [(not errors, errors[0] if errors else None)]

        return self.each(use, "valid boolean, message string")


def sniffed(text: str) -> str:
    """The kind of a small text on the driver."""
    start = text.lstrip()[:1]
    return "json" if start in ("{", "[", '"') else "xml" if start == "<" else "brace"


def of(df: DataFrame, content: Column | str, doc_id: Column | str = "doc_id", kind: str | None = None, trim: bool | None = None, merge: bool = True, root: str | None = None, forced: bool = False, keep: Iterable[str] = ()) -> Trees:
    """The trees of a column of texts; see ``readers.nodes``. Texts that are null have none. ``keep``: columns that go along to results."""
    return Trees(readers.texts(df, content, doc_id, kind, forced, keep), readers.maker(trim, merge, root), kept=tuple(keep))


def parsed(df: DataFrame, content: Column | str, grammar: str, doc_id: Column | str = "doc_id", every: bool = False, silent: bool = False, recover: bool = False) -> Trees:
    """The trees of a column of texts by a grammar, which is checked here, on the driver."""
    from ..grammar import registry

    registry.machine(grammar)
    content = F.col(content) if isinstance(content, str) else content
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    slim = df.select(doc_id.cast("long").alias("doc_id"), content.alias("raw")).filter("raw is not null")
    # equal texts meet where they are remembered
    slim = readers.dealt(slim, "raw", F.when(F.length("raw") <= _SHORT, F.pmod("doc_id", F.lit(_SALT))).otherwise(F.col("doc_id")))
    return Trees(slim, lambda row: registry.parse_text(grammar, row["raw"], every, silent, recover))
