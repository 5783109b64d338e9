"""Pipelines of steps over tables of documents: checked when they are put together, run by Spark when the result is used.

Over texts, all steps work on each text's tree in one pass (``trees``); over tables of nodes, each is a relational plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from ..model import Node, build
from ..operators import measure, mutate
from ..sinks import writers
from ..sources import readers
from ..sources.readers import tree_rows
from . import trees, xpath, xsd, xslt
from .trees import Trees, sniffed


@dataclass(frozen=True)
class Step:
    name: str
    over_trees: Callable[[Trees], Trees]
    over_nodes: Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Pipeline:
    """Steps from documents to documents. Every method gives a new pipeline."""

    steps: tuple[Step, ...] = ()

    def then(self, name: str, over_trees: Callable[[Trees], Trees], over_nodes: Callable[[DataFrame], DataFrame]) -> Pipeline:
        return Pipeline((*self.steps, Step(name, over_trees, over_nodes)))

    def select(self, path: str, order: str = "reverse") -> Pipeline:
        xpath.parse(path)
        return self.then(f"select {path}", lambda t: t.select(path, order), lambda n: mutate.select(n, path, order))

    def delete(self, path: str) -> Pipeline:
        return self.then(f"delete {path}", lambda t: t.delete(path), lambda n: mutate.delete(n, path))

    def replace(self, argument: str) -> Pipeline:
        xpath.parse(argument.partition("=")[0])
        return self.then(f"replace {argument}", lambda t: t.replace_argument(argument), lambda n: mutate.replace_argument(n, argument))

    def delete_entity(self, name: str) -> Pipeline:
        return self.then(f"delete-entity {name}", lambda t: t.delete_entity(name), lambda n: mutate.delete_entity(n, name))

    def replace_entity(self, name: str, value: str | Node) -> Pipeline:
        if isinstance(value, str):
            return self.then(f"replace-entity {name}", lambda t: t.replace_entity(name, value), lambda n: mutate.replace_entity(n, name, value))
        return self.then(f"replace-entity {name}", lambda t: t.replace_entity_with_tree(name, value), lambda n: mutate.replace_entity_with_tree(n, name, value))

    def substitute(self, name: str | None = None) -> Pipeline:
        return self.then("substitute", lambda t: t.substitute_entity(name), lambda n: mutate.substitute_entity(n, name))

    def add(self, snippet: str) -> Pipeline:
        mutate.snippet_rows(snippet)
        return self.then("add", lambda t: t.add(snippet), lambda n: mutate.add(n, snippet))

    def add_root(self, name: str) -> Pipeline:
        return self.then(f"add-root {name}", lambda t: t.add_root(name), lambda n: mutate.add_root(n, name))

    def set_attribute(self, path: str, name: str, value: str) -> Pipeline:
        xpath.parse(path)
        return self.then(f"set {path}/@{name}", lambda t: t.set_attribute(path, name, value), lambda n: mutate.set_attribute(n, path, name, value))

    def transform(self, sheet: str, kind: str = "brace", params: dict | None = None, documents: dict[str, str] | None = None) -> Pipeline:
        return self.then("transform", lambda t: t.transform(sheet, kind, params, documents), lambda n: transform(n, sheet, kind, params, documents))

    def validate(self, schema: str, kind: str = "brace") -> Pipeline:
        """Only valid documents go on."""
        return self.then("validate", lambda t: t.valid(schema, kind), lambda n: n.join(validate(n, schema, kind).filter("valid").select("doc_id"), "doc_id", "left_semi"))

    def run(self, nodes: DataFrame) -> DataFrame:
        """Over a table of nodes."""
        for s in self.steps:
            nodes = s.over_nodes(nodes)
        return nodes

    def over(self, documents: Trees) -> Trees:
        for s in self.steps:
            documents = s.over_trees(documents)
        return documents

    def _trees(self, df: DataFrame, content: Column | str, doc_id: Column | str, grammar: str | None, options: dict) -> Trees:
        return self.over(trees.parsed(df, content, grammar, doc_id, **options) if grammar else trees.of(df, content, doc_id, **options))

    def read(self, df: DataFrame, content: Column | str, doc_id: Column | str = "doc_id", grammar: str | None = None, **options) -> DataFrame:
        """Rows of nodes of a table of texts after all steps."""
        return self._trees(df, content, doc_id, grammar, options).nodes()

    def render(self, df: DataFrame, content: Column | str, to: str, doc_id: Column | str = "doc_id", grammar: str | None = None, to_options: dict | None = None, **options) -> DataFrame:
        """(doc_id, text) of a table of texts after all steps."""
        return self._trees(df, content, doc_id, grammar, options).render(to, **(to_options or {}))

    def explain(self) -> str:
        return " -> ".join(s.name for s in self.steps) or "nothing"


def transform(nodes: DataFrame, sheet: str, kind: str = "brace", params: dict | None = None, documents: dict[str, str] | None = None) -> DataFrame:
    """Each document of a table of nodes through a stylesheet. ``documents``: small texts for document(), import and include, by name; all are parsed on the driver."""
    others = {k: readers.parse(v, sniffed(v), trim=False) for k, v in (documents or {}).items()}
    compiled = xslt.compile(readers.parse(sheet, kind, trim=False), others)
    grouped = writers.gathered(nodes)
    return tree_rows(grouped, lambda row: xslt.transform(compiled, build(row["nodes"]), params, others))


def validate(nodes: DataFrame, schema: str, kind: str = "brace") -> DataFrame:
    """(doc_id, valid, message) of a table of nodes: message has the first thing that is wrong. The schema serves all documents."""
    compiled = xsd.compile(readers.parse(schema, kind, trim=False))

    def check(doc: Node) -> str | None:
        errors = xsd.validate(compiled, doc)
        return errors[0] if errors else None

    out = writers.trees(nodes, check, "message")
    return out.selectExpr("doc_id", "message is null as valid", "message")


def statistics(df: DataFrame, content: Column | str, doc_id: Column | str = "doc_id", kind: str | None = None) -> DataFrame:
    """Counters of each document of a table of texts."""
    docs = readers.docs(df, content, doc_id)
    return measure.statistics(readers.nodes(df, content, doc_id, kind), docs)
