"""Table functions for SQL: nodes, tokens and matches of a grammar, to be used with LATERAL.

    register(spark)
    spark.sql("SELECT page_id, n.path FROM pages, LATERAL tree_nodes(html, 'html') n WHERE n.kind = 'element'")
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..model import NODES, shred
from ..plans import xpath, xpath_tree
from ..sources import brace, readers

_TYPES = {"int": IntegerType(), "string": StringType()}


def _schema(ddl: str) -> StructType:
    return StructType([StructField(c, _TYPES[t]) for c, t in (x.split() for x in ddl.split(", "))])


def _constant(argument: AnalyzeArgument, what: str) -> str:
    if not isinstance(argument.value, str):
        raise ValueError(f"{what} has to be a constant string")
    return argument.value


class TreeNodes:
    """tree_nodes(text, type): the nodes of a text of that type (brace, xml, html, json, text), columns of NODES without doc_id. A text that can't be parsed gives a row of kind error."""

    @staticmethod
    def analyze(text: AnalyzeArgument, kind: AnalyzeArgument) -> AnalyzeResult:
        if _constant(kind, "the type") not in ("brace", "xml", "html", "json", "text"):
            raise ValueError(f"unknown type {kind.value}")
        return AnalyzeResult(_schema(NODES.split(", ", 1)[1]))

    def eval(self, text: str | None, kind: str) -> Iterator[tuple]:
        if text is None:
            return
        try:
            for r in shred(readers.parse(text, kind), None):
                yield r[1:]
        except ValueError as e:
            yield 0, 0, -1, 0, 0, "error", None, None, None, str(e), ""


class BraceTokens:
    """brace_tokens(text): i, kind, text, line, col of the tokens of brace syntax; a text that is none gives one of kind error."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(_schema("i int, kind string, text string, line int, col int"))

    def eval(self, text: str | None) -> Iterator[tuple]:
        if text is None:
            return
        try:
            for i, t in enumerate(brace.tokenize(text)):
                yield i, *t
        except brace.ParseError as e:
            yield 0, "error", str(e), e.line, e.column


class GrammarRows:
    """grammar_rows(text, grammar, row, NAME => path ...): a row for each node that the path ``row`` gives in the document that a grammar makes of a text.

    The columns are the named arguments: strings, the values of their paths from that node. A text that doesn't parse has no such nodes.
    """

    def __init__(self):
        self.paths: dict[str, object] = {}

    @staticmethod
    def analyze(text: AnalyzeArgument, grammar: AnalyzeArgument, row: AnalyzeArgument, **columns: AnalyzeArgument) -> AnalyzeResult:
        from ..grammar import registry

        registry.machine(_constant(grammar, "the grammar"))
        for what, path in (("the rows' path", row), *columns.items()):
            xpath.parse(_constant(path, what))
        return AnalyzeResult(_schema(", ".join(f"{c} string" for c in columns)))

    def _path(self, text: str) -> object:
        if text not in self.paths:
            self.paths[text] = xpath.parse(text)
        return self.paths[text]

    def eval(self, text: str | None, grammar: str, row: str, **columns: str) -> Iterator[tuple]:
        from ..grammar import registry

        if text is None:
            return
        doc = registry.parse_text(grammar, text, silent=True)
        for node in xpath_tree.evaluate(self._path(row), xpath_tree.Context(doc)):
            yield tuple(xpath_tree.string(xpath_tree.evaluate(self._path(p), xpath_tree.Context(node))) for p in columns.values())


def register(spark: SparkSession) -> None:
    """Makes the table functions known to the session's SQL."""
    for name, made in (("tree_nodes", TreeNodes), ("brace_tokens", BraceTokens), ("grammar_rows", GrammarRows)):
        spark.udtf.register(name, udtf(made))
